"""Command line: ``dry-run``, ``process`` and ``colours``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxelgrain.operators.geometry import entity_filter
from voxelgrain.plans import process
from voxelgrain.sources import folders, report_files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voxelgrain")
    commands = parser.add_subparsers(dest="command", required=True)
    dry = commands.add_parser("dry-run", help="what is found below a folder, without opening an image")
    run = commands.add_parser("process", help="measure all objects below a folder")
    recolour = commands.add_parser("colours", help="replace a report's colours")
    for p in (dry, run):
        p.add_argument("root")
        p.add_argument("--object-mask")
    run.add_argument("--out", required=True)
    run.add_argument("--voxel-size", type=lambda s: tuple(map(float, s.split(","))), help="z,y,x or y,x in micrometres; else what the images say")
    run.add_argument("--gap", type=float, default=0.5)
    run.add_argument("--group", action="append", default=[], help="a folder below the root that is one condition")
    run.add_argument("--palette")
    run.add_argument("--skeletons", help="entities that get skeletons, with commas between them; else all")
    run.add_argument("--no-skeletons", action="store_true")
    run.add_argument("--no-clip", action="store_true")
    run.add_argument("--no-promote", action="store_true")
    run.add_argument("--resume", action="store_true")
    run.add_argument("--geometry", action="store_true")
    recolour.add_argument("report")
    recolour.add_argument("palette")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("voxelgrain").getOrCreate()
    if args.command == "dry-run":
        rows = folders.objects(folders.discover(folders.listing(spark, args.root)), args.object_mask)
        folders.dry_run(rows).orderBy("key").show(1000, False)
        bad = rows.where("error is not null").select("folder", "error")
        bad.show(1000, False)
        return int(bad.count() > 0)
    if args.command == "process":
        if args.object_mask is None:
            parser.error("--object-mask is needed")
        palette = report_files.read_palette(spark, args.palette) if args.palette else {}
        settings = process.Settings(gap_um=args.gap, skeleton_entities=entity_filter(args.skeletons, args.no_skeletons), groups=tuple(args.group), palette=palette)
        failures = process.run(spark, args.root, args.out, args.object_mask, args.voxel_size, settings, not args.no_clip, not args.no_promote, args.resume, args.geometry)
        failures.show(1000, False)
        return int(failures.count() > 0)
    rows, facts = report_files.read_report(spark, args.report)
    found, n = report_files.recolour(rows, report_files.read_palette(spark, args.palette))
    report_files.replace_report(found, args.report, facts)
    print(f"{n} rows have a colour")
    return 0


if __name__ == "__main__":
    sys.exit(main())
