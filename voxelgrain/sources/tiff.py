"""TIFF: sizes, voxel sizes and samples of uncompressed and deflated strips, read with numpy, as a Spark source of voxels."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.functions.expressions import entity_file

#: Bytes and struct codes of the field types, and micrometres of a resolution unit.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
UNIT_UM = {2: 25400.0, 3: 10000.0}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, COUNTS, X_RES, Y_RES, UNIT, PREDICTOR, FORMAT = 256, 257, 258, 259, 270, 273, 279, 282, 283, 296, 317, 339


@dataclass
class Page:
    tags: dict[int, tuple]
    order: str


def pages(data: bytes) -> list[Page]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, out = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind not in FIELDS:
                continue
            size, code = FIELDS[kind]
            where = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            tags[tag] = (data[where : where + count],) if code == "s" else struct.unpack_from(order + code * count, data, where)
        out.append(Page(tags, order))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return out


def _plane(data: bytes, page: Page) -> np.ndarray:
    t = page.tags
    bits, kind = t.get(BITS, (8,))[0], t.get(FORMAT, (1,))[0]
    dtype = np.dtype(page.order + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    parts = [data[o : o + c] for o, c in zip(t[OFFSETS], t[COUNTS], strict=True)]
    how = t.get(COMPRESSION, (1,))[0]
    if how in (8, 32946):
        parts = [zlib.decompress(p) for p in parts]
    elif how != 1:
        raise ValueError(f"compression {how} is not supported")
    plane = np.frombuffer(b"".join(parts), dtype).reshape(t[HEIGHT][0], t[WIDTH][0])
    return np.cumsum(plane, axis=1, dtype=dtype) if t.get(PREDICTOR, (1,))[0] == 2 else plane


def _settings(page: Page) -> dict[str, str]:
    """The ``name=value`` lines of the description that ImageJ writes."""
    text = (page.tags.get(DESCRIPTION) or (b"",))[0].split(b"\0")[0].decode("utf-8", "replace")
    return dict(line.split("=", 1) for line in text.splitlines() if "=" in line) if text.startswith("ImageJ") else {}


def read_volume(data: bytes) -> np.ndarray:
    """A plane, or a stack of equal planes; nothing else."""
    found = pages(data)
    planes = [_plane(data, p) for p in found]
    more = int(_settings(found[0]).get("images", 1))
    if len(planes) == 1 and more > 1:
        page, size = found[0], planes[0].nbytes
        start = page.tags[OFFSETS][0]
        planes = [np.frombuffer(data, planes[0].dtype, planes[0].size, start + k * size).reshape(planes[0].shape) for k in range(more)]
    if len({p.shape for p in planes}) != 1:
        raise ValueError("the planes differ in size")
    return planes[0] if len(planes) == 1 else np.stack(planes)


def header(data: bytes) -> tuple[tuple[int, ...], str]:
    """Shape and type of a plane or a stack, from the tags alone."""
    found = pages(data)
    sizes = {(p.tags[HEIGHT][0], p.tags[WIDTH][0]) for p in found}
    if len(sizes) != 1:
        raise ValueError("the planes differ in size")
    tags = found[0].tags
    kind = {1: "uint", 2: "int", 3: "float"}[tags.get(FORMAT, (1,))[0]] + str(tags.get(BITS, (8,))[0])
    n = len(found) if len(found) > 1 else int(_settings(found[0]).get("images", 1))
    (plane,) = sizes
    return (plane if n == 1 else (n, *plane)), kind


def voxel_size(data: bytes, ndim: int = 3) -> tuple[float, ...]:
    """Micrometres along each axis in array order; raises if one isn't given."""
    page = pages(data)[0]
    scale = UNIT_UM.get(page.tags.get(UNIT, (1,))[0], 1.0)
    both = X_RES in page.tags and Y_RES in page.tags
    sizes = [scale * den / num if both and num else None for num, den in (page.tags.get(r, (0, 1))[:2] for r in (Y_RES, X_RES))]
    spacing = _settings(page).get("spacing")
    found = [float(spacing) if spacing else None, *sizes][-ndim:]
    if any(s is None for s in found):
        raise ValueError("the source doesn't tell its voxel size")
    return tuple(found)


def write_volume(volume: np.ndarray, spacing: float | None = None, resolution: tuple[int, int] | None = None) -> bytes:
    """A small uncompressed TIFF, for fixtures and exports."""
    planes = volume if volume.ndim == 3 else volume[None]
    planes = np.ascontiguousarray(planes.astype(planes.dtype.newbyteorder("<")))
    kind = {"u": 1, "i": 2, "f": 3, "b": 1}[planes.dtype.kind]
    text = b"ImageJ=1.0\n" + (f"spacing={spacing}\n".encode() if spacing else b"") + b"\0"
    body, offsets = b"II*\0\0\0\0\0", []
    extra = len(body)
    body += text + struct.pack("<II", *(resolution or (1, 1)))
    for p in planes:
        offsets.append(len(body))
        body += p.tobytes()
    body += b"\0" * (len(body) % 2)
    link = 4
    for o in offsets:
        entries = [(WIDTH, 4, 1, planes.shape[2]), (HEIGHT, 4, 1, planes.shape[1]), (BITS, 3, 1, planes.itemsize * 8), (COMPRESSION, 3, 1, 1), (DESCRIPTION, 2, len(text), extra), (OFFSETS, 4, 1, o), (COUNTS, 4, 1, planes[0].nbytes)]
        if resolution:
            entries += [(X_RES, 5, 1, extra + len(text)), (Y_RES, 5, 1, extra + len(text)), (UNIT, 3, 1, 3)]
        entries.append((FORMAT, 3, 1, kind))
        body = body[:link] + struct.pack("<I", len(body)) + body[link + 4 :]
        link = len(body) + 2 + 12 * len(entries)
        body += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return body


def check_labels(volume: np.ndarray) -> np.ndarray:
    """Whole, non-negative labels in the narrowest unsigned type that holds them; anything else is refused."""
    if volume.dtype.kind == "f" and not (np.isfinite(volume).all() and (volume == np.floor(volume)).all()):
        raise ValueError("labels must be whole numbers")
    if volume.size and volume.min() < 0:
        raise ValueError("labels must not be negative")
    most = int(volume.max()) if volume.size else 0
    return volume.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def voxels(spark: SparkSession, root: str) -> DataFrame:
    """``object_id, entity, kind, label, z, y, x`` of all label and mask files below ``root``: foreground only, one file a record.

    The object's id is its folder's path below ``root``, so that equal folder names in two groups stay apart. A file
    that can't be read gives one row with an ``error``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(root)
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    rows = files.select(F.col("path"), F.col("content"), entity_file(stem).alias("e")).where("e is not null").select("path", "content", "e.name", "e.kind")

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, name, kind in batch.itertuples(index=False):
                try:
                    volume = check_labels(read_volume(bytes(content)))
                    at = np.argwhere(volume if volume.ndim == 3 else volume[None])
                    label = (volume if volume.ndim == 3 else volume[None])[tuple(at.T)].astype("int64")
                    yield pd.DataFrame({"folder": path.rsplit("/", 1)[0], "entity": name, "kind": kind, "label": label, "z": at[:, 0].astype("int32"), "y": at[:, 1].astype("int32"), "x": at[:, 2].astype("int32"), "error": None})
                except (ValueError, struct.error, zlib.error, KeyError) as e:
                    yield pd.DataFrame({"folder": [path.rsplit("/", 1)[0]], "entity": [name], "kind": [kind], "label": [0], "z": [0], "y": [0], "x": [0], "error": [str(e)]})

    found = rows.mapInPandas(read, "folder string, entity string, kind string, label long, z int, y int, x int, error string")
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    return found.withColumn("object_id", F.regexp_replace("folder", f"^.*?{base}/?", "")).drop("folder")
