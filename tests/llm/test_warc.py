import gzip
import hashlib
import zlib

import pytest
from pyarrow import fs

from voxelgrain.llm import common
from voxelgrain.llm import warc as w


def pages():
    rows = [(i, f"http://a/{i}", ("x" if i % 3 else "é") * (i * 7 % 400)) for i in range(200)]
    rows += [(500 + i, "http://copy", "shared payload " * 20) for i in range(60)] + [(700, None, None), (701, "u\r\nWARC/1.1", ""), (702, "", "WARC/1.1\r\n\r\n" * 40)]
    rows += [(None, "n", "shared payload " * 20), (703, "z", "\x00\r\n\r\n" * 100), (704, "big", "0123456789" * 300000), (500, "again", "other"), (705, "s", "short"), (706, "s", "short")]
    rows += [(90_001 + k // 2, "tied", "the same body twice " * 9) for k in range(4)]
    return rows


def expected(rows):
    first = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    for i, _, t in rows:
        b = (t or "").encode()
        again = len(b) >= 100 and first.get(b, i) != i
        yield i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = w.round_trip(df)
    out = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr)
    assert out == sorted(expected(rows), key=repr)
    assert w.round_trip(df.limit(0)).count() == 0


def test_members_and_index(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = common.scratch(spark, "warc-test")
    archives = w.write(w.with_types(df), folder)
    files = w.normalise(archives, folder)
    index = w.index(files, folder)
    assert {r.file: r.records for r in files.collect()} == {r.file: r["count"] for r in index.groupBy("file").count().collect()}
    store, base = w._open(folder)
    for (file,) in index.select("file").distinct().collect():
        data = store.open_input_file(f"{base}/{file}").read()
        lines = store.open_input_file(f"{base}/{file}.idx").read().decode().splitlines()
        at = 0
        for line in lines:
            offset, length = map(int, line.split("\t")[:2])
            assert offset == at and gzip.decompress(data[offset : offset + length]).startswith(w.VERSION)
            at += length
        assert at == len(data)
    bodies = {(r.page_id, r.payload_digest): bytes(r.payload) for r in w.read(index, folder, payloads=True).where("record_type = 'response'").collect()}
    assert all(hashlib.sha256(b).hexdigest() == d for (_, d), b in bodies.items())
    assert bodies[704, hashlib.sha256(("0123456789" * 300000).encode()).hexdigest()] == b"0123456789" * 300000


def test_a_lost_sidecar_line_shows(spark):
    folder = common.scratch(spark, "warc-cut")
    files = w.normalise(w.write(w.with_types(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1)), folder), folder)
    store, base = w._open(folder)
    (name,) = [r.file for r in files.collect()]
    lines = store.open_input_file(f"{base}/{name}.idx").read().splitlines(keepends=True)
    with store.open_output_stream(f"{base}/{name}.idx") as out:
        out.write(lines[0])
    with pytest.raises(Exception, match="sidecar"):
        w.index(files, folder).collect()


def test_broken_streams():
    good = gzip.compress(w._record(1, "u", b"abc", "d", "response", None))
    pieces = lambda data: list(w._records(w._inflated(fs.LocalFileSystem and __import__("io").BytesIO(data))))
    assert len(pieces(good + good + b"\0" * 9)) == 2
    with pytest.raises((ValueError, zlib.error)):
        pieces(good[:-20])
    with pytest.raises(ValueError):
        pieces(gzip.compress(b"junk\r\n\r\nmore"))
