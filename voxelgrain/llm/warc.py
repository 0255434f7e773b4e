"""WARC archives: writing, normalising monolithic gzip files, and reading back by an offset index.

``write`` lays pages out as WARC 1.1 records, a gzip stream over the whole of each file, as crawlers that don't
know the format's rules do. ``normalise`` is the operator proper: it inflates each such stream once, from front to
back and a piece at a time, finds the records, writes every record as a gzip member of its own and a sidecar index
(offset, length, kind, identifiers, digest) beside the file. ``index`` reads the sidecars, and ``read`` takes records from their offsets alone,
checks their digest and yields one row a record.

Of records with equal payloads of ``LEAST_SHARED`` bytes or more the one with the smallest page id is a response;
the others are revisits, which name it and hold no payload. Finding the first of equal payloads is a grouped
minimum over digests (combined before the shuffle), joined back on the digest.

Files live in the shared folder of the session and are opened with ``pyarrow.fs``, by the folder's URI. A file is
written under a name of its own by every task attempt, and only attempts that end are listed in the index table,
so a lost executor or a repeated task leaves nothing that a reader would see. Null payloads are empty ones; rows whose page id is
repeated get a record each, and those that share the smallest id and the payload are all responses. Very long payloads
are inflated a piece at a time, but one record must fit a worker. An empty table gives an empty result. Other columns
aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import scratch, written

LEAST_SHARED = 100
#: Bytes that are inflated or copied at once.
PIECE = 1 << 20
VERSION = b"WARC/1.1"
HEAD_END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names for a store that Arrow calls s3 are understood."""
    path = re.sub("^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def with_types(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, ``record_type`` and ``refers_to`` of every page."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    hashed = pages.select(F.col(key).alias("page_id"), F.col("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    shared = F.octet_length("payload") >= LEAST_SHARED
    first = hashed.where(shared).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    # Payloads that nobody shares need no partner, so the join's small side is the shared ones alone.
    first = written(first.where("times > 1").select(F.col("digest").alias("of"), "first"), "firsts")
    joined = hashed.join(first, shared & (F.col("digest") == F.col("of")), "left")
    again = F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(True))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, first: int | None) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    target = re.sub(r"[\r\n]", " ", url or "")
    head += [f"WARC-Target-URI: {target}"] * bool(target)
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + HEAD_END + payload + b"\r\n\r\n"


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records as one-stream gzip files, one a partition, and returns a row a file: ``file``, ``records``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, gz, n, name = None, None, 0, f"mono-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store, base = _open(folder)
                    store.create_dir(base, recursive=True)
                    out, gz = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(gz.compress(_record(*row)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return written(records.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, "file string, records bigint"), "archives")


def _inflated(stream) -> Iterator[bytes]:
    """The stream's bytes, inflated once from front to back; further members and zero padding are accepted."""
    gz = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            if gz.eof:
                data = data.lstrip(b"\0")
                if not data:
                    break
                gz = zlib.decompressobj(31)
            yield gz.decompress(data, PIECE)
            data = gz.unconsumed_tail or gz.unused_data
    while not gz.eof:
        piece = gz.flush()
        if not piece:
            raise ValueError("the gzip stream ends early")
        yield piece


def _records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields (names in lower case), header block and payload of each record."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(HEAD_END)) < 0:
            if not more():
                if held.strip(b"\r\n"):
                    raise ValueError("a record's header ends early")
                return
        begin = len(held) - len(held.lstrip(b"\r\n"))
        if begin:
            del held[:begin]
            continue
        head = bytes(held[:end])
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("a record's payload ends early")
        yield fields, head, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


INDEX = "file string, offset bigint, length bigint, record_type string, record_id string, digest string"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each file of ``archives`` with a gzip member for every record, beside a sidecar ``.idx``. Returns a row a file: ``file``, ``records``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, base = _open(folder)
                name, at, rows = f"rec-{uuid.uuid4().hex}.warc.gz", 0, []
                with store.open_input_stream(f"{base}/{file}", compression=None) as source, store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    for fields, head, payload in _records(_inflated(source)):
                        gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = gz.compress(head + HEAD_END + payload + b"\r\n\r\n") + gz.flush()
                        out.write(member)
                        rows.append((name, at, len(member), fields["warc-type"], fields["warc-record-id"], fields["warc-payload-digest"]))
                        at += len(member)
                with store.open_output_stream(f"{base}/{name}.idx") as out:
                    out.write("".join("\t".join(map(str, r[1:])) + "\n" for r in rows).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64())], ["file", "records"])

    # A task for each file, as they are about as large as the partitions they come from.
    spread = archives.select("file").repartition(max(1, archives.count()), "file")
    return written(spread.mapInArrow(run, "file string, records bigint"), "normalised")


def index(files: DataFrame, folder: str) -> DataFrame:
    """The rows of the files' sidecars, a row a record; a sidecar of another length than its file's records is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{base}/{name}.idx", compression=None) as source:
                    lines = [x.split("\t") for x in source.read().decode().splitlines()]
                if len(lines) != records:
                    raise ValueError(f"the sidecar of {name} has {len(lines)} records of {records}")
                rows = [(name, int(x[0]), int(x[1]), *x[2:]) for x in lines]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    spread = files.select("file", "records").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(run, INDEX)


ROWS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of ``index``, read from its offset; with the ``payload`` itself if asked for."""
    schema = ROWS + (", payload binary" if payloads else "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        file, source = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != file:
                    file, source = name, store.open_input_file(f"{base}/{name}")
                source.seek(offset)
                fields, _, payload = next(_records([zlib.decompress(source.read(length), 31)]))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload at {offset} of {name} doesn't have its digest")
                size = len(payload) if fields["warc-type"] == "response" else int(fields["x-payload-length"])
                rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], _page(fields.get("warc-refers-to")), size, digest, payload)[: len(names)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return index.select("file", "offset", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Writes ``pages``, normalises the archives, and returns what reading them back gives."""
    folder = scratch(pages.sparkSession, "warc")
    files = normalise(write(with_types(pages, key, payload), folder), folder)
    return read(index(files, folder), folder)


def sql() -> str:
    """DuckDB SQL for the pages' records."""
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id <> first THEN first END AS refers_to FROM f"""
