"""What the operators of this subpackage share: table reading, words, and cutting lineage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (code points 32 and 9 to 13).
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression for Spark, DuckDB and Python alike.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_noted: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("noted", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by Spark's own reader, from wherever Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where none is named, a local session gets a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="voxelgrain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/voxelgrain/{name}-{uuid.uuid4().hex}"
    for paths in _noted.get():
        paths.append(path)
    return path


@contextlib.contextmanager
def noting() -> Iterator[list[str]]:
    """Notes the paths in the shared folder that are given out meanwhile."""
    paths: list[str] = []
    token = _noted.set((*_noted.get(), paths))
    try:
        yield paths
    finally:
        _noted.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes what lies at ``paths``, by Spark's own file system; what is gone already is no error."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files behind when it ends, rather than when the driver happens to collect garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts lineage: ``df`` as a Parquet table in the shared folder, which outlives any executor. ``discard`` deletes it.
    ``options`` are those of Parquet's writer."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with shuffles_removed(spark):
        df.write.options(**options or {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, when nothing is still to be computed from them."""
    for t in tables:
        remove(t.sparkSession, [t.scratch_path])


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker calls ``forget`` and gives free memory back: idle workers stay for a while, beside other stages' tasks."""

    def run_lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            give_back()

    return run_lean


def give_back() -> None:
    """Returns to the system what this process's allocators hold and nothing uses; where the C library has no such call, what Arrow holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, base: str) -> str:
    """A name that no column of ``df`` begins with, for columns that come and go inside an operator."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(base) for c in names):
        base = f"_{base}"
    return base


def words(text: Column) -> Column:
    """The maximal runs of characters other than ``SPACES``, in order; none for null or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, SPACE_RUN))
