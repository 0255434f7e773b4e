"""Objects that arrive while a job runs: voxel files are measured as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxelgrain.operators.measure import INSTANCE, Size, extent
from voxelgrain.sources.report_files import write_parts

VOXELS = "object_id string, entity string, label long, z int, y int, x int"


def measure_arrivals(spark: SparkSession, source: str, parts: str, checkpoint: str, size: Size) -> StreamingQuery:
    """Measures every new Parquet file of voxels once and adds its instances to ``parts``.

    A file holds whole objects, as the loaders write them, so an arrival needs no state and no watermark.
    """

    def one(batch: DataFrame, _: int) -> None:
        write_parts(extent(batch, INSTANCE, size), parts)

    stream = spark.readStream.schema(VOXELS).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
