"""Fields that grow: new files of values as a stream. An extension; batch operators work on the stored field.

Every micro-batch replaces the times that it brings, so a batch that is run again after a failure
leaves the same store. Means by year are a windowed aggregate with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lowrank import fit
from ..operators.masks import to_series
from ..schema import FIELD

ARRIVING = f"{FIELD}, ts timestamp"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The stream of Parquet files under path. NaN becomes null."""
    rows = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("sla", F.nanvl("sla", F.lit(None).cast("double")))


def keep(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Store the stream by time, once for what there is. A time that comes again takes the place of the former."""

    def put(batch: DataFrame, _: int) -> None:
        latest = batch.dropDuplicates(["cell_id", "t"])
        latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t").parquet(store)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def yearly_means(stream: DataFrame, late: str = "90 days", width: str = "365 days") -> DataFrame:
    """window, n, mean of values over time windows; values later than `late` behind the newest are left out."""
    seen = stream.withWatermark("ts", late).where("sla is not null")
    return seen.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.avg("sla").alias("mean"))


def refit(spark: SparkSession, store: str, labels: DataFrame, m: int) -> DataFrame:
    """Subspaces of the clusters over all that is stored."""
    field = spark.read.parquet(store).select("cell_id", "lat_idx", "lon_idx", F.col("t").cast("int").alias("t"), "latitude", "longitude", "sla")
    return fit(to_series(field).join(labels.select("cell_id", "cluster_id"), "cell_id"), m)
