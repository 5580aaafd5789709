"""Micro-batch pipeline: new notices are screened and deduplicated against the stored snapshot.

The stream runs to the end of what has arrived (`availableNow`), as the schedule
does. Dedup compares with kept rows by two keys, which no single state key can
express, so each micro-batch joins the stored snapshot; batches are deduplicated
in themselves first. Writing a batch twice gives the same files: a batch's rows
live in a folder of its own number, which is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.dedup import anti_window, keep_disjunctive

KEYS = ["id", "canonical_url", "normalized_title", "source", "created_at"]


def run_available(spark: SparkSession, arrivals: str, schema: str, store: str, checkpoint: str, cut: Callable[[DataFrame], DataFrame], screen: Callable[[DataFrame], DataFrame] = lambda df: df, days: int = 90) -> StreamingQuery:
    """Process all arrived Parquet files; kept rows are in `store`/batch=<number>."""

    def one(batch: DataFrame, number: int) -> None:
        fresh = screen(batch)
        before = _stored(spark, store, fresh, number)
        if before is not None:
            fresh = anti_window(fresh, before, days)
        kept = keep_disjunctive(fresh, cut, days).where("kept").drop("kept")
        kept.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(arrivals)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, store: str, like: DataFrame, number: int) -> DataFrame | None:
    """Rows of the batches before this one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in like.schema.fields)}, batch long").parquet(store).where(F.col("batch") < number).select(KEYS)


def windowed_health(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Failures and runs of each source by time window; late rows beyond the watermark are left out."""
    rows = events.withColumn("run_time", F.col("run_time").cast("timestamp")).withWatermark("run_time", late)
    return rows.groupBy(F.window("run_time", f"{minutes} minutes"), "source").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"))
