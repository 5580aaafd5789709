"""The log of runs and the health rows of their sources, as snapshots to which rows are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import health
from tidewater.schemas import RUN_LOG, SOURCE_RUN

COUNTS = ("total_articles", "new_articles", "keyword_passed", "ai_confirmed", "pushed")
#: Statuses of a source that count as an error (fixed values).
ERROR_STATUSES = ("failed", "partial", "anomaly")


def has_error(status: Column) -> Column:
    return status.isin(*ERROR_STATUSES)


def _row(log: DataFrame, values: dict[str, Column]) -> DataFrame:
    one = log.sparkSession.range(1)
    return one.select([F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) if not isinstance(values.get(f.name), Column) else values[f.name].cast(f.dataType).alias(f.name) for f in log.schema])


def next_id(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1


def start_run(log: DataFrame, now: Column) -> tuple[DataFrame, int]:
    """The log with a running row, and its id."""
    run = next_id(log)
    return log.unionByName(_row(log, {"id": F.lit(run), "run_time": now, "status": F.lit("running")})), run


def finish_run(log: DataFrame, run: int, status: str, now: Column, counts: dict[str, int] | None = None, errors: list[str] = (), seconds: float | None = None) -> DataFrame:
    """The log with the row closed; counts that aren't given are 0, and no errors are null."""
    closing = {c: F.lit((counts or {}).get(c, 0)) for c in COUNTS} | {
        "status": F.lit(status), "finished_at": now, "duration_seconds": F.lit(seconds).cast("double"), "errors": F.array(*[F.lit(e) for e in errors]) if errors else F.lit(None),
    }
    return log.select([F.when(F.col("id") == run, closing[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in closing else F.col(f.name) for f in log.schema])


def insert_run(log: DataFrame, now: Column, counts: dict[str, int], errors: list[str] = ()) -> DataFrame:
    """A run that is opened and closed at once."""
    opened, run = start_run(log, now)
    return finish_run(opened, run, "completed_with_errors" if errors else "completed", now, counts, errors)


def record_sources(log: DataFrame, run: int, states: DataFrame, now: Column) -> DataFrame:
    """The health log with one row for each source of a run.

    `states`: source, source_type, status, article_count, and optional raw_count
    (results before accounts are matched), new_count, duration_seconds, detail_success, detail_failed, error. An empty success of a
    source that is used to have rows is recorded as an anomaly.
    """
    first = next_id(log)
    history = health.baseline(log)
    rows = states.join(history, "source", "left")
    raw = F.col("raw_count" if "raw_count" in states.columns else "article_count")
    recorded = health.recorded_status(F.col("source_type"), F.col("status"), raw, F.col("article_count"), F.coalesce("baseline", F.lit(0)))
    rows = rows.withColumn("status", recorded).withColumn("run_id", F.lit(run)).withColumn("created_at", now)
    # sources are configured by hand, so few
    rows = rows.withColumn("id", F.lit(first) + F.size(F.filter(_names(states), lambda n: n < F.col("source"))))
    zero = {"new_count": 0, "detail_success": 0, "detail_failed": 0}
    value = lambda f: F.coalesce(F.col(f.name), F.lit(zero.get(f.name))) if f.name in rows.columns else F.lit(zero.get(f.name))
    return log.unionByName(rows.select([F.nullif(value(f), F.lit("")).alias(f.name) if f.name == "error" else value(f).cast(f.dataType).alias(f.name) for f in log.schema]))


def _names(states: DataFrame) -> Column:
    return F.array(*[F.lit(r[0]) for r in states.select("source").distinct().orderBy("source").collect()]).cast("array<string>")


def empty_logs(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], RUN_LOG), spark.createDataFrame([], SOURCE_RUN)
