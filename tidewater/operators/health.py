"""Source and schedule health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILING = ("failed", "partial")


def baseline(runs: DataFrame, last: int = 5) -> DataFrame:
    """Upper median of the article counts of a source's last successful runs: source, baseline (0 without any)."""
    good = runs.where((F.col("status") == "success") & (F.col("article_count") > 0))
    recent = good.withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("id")))).where(F.col("__n") <= last)
    listed = recent.groupBy("source").agg(F.array_sort(F.collect_list("article_count")).alias("v"))
    median = listed.select("source", F.get("v", F.expr("int(size(v) div 2)")).alias("baseline"))
    return runs.select("source").distinct().join(median, "source", "left").select("source", F.coalesce("baseline", F.lit(0)).alias("baseline"))


def failure_streak(runs: DataFrame, look_back: int = 20) -> DataFrame:
    """Leading failures among a source's last runs: source, streak."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("id")))
    recent = runs.withColumn("__n", n).where(F.col("__n") <= look_back)
    first_good = F.min(F.when(~F.col("status").isin(*FAILING), F.col("__n")))
    return recent.groupBy("source").agg((F.coalesce(first_good, F.count("*") + 1) - 1).alias("streak"))


def recorded_status(kind: Column, status: Column, raw: Column, matched: Column, base: Column) -> Column:
    """A chat source with results but no match is no_match; an empty source that used to deliver is an anomaly."""
    return F.when((kind == "wechat") & (raw > 0) & (matched == 0), "no_match").when((status == "empty") & (base > 0), "anomaly").otherwise(status)


def missed_windows(schedule: DataFrame, runs: DataFrame, now: Column, grace_minutes: int = 90, early_minutes: int = 15) -> DataFrame:
    """Schedule rows (key, scheduled_at) whose time and grace have passed without a finished run.

    The schedule is a handful of rows a day; the join on the day keeps it an
    equi-join, so neither side needs to be small.
    """
    due = schedule.where(now >= F.col("scheduled_at") + F.expr(f"interval {grace_minutes} minutes"))
    due = due.withColumn("low", F.col("scheduled_at") - F.expr(f"interval {early_minutes} minutes")).withColumn("high", F.col("scheduled_at") + F.expr(f"interval {grace_minutes} minutes"))
    done = runs.where(F.col("status").isin("completed", "completed_with_errors")).select("run_time", F.to_date("run_time").alias("day"))
    spread = due.withColumn("day", F.explode(F.array_distinct(F.array(F.to_date("low"), F.to_date("high")))))
    met = spread.join(done, (spread["day"] == done["day"]) & F.col("run_time").between(F.col("low"), F.col("high")), "left_semi").select("key")
    return due.join(met, "key", "left_anti").select(schedule.columns)


def new_alerts(missing: DataFrame, alerted: DataFrame) -> DataFrame:
    """Keys to alert now."""
    return missing.join(alerted, "key", "left_anti")


def remembered_alerts(missing: DataFrame, alerted: DataFrame) -> DataFrame:
    """Keys whose alert is still current."""
    return alerted.join(missing, "key", "left_semi")


def run_summary(batches: DataFrame) -> DataFrame:
    """Totals and status of one run over its source batches (status, articles)."""
    bad = F.count_if(F.col("status").isin("failed", "partial"))
    failed = F.count_if(F.col("status") == "failed")
    status = F.when(F.count("*") == 0, "completed").when(failed == F.count("*"), "failed").when(bad > 0, "completed_with_errors").otherwise("completed")
    return batches.agg(F.coalesce(F.sum("articles"), F.lit(0)).alias("total"), F.count("*").alias("sources"), bad.alias("with_errors"), status.alias("status"))


def all_failed(batches: DataFrame) -> DataFrame:
    """Whether every source failed, which repeats the whole scan."""
    return batches.agg(F.coalesce(F.bool_and(F.col("status") == "failed"), F.lit(False)).alias("retry"))
