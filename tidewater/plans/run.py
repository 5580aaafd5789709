"""A whole monitoring run: scan, store, enrich, screen, judge, deliver, alert, and its log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import health, state
from tidewater.plans import config as settings
from tidewater.plans import monitor, runs
from tidewater.sources import files, sinks
from tidewater.sources.scan import run_sources, scan_with_retry
from tidewater.storage import cut

Scan = Callable[[], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Tables:
    """Snapshots of the stored tables."""

    articles: DataFrame
    extractions: DataFrame
    run_log: DataFrame
    source_runs: DataFrame


@dataclass(frozen=True)
class Outside:
    """What a run calls: the model (prompt to reply), the sender (text to an error or null), pages of short notices, and a clock to wait by."""

    model: Callable[[str], str]
    send: Callable[[str], str | None]
    pages: Callable[[DataFrame], DataFrame] | None = None
    sleep: Callable[[float], None] = time.sleep


class RunFailed(Exception):
    """A run that broke off; `tables` are those to store, with the failed row in the log."""

    def __init__(self, tables: Tables, cause: Exception):
        super().__init__(f"{type(cause).__name__}: {cause}")
        self.tables = tables


def select_sources(config: dict, scans: dict[str, Scan], selector: str | None) -> dict[str, Scan]:
    """The scans that a selector (a name, a kind, or kind:name) names; it must name one."""
    kinds = {n: k for n, k, _, _ in settings.source_rows(config)}
    if not selector:
        return scans
    chosen = {n: s for n, s in scans.items() if selector in (n, k := kinds.get(n, "website"), f"{k}:{n}")}
    if not chosen:
        raise settings.ConfigError([f"no enabled source is called {selector}"])
    return chosen


def scan_all(spark: SparkSession, config: dict, scans: dict[str, Scan], sleep: Callable[[float], None], selective: bool) -> tuple[dict[str, DataFrame], DataFrame, int]:
    """Rows by source, states of all, and how often everything had to be scanned again."""
    last: list = []

    def once() -> list[str]:
        last[:] = run_sources(scans, spark)
        return [r.status for r in last[1].select("status").collect()]  # one row for each configured source

    delays = tuple(60.0 * m for m in settings.get(config, "health.all_failed_retry_delays_minutes"))
    again = scan_with_retry(once, sleep, delays, selective)
    return last[0], last[1], again


def discovered(found: dict[str, DataFrame]) -> DataFrame | None:
    """Rows of all sources in the order of the sources, to be stored in one go."""
    parts = [rows.withColumn("source", F.lit(name)).withColumn("seq", F.lit(i)) for i, (name, rows) in enumerate(found.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def run_pipeline(
    spark: SparkSession, config: dict, tables: Tables, scans: dict[str, Scan], outside: Outside, now: Column, today: Column, year: int,
    dry_run: bool = False, source: str | None = None, metrics_path: str | None = None, write: Callable[[DataFrame], DataFrame] = cut,
) -> tuple[Tables, dict]:
    """One run over all sources, or those that `source` selects: the new tables and a summary.

    `scans` gives for each source its rows (title, url, publish_date, summary,
    raw_content) and its status row. A source that fails is recorded and the others
    go on; if all fail, all are scanned again after the configured delays. New rows
    of all sources are added in one write and stored ones stay where they are; the
    table is written once when notices are enriched and screened and once at the end. A
    step that fails closes the log as failed and raises RunFailed, whose tables are the
    last that were written. A dry run scans, enriches, screens and judges, but sends
    nothing and alerts nobody.
    """
    began = time.monotonic()
    log, number = runs.start_run(tables.run_log, now)
    done = replace(tables, run_log=write(log))
    setting = lambda path: settings.get(config, path)
    counts = dict.fromkeys(runs.COUNTS, 0)
    problems: list[str] = []
    try:
        chosen = select_sources(config, scans, source)
        found, states, again = scan_all(spark, config, chosen, outside.sleep, bool(source))
        states = write(states)
        rows, articles = discovered(found), done.articles
        fresh = write(state.fresh_rows(articles, rows, now, setting("storage.dedup_days"))) if rows is not None else articles.limit(0)
        articles = articles.unionByName(fresh)
        done = replace(done, articles=articles)
        new = {r.source: r.n for r in fresh.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row for each source
        counts |= {"total_articles": states.agg(F.coalesce(F.sum("articles"), F.lit(0))).first()[0], "new_articles": sum(new.values())}

        details = None
        if outside.pages is not None and setting("crawler.detail.enabled"):
            articles, details = enriched(articles, outside.pages, now, write, setting("crawler.detail.min_existing_length"))
        articles = write(monitor.screen(articles, setting("filter.keywords") or [], setting("filter.exclude_keywords"), today, now))
        done = replace(done, articles=articles)
        counts["keyword_passed"] = articles.where((F.col("status") == "ai_pending") & (F.col("updated_at") == now)).count()

        recorded = recorded_states(spark, config, states, new, details)
        done = replace(done, source_runs=write(runs.record_sources(done.source_runs, number, recorded, now)))
        mine = done.source_runs.where(F.col("run_id") == number)
        told = {r.source: r for r in recorded.select("source", "error").collect()}
        for r in mine.where(runs.has_error(F.col("status"))).orderBy("id").collect():  # at most the configured sources
            problems.append(f"{r.source}: {told[r.source].error or r.status}")
        if again and states.where("status <> 'failed'").isEmpty():
            problems.append(f"all sources failed, also after {again} more scans")
        if metrics_path:
            files.append_metrics(source_metrics(states, mine, now), metrics_path)

        articles, extractions = monitor.judge(articles, done.extractions, outside.model, year, now, write, setting("filter.ai.max_workers"))
        extractions = write(extractions)
        sources = spark.createDataFrame(settings.source_rows(config), "name string, kind string, tier string, pos int")
        confirmed = monitor.current(articles, "ready_to_push").where(F.col("updated_at") == now).count()
        waiting = monitor.current(articles, "ai_pending").count()
        delay = setting("notification.aggregator_delay_hours")
        articles = write(monitor.push(articles, extractions, sources, outside.send, now, write, delay, dry_run=dry_run))
        done = replace(done, articles=articles, extractions=extractions)
        sent, failed = articles.agg(F.count_if((F.col("status") == "pushed") & (F.col("pushed_at") == now)), F.count_if(F.col("status") == "push_failed")).first()
        counts |= {"ai_confirmed": confirmed, "pushed": sent}
        problems += [f"{waiting} notices wait for the model"] * bool(waiting) + [f"{failed} notices wait to be sent"] * bool(failed)
        alerts = [] if dry_run else [a for a in run_alerts(done.source_runs, states, setting("health.failure_alert_threshold")) if sinks.alert(a, outside.send, outside.sleep) is None]
        status = "completed_with_errors" if problems else "completed"
        log = runs.finish_run(done.run_log, number, status, now, counts, problems, time.monotonic() - began)
        return replace(done, run_log=write(log)), {"run": number, "status": status, "errors": problems, "alerts": alerts, **counts}
    except Exception as e:
        log = runs.finish_run(done.run_log, number, "failed", now, counts, [*problems, f"{type(e).__name__}: {e}"[:500]], time.monotonic() - began)
        raise RunFailed(replace(done, run_log=write(log)), e) from e


def enriched(articles: DataFrame, pages: Callable[[DataFrame], DataFrame], now: Column, write: Callable[[DataFrame], DataFrame], least: int) -> tuple[DataFrame, DataFrame]:
    """Articles with readable text of the pages of short notices, and counts by source."""
    short = monitor.short_notices(articles, least).select("id", "source", "url")
    updates, details = monitor.enrich(articles, write(pages(short)), least=least)
    return state.update_content(articles, write(updates), now), details


def recorded_states(spark: SparkSession, config: dict, states: DataFrame, new: dict[str, int], details: DataFrame | None) -> DataFrame:
    """States of the sources as the health log takes them; all tables here have a row for each source."""
    kinds = spark.createDataFrame([(n, k) for n, k, _, _ in settings.source_rows(config)], "source string, source_type string").dropDuplicates(["source"])
    added = spark.createDataFrame(list(new.items()), "source string, new_count long")
    rows = states.join(added, "source", "left").join(kinds, "source", "left").na.fill({"new_count": 0, "source_type": "website"})
    rows = rows.withColumnsRenamed({"articles": "article_count", "seconds": "duration_seconds"}).withColumn("raw_count", F.coalesce("raw_count", "article_count"))
    return monitor.detail_counts(rows, details) if details is not None else rows


def source_metrics(states: DataFrame, mine: DataFrame, now: Column) -> DataFrame:
    """One row for each source that counted its results: run, source, kind, recorded status and counts."""
    counted = states.where("raw_count is not null").select("source", "raw_count", "matched_count")
    return mine.select("run_id", "source", "source_type", "status").join(counted, "source").withColumn("recorded_at", now.cast("string"))


def run_alerts(source_runs: DataFrame, states: DataFrame, threshold: int) -> list[str]:
    """What a run has to say: that all its sources failed, or which have failed `threshold` times in a row just now."""
    if states.isEmpty():
        return []
    if states.where("status <> 'failed'").isEmpty():
        return ["本次所有信息源抓取失败，请检查日志。"]
    streaks = health.failure_streak(source_runs.join(states.select("source"), "source", "left_semi")).where(F.col("streak") == threshold)
    names = [r.source for r in streaks.orderBy("source").collect()]
    return [f"以下渠道已连续失败{threshold}次：" + "、".join(names)] if names else []
