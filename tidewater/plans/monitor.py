"""One monitoring run over snapshots: screen, judge, merge, deliver.

Each step takes a snapshot and returns the next one; `cut` writes it, so a run
that is broken off goes on from the status its rows have.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.html import readable_column
from tidewater.operators import evaluate, events, filters, health, reply, state
from tidewater.schemas import PIPELINE_VERSION
from tidewater.sources.sinks import deliver

Cut = Callable[[DataFrame], DataFrame]


def current(articles: DataFrame, *statuses: str) -> DataFrame:
    return articles.where(F.col("status").isin(*statuses) & (F.col("pipeline_version") >= PIPELINE_VERSION))


def short_notices(articles: DataFrame, least: int = 120) -> DataFrame:
    """Discovered notices whose text is shorter than `least`."""
    return current(articles, "discovered").where(filters.needs_detail(F.col("raw_content"), F.col("summary"), least))


def enrich(articles: DataFrame, pages: DataFrame, limit: int = 500, least: int = 120) -> tuple[DataFrame, DataFrame]:
    """Readable text for short discovered notices from landed pages (id, html, final_url): updates, and counts by source."""
    short = short_notices(articles, least)
    got = short.select("id", "source").join(pages, "id", "left").withColumn("raw_content", F.when(F.col("html").isNotNull(), readable_column("html")))
    ok = F.coalesce(F.col("raw_content"), F.lit("")) != ""
    counts = got.groupBy("source").agg(F.count_if(ok).alias("detail_success"), F.count_if(~ok).alias("detail_failed"))
    updates = got.where(ok).select("id", F.substring("raw_content", 1, limit).alias("summary"), "raw_content", F.col("final_url").alias("url"))
    return updates, counts


def detail_counts(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Source runs with their detail counts, 0 where there are none."""
    return runs.join(counts, "source", "left").na.fill(0, ["detail_success", "detail_failed"])


def screen(articles: DataFrame, keywords: list[str], excluded: list[str], today: Column, now: Column) -> DataFrame:
    """Discovered notices become ai_pending or keyword_rejected."""
    rows = current(articles, "discovered")
    reason = filters.gate_reason(F.col("title"), F.col("source"), F.col("publish_date"), today)
    hit = filters.keyword_pass(F.col("title"), F.col("summary"), keywords, excluded)
    why = F.when(reason.isNotNull(), F.concat(F.lit("P3标题门禁: "), reason)).when(~hit, F.lit("no keyword"))
    changes = rows.select("id", F.when(why.isNull(), "ai_pending").otherwise("keyword_rejected").alias("status"), why.alias("ai_reason"))
    return state.transition(articles, changes, now)


def judge(articles: DataFrame, extractions: DataFrame, model: Callable[[str], str], year: int, now: Column, cut: Cut, workers: int = 1, name: str = "model", prompt: str = "1") -> tuple[DataFrame, DataFrame]:
    """Pending notices are judged: (articles, extractions). No decision leaves them pending with the error."""
    judged = cut(reply.judge(current(articles, "ai_pending"), model, year, workers))
    to = F.when(F.col("decision"), "ready_to_push").when(~F.col("decision"), "ai_rejected").otherwise("ai_pending")
    undecided = F.col("decision").isNull()
    changes = judged.select("id", to.alias("status"), F.col("reason").alias("ai_reason"), F.when(undecided, F.col("reason")).alias("last_error"), undecided.alias("increment"), (~undecided).alias("clear_error"))
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    new = judged.where("decision is not null").select(
        F.col("id").alias("article_id"), F.col("decision").alias("is_award_application"), blank("award_name"), blank("deadline_text"), blank("deadline_date"), "applicant_scope",
        F.lit(name).alias("model"), F.lit(prompt).alias("prompt_version"), "raw_response", now.alias("created_at"), now.alias("updated_at"),
    )
    both = state.upsert(extractions.withColumn("seq", F.lit(0)), new.withColumn("seq", F.lit(1)), "article_id").drop("seq")
    return state.transition(articles, changes, now), both


def push(articles: DataFrame, extractions: DataFrame, sources: DataFrame, send: Callable[[str], str | None], now: Column, cut: Cut, delay_hours: int = 24, dry_run: bool = False) -> DataFrame:
    """Merge reports of each event and deliver the winners that are due."""
    if dry_run:
        return articles
    facts = extractions.select(F.col("article_id").alias("id"), "award_name", "deadline_text", "deadline_date", "applicant_scope")
    rows = events.source_tier(current(articles, "ready_to_push", "push_failed", "pushed"), sources).join(facts, "id", "left")
    rows = rows.withColumn("completeness", events.completeness(F.col("award_name"), F.col("deadline_date"), F.col("deadline_text"), F.coalesce(F.size("applicant_scope"), F.lit(0)), F.col("raw_content"), F.col("summary")))
    rows = rows.withColumn("event_key", events.event_key(F.col("award_name"), F.col("title"), F.col("summary"), F.col("source"), F.col("publish_date")))
    merged = cut(events.merge(rows, now, delay_hours))
    winners = merged.where("action = 'push'").withColumn("applicant_scope", F.coalesce("applicant_scope", F.array().cast("array<string>")))
    sent = cut(deliver(winners, send))
    lost = merged.where("action = 'supersede'").select("id", F.lit("source_superseded").alias("status"), F.concat(F.lit("event "), F.col("event_key")).alias("ai_reason"), F.lit(None).cast("string").alias("last_error"), F.lit(False).alias("increment"), F.lit(False).alias("pushed"), F.lit(False).alias("clear_error"))
    told = sent.select("id", F.when(F.col("success"), "pushed").otherwise("push_failed").alias("status"), F.lit(None).cast("string").alias("ai_reason"), F.when(~F.col("success"), F.coalesce("error", F.lit("failed"))).alias("last_error"), (~F.col("success")).alias("increment"), F.col("success").alias("pushed"), F.col("success").alias("clear_error"))
    better = merged.select(F.col("id").alias("better_id"), F.col("source").alias("__source"), F.col("url").alias("__url"))
    upgrades = merged.where("action = 'take_over'").join(better, "better_id").select("id", F.col("__source").alias("source"), F.col("__url").alias("url"), F.concat(F.lit("event "), F.col("event_key")).alias("reason"))
    return state.transition(state.update_provenance(articles, upgrades, now), lost.unionByName(told), now)


def replay(rows: DataFrame, model: Callable[[str], str], workers: int = 2) -> DataFrame:
    """Evaluation rows (id, title, source, event_date and more) with the gate's and the model's prediction at event time.

    `predicted_should_push` and `decision_stage` of the rows, where they have them,
    are relabelled by the new decision.
    """
    gate = filters.gate_reason(F.col("title"), F.col("source"), F.lit(None).cast("string"), F.current_date(), F.to_date("event_date"))
    gated = rows.withColumn("gate", gate)
    asked = gated.where("gate is null").select("id", "title", F.lit("").alias("raw_content"), F.lit("").alias("summary"))
    judged = reply.judge(asked, model, 2000, workers).select("id", "decision")
    out = gated.join(judged, "id", "left").withColumn("predicted", F.coalesce("decision", F.lit(False)))
    stage = F.when(F.col("gate").isNotNull(), "keyword_negative").when(F.col("decision").isNull(), "unresolved").when(F.col("decision"), "ai_positive").otherwise("ai_negative")
    fresh = {"decision_stage": stage, "predicted_should_push": F.when(F.col("predicted"), evaluate.YES).otherwise(evaluate.NO)}
    return out.withColumns({c: v for c, v in fresh.items() if c in rows.columns})


def replay_metrics(replayed: DataFrame) -> DataFrame:
    """Metrics of replayed rows that have label (boolean), basis and weight."""
    return evaluate.coverage(evaluate.metrics(replayed))


def event_time_queue(review: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Review rows with first_seen_at (joined by id as text), event date, its basis, and blank labels to fill."""
    seen = first_seen.select(F.col("id").cast("string").alias("__id"), F.coalesce(F.col("first_seen_at").cast("string"), F.lit("")).alias("first_seen_at"))
    rows = review.join(seen, F.col("id").cast("string") == F.col("__id"), "left").drop("__id").withColumn("first_seen_at", F.coalesce("first_seen_at", F.lit("")))
    rows = rows.withColumn("__t", evaluate.event_time(F.col("publish_date"), F.col("first_seen_at")))
    rows = rows.withColumn("event_date", F.col("__t.event_date")).withColumn("event_time_basis", F.col("__t.event_time_basis")).drop("__t")
    blank = ("内容类型", "行业相关", "事件时点可行动", "事件时点评估结论", "证据说明", "复核人", "复核时间")
    rows = rows.withColumn("证据链接", F.col("url") if "url" in review.columns else F.lit(""))
    old = lambda c: F.col(c) if c in review.columns else F.lit("")
    rows = rows.withColumn("快照口径审核结论", old("人工审核结论")).withColumn("快照口径审核备注", old("审核备注"))
    return rows.withColumns({c: F.lit("") for c in blank})


def watchdog(schedule: DataFrame, runs: DataFrame, alerted: DataFrame, now: Column, cut: Cut, grace_minutes: int = 90) -> tuple[DataFrame, DataFrame]:
    """Keys to alert now, and the keys to remember as alerted."""
    missing = cut(health.missed_windows(schedule, runs, now, grace_minutes).select("key"))
    fresh = health.new_alerts(missing, alerted)
    return fresh, health.remembered_alerts(missing, alerted).unionByName(fresh)


def read_alerted(path: str) -> list[str]:
    """Keys of a watchdog's state file; a file that is missing or broken remembers nothing."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return []
    keys = found.get("alerted") if isinstance(found, dict) else None
    return [k for k in keys if isinstance(k, str)] if isinstance(keys, list) else []


def write_alerted(path: str, keys: list[str]) -> None:
    """The state file, replaced as a whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fresh = target.with_suffix(".new")
    fresh.write_text(json.dumps({"alerted": sorted(keys)}), encoding="utf-8")
    fresh.replace(target)


def run_watchdog(schedule: DataFrame, runs: DataFrame, path: str, now: Column, send: Callable[[str], str | None], cut: Cut, check_only: bool = False) -> list[str]:
    """Alert once for each schedule entry without a finished run; the keys missing now. `check_only` sends and remembers nothing."""
    spark = schedule.sparkSession
    alerted = spark.createDataFrame([(k,) for k in read_alerted(path)], "key string")
    fresh, kept = watchdog(schedule, runs, alerted, now, cut)
    missing = sorted(r.key for r in fresh.collect())  # a schedule has a handful of entries
    if check_only:
        return missing
    if missing and send("; ".join(missing)) is not None:
        kept = health.remembered_alerts(fresh.unionByName(kept).distinct(), alerted)  # not told, so not remembered
    write_alerted(path, [r.key for r in kept.distinct().collect()])
    return missing
