"""Snapshots of the status table: transitions, upserts, provenance, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import normalize_title
from tidewater.functions.urls import canonical_url
from tidewater.operators.dedup import anti_window, keep_disjunctive
from tidewater.operators.filters import any_of
from tidewater.schemas import PIPELINE_VERSION, SCHEMA_VERSION
from tidewater.storage import cut


def transition(articles: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Apply status changes: id, status, and optional ai_reason, last_error, increment, pushed, clear_error.

    A given error wins over clearing it; rows without a change stay as they are.
    """
    names = ("status", "ai_reason", "last_error", "increment", "pushed", "clear_error")
    have = [F.col(c).alias(f"__{c}") if c in changes.columns else F.lit(None).cast("string" if c in ("status", "ai_reason", "last_error") else "boolean").alias(f"__{c}") for c in names]
    rows = articles.join(changes.select(F.col("id"), F.lit(True).alias("__hit"), *have), "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    error = F.coalesce("__last_error", F.when(~yes("__clear_error"), F.col("last_error")))
    values = {
        "status": F.coalesce("__status", "status"),
        "ai_reason": F.coalesce("__ai_reason", "ai_reason"),
        "last_error": F.when(yes("__hit"), error).otherwise(F.col("last_error")),
        "attempt_count": F.col("attempt_count") + yes("__increment").cast("int"),
        "updated_at": F.when(yes("__hit"), now).otherwise(F.col("updated_at")),
        "pushed_at": F.when(yes("__pushed"), now).otherwise(F.col("pushed_at")),
    }
    return rows.select([values.get(c, F.col(c)).alias(c) for c in articles.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, created: str = "created_at", order: str = "seq") -> DataFrame:
    """Latest row of each key by `order`; the first creation time stays."""
    rows = old.unionByName(new)
    window = Window.partitionBy(key)
    rows = rows.withColumn("__first", F.min(created).over(window)).withColumn("__n", F.row_number().over(window.orderBy(F.desc(order))))
    return rows.where("__n = 1").withColumn(created, F.col("__first")).drop("__first", "__n")


def update_content(articles: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """New summary, raw content and, where given, URL with the keys that depend on it."""
    u = updates.select("id", F.col("summary").alias("__s"), F.col("raw_content").alias("__r"), F.col("url").alias("__u"), F.lit(True).alias("__hit"))
    rows = articles.join(u, "id", "left")
    moved = F.coalesce(F.col("__u"), F.lit("")) != ""
    url = F.when(moved, canonical_url(F.col("__u"))).otherwise(F.col("canonical_url"))
    rows = rows.withColumn("__c", url)
    values = {
        "summary": F.coalesce("__s", "summary"), "raw_content": F.coalesce("__r", "raw_content"),
        "url": F.when(moved, F.col("__u")).otherwise(F.col("url")), "canonical_url": F.col("__c"),
        "dedup_key": F.when(moved, fingerprint(F.col("source"), F.col("normalized_title"), F.col("__c"), F.col("publish_date"))).otherwise(F.col("dedup_key")),
        "updated_at": F.when(F.coalesce("__hit", F.lit(False)), now).otherwise(F.col("updated_at")),
    }
    return rows.select([values.get(c, F.col(c)).alias(c) for c in articles.columns])


def audit(old: Column, before: Column, after: Column, reason: Column) -> Column:
    """The audit trail with one more change of source."""
    entry = F.concat(F.lit("来源升级: "), before, F.lit(" -> "), after, F.lit("; 原因: "), reason)
    return F.concat_ws("; ", F.nullif(F.coalesce(old, F.lit("")), F.lit("")), entry)


def update_provenance(articles: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Source and URL of a better report (id, source, url, reason), noted in ai_reason."""
    c = changes.select("id", F.col("source").alias("__source"), F.col("url").alias("__url"), F.col("reason").alias("__reason"))
    rows = articles.join(c, "id", "left")
    hit = F.col("__source").isNotNull()
    new_url = F.when(hit, canonical_url(F.col("__url"))).otherwise(F.col("canonical_url"))
    rows = rows.withColumn("__c", new_url)
    values = {
        "ai_reason": F.when(hit, audit(F.col("ai_reason"), F.col("source"), F.col("__source"), F.col("__reason"))).otherwise(F.col("ai_reason")),
        "source": F.coalesce("__source", "source"), "url": F.when(hit, F.col("__url")).otherwise(F.col("url")), "canonical_url": F.col("__c"),
        "dedup_key": F.when(hit, fingerprint(F.col("__source"), F.col("normalized_title"), F.col("__c"), F.col("publish_date"))).otherwise(F.col("dedup_key")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return rows.select([values.get(c, F.col(c)).alias(c) for c in articles.columns])


def fingerprint(source: Column, normalized: Column, canonical: Column, publish_date: Column) -> Column:
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.sha2(F.concat_ws("|", part(source), F.coalesce(normalized, F.lit("")), F.coalesce(canonical, F.lit("")), part(publish_date)), 256)


def backfill_keys(articles: DataFrame) -> DataFrame:
    """Fills normalised titles, canonical URLs and fingerprints that are blank; everything else stays."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = articles.withColumn("__t", F.when(blank("normalized_title"), normalize_title(F.col("title"))).otherwise(F.col("normalized_title")))
    rows = rows.withColumn("__c", F.when(blank("canonical_url"), canonical_url("url")).otherwise(F.col("canonical_url")))
    key = F.when(blank("dedup_key"), fingerprint(F.col("source"), F.col("__t"), F.col("__c"), F.col("publish_date"))).otherwise(F.col("dedup_key"))
    values = {"normalized_title": F.col("__t"), "canonical_url": F.col("__c"), "dedup_key": key}
    return rows.select([values.get(c, F.col(c)).alias(c) for c in articles.columns])


def schema_version(columns: list[str]) -> int:
    """The layout that a table's columns show: 0 nothing known, 1 the first, else the present one."""
    if "pipeline_version" in columns:
        return SCHEMA_VERSION
    return 1 if {"id", "title", "url", "status"} <= set(columns) else 0


def migrate(articles: DataFrame, backup_path: str | None = None) -> DataFrame:
    """A table of any layout in the present one; one of the first layout is written to `backup_path` before."""
    version = schema_version(articles.columns)
    if version == 0:
        raise ValueError("not a table of articles")
    if version == 1:
        if backup_path:
            articles.write.mode("errorifexists").parquet(backup_path)
        return migrate_v1(articles)
    return backfill_keys(articles)


def migrate_v1(old: DataFrame) -> DataFrame:
    """Articles of the first layout in the present one; they stay out of the pipeline by their version 1."""
    return old.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), normalize_title(F.col("title")).alias("normalized_title"), F.coalesce("url", F.lit("")).alias("url"),
        canonical_url(F.col("url")).alias("canonical_url"),
        fingerprint(F.col("source"), normalize_title(F.col("title")), canonical_url(F.col("url")), F.col("publish_date")).alias("dedup_key"),
        F.coalesce("source", F.lit("")).alias("source"), "publish_date", "summary", "raw_content", F.coalesce("status", F.lit("new")).alias("status"), "ai_reason",
        F.lit(None).cast("string").alias("last_error"), F.lit(0).alias("attempt_count"), F.lit(PIPELINE_VERSION - 1).alias("pipeline_version"),
        "created_at", F.col("created_at").alias("updated_at"), "pushed_at",
    )


def pending(articles: DataFrame, extractions: DataFrame, statuses: list[str], least_version: int = PIPELINE_VERSION) -> DataFrame:
    """Rows of the given statuses with their extraction, in id order."""
    rows = articles.where(F.col("status").isin(statuses) & (F.col("pipeline_version") >= least_version))
    return rows.join(extractions.withColumnRenamed("article_id", "id"), "id", "left").orderBy("id")


def article_by_id(articles: DataFrame, id_: int) -> DataFrame:
    return articles.where(F.col("id") == id_)


def extraction_of(extractions: DataFrame, article_id: int) -> DataFrame:
    return extractions.where(F.col("article_id") == article_id)


def matching(articles: DataFrame, words: list[str], ids: list[int] | None = None) -> DataFrame:
    """Ad-hoc look at rows whose title, summary or content holds a word, or whose id is listed."""
    text = F.concat_ws(" ", "title", "summary", "raw_content")
    hit = any_of(text, words)
    return articles.where(hit | F.col("id").isin(ids) if ids else hit)


def fresh_rows(articles: DataFrame, rows: DataFrame, now: Column, days: int = 90, status: str = "discovered") -> DataFrame:
    """Rows (title, url, source, publish_date, summary, raw_content) that no stored one, and none of them before, repeats within `days`, as new articles.

    They come in the order of `seq` where there is one, then of URL, title and source;
    a row is repeated only by one that is kept. New ids follow the largest stored one.
    """
    top = articles.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = [*(["seq"] if "seq" in rows.columns else []), "url", "title", "source"]
    coming = rows.withColumn("normalized_title", normalize_title(F.col("title"))).withColumn("canonical_url", canonical_url("url")).withColumn("created_at", now)
    coming = ordered_positions(anti_window(coming, articles, days), *order).withColumnRenamed("__position", "id")
    kept = keep_disjunctive(coming, cut, days).where("kept")
    numbered = ordered_positions(kept, "id").withColumn("id", F.col("__position") + top + 1)
    values = {
        "status": F.lit(status), "attempt_count": F.lit(0), "pipeline_version": F.lit(PIPELINE_VERSION), "updated_at": now,
        "dedup_key": fingerprint(F.col("source"), F.col("normalized_title"), F.col("canonical_url"), F.col("publish_date")),
    }
    return numbered.select([values.get(f.name, F.col(f.name) if f.name in numbered.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in articles.schema])


def insert(articles: DataFrame, rows: DataFrame, now: Column, days: int = 90, status: str = "discovered") -> DataFrame:
    """The table with `fresh_rows` of it appended."""
    return articles.unionByName(fresh_rows(articles, rows, now, days, status))


def positions(rows: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Adds __position: each row's number from 0 in the order of `key` (long; equal keys in any order).

    Buckets are ranges of the key with explicit bounds (approximate quantiles),
    so both uses of them agree, no plan sorts the table in one task, and none of
    a bucket's rows are lost however partitions are coalesced.
    """
    grid = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx(key, grid, 4 * buckets)).first()[0] or []
    edges = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]).cast("array<long>")
    cut_rows = rows.withColumn("__bucket", F.size(F.filter(edges, lambda b: b < F.col(key))))
    counts = cut_rows.groupBy("__bucket").agg(F.count("*").alias("__size"))  # one row for each bucket
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__bucket", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    return cut_rows.withColumn("__nth", nth).join(base, "__bucket").withColumn("__position", F.col("__base") + F.col("__nth") - 1).drop("__bucket", "__base", "__nth")


def ordered_positions(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds __position: each row's number from 0 in an order of any columns, ties in any order.

    Rows are dealt by ranges of the order and sorted there; a range's rows are
    numbered by the rows of the ranges before it, of which there are as many as
    partitions.
    """
    wide = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    held = cut(wide.withColumn("__part", F.shiftright("__m", 33)).withColumn("__nth", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m"))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__size"))
    base = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return held.join(base, "__part").withColumn("__position", F.col("__base") + F.col("__nth")).drop("__part", "__nth", "__base")


def batches(rows: DataFrame, size: int = 10) -> DataFrame:
    """Numbers rows (in id order) for a sink in batches: batch_no from 0."""
    return positions(rows, "id").withColumn("batch_no", F.expr(f"__position div {size}")).drop("__position")


#: What a message says where a notice has no date or summary.
NO_DATE, NO_SUMMARY, SUMMARY_CHARS = "未知", "无摘要", 200
RULE = "━" * 16


def notice_lines(columns: list[str]) -> Column:
    """Lines of one notice; columns that a table lacks are blank."""
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("")
    filled = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    deadline = F.when(have("deadline_date") != "", have("deadline_date")).otherwise(have("deadline_text"))
    scope = F.coalesce(F.array_join("applicant_scope", "、"), F.lit("")) if "applicant_scope" in columns else F.lit("")
    summary = F.substring(have("summary"), 1, SUMMARY_CHARS)
    date = F.when(have("publish_date") == "", NO_DATE).otherwise(have("publish_date"))
    lines = [
        F.concat(F.lit("📌 "), have("title")), F.concat(F.lit("来源："), have("source"), F.lit(" | 日期："), date), F.concat(F.lit("摘要："), F.when(summary == "", NO_SUMMARY).otherwise(summary)),
        filled("奖项：", have("award_name")), filled("截止：", deadline), filled("申报对象：", scope), F.concat(F.lit("🔗 "), have("url")), F.lit(RULE),
    ]
    return F.concat_ws("\n", *lines)


def render(rows: DataFrame) -> DataFrame:
    """Message of each batch: a header with the number of notices, then their lines in id order."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("id", notice_lines(rows.columns).alias("l")))), lambda s: s["l"])
    header = F.concat(F.lit("📰 报奖信息监测 (本次发现 "), F.count("*").cast("string"), F.lit(" 条)"))
    return rows.groupBy("batch_no").agg(F.concat_ws("\n", header, F.array_join(body, "\n")).alias("content"), F.count("*").alias("n"))
