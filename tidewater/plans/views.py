"""Deterministic notice views over the test tables, in Spark and as SQL for the oracle.

The notice engine's own tables don't exist in the test data; these views give
documents the columns of notices by arithmetic on their ids, so that both
engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import normalize_title
from tidewater.functions.urls import canonical_url
from tidewater.sources.files import read_table

AWARDS = ("城市规划科学技术奖", "自然资源科技奖", "摄影大赛", "风景园林设计竞赛", "安全生产培训", "华夏建设奖评优", "测绘成果奖")
ACTIONS = ("申报通知", "推荐工作启动", "获奖名单公示", "报名", "会议", "评审结果公布", "征集延期", "")
PUBLISHERS = ("城市规划学会", "行业信息库", "风景园林学会", "微信公众号:规划视界", "教育局", "微信公众号:未知号", "资讯聚合")
PLACES = ("四川省", "广东省", "上海市", "内蒙古自治区", "", "成都市")
STATUSES = ("discovered", "keyword_rejected", "ai_pending", "ai_rejected", "ready_to_push", "push_failed", "pushed", "source_superseded", "ai_confirmed")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def _sql(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({index}) % {len(values)} + 1]"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notices."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        i.alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.substring(text, 1, 40).alias("title"), F.substring(text, 1, 500).alias("summary"), text.alias("raw_content"),
        F.concat(F.lit("HTTP://"), F.coalesce("source", F.lit("")), F.lit(".Example.com:80//n/"), (i % 400).cast("string"), F.lit("?utm_source=x&b=2&a="), (i % 3).cast("string"), F.lit("#top")).alias("url"),
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (i * 37 % 200).cast("int")), "yyyy-MM-dd").alias("publish_date"),
        F.timestamp_add("DAY", (i * 7 % 300).cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        _pick(STATUSES, i).alias("status"), (i % 2 + 1).cast("int").alias("pipeline_version"), (i % 4).cast("int").alias("attempt_count"),
    )


ARTICLES_SQL = f"""articles AS (SELECT doc_id AS id, coalesce(source, '') AS source, substr(coalesce(text, ''), 1, 40) AS title, substr(coalesce(text, ''), 1, 500) AS summary, coalesce(text, '') AS raw_content,
  'HTTP://' || coalesce(source, '') || '.Example.com:80//n/' || (doc_id % 400) || '?utm_source=x&b=2&a=' || (doc_id % 3) || '#top' AS url,
  strftime(DATE '2026-01-01' + CAST(doc_id * 37 % 200 AS INTEGER), '%Y-%m-%d') AS publish_date, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 DAY * (doc_id * 7 % 300) AS created_at,
  {_sql(STATUSES, 'doc_id')} AS status, CAST(doc_id % 2 + 1 AS INTEGER) AS pipeline_version, CAST(doc_id % 4 AS INTEGER) AS attempt_count FROM documents)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as it was fetched twice: its canonical URL, normalised title and registered domain; some titles change, some URLs are unknown."""
    p = read_table(spark, sf_dir, "pages").withColumn("visit", F.explode(F.array(F.lit(0), F.lit(1))))
    i, again = F.col("page_id"), F.col("visit") == 1
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.when(again & (i % 3 == 0), " updated").otherwise(""))
    return p.select(
        (i * 2 + F.col("visit")).alias("id"), F.when(i % 13 == 0, "").otherwise(canonical_url("url")).alias("canonical_url"), normalize_title(title).alias("normalized_title"),
        F.substring_index(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1), ".", -2).alias("source"),
        F.timestamp_add("DAY", (i * 7 % 300 + F.col("visit") * (i * 13 % 160)).cast("int"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
    )


PAGE_URL_SQL = "regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^=&]*|from|from_source|spm)=[^&]*', '\\1', 'g'), '[?&]+$', '')"
VISITS_SQL = f"""visits AS (SELECT page_id * 2 + visit AS id, CASE WHEN page_id % 13 = 0 THEN '' ELSE {PAGE_URL_SQL} END AS canonical_url,
  regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || CASE WHEN visit = 1 AND page_id % 3 = 0 THEN ' updated' ELSE '' END), '\\s+', '', 'g') AS normalized_title,
  regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '[^.]*\\.[^.]*$') AS source, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 DAY * (page_id * 7 % 300 + visit * (page_id * 13 % 160)) AS created_at
  FROM pages, (VALUES (0), (1)) v(visit))"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with titles that the screening rules are made for."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    year = F.concat((F.lit(2024) + i % 4).cast("string"), F.lit("年"))
    return d.select(
        i.alias("id"), _pick(PUBLISHERS, i * 3).alias("source"), F.concat(_pick(PLACES, i), year, _pick(AWARDS, i * 5 + 1), _pick(ACTIONS, F.expr("doc_id div 7"))).alias("title"),
        F.when(i % 5 < 2, _pick(AWARDS, i * 5 + 1)).otherwise("").alias("award_name"), F.when(i % 6 == 0, "2026-08-31").otherwise("").alias("deadline_date"),
        F.when(i % 4 == 0, "8月31日").otherwise("").alias("deadline_text"), (i % 3).cast("int").alias("scope_size"), F.coalesce("text", F.lit("")).alias("raw_content"),
        F.when(i % 10 == 0, "").when(i % 10 == 1, "2026/07/05").when(i % 10 == 2, "2026-7-1").otherwise(F.date_format(F.date_add(F.lit("2025-06-01").cast("date"), (i * 13 % 500).cast("int")), "yyyy-MM-dd")).alias("publish_date"),
        F.timestamp_add("HOUR", (i * 11 % 96).cast("int"), F.lit("2026-07-29 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.when(i % 9 == 0, "pushed").when(i % 9 < 6, "ready_to_push").otherwise("push_failed").alias("status"),
    )


NOTICES_SQL = f"""notices AS (SELECT doc_id AS id, {_sql(PUBLISHERS, 'doc_id * 3')} AS source,
  {_sql(PLACES, 'doc_id')} || CAST(2024 + doc_id % 4 AS VARCHAR) || '年' || {_sql(AWARDS, 'doc_id * 5 + 1')} || {_sql(ACTIONS, 'doc_id // 7')} AS title,
  CASE WHEN doc_id % 5 < 2 THEN {_sql(AWARDS, 'doc_id * 5 + 1')} ELSE '' END AS award_name, CASE WHEN doc_id % 6 = 0 THEN '2026-08-31' ELSE '' END AS deadline_date,
  CASE WHEN doc_id % 4 = 0 THEN '8月31日' ELSE '' END AS deadline_text, CAST(doc_id % 3 AS INTEGER) AS scope_size, coalesce(text, '') AS raw_content,
  CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN '2026/07/05' WHEN doc_id % 10 = 2 THEN '2026-7-1' ELSE strftime(DATE '2025-06-01' + CAST(doc_id * 13 % 500 AS INTEGER), '%Y-%m-%d') END AS publish_date,
  TIMESTAMP '2026-07-29 00:00:00' + INTERVAL 1 HOUR * (doc_id * 11 % 96) AS created_at,
  CASE WHEN doc_id % 9 = 0 THEN 'pushed' WHEN doc_id % 9 < 6 THEN 'ready_to_push' ELSE 'push_failed' END AS status FROM documents)"""


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as health rows: a user is a source."""
    e = read_table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "empty").when(F.col("event_type") == "view", "partial").otherwise("success")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source"), status.alias("status"), F.floor("value").cast("long").alias("article_count"), F.col("ts").alias("run_time"), F.when(F.col("user_id") % 3 == 0, "wechat").otherwise("website").alias("source_type"))


RUNS_SQL = """runs AS (SELECT event_id AS id, 's' || user_id AS source, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'empty' WHEN 'view' THEN 'partial' ELSE 'success' END AS status,
  CAST(floor(value) AS BIGINT) AS article_count, ts AS run_time, CASE WHEN user_id % 3 = 0 THEN 'wechat' ELSE 'website' END AS source_type FROM events)"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as reviewed predictions with weights."""
    lab = read_table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return lab.select(
        i.alias("id"), (i % 3 == 0).alias("predicted"), F.when(i % 7 == 0, F.lit(None).cast("boolean")).otherwise(F.col("quality") == 1).alias("label"),
        F.when(i % 11 == 0, "unknown").when(i % 2 == 0, "published_at").otherwise("first_seen_at").alias("basis"), (F.lit(1.0) + (i % 4).cast("double") / 2).alias("weight"), (i % 5).cast("string").alias("stratum"),
    )


REVIEWED_SQL = """reviewed AS (SELECT doc_id AS id, doc_id % 3 = 0 AS predicted, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality = 1 END AS label,
  CASE WHEN doc_id % 11 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'published_at' ELSE 'first_seen_at' END AS basis, 1.0 + (doc_id % 4)::DOUBLE / 2 AS weight, CAST(doc_id % 5 AS VARCHAR) AS stratum FROM labels)"""
