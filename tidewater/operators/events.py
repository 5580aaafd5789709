"""Event identity, source tiers and merging of reports about one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import award_identity, first_year
from tidewater.operators.filters import aggregator_due, any_of

#: Authority of source tiers (fixed values).
TIER_PRIORITY = {"official_website": 400, "official_wechat": 300, "authoritative_secondary": 200, "aggregator": 100}
#: Phases and the words that name them, in order (fixed values).
PHASES = (
    ("application", ("申报", "推荐", "提名", "报名", "征集")),
    ("selection", ("评选", "评审")),
    ("result", ("公示", "名单", "获奖", "表彰")),
)
#: Where a notice applies, most specific first (fixed values).
JURISDICTIONS = (
    "(?:北京|上海|天津|重庆)市",
    "(?:内蒙古|广西|西藏|宁夏|新疆)自治[区州]",
    "(?:香港|澳门)特别行政区",
    "[黑吉辽蒙冀晋鲁豫苏皖浙闽赣鄂湘粤桂琼川贵云藏陕甘青宁新]省",
    "(?:北京|上海|天津|重庆|广州|深圳|成都|杭州|南京|武汉|西安|厦门|福州|昆明|合肥|南昌|南宁|贵阳|海口|兰州|银川|乌鲁木齐|拉萨|呼和浩特)市",
)
NATIONWIDE = "全国"
WECHAT_PREFIX = "微信公众号:"


def phase(title: Column, summary: Column, phases: tuple = PHASES) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))
    out = F.lit(phases[0][0])
    for name, words in reversed(phases):
        out = F.when(any_of(text, words), F.lit(name)).otherwise(out)
    return out


def jurisdiction(title: Column, source: Column) -> Column:
    text = F.concat(F.coalesce(title, F.lit("")), F.coalesce(source, F.lit("")))
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in JURISDICTIONS], F.lit(NATIONWIDE))


def event_key(award: Column, title: Column, summary: Column, source: Column, publish_date: Column, exact: bool = True, phases: tuple = PHASES) -> Column:
    """award|year|phase|jurisdiction; the title stands in for a missing award."""
    name = F.coalesce(F.nullif(award_identity(award, exact), F.lit("")), award_identity(title, exact))
    return F.concat_ws("|", name, first_year(award, title, publish_date), phase(title, summary, phases), jurisdiction(title, source))


def source_tier(rows: DataFrame, sources: DataFrame, column: str = "source") -> DataFrame:
    """Adds tier and priority. `sources`: name, kind (website, wechat), tier, pos; the first entry of a name counts."""
    first = F.row_number().over(Window.partitionBy("kind", "name").orderBy("pos"))
    known = sources.withColumn("__n", first).where("__n = 1").select(F.col("kind").alias("__kind"), F.col("name").alias("__name"), F.col("tier").alias("__tier"))
    chat = F.col(column).startswith(WECHAT_PREFIX)
    name = F.when(chat, F.substring_index(F.col(column), ":", -1)).otherwise(F.col(column))
    keyed = rows.withColumn("__k", F.when(chat, "wechat").otherwise("website")).withColumn("__s", name)
    # the dimension is configuration; should it outgrow a broadcast, the optimiser shuffles instead
    out = keyed.join(known, (F.col("__k") == F.col("__kind")) & (F.col("__s") == F.col("__name")), "left")
    guess = F.when(chat, "official_wechat").when(any_of(F.col(column), ("信息库", "聚合")), "aggregator").otherwise("official_website")
    out = out.withColumn("tier", F.coalesce("__tier", guess)).drop("__k", "__s", "__kind", "__name", "__tier")
    return out.withColumn("priority", priority(F.col("tier")))


def priority(tier: Column) -> Column:
    out = F.lit(0)
    for name, value in TIER_PRIORITY.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def completeness(award: Column, deadline_date: Column, deadline_text: Column, scope_size: Column, raw: Column, summary: Column) -> Column:
    """Ranks reports of equal authority: structured fields first, then length."""
    has = lambda c, n: F.when(F.coalesce(c, F.lit("")) != "", F.lit(n)).otherwise(0)
    length = F.length(F.coalesce(F.nullif(raw, F.lit("")), summary, F.lit("")))
    score = has(award, 100) + has(deadline_date, 50) + has(deadline_text, 25) + F.when(scope_size > 0, 25).otherwise(0)
    return score + F.floor(F.least(length, F.lit(5000)) / 100).cast("int")


def _rank() -> Column:
    """What orders reports of an event: authority, completeness, date, id, the largest first."""
    return F.struct(F.col("priority"), F.col("completeness"), F.coalesce("publish_date", F.lit("")).alias("d"), F.col("id"))


def winners(rows: DataFrame) -> DataFrame:
    """The best report of each event: event_key, id. A maximum needs no sort, and is summed up before the shuffle."""
    return rows.groupBy("event_key").agg(F.max(_rank())["id"].alias("id"))


def merge(rows: DataFrame, now: Column, delay_hours: int = 24) -> DataFrame:
    """What becomes of each pending or pushed report of an event.

    `rows`: id, event_key, status, tier, priority, completeness, publish_date,
    created_at. Adds `action`: push, wait (an aggregator that isn't due),
    supersede, take_over (a pushed report whose source a better pending report
    replaces), none; and `better_id`, the report that takes over. The best report
    of an event, and the best pushed one, are maxima that are joined back, so an
    event of very many reports is in no single task.
    """
    pushed = F.col("status") == "pushed"
    top = rows.groupBy(F.col("event_key").alias("__key")).agg(F.max(_rank())["id"].alias("__best"), F.max(F.when(pushed, _rank()))["id"].alias("__pushed"))
    rows = rows.join(top, F.col("event_key").eqNullSafe(F.col("__key")))
    best, best_pushed = F.col("__best"), F.col("__pushed")
    action = (
        F.when(pushed & (F.col("id") == best_pushed) & (best != best_pushed), "take_over")
        .when(pushed, "none")
        .when(best_pushed.isNotNull() | (F.col("id") != best), "supersede")
        .when((F.col("tier") == "aggregator") & ~aggregator_due(F.col("created_at"), now, delay_hours), "wait")
        .otherwise("push")
    )
    better = F.when(F.col("action") == "take_over", F.col("__best"))
    return rows.withColumn("action", action).withColumn("better_id", better).drop("__best", "__pushed", "__key")
