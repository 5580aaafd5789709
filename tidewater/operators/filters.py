"""Screening rules as expressions over notice columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import strict_date, years_in


def any_of(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Whether a text holds one of the terms, by one alternation."""
    if not terms:
        return F.lit(False)
    return F.coalesce(text, F.lit("")).rlike("|".join(re.escape(t) for t in terms))


@dataclass(frozen=True)
class GateTerms:
    """Word lists of the title gate (fixed values)."""

    target_sources: tuple[str, ...] = ("城市规划学会", "城市规划协会", "国土空间规划协会", "自然资源学会", "华夏建设科学技术奖励委员会", "风景园林学会")
    industry: tuple[str, ...] = ("规划", "国土", "自然资源", "园林", "建设", "住建", "建筑", "城市设计", "测绘", "景观", "人居", "遗产")
    opportunity: tuple[str, ...] = ("申报", "提名", "推荐", "参评", "报名", "征集", "启动", "延期")
    award: tuple[str, ...] = ("奖", "竞赛", "大赛", "评优")
    result: tuple[str, ...] = ("获奖", "授奖", "名单", "公示", "评审结果", "评选结果", "喜报", "荣获", "拟奖", "公布", "网络人气", "网络投票", "投票")
    competition: tuple[str, ...] = ("竞赛", "大赛")


def gate_reason(title: Column, source: Column, publish_date: Column, today: Column, event_date: Column | None = None, terms: GateTerms = GateTerms()) -> Column:
    """Name of the first gate rule that rejects a title, or null for titles that pass.

    Rules in order: result, no_action, not_award, stale_year, off_industry. An
    event date that isn't given is the publish date, or `today` where that isn't
    a full ISO date.
    """
    from_target = any_of(source, terms.target_sources)
    date = F.coalesce(strict_date(publish_date), today) if event_date is None else event_date
    newest = F.array_max(years_in(F.coalesce(title, F.lit(""))))
    rules = (
        ("result", any_of(title, terms.result)),
        ("no_action", ~any_of(title, terms.opportunity) & ~(from_target & any_of(title, terms.competition))),
        ("not_award", ~any_of(title, terms.award)),
        ("stale_year", F.coalesce(newest < F.year(date), F.lit(False))),
        ("off_industry", ~from_target & ~any_of(title, terms.industry)),
    )
    out = F.lit(None).cast("string")
    for name, rejects in reversed(rules):
        out = F.when(rejects, F.lit(name)).otherwise(out)
    return out


def keyword_pass(title: Column, summary: Column, keywords: list[str], excluded: list[str]) -> Column:
    """Whether title and summary match a keyword pattern and no excluded one, ignoring case."""
    for pattern in [*keywords, *excluded]:
        re.compile(pattern)
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))
    either = lambda ps: text.rlike("(?iu)" + "|".join(f"(?:{p})" for p in ps)) if ps else F.lit(False)
    return ~either(excluded) & either(keywords)


def in_backfill_window(publish_date: Column, today: Column, days: int = 3) -> Column:
    """Dates from days - 1 before today up to today; texts that are no date stay."""
    parsed = F.try_to_date(F.when(publish_date.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), publish_date), "yyyy-M-d")
    return parsed.isNull() | parsed.between(F.date_sub(today, max(1, days) - 1), today)


def needs_detail(raw_content: Column, summary: Column, least: int = 120) -> Column:
    return F.length(F.coalesce(F.nullif(raw_content, F.lit("")), summary, F.lit(""))) < least


def account_key(name: Column) -> Column:
    """Account names compare without white space and case."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", ""))


def account_matches(rows: DataFrame, aliases: DataFrame, required: bool = False) -> DataFrame:
    """Rows whose `account` is one of `aliases` (alias); unnamed accounts pass unless `required`."""
    known = aliases.where(F.coalesce("alias", F.lit("")) != "").select(account_key(F.col("alias")).alias("__k")).distinct()
    rows = rows.withColumn("__a", account_key(F.col("account")))
    named = rows.where("__a <> ''").join(known, F.col("__a") == F.col("__k"), "left_semi")
    out = named if required else named.unionByName(rows.where("__a = ''"))
    return out.drop("__a")


def source_selected(selector: str | None, name: Column, kind: Column) -> Column:
    """A selector is empty, a name, a kind, or kind:name."""
    if not selector:
        return F.lit(True)
    head, _, tail = selector.partition(":")
    if tail and head in ("website", "wechat"):
        return (kind == head) & (name == tail)
    return (name == selector) | (kind == selector)


def aggregator_due(created_at: Column, now: Column, delay_hours: int = 24) -> Column:
    """Whether an aggregator's notice has waited long enough; without a time it is due."""
    return F.coalesce(now >= created_at + F.expr(f"interval {max(1, delay_hours)} hours"), F.lit(True))


def link_rows(pages: DataFrame, kind: str, allowed: list[str], title_keywords: list[str] = ()) -> DataFrame:
    """Notice links of parsed pages (page_id, url, links): page_id, title, url, date; the first of each URL stays.

    `kind` is wide (titles of 6, wide domains, wide navigation words) or narrow.
    """
    from pyspark.sql import Window

    from tidewater.functions import urls

    narrow = kind == "narrow"
    rows = pages.select("page_id", F.col("url").alias("page"), F.explode("links").alias("l"))
    title = F.col("l.heading") if narrow else F.col("l.title")
    rows = rows.select("page_id", "page", F.col("l.pos").alias("pos"), title.alias("title"), F.col("l.href").alias("href"), F.col("l.date").alias("date"), F.col("l.nav_narrow" if narrow else "l.nav_wide").alias("nav"))
    bad = ("javascript:", "#", "mailto:", "tel:") if narrow else ("javascript:", "#")
    ok = (F.length("title") >= (8 if narrow else 6)) & (F.col("href") != "") & ~F.col("href").rlike("^(" + "|".join(bad) + ")")
    rows = rows.where(ok).withColumn("url", urls.join_url("page", "href"))
    host, base = urls.host(F.col("url")), urls.host(F.col("page"))
    allow = urls.domain_allowed_strict if narrow else urls.domain_allowed_wide
    rows = rows.where(((host == "") | allow(host, base, list(allowed))) & ~F.col("nav"))
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    rows = rows.withColumn("__n", first).where("__n = 1")
    if title_keywords:  # a URL counts as seen before its title is looked at
        rows = rows.where(any_of(F.col("title"), list(title_keywords)))
    return rows.select("page_id", "pos", "title", "url", "date")
