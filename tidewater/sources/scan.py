"""Paged scans: which pages of a source count, and what became of the scan.

Pages land as rows (source, page_num, url, body, fetch_error); these operators
decide over the landed pages what a page-by-page crawler would have decided:
where it stops, which rows are new, and the status of the source.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewater.functions.urls import page_url
from tidewater.operators.filters import account_key, in_backfill_window
from tidewater.schemas import CRAWL_PAGE


def _numbers(last):
    """1 to `last`; nothing for less than 1, where a sequence would run backwards."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def page_plan(sources: DataFrame) -> DataFrame:
    """Pages to fetch: source, page_num, url. `sources`: source, url_template, first_page_url, n_start, n_step, max_pages."""
    pages = sources.withColumn("page_num", F.explode(_numbers(F.col("max_pages"))))
    return pages.select("source", "page_num", page_url(F.col("url_template"), F.col("page_num"), F.col("first_page_url"), F.col("n_start"), F.col("n_step")).alias("url"))


def scan(pages: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept items and one status row per source.

    `pages`: source, page_num, fetch_error (null if fetched). `items`: source,
    page_num, pos, url and more. A scan ends before the first page that failed or
    has no items, and with the first page after page 1 that brings nothing new.
    """
    first = F.row_number().over(Window.partitionBy("source", "url").orderBy("page_num", "pos"))
    items = items.withColumn("__new", first == 1)
    per = items.groupBy("source", "page_num").agg(F.count("*").alias("items"), F.count_if("__new").alias("new"))
    flow = pages.select("source", "page_num", "fetch_error").join(per, ["source", "page_num"], "left").na.fill(0, ["items", "new"])
    broken = F.min(F.when(F.col("fetch_error").isNotNull(), F.col("page_num")))
    blank = F.min(F.when(F.col("fetch_error").isNull() & (F.col("items") == 0), F.col("page_num")))
    stale = F.min(F.when((F.col("page_num") > 1) & (F.col("items") > 0) & (F.col("new") == 0), F.col("page_num")))
    ends = flow.groupBy("source").agg(broken.alias("broken"), blank.alias("blank"), stale.alias("stale"), F.max("page_num").alias("last"))
    stop = F.least(F.coalesce("broken", F.col("last") + 1), F.coalesce("blank", F.col("last") + 1), F.coalesce("stale", F.col("last") + 1))
    ends = ends.withColumn("stop", stop)
    kept = items.where("__new").join(ends.select("source", "stop"), "source").where("page_num < stop").drop("__new", "stop")
    counts = kept.groupBy("source").agg(F.count("*").alias("articles"))
    status = F.when((F.col("broken") == F.col("stop")) & (F.coalesce("articles", F.lit(0)) == 0), "failed").when(F.col("broken") == F.col("stop"), "partial").when((F.col("blank") == 1) & (F.col("stop") == 1), "empty").otherwise("success")
    state = ends.join(counts, "source", "left").select("source", status.alias("status"), F.coalesce("articles", F.lit(0)).alias("articles"))
    return kept, state


def search_status(results: DataFrame) -> DataFrame:
    """Status of search scans (source, failed pages, rows): any row is a success."""
    status = F.when(F.col("rows") > 0, "success").when(F.col("failed_pages") > 0, "failed").otherwise("empty")
    return results.withColumn("status", status)


def search_scan(pages: DataFrame, results: DataFrame, aliases: DataFrame, today: Column, days: int = 3) -> tuple[DataFrame, DataFrame]:
    """Kept results and one status row per source of a search over several queries and pages.

    `pages`: source, query, page_num, fetch_error (null if fetched). `results`: source,
    query, page_num, account, publish_date and more. `aliases`: source, alias. Results of
    fetched pages count as raw; those whose account is an alias of their source, or who
    name none, are matched; of these the ones within `days` of today are kept. A page
    that fails leaves the others as they are. The status row has what a run records:
    status, articles, raw_count, matched_count, error.
    """
    fetched = results.join(pages.where("fetch_error is null").select("source", "query", "page_num"), ["source", "query", "page_num"], "left_semi")
    known = aliases.where(F.coalesce("alias", F.lit("")) != "").select("source", account_key(F.col("alias")).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    named = fetched.withColumn("__k", account_key(F.col("account"))).join(known, ["source", "__k"], "left")
    matched = named.withColumn("__ok", F.col("__hit").isNotNull() | (F.col("__k") == "")).withColumn("__kept", F.col("__ok") & in_backfill_window(F.col("publish_date"), today, days))
    counts = matched.groupBy("source").agg(F.count("*").alias("raw_count"), F.count_if("__ok").alias("matched_count"), F.count_if("__kept").alias("rows"))
    failed = pages.groupBy("source").agg(F.count_if(F.col("fetch_error").isNotNull()).alias("failed_pages"))
    state = search_status(failed.join(counts, "source", "left").na.fill(0, ["raw_count", "matched_count", "rows"]))
    error = F.when(F.col("failed_pages") > 0, F.concat(F.col("failed_pages").cast("string"), F.lit(" pages failed")))
    return matched.where("__kept").select(results.columns), state.select("source", "status", F.col("rows").alias("articles"), "raw_count", "matched_count", error.alias("error"))


def search_plan(queries: DataFrame, pages: int, year: int) -> DataFrame:
    """Queries by pages; {year} in a query is filled in."""
    text = F.replace(F.col("query"), F.lit("{year}"), F.lit(str(year)))
    return queries.withColumn("query", text).withColumn("page_num", F.explode(_numbers(F.lit(pages))))


def topic_aliases(accounts: DataFrame) -> DataFrame:
    """Names and aliases of accounts that are enabled or take part in topic search, each once, in order."""
    rows = accounts.where("coalesce(enabled, true) or coalesce(topic_match_enabled, false)")
    named = rows.select("pos", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "alias"))
    first = F.row_number().over(Window.partitionBy("alias").orderBy("pos", "n"))
    return named.where("coalesce(alias, '') <> ''").withColumn("__k", first).where("__k = 1").select("pos", "n", "alias")


class _Page(InputPartition):
    def __init__(self, source: str, page_num: int, url: str):
        self.source, self.page_num, self.url = source, page_num, url


def fetch_with_retries(get: Callable[[str], tuple[int, str, float | None]], url: str, times: int = 3, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(body, error) of a GET; 429, 5xx and connection errors are tried again.

    `get` returns status, body and the Retry-After seconds if sent, or raises
    ConnectionError or TimeoutError; certificate errors must be raised otherwise.
    """
    error = ""
    for attempt in range(max(1, times)):
        wait = delay * 2**attempt
        try:
            status, body, after = get(url)
        except (ConnectionError, TimeoutError) as e:
            error = f"{type(e).__name__}: {e}"
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"
        else:
            if status < 400:
                return body, None
            error = f"status {status}"
            if status != 429 and status < 500:
                return None, error
            wait = min(60.0, after) if after is not None else wait
        if attempt + 1 < times:
            sleep(wait)
    return None, error


def signed_request(url: str, fixed: dict[str, str], secret: str, timestamp: int) -> tuple[str, dict[str, str], dict[str, str]]:
    """(URL without its query, parameters, signing headers) of a request that is signed by its parameters.

    The query's parameters win over `fixed` ones; the signature is the md5 of the
    sorted non-blank parameters, the time in milliseconds and the secret.
    """
    split = urlsplit(url)
    parameters = fixed | dict(reversed(parse_qsl(split.query)))
    text = "&".join(f"{k}={v}" for k, v in sorted(parameters.items()) if v.strip())
    sign = hashlib.md5(f"{text}{timestamp}{secret}".encode()).hexdigest()
    return f"{split.scheme}://{split.netloc}{split.path}", parameters, {"sign": sign, "signTimeStamp": str(timestamp)}


def signed_fetcher(get: Callable[[str, dict, dict], tuple[int, str, float | None]], fixed: dict[str, str], secret: str, times: int = 3, delay: float = 2.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
    """A fetcher (url -> body, error) of signed requests; each try has a time and a signature of its own."""

    def once(url: str) -> tuple[int, str, float | None]:
        try:
            return get(*signed_request(url, fixed, secret, int(clock() * 1000)))
        except Exception as e:  # every failure is tried again here
            raise ConnectionError(str(e)) from e

    return lambda url: fetch_with_retries(once, url, times, delay, sleep)


#: What a source's status row may say beside status and articles: results before accounts were matched, and matched ones.
METRICS = ("raw_count", "matched_count")


def run_sources(plans: dict[str, Callable[[], tuple[DataFrame, DataFrame]]], spark: SparkSession, clock: Callable[[], float] = time.monotonic) -> tuple[dict[str, DataFrame], DataFrame]:
    """Scan each source (name -> function giving its rows and its status row); one that raises fails alone.

    Gives the rows of each source, and source, status, articles, seconds, error and METRICS of all.
    """
    rows, states = {}, []
    for name, plan in plans.items():
        began = clock()
        try:
            found, state = plan()
            first = state.first()
            rows[name] = found
            more = [int(first[m]) if first and m in state.columns and first[m] is not None else None for m in METRICS]
            states.append((name, first["status"] if first else "empty", int(first["articles"]) if first else 0, clock() - began, None, *more))
        except Exception as e:  # whatever a source does, the others go on
            states.append((name, "failed", 0, clock() - began, f"{type(e).__name__}: {e}"[:500], None, None))
    return rows, spark.createDataFrame(states, "source string, status string, articles long, seconds double, error string, raw_count long, matched_count long")


class PageSource(DataSource):
    """Pages of a plan through an injected fetcher, a partition per page; errors are rows, never failures.

    Options: plan (JSON list of [source, page_num, url]); the subclass made by
    `page_source` carries the fetcher.
    """

    fetcher: Callable[[str], tuple[str | None, str | None]] | None = None

    @classmethod
    def name(cls) -> str:
        return "tidewater_pages"

    def schema(self) -> str:
        return CRAWL_PAGE

    def reader(self, schema) -> DataSourceReader:
        import json

        return _PageReader(json.loads(self.options.get("plan", "[]")), type(self).fetcher)


class _PageReader(DataSourceReader):
    def __init__(self, plan: list, fetcher):
        self.plan, self.fetcher = plan, fetcher

    def partitions(self) -> list[InputPartition]:
        return [_Page(*p) for p in self.plan] or [_Page("", 0, "")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if partition.url:
            body, error = self.fetcher(partition.url)
            yield partition.source, partition.page_num, partition.url, body, error


def page_source(spark: SparkSession, fetcher: Callable[[str], tuple[str | None, str | None]]) -> str:
    """Register the data source with a fetcher (url -> body, error); returns the format's name."""
    kind = type("FetchedPages", (PageSource,), {"fetcher": staticmethod(fetcher)})
    spark.dataSource.register(kind)
    return kind.name()


def scan_with_retry(run: Callable[[], list[str]], sleep: Callable[[float], None], delays: tuple[float, ...] = (1800.0, 5400.0), selective: bool = False) -> int:
    """Run a scan; while every source failed (and none was selected) wait and run it again. How often it was run again.

    `run` gives the statuses of its sources.
    """
    statuses, again = run(), 0
    for delay in () if selective else delays:
        if not statuses or any(s != "failed" for s in statuses):
            break
        sleep(delay)
        statuses, again = run(), again + 1
    return again
