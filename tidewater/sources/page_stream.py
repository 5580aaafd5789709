"""Scans that stop while they fetch: a stream whose next page depends on what became of the page before.

A source's offset is the last page that is planned for it. Each micro-batch has one
page of every source that goes on; the pages land, Spark counts their items and which
of them are new, and the verdicts (one for each page) are written where the reader of
the stream finds them. So nothing is fetched behind a page that failed, that was empty
or that brought nothing new, and a source that stops or fails stops alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidewater.schemas import CRAWL_PAGE
from tidewater.sources.scan import scan

Fetcher = Callable[[str], tuple[str | None, str | None]]


class _Planned(InputPartition):
    def __init__(self, source: str, page_num: int, url: str):
        self.source, self.page_num, self.url = source, page_num, url


def read_verdicts(folder: str) -> dict[str, dict[int, bool]]:
    """Whether the scan goes on after a page, by source and page."""
    found: dict[str, dict[int, bool]] = {}
    for path in sorted(Path(folder).glob("*.json")):
        for source, page, go_on in json.loads(path.read_text(encoding="utf-8")):
            found.setdefault(source, {})[page] = go_on
    return found


def write_verdicts(folder: str, number: int, rows: list[tuple[str, int, bool]]) -> None:
    """The verdicts of a batch, there as a whole or not at all."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    fresh = Path(folder) / f".{number}.new"
    fresh.write_text(json.dumps(rows), encoding="utf-8")
    os.replace(fresh, Path(folder) / f"{number:09d}.json")


class _Reader(DataSourceStreamReader):
    """Plans pages; offsets follow from the verdicts alone, so a restart goes on where the scan was."""

    def __init__(self, plan: list, verdicts: str, fetcher: Fetcher | None):
        self.urls: dict[str, dict[int, str]] = {}
        for source, page, url in plan:
            self.urls.setdefault(source, {})[page] = url
        self.verdicts, self.fetcher = verdicts, fetcher

    def initialOffset(self) -> dict:
        return {source: 0 for source in self.urls}

    def latestOffset(self) -> dict:
        judged = read_verdicts(self.verdicts)
        out = {}
        for source, pages in self.urls.items():
            known = judged.get(source, {})
            last = max(known, default=0)
            out[source] = last + 1 if known.get(last, True) and last + 1 in pages else last
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Planned(s, p, self.urls[s][p]) for s in self.urls for p in range(start.get(s, 0) + 1, end.get(s, 0) + 1)]

    def read(self, partition: _Planned) -> Iterator[tuple]:
        body = error = None
        if self.fetcher is not None:
            try:
                body, error = self.fetcher(partition.url)
            except Exception as e:  # a page that can't be fetched is a row, and ends its own source alone
                error = f"{type(e).__name__}: {e}"
        yield partition.source, partition.page_num, partition.url, body, error

    def commit(self, end: dict) -> None:
        pass


class PageStream(DataSource):
    """Options: plan (JSON list of [source, page_num, url]) and verdicts (a folder of the driver's)."""

    fetcher: Fetcher | None = None

    @classmethod
    def name(cls) -> str:
        return "tidewater_page_stream"

    def schema(self) -> str:
        return CRAWL_PAGE

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(json.loads(self.options["plan"]), self.options["verdicts"], type(self).fetcher)


def stream_scan(
    spark: SparkSession, plan: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, state: str, cut: Callable[[DataFrame], DataFrame],
    fetcher: Fetcher | None = None, landed: DataFrame | None = None,
) -> StreamingQuery:
    """Start a scan of the pages of `plan` (source, page_num, url; a row for each page that a source may have).

    `parse` gives the items (source, page_num, pos, url and more) of fetched pages.
    Pages come from `fetcher` (url -> body, error), or are looked up in `landed`
    (url, body, fetch_error). Items land in `out`/items, pages in `out`/pages;
    `state` is a folder of the driver's for verdicts, `out`/checkpoint Spark's own.
    """
    kind = type("ScannedPages", (PageStream,), {"fetcher": staticmethod(fetcher) if fetcher else None})
    spark.dataSource.register(kind)
    rows = [[r.source, r.page_num, r.url] for r in plan.select("source", "page_num", "url").collect()]  # configured sources and their page limits
    pages = spark.readStream.format(kind.name()).option("plan", json.dumps(rows)).option("verdicts", state).load()

    def judge(batch: DataFrame, number: int) -> None:
        if landed is not None:
            wanted = batch.select("source", "page_num", "url")
            batch = wanted.join(landed.select("url", "body", "fetch_error"), "url", "left").withColumn("fetch_error", F.when(F.col("body").isNull(), F.coalesce("fetch_error", F.lit("not there"))).otherwise(F.col("fetch_error")))
        batch = cut(batch)
        items = cut(parse(batch.where("fetch_error is null")))
        first = items.groupBy("source", "url").agg(F.min(F.struct("page_num", "pos")).alias("first"))
        before = _landed(spark, f"{out}/items", items, number)
        if before is not None:
            first = first.join(before.select("source", "url").distinct(), ["source", "url"], "left_anti")
        new = first.groupBy("source", F.col("first.page_num").alias("page_num")).agg(F.count("*").alias("new"))
        counts = items.groupBy("source", "page_num").agg(F.count("*").alias("items"))
        judged = batch.select("source", "page_num", "fetch_error").join(counts, ["source", "page_num"], "left").join(new, ["source", "page_num"], "left").na.fill(0, ["items", "new"])
        go_on = F.col("fetch_error").isNull() & (F.col("items") > 0) & ((F.col("page_num") == 1) | (F.col("new") > 0))
        judged = cut(judged.withColumn("go_on", go_on))
        items.write.mode("overwrite").parquet(f"{out}/items/batch={number}")
        judged.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        write_verdicts(state, number, [(r.source, r.page_num, r.go_on) for r in judged.collect()])  # one page of each source

    return pages.writeStream.foreachBatch(judge).option("checkpointLocation", f"{out}/checkpoint").start()


def _landed(spark: SparkSession, path: str, like: DataFrame, number: int) -> DataFrame | None:
    """Items of the batches before this one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") < number).drop("batch")


def scanned(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Kept items and one status row per source of a scan that has ended."""
    return scan(spark.read.parquet(f"{out}/pages").drop("batch"), spark.read.parquet(f"{out}/items").drop("batch"))
