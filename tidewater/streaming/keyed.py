"""Dedup and delayed release as keyed state of a stream.

Dedup has two keys, the URL and the pair of title and source, and a row's verdict needs
both, so it has two phases. The state of a key in a slice of time is when a row of it that
can forbid a row of the slice was last kept: a running maximum, which Spark keeps and drops
behind the watermark without Python. In the first phase each key that has arrivals answers
with its state; rows that a kept row forbids go, and the others are decided among
themselves. In the second phase the kept rows, once they are written, come back as a stream
of their own and set the states of their keys before the next arrivals are judged. So no
batch reads what is stored.

Release keeps the best report of an event as state; an aggregator's report has a timer,
and goes out when event time reaches it unless a better source came before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewater.operators.dedup import keep_disjunctive

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["id", "canonical_url", "normalized_title", "source", "created_at"]


def _ms(value) -> int:
    return int(pd.Timestamp(value).value // 1_000_000)


def _keys() -> Column:
    """The keys of a row under which it is looked up; none for nulls and for an empty URL."""
    url = F.when(F.coalesce("canonical_url", F.lit("")) != "", F.struct(F.lit("url").alias("kind"), F.col("canonical_url").alias("k1"), F.lit("").alias("k2")))
    title = F.when(F.col("normalized_title").isNotNull() & F.col("source").isNotNull(), F.struct(F.lit("title").alias("kind"), F.col("normalized_title").alias("k1"), F.col("source").alias("k2")))
    return F.array_compact(F.array(url, title))


def dedup_stream(
    spark: SparkSession, arrivals: DataFrame, store: str, checkpoint: str, cut: Callable[[DataFrame], DataFrame], days: int = 90, partitions: int | None = None, available: bool = False,
) -> StreamingQuery:
    """Start a stream that appends the kept rows of `arrivals` (a stream with at least KEYS) to `store`/batch=<number>.

    Arrivals of later batches must not be more than `days` older than those before;
    within a batch they come in any order. Every batch's folder is overwritten when
    the batch is run again, and setting a state twice is setting it once. With `available`
    the stream ends with what has arrived when it starts; rows it keeps set their states
    in the next start's batch, along with that one's arrivals.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrivals.schema.fields)
    make_folder(spark, store)
    kept = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(store)
    both = arrivals.withColumn("kept", F.lit(False)).unionByName(kept.withColumn("kept", F.lit(True)))
    at, span = F.col("created_at").cast("timestamp"), F.expr(f"interval {days} days")
    # a kept row forbids rows of its own slice and, as arrivals are up to `days` out of order, of the slices beside it
    slices = F.when(F.col("kept"), F.array(at - span, at, at + span)).otherwise(F.array(at))
    keyed = both.select(F.explode(_keys()).alias("k"), F.when(F.col("kept"), at).alias("last"), slices.alias("slices")).select("k.*", "last", F.explode("slices").alias("at"))
    # times are up to `days` ahead of the newest row, and rows `days` older ask for what was kept `days` before them
    states = keyed.withWatermark("at", f"{3 * days} days").groupBy(F.window("at", f"{days} days"), "kind", "k1", "k2").agg(F.max("last").alias("last")).where("last is not null")
    row = F.struct(*arrivals.columns).alias("row")
    nothing = F.lit(None).cast("string")
    passed = arrivals.select(row, F.lit(None).cast("timestamp").alias("slice"), nothing.alias("kind"), nothing.alias("k1"), nothing.alias("k2"), F.lit(None).cast("timestamp").alias("last"))
    answers = states.select(F.lit(None).cast(passed.schema["row"].dataType).alias("row"), F.col("window.start").alias("slice"), "kind", "k1", "k2", "last")
    since = at - span

    def decide(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        rows = batch.where("row is not null").select("row.*")
        if rows.isEmpty():
            return
        last = batch.where("kind is not null")
        by_url = last.where("kind = 'url'").select(F.col("slice").alias("__w"), F.col("k1").alias("__u"), F.col("last").alias("__last_u"))
        by_title = last.where("kind = 'title'").select(F.col("slice").alias("__w"), F.col("k1").alias("__t"), F.col("k2").alias("__s"), F.col("last").alias("__last_t"))
        known = rows.withColumn("__slice", F.window(at, f"{days} days")["start"])
        known = known.join(by_url.hint("merge"), (F.col("canonical_url") == F.col("__u")) & (F.col("__slice") == F.col("__w")), "left").drop("__w")
        known = known.join(by_title.hint("merge"), (F.col("normalized_title") == F.col("__t")) & (F.col("source") == F.col("__s")) & (F.col("__slice") == F.col("__w")), "left")
        free = known.where(~F.coalesce(F.col("__last_u") >= since, F.lit(False)) & ~F.coalesce(F.col("__last_t") >= since, F.lit(False))).select(rows.columns)
        kept_now = keep_disjunctive(free, cut, days).where("kept").drop("kept")
        kept_now.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = passed.unionByName(answers).writeStream.outputMode("update").foreachBatch(decide).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available else writer
    # states that have expired are dropped by the next batch, not by one of their own
    return _with_state(spark, lambda: writer.start(), partitions, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})


def run_until_idle(query: StreamingQuery) -> None:
    """Process what has arrived, and the kept rows that come back, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _with_state(spark: SparkSession, start: Callable[[], StreamingQuery], partitions: int | None = None, more: dict[str, str] | None = None) -> StreamingQuery:
    """Start a query under the settings that keyed state needs; the session's own come back.

    Every partition of a state is a store that each batch opens, so unless `partitions`
    says otherwise there are at most two for each core, however many a shuffle has.
    """
    partitions = partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)} | (more or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


#: The tier whose reports wait (a fixed value of the tiers).
AGGREGATOR = "aggregator"
ACTIONS = "event_key string, id long, action string, better_id long, at timestamp"


class Release(StatefulProcessor):
    """State of an event: the report that waits, and the one that went out.

    As if a run followed each arrival: an official source's report goes out at once,
    an aggregator's waits for its time, of two that wait the lesser is superseded.
    When one is out others are superseded, and one of more authority takes over.
    """

    def __init__(self, delay_hours: int):
        self.delay = delay_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rank = "priority int, completeness int, publish_date string, id long"
        self.waiting = handle.getValueState("waiting", f"{rank}, due long")
        self.out = handle.getValueState("out", rank)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the order of arrival decides, so a batch's reports of one event are put in order; what a batch holds is bounded by its source
        arrived = pd.concat(list(rows)).sort_values(["created_at", "id"])
        waiting = tuple(self.waiting.get()) if self.waiting.exists() else None
        out = tuple(self.out.get()) if self.out.exists() else None
        held = waiting
        done: list[tuple] = []
        for r in arrived.itertuples(index=False):
            at = _ms(r.created_at)
            if waiting is not None and waiting[4] <= at:
                done.append((waiting[3], "push", None, waiting[4]))
                out, waiting = waiting[:4], None
            mine = (int(r.priority), int(r.completeness), r.publish_date or "", int(r.id))
            if out is not None:
                done.append((mine[3], "supersede", None, at))
                if mine > out:
                    done.append((out[3], "take_over", mine[3], at))
                    out = (mine[0], *out[1:])  # it has the better one's source from now on
            elif waiting is not None and waiting[:4] > mine:
                done.append((mine[3], "supersede", None, at))
            else:
                if waiting is not None:
                    done.append((waiting[3], "supersede", None, at))
                    waiting = None
                if r.tier == AGGREGATOR:
                    waiting = (*mine, at + self.delay)
                else:
                    done.append((mine[3], "push", None, at))
                    out = mine
        if waiting != held:
            if held is not None:
                self.handle.deleteTimer(held[4])
            if waiting is None:
                self.waiting.clear()
            else:
                self.waiting.update(waiting)
                self.handle.registerTimer(waiting[4])
        if out is not None:
            self.out.update(out)
        if done:
            yield self._frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = tuple(self.waiting.get()) if self.waiting.exists() else None
        if waiting is None or waiting[4] > expiredTimerInfo.getExpiryTimeInMs():
            yield self._frame(key, [])
            return
        self.waiting.clear()
        self.out.update(waiting[:4])
        yield self._frame(key, [(waiting[3], "push", None, waiting[4])])

    @staticmethod
    def _frame(key, done: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*done)) or [()] * 4
        kinds = ("int64", "object", "Int64", "int64")
        frame = pd.DataFrame({n: pd.Series(c, dtype=k) for n, c, k in zip(("id", "action", "better_id", "at"), columns, kinds)})
        frame.insert(0, "event_key", pd.Series([key[0]] * len(done), dtype="object"))
        return frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))

    def close(self) -> None:
        pass


def release_stream(spark: SparkSession, reports: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, delay_hours: int = 24, late: str = "1 hour", partitions: int | None = None) -> StreamingQuery:
    """Start a stream that hands the actions of an event's reports to `sink` (batch, its number) as they are due.

    `reports`: event_key, id, tier, priority, completeness, publish_date, created_at,
    at most `late` out of order from batch to batch. Nothing is scanned for reports that
    wait: their timers fire when event time has passed them.
    """
    rows = reports.select("event_key", "id", "tier", "priority", "completeness", F.coalesce("publish_date", F.lit("")).alias("publish_date"), F.col("created_at").cast("timestamp").alias("created_at"))
    actions = rows.withWatermark("created_at", late).groupBy("event_key").transformWithStateInPandas(Release(delay_hours), ACTIONS, "Append", "EventTime")
    return _with_state(spark, lambda: actions.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start(), partitions)
