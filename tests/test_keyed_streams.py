"""Keyed state of streams against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import dedup, events
from tidewater.storage import cut
from tidewater.streaming import keyed

DAY = dt.datetime(2026, 1, 1)
SCHEMA = "id long, canonical_url string, normalized_title string, source string, created_at timestamp"


def arrive(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/part={n}")


@pytest.mark.parametrize("seed", [1])
def test_micro_batches_keep_what_one_batch_keeps(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "", "u1", "u2", "u3", "u4", "u5"]), rnd.choice([None, "a", "b", "c"]), rnd.choice([None, "s", "s", "t"]), DAY + dt.timedelta(days=rnd.randrange(400), hours=rnd.randrange(24))) for i in range(150)]
    rows.sort(key=lambda r: (r[4], r[0]))
    arrivals, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    edges = sorted(rnd.sample(range(1, len(rows)), 3))
    for n, (a, b) in enumerate(zip([0, *edges], [*edges, len(rows)])):
        arrive(spark, rows[a:b], SCHEMA, arrivals, n)
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(arrivals)
        keyed.run_until_idle(keyed.dedup_stream(spark, stream, store, check, cut, partitions=2))
    got = sorted(r.id for r in spark.read.parquet(store).collect())
    want = sorted(r.id for r in dedup.keep_disjunctive(spark.createDataFrame(rows, SCHEMA), cut).where("kept").collect())
    assert got == want


def test_stored_rows_are_not_read_again(spark, tmp_path):
    """Later batches are judged by the states alone: what is stored may be gone."""
    arrivals, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))

    def run(n, *rows):
        arrive(spark, [(i, u, t, "s", DAY + dt.timedelta(days=d)) for i, u, t, d in rows], SCHEMA, arrivals, n)
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(arrivals)
        keyed.run_until_idle(keyed.dedup_stream(spark, stream, store, check, cut, partitions=2))

    run(0, (1, "u", "a", 0), (2, "v", "b", 1))
    kept = {r.id for r in spark.read.parquet(store).collect()}
    for f in (tmp_path / "store").rglob("*.parquet"):
        f.unlink()
    run(1, (3, "u", "x", 80), (4, "w", "b", 85), (5, "y", "z", 85))
    run(2, (6, "u", "q", 95), (7, "y", "r", 96))
    kept |= {r.id for r in spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(store).collect()}
    assert kept == {1, 2, 5, 6}


def test_states_are_kept_without_python(spark, tmp_path):
    """States are running maxima by slice; kept rows set them along with the next arrivals, also for rows out of order and in slices beside theirs."""
    arrivals, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    parts = [[(1, "u", "a", 0), (2, "v", "b", 95)], [(3, "u", "x", 80), (4, "v", "y", 89), (5, "t", "b", 10), (6, "w", "z", 95)], [(7, "w", "q", 185), (8, "w", "r", 186)]]
    for n, rows in enumerate(parts):
        arrive(spark, [(i, u, t, "s", DAY + dt.timedelta(days=d)) for i, u, t, d in rows], SCHEMA, arrivals, n)
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(arrivals)
        query = keyed.dedup_stream(spark, stream, store, check, cut, partitions=2, available=True)
        query.awaitTermination()
        assert [p.batchId for p in query.recentProgress] == [n]
        assert [o.operatorName for o in query.lastProgress.stateOperators] == ["stateStoreSave"]
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == [1, 2, 6, 8]


def test_rounds_send_nothing_through_the_driver(spark):
    """No round broadcasts the states of the slices."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return cut(df)

    rows = cut(spark.createDataFrame([(i, f"u{i % 3}", f"t{i % 2}", "s", DAY + dt.timedelta(days=i)) for i in range(6)], SCHEMA))
    kept = dedup.keep_disjunctive(rows, seen)
    assert [r.id for r in kept.where("kept").orderBy("id").collect()] == [0, 1]
    plans.append(kept._jdf.queryExecution().sparkPlan().toString())
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


REPORT = "event_key string, id long, tier string, priority int, completeness int, publish_date string, created_at timestamp"


def after_each_arrival(rows, hours=24):
    """Actions as if a run followed each arrival, and what still waits."""
    state, done = {}, []
    for key, i, tier, prio, comp, date, at in sorted(rows, key=lambda r: (r[6], r[1])):
        waiting, out = state.get(key, (None, None))
        if waiting and waiting[1] <= at:
            done.append((waiting[0][3], "push", None, waiting[1]))
            out, waiting = waiting[0], None
        mine = (prio, comp, date, i)
        if out:
            done.append((i, "supersede", None, at))
            if mine > out:
                done.append((out[3], "take_over", i, at))
                out = (prio, *out[1:])
        elif waiting and waiting[0] > mine:
            done.append((i, "supersede", None, at))
        else:
            if waiting:
                done.append((waiting[0][3], "supersede", None, at))
            waiting = (mine, at + dt.timedelta(hours=hours)) if tier == "aggregator" else None
            if not waiting:
                done.append((i, "push", None, at))
                out = mine
        state[key] = (waiting, out)
    return done, {k: w for k, (w, _) in state.items() if w}


def test_release_by_timers(spark, tmp_path):
    rnd = random.Random(4)
    tiers = list(events.TIER_PRIORITY.items())
    rows = []
    for i in range(120):
        tier, prio = rnd.choice(tiers + [("aggregator", 100)] * 4)
        rows.append((f"e{rnd.randrange(25)}", i, tier, prio, rnd.randrange(4), rnd.choice(["", "2026-01-01"]), DAY + dt.timedelta(minutes=40 * i)))
    reports, check, out = (str(tmp_path / n) for n in ("in", "check", "out"))

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for n, a in enumerate(range(0, 120, 30)):
        arrive(spark, rows[a : a + 30], REPORT, reports, n)
        stream = spark.readStream.schema(REPORT).option("recursiveFileLookup", "true").parquet(reports)
        keyed.run_until_idle(keyed.release_stream(spark, stream, sink, check, partitions=2))
    got = sorted((r.id, r.action, r.better_id or -1, r.at) for r in spark.read.parquet(out).collect())
    done, waiting = after_each_arrival(rows)
    watermark = rows[-1][6] - dt.timedelta(hours=1)
    done += [(w[0][3], "push", None, w[1]) for w in waiting.values() if w[1] <= watermark]
    assert got == sorted((i, a, b if b is not None else -1, at) for i, a, b, at in done)
    assert {a for _, a, _, _ in got} == {"push", "supersede", "take_over"}


def test_one_arrival_is_what_a_merge_says(spark):
    """The rules of the state are those of the batch form, for one run after an arrival."""
    rows = [("e", 1, "aggregator", 100, 3, "", DAY), ("e", 2, "official_wechat", 300, 0, "", DAY + dt.timedelta(hours=1)), ("f", 3, "aggregator", 100, 0, "", DAY), ("g", 4, "aggregator", 100, 0, "", DAY - dt.timedelta(hours=30))]
    df = spark.createDataFrame(rows, REPORT).withColumn("status", F.lit("ready_to_push"))
    got = {r.id: r.action for r in events.merge(df, F.lit(DAY + dt.timedelta(hours=1))).collect()}
    assert got == {1: "supersede", 2: "push", 3: "wait", 4: "push"}
