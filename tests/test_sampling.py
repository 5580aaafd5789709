"""Apportionment, samples, resampling and stored arrays against plain versions."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import evaluate, health, state


def test_apportionment_is_allocation(spark):
    rnd = random.Random(2)
    for n, most in ((1, 5), (7, 30), (60, 4), (300, 50)):
        sizes = {f"s{i:04}": rnd.randrange(1, most) for i in range(n)}
        table = spark.createDataFrame(list(sizes.items()), "source string, population long")
        for target in sorted({0, 1, n - 1, n, n + 3, sum(sizes.values()) // 2, sum(sizes.values()) - 1, sum(sizes.values()), 10**6}):
            got = {r.source: r.sample_size for r in evaluate.apportion(table, target).collect()}
            assert got == evaluate.allocate(sizes, target), (n, target)


def test_apportionment_of_very_many_groups(spark):
    table = spark.range(100_000).select(F.format_string("s%06d", "id").alias("source"), (1 + F.col("id") * 7919 % 1000).alias("population"))
    got = evaluate.apportion(table, 1_234_567)
    total, n, least, over = got.agg(F.sum("sample_size"), F.count("*"), F.min("sample_size"), F.count_if(F.col("sample_size") > F.col("population"))).first()
    assert (total, n, least, over) == (1_234_567, 100_000, 1, 0)
    sizes = {r.source: r.population for r in table.collect()}
    want = evaluate.allocate(sizes, 1_234_567)
    assert {r.source: r.sample_size for r in got.collect()} == want


def test_ordered_positions(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(4), rnd.choice("abc")) for i in range(500)]
    got = state.ordered_positions(spark.createDataFrame(rows, "id int, a int, b string").repartition(6), F.col("a").desc(), "b", "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.__getitem__("__position"))] == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]


def test_bottom_of_a_group_of_all_rows(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("g")).withColumn("k", F.when(F.col("g") == "hot", 25).otherwise(7))
    order = F.sha2(F.col("id").cast("string"), 256)
    got = sorted(r.id for r in evaluate.bottom(rows, "g", order, "k").collect())
    want = []
    for g, k in (("hot", 25), ("rare", 7)):
        want += [r.id for r in rows.where(F.col("g") == g).orderBy(order).limit(k).collect()]
    assert got == sorted(want)


def test_last_runs_of_a_source_are_cut_before_they_are_shuffled(spark):
    """The last rows of each source by id are found in each task first: no source is one sort of all its runs."""
    runs = spark.range(1000).select("id", F.when(F.col("id") < 990, "a").otherwise("b").alias("source"), F.lit("success").alias("status"), (F.col("id") % 9 + 1).cast("int").alias("article_count")).repartition(4)
    for found in (health.baseline(runs), health.failure_streak(runs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan


def test_each_resample_has_its_stratum_s_size():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 1, 0, 40, 4])
    drawn = np.stack(list(evaluate._split(rng, np.full(20_000, 50), sizes)))
    assert (drawn.sum(0) == 50).all() and (drawn >= 0).all()
    assert np.allclose(drawn.mean(1), sizes, atol=0.15)
    assert np.allclose(drawn.var(1), 50 * sizes / 50 * (1 - sizes / 50), atol=0.6)  # as of a multinomial


def plain_bootstrap(rows, iterations, seed):
    rng = np.random.default_rng(seed)
    strata = sorted({r[0] for r in rows})
    out = {n: [] for n in ("accuracy", "precision", "recall", "f1")}
    for _ in range(iterations):
        c = np.zeros(4)
        for s in strata:
            own = [r for r in rows if r[0] == s]
            for i in range(len(own)) if own[0][4] else rng.integers(0, len(own), len(own)):
                c[2 * own[i][1] + own[i][2]] += own[i][3]
        tn, fn, fp, tp = c
        p, r = tp / (tp + fp), tp / (tp + fn)
        for n, v in (("accuracy", (tp + tn) / c.sum()), ("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r))):
            out[n].append(v)
    return {n: np.percentile(v, [2.5, 97.5]) for n, v in out.items()}


def test_intervals_agree_with_a_plain_bootstrap(spark):
    rnd = random.Random(7)
    rows = [(f"s{i % 3}", rnd.random() < 0.6, rnd.random() < 0.5, 1.0 if i % 3 else round(rnd.uniform(0.5, 6), 3), i % 3 == 2) for i in range(240)]
    rows = [(s, p, a, 1.0 if census else w, census) for s, p, a, w, census in rows]
    table = spark.createDataFrame(rows, "stratum string, predicted boolean, actual boolean, weight double, census boolean")
    got = {r.name: (r.low, r.high) for r in evaluate.bootstrap(spark, table, 2000).collect()}
    want = plain_bootstrap(rows, 2000, 5)
    for n, (low, high) in want.items():
        assert abs(got[n][0] - low) < 0.02 and abs(got[n][1] - high) < 0.02, (n, got[n], low, high)


def test_stored_arrays_are_read_with_recovery(spark):
    cases = [('["a", "b"]', ["a", "b"]), ("[]", []), (None, []), ("", []), ("  ", []), ("[broken", []), ('{"a": 1}', []), ('"text"', []), ("7", []), ("null", []), ('["a", 1, null, true, "ä\\u4f60"]', ["a", "1", "None", "True", "ä你"]), ("[false]", ["False"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, c string").select("id", text.text_array(F.col("c")).alias("v"), text.array_problem(F.col("c")).alias("bad"))
    got = {r.id: (list(r.v), r.bad) for r in df.collect()}
    for i, (c, want) in enumerate(cases):
        is_array = False
        try:
            is_array = isinstance(json.loads(c or ""), list)
        except ValueError:
            pass
        assert got[i] == (want, bool(c) and not is_array), c
