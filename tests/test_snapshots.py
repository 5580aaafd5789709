"""Commits of keyed tables: what is rewritten, who wins, and what readers see."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import state
from tidewater.sources.snapshots import Conflict, Table


def make(spark, tmp_path, n=1000, size=50):
    rows = spark.range(n).select("id", F.lit("discovered").alias("status"), F.lit(0).alias("attempt_count"))
    return Table.create(spark, f"file://{tmp_path}/t", rows, "id", size)


def mark(rows, ids):
    return rows.withColumn("status", F.when(F.col("id").isin(ids), "pushed").otherwise(F.col("status")))


def test_a_change_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    table = make(spark, tmp_path)
    before = table.latest()
    ids = list(range(990, 1000))  # one in a hundred, those that came last
    table.change(spark.createDataFrame([(i,) for i in ids], "id long"), lambda rows: mark(rows, ids))
    after = table.latest()
    assert after.number == before.number + 1 and len(before.files) == 20
    assert {b for b in after.files if after.files[b] != before.files[b]} == {19}
    assert table.read().count() == 1000 and {r.id for r in table.read().where("status = 'pushed'").collect()} == set(ids)
    assert table.read(before).where("status = 'pushed'").count() == 0  # readers of the old version see it whole
    # the files of a bucket that was not touched are read as they are
    assert all(f in before.files[0] for f in after.files[0])


def test_of_two_writers_one_fails_and_tries_again(spark, tmp_path):
    table, other = make(spark, tmp_path, 100), Table(spark, f"file://{tmp_path}/t")
    keys = spark.createDataFrame([(7,), (60,)], "id long")
    calls = []

    def slow(rows):
        if not calls:  # another writer commits between our read and our commit
            other.change(keys, lambda r: r.withColumn("attempt_count", F.col("attempt_count") + 1))
        calls.append(1)
        return rows.withColumn("attempt_count", F.col("attempt_count") + 1)

    with pytest.raises(Conflict):
        table.change(keys, slow, tries=1)
    assert table.latest().number == 1 and table.read().agg(F.max("attempt_count")).first()[0] == 1
    calls.clear()
    table.change(keys, slow)
    assert len(calls) == 2 and table.latest().number == 3
    assert table.read().agg(F.max("attempt_count"), F.count("*")).first()[:] == (3, 100)


def test_appends_read_nothing_and_number_after_the_largest(spark, tmp_path):
    table, other = make(spark, tmp_path, 100), Table(spark, f"file://{tmp_path}/t")
    first = table.latest()
    fresh = lambda v, n: spark.range(n).select((F.col("id") + v.most + 1).alias("id"), F.lit("new").alias("status"), F.lit(0).alias("attempt_count"))
    raced = []

    def rows(version):
        if not raced:
            raced.append(other.add(lambda v: fresh(v, 5)))
        return fresh(version, 10)

    table.add(rows)
    last = table.latest()
    assert last.number == 2 and last.most == 114
    assert sorted(r.id for r in table.read().collect()) == list(range(115))
    assert all(set(first.files[b]) <= set(last.files[b]) for b in first.files)


def test_a_change_may_add_rows_of_its_keys_only(spark, tmp_path):
    table = make(spark, tmp_path, 100)
    keys = spark.createDataFrame([(3,)], "id long")
    with pytest.raises(ValueError):
        table.change(keys, lambda rows: rows.unionByName(rows.limit(1).withColumn("id", F.lit(99).cast("long"))))
    assert table.latest().number == 0 and table.read().count() == 100
    table.change(keys.where("false"), lambda rows: rows)
    assert table.latest().number == 0


def test_clean_keeps_what_versions_name(spark, tmp_path):
    table = make(spark, tmp_path, 100)
    keys = spark.createDataFrame([(3,)], "id long")
    for _ in range(3):
        table.change(keys, lambda rows: rows.withColumn("attempt_count", F.col("attempt_count") + 1))
    table.clean(2)
    assert table.read().agg(F.max("attempt_count"), F.count("*")).first()[:] == (3, 100)
    assert table.read(table.at(2)).agg(F.max("attempt_count")).first()[0] == 2
    assert len(list((tmp_path / "t" / "manifests").glob("*.json"))) == 2


def test_a_table_is_created_once_and_empty_ones_are_tables(spark, tmp_path):
    table = Table.create(spark, f"file://{tmp_path}/e", spark.createDataFrame([], "id long, status string"))
    assert table.read().collect() == [] and table.read().columns == ["id", "status"]
    with pytest.raises(Conflict):
        Table.create(spark, f"file://{tmp_path}/e", spark.createDataFrame([], "id long, status string"))
    table.add(lambda v: spark.createDataFrame([(v.most + 1, "x")], "id long, status string"))
    assert [tuple(r) for r in table.read().collect()] == [(1, "x")]


def test_transitions_of_a_table(spark, tmp_path):
    from tidewater.schemas import ARTICLE

    rows = spark.range(1, 201).select(
        "id", *[F.lit("x").alias(c) for c in ("title", "normalized_title", "url", "canonical_url", "dedup_key", "source", "publish_date", "summary", "raw_content")], F.lit("ai_pending").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in ("ai_reason", "last_error")], F.lit(0).alias("attempt_count"), F.lit(2).alias("pipeline_version"), *[F.lit("2026-01-01").cast("timestamp").alias(c) for c in ("created_at", "updated_at")],
        F.lit(None).cast("timestamp").alias("pushed_at"),
    )
    table = Table.create(spark, f"file://{tmp_path}/a", spark.createDataFrame(rows.rdd, ARTICLE), "id", 20)
    changes = spark.createDataFrame([(199, "ready_to_push"), (200, "ai_rejected")], "id long, status string")
    now = F.lit("2026-01-02").cast("timestamp")
    table.change(changes, lambda part: state.transition(part, changes, now))
    got = {r.id: r.status for r in table.read().where("updated_at = timestamp'2026-01-02'").collect()}
    assert got == {199: "ready_to_push", 200: "ai_rejected"} and table.read().count() == 200
