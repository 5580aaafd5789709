"""Pruned lookups of stored keys against the plain anti join."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewater.operators import dedup
from tidewater.sources import key_files

DAY = dt.datetime(2025, 1, 1)
SCHEMA = "id long, canonical_url string, normalized_title string, source string, created_at timestamp"


def rows(rnd, n, first, days, urls):
    return [(i, rnd.choice([None, "", *[f"u{rnd.randrange(urls)}"] * 8]), rnd.choice([None, f"t{rnd.randrange(urls)}"]), rnd.choice([None, "s", "t"]), DAY + dt.timedelta(days=first + rnd.randrange(days), hours=rnd.randrange(24))) for i in range(n)]


def test_same_rows_from_fewer_files(spark, tmp_path):
    rnd = random.Random(9)
    stored = spark.createDataFrame(rows(rnd, 3000, 0, 700, 600), SCHEMA)
    incoming = spark.createDataFrame(rows(rnd, 12, 600, 3, 600), SCHEMA)
    path = f"file://{tmp_path}/k"
    key_files.write_keys(stored.where("id < 2000"), path)
    key_files.write_keys(stored.where("id >= 2000"), path)  # appended, indexed by file
    got = key_files.anti_window_files(incoming, path)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in dedup.anti_window(incoming, stored).collect())
    files = key_files.files_that_may_match(incoming, path)
    every = {r[0] for r in spark.read.parquet(f"{path}/keys").select(F.col("_metadata.file_path")).distinct().collect()}
    months = {int(f.split("month=")[1][:6]) for f in files}
    assert 0 < len(files) < len(every) / 8 and months <= {202605, 202606, 202607, 202608}
    # the plan reads those files alone
    assert {f.rsplit("/", 1)[1] for f in got.inputFiles() if "/keys/" in f} <= {f.rsplit("/", 1)[1] for f in files}


def test_many_seeds_and_edges(spark, tmp_path):
    rnd = random.Random(3)
    stored = spark.createDataFrame(rows(rnd, 400, 0, 200, 60), SCHEMA)
    incoming = spark.createDataFrame(rows(rnd, 300, 0, 330, 60), SCHEMA)
    path = f"file://{tmp_path}/k"
    assert key_files.anti_window_files(incoming, path).count() == 300  # nothing is stored
    key_files.write_keys(stored, path, 3)
    assert sorted(r.id for r in key_files.anti_window_files(incoming, path).collect()) == sorted(r.id for r in dedup.anti_window(incoming, stored).collect())
    assert key_files.anti_window_files(incoming.where("false"), path).collect() == []
    far = incoming.withColumn("created_at", F.lit("2030-01-01").cast("timestamp"))
    assert key_files.files_that_may_match(far, path) == [] and key_files.anti_window_files(far, path).count() == 300
