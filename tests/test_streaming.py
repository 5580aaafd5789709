import datetime as dt

from tidewater.plans.catalog import cut
from tidewater.streaming.pipeline import run_available, windowed_health

DAY = dt.datetime(2026, 1, 1)
SCHEMA = "id long, canonical_url string, normalized_title string, source string, created_at timestamp"


def test_available_batches_dedup_against_the_store(spark, tmp_path):
    arrivals, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))

    def arrive(*rows):
        spark.createDataFrame([(i, u, t, "s", DAY + dt.timedelta(days=d)) for i, u, t, d in rows], SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        run_available(spark, arrivals, SCHEMA, store, check, cut).awaitTermination()

    arrive((1, "u", "a", 0), (2, "u", "b", 10))
    arrive((3, "u", "c", 60), (4, "w", "a", 70), (5, "x", "e", 70))
    arrive((6, "u", "f", 91))
    assert {r.id for r in spark.read.parquet(store).select("id").collect()} == {1, 5, 6}


def test_windowed_health(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([("s", "failed", DAY), ("s", "success", DAY), ("s", "failed", DAY + dt.timedelta(hours=9))], "source string, status string, run_time timestamp").coalesce(1).write.parquet(path)
    rows = spark.readStream.schema("source string, status string, run_time timestamp").parquet(path)
    query = windowed_health(rows).writeStream.format("memory").queryName("health").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.runs, r.failures) for r in spark.table("health").collect()) == [(1, 1), (2, 1)]
