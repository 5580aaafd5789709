"""Stored keys of the window dedup, laid out so that most files needn't be opened.

Keys lie in a folder for each month, in files by ranges of their hash. A small index has
the month of each file and the bits of its keys' hashes as bitmaps (a Bloom filter of
one hash). Incoming rows are turned into the same bitmaps; months outside their window
are pruned by partition, and of the rest only files whose bitmaps share a bit with the
incoming ones are read. A shared bit may be chance, so the join decides; a file without
one holds no key that comes in. Each stored row lies there twice, under its URL and under
its title and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a file's bitmaps: PAGES bitmaps of 32,768 bits.
PAGES = 32
BITS = PAGES * 32_768
_MONTH = "yyyyMM"


def _hashes() -> Column:
    """The keys that a row is found under: kind and hash; none for nulls and empty URLs."""
    url = F.when(F.coalesce("canonical_url", F.lit("")) != "", F.struct(F.lit("u").alias("kind"), F.xxhash64(F.lit("u"), "canonical_url").alias("h")))
    title = F.when(F.col("normalized_title").isNotNull() & F.col("source").isNotNull(), F.struct(F.lit("t").alias("kind"), F.xxhash64(F.lit("t"), "normalized_title", "source").alias("h")))
    return F.array_compact(F.array(url, title))


def keyed_rows(rows: DataFrame) -> DataFrame:
    keys = rows.select("canonical_url", "normalized_title", "source", "created_at", F.explode(_hashes()).alias("k"))
    return keys.select("canonical_url", "normalized_title", "source", "created_at", "k.kind", "k.h")


def write_keys(rows: DataFrame, path: str, files: int = 8) -> None:
    """Store the keys of rows (canonical_url, normalized_title, source, created_at) in about `files` files a month, with their index."""
    spark = rows.sparkSession
    keys = keyed_rows(rows).withColumn("month", F.date_format("created_at", _MONTH).cast("int"))
    part = F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * files).cast("int")
    keys.repartition("month", part).sortWithinPartitions("month", "h").write.mode("append").partitionBy("month").parquet(f"{path}/keys")
    there = spark.read.parquet(f"{path}/keys").select("month", F.col("_metadata.file_path").alias("file"), F.pmod("h", F.lit(BITS)).alias("bit"))
    known = _index(spark, path)
    if known is not None:
        there = there.join(known.select("file").distinct(), "file", "left_anti")
    there.groupBy("month", "file", *_page()).agg(_bitmap()).write.mode("append").parquet(f"{path}/index")


def _page() -> list[Column]:
    return [F.bitmap_bucket_number("bit").alias("page")]


def _bitmap() -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")


def _index(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index")
    return spark.read.parquet(f"{path}/index") if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else None


def files_that_may_match(incoming: DataFrame, path: str, days: int = 90) -> list[str]:
    """Files that may hold a key of `incoming` in the window before one of its rows; a name for each reaches the driver."""
    spark = incoming.sparkSession
    index = _index(spark, path)
    if index is None:
        return []
    first, last = incoming.agg(F.min("created_at") - F.expr(f"interval {days} days"), F.max("created_at")).first()
    if last is None:
        return []
    months = index.where(F.col("month").between(int(first.strftime("%Y%m")), int(last.strftime("%Y%m"))))
    wanted = keyed_rows(incoming).select(F.pmod("h", F.lit(BITS)).alias("bit")).groupBy(*_page()).agg(_bitmap())  # PAGES rows at most
    both = months.select("file", "page", "bits").unionByName(months.select("file", "page").join(wanted, "page"))
    shared = both.groupBy("file", "page").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where("n = 2 and bitmap_count(bits) > 0")
    return sorted(r[0] for r in shared.select("file").distinct().collect())


def anti_window_files(incoming: DataFrame, path: str, days: int = 90) -> DataFrame:
    """Incoming rows without a stored row of the same URL, or title and source, in the window before them; reads files that may match."""
    spark = incoming.sparkSession
    files = files_that_may_match(incoming, path, days)
    if not files:
        return incoming
    first, last = incoming.agg(F.min("created_at") - F.expr(f"interval {days} days"), F.max("created_at")).first()
    stored = spark.read.option("basePath", f"{path}/keys").parquet(*files).where(F.col("created_at").between(F.lit(first), F.lit(last)))
    s = stored.select(F.col("canonical_url").alias("__u"), F.col("normalized_title").alias("__t"), F.col("source").alias("__s"), F.col("created_at").alias("__at"), "kind")
    recent = (F.col("__at") <= F.col("created_at")) & (F.col("__at") >= F.col("created_at") - F.expr(f"interval {days} days"))
    out = incoming.join(s.where("kind = 'u'"), (F.col("canonical_url") == F.col("__u")) & recent, "left_anti")
    return out.join(s.where("kind = 't'"), (F.col("normalized_title") == F.col("__t")) & (F.col("source") == F.col("__s")) & recent, "left_anti")
