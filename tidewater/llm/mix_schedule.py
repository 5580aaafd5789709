"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot i stands at the golden-ratio point
frac(i * 0.618...), which cumulative target shares map to a source; slots are
ranked within their source. Each source's documents are shuffled by a hash,
laid end to end, and cut into blocks of equal token counts; rank r takes block
r modulo the number of blocks, so a source is read round after round. The
schedule stops for a source once its target is reached, the last block being
shortened to fit, and blocks for which a source's share earned too few slots are
spread evenly between the others. Every reading of a document says at which slot it
begins, so whoever trains can read the documents in the order of the schedule. All of it is DataFrame operations: one scan that measures the texts,
then joins of (document, block) pieces with slots. No text is shuffled.

Ranks and offsets are prefix sums over many small groups (slot chunks, hash
buckets), so a source that holds a third of all rows is spread like any other.
Tables of one row for each source are sorted as a whole; whether a join with them
is a broadcast is left to the optimiser, which looks at their size.

Defined results: null or blank text has size 0 and takes nothing; a null source
is a source of its own, ordered last; identical rows are separate documents;
an empty table gives an empty mix; rows of equal hash go by id and size; a very
long text is as many pieces as blocks it reaches into; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, word_count

#: Fixed value: 2**32 divided by the golden ratio, made odd (a Weyl sequence).
GOLDEN = 2654435769
TWO32 = 4294967296
CELLS = 1024
BLOCK_WORDS = 4096
SLOT_CHUNK = 512


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per source: sidx, source, source_size, weight, target.

    Sources in code point order (null last) take the weights in turn. Targets
    share all words by weight; a target stops at `cap` times its source's size
    and the excess is shared again. With sources ordered by cap / weight the
    stopped ones are a prefix, so the fixed point needs no iteration.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("sidx", F.row_number().over(order).cast("int") - 1)
    per = per.withColumn("weight", F.element_at(turn, F.pmod("sidx", F.lit(len(weights))).cast("int") + 1).cast("double"))
    per = per.withColumn("limit", F.col("source_size") * F.lit(cap))
    ratio = everything.orderBy(F.col("limit") / F.col("weight"), "sidx")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    spent = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = F.sum("source_size").over(everything)
    per = per.withColumn("level", (total - stopped) / (F.sum("weight").over(everything) - spent))
    # the first source that isn't stopped fixes the level for all behind it
    free = F.col("level") * F.col("weight") <= F.col("limit")
    per = per.withColumn("level", F.min(F.when(free, F.struct((F.col("limit") / F.col("weight")).alias("r"), "sidx", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return per.select("sidx", "source", F.col("source_size").cast("long").alias("source_size"), "weight", target.alias("target"))


def _slots(spark: SparkSession, sources: DataFrame, n_slots: int) -> DataFrame:
    """The schedule: slot, sidx, rank, for slots in schedule order."""
    share = Window.partitionBy(F.lit(1)).orderBy("sidx")
    total = F.sum("words").over(Window.partitionBy(F.lit(1)))
    upto = F.sum("words").over(share.rowsBetween(Window.unboundedPreceding, 0))
    bound = lambda c: F.round(c / total * TWO32).cast("long")
    ranges = sources.where("words > 0").select("sidx", bound(upto - F.col("words")).alias("lo"), bound(upto).alias("hi")).where("hi > lo")
    width = TWO32 // CELLS
    ranges = ranges.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    point = F.pmod(F.pmod(F.col("id") + 1, F.lit(2**31)) * F.lit(GOLDEN), F.lit(TWO32))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {width}"))
    slots = slots.join(ranges, (slots["cell"] == ranges["cell"]) & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "sidx")
    slots = slots.withColumn("chunk", F.expr(f"slot div {SLOT_CHUNK}"))
    ahead = Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("sidx", "chunk").agg(F.count("*").alias("n")).select("sidx", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("sidx", "chunk").orderBy("slot"))
    return slots.withColumn("nth", within).join(counts, ["sidx", "chunk"]).select("slot", "sidx", (F.col("base") + F.col("nth") - 1).alias("rank"))


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int) -> DataFrame:
    """Slots with the block each takes: slot, sidx, round, block, block_words (of the source), length.

    `sources` holds sidx, source_size and `words` (the target in whole words).
    """
    slots = cut(_slots(spark, sources, n_slots))
    won = slots.groupBy("sidx").agg(F.count("*").alias("won"))
    plan = sources.where("words > 0").join(won, "sidx", "left").withColumn("won", F.coalesce("won", F.lit(0)))
    plan = plan.withColumn("block_words", F.expr("greatest(1, (words + greatest(won, 1) - 1) div greatest(won, 1))"))
    plan = plan.withColumn("n_blocks", F.expr("(source_size + block_words - 1) div block_words"))
    needed = F.expr("words div source_size * n_blocks + (words % source_size + block_words - 1) div block_words")
    plan = plan.withColumn("needed", needed)
    late = plan.where("needed > won").select("sidx", "won", "needed", F.explode(F.sequence(F.col("won").cast("long"), F.col("needed") - 1)).alias("rank"))
    late = late.select(F.expr(f"(2 * (rank - won) + 1) * {n_slots} div (2 * (needed - won))").alias("slot"), "sidx", "rank")
    used = slots.unionByName(late).join(plan, "sidx").where("rank < needed")
    used = used.select("slot", "sidx", F.expr("rank div n_blocks").alias("round"), F.expr("rank % n_blocks").alias("block"), "block_words", "source_size", "words")
    start = F.col("round") * F.col("source_size") + F.col("block") * F.col("block_words")
    whole = F.least("block_words", F.col("source_size") - F.col("block") * F.col("block_words"))
    return used.withColumn("length", F.greatest(F.lit(0).cast("long"), F.least(whole, F.col("words") - start))).where("length > 0")


def place(sizes: DataFrame, sources: DataFrame, n_docs: int, seed: int = 7) -> DataFrame:
    """Each document's start in its source's shuffled stream: adds sidx, bucket, nth, start."""
    buckets = max(64, min(65536, n_docs // 512))
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.join(sources.select("sidx", F.col("source").alias("__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    ahead = Window.partitionBy("sidx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("sidx", "bucket").agg(F.sum("size").alias("n")).select("sidx", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sidx", "bucket").orderBy("order", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("nth", F.row_number().over(inside)).withColumn("before", before)
    return rows.join(base, ["sidx", "bucket"]).withColumn("start", F.col("base") + F.col("before")).drop("base", "before", "order")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, block_words: int = BLOCK_WORDS, size: Column | None = None) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, rounds, taken.

    `rounds` lists (round, words, slot) for every reading of the source that reaches
    the document; `words` is the length of the part taken, from its beginning, and
    `slot` where in the schedule that begins.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    sizes = cut(docs.select("doc_id", "source", size.alias("size")))
    sources = cut(source_targets(sizes, weights, cap).withColumn("words", F.floor("target").cast("long")))
    total, n_sources = sources.agg(F.sum("words"), F.count("*")).first()
    n_slots = 0
    if total:
        n_slots = math.ceil(total / max(1, min(block_words, total // (64 * n_sources))))
    placed = place(sizes, sources, sizes.count())
    slots = schedule(spark, sources, n_slots)
    blocks = slots.select("sidx", "block_words").distinct()
    pieces = placed.join(blocks, "sidx", "left")
    touched = F.when((F.col("size") > 0) & F.col("block_words").isNotNull(), F.sequence(F.expr("start div block_words"), F.expr("(start + size - 1) div block_words")))
    pieces = pieces.withColumn("block", F.explode_outer(touched))
    slots = slots.select(F.col("sidx").alias("s"), F.col("block").alias("b"), "round", "slot", "length", (F.col("block") * F.col("block_words")).alias("from"))
    joined = pieces.join(slots, (F.col("sidx") == F.col("s")) & (F.col("block") == F.col("b")), "left")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("start") + F.col("size"), F.col("from") + F.col("length")) - F.greatest("start", "from"))
    joined = joined.withColumn("part", F.when(F.col("length").isNotNull(), part).otherwise(0))
    key = ["doc_id", "sidx", "bucket", "nth", "size"]
    per_round = joined.groupBy(*key, "round").agg(F.sum("part").alias("part"), F.min(F.when(F.col("part") > 0, F.col("slot"))).alias("slot"))
    # at most `cap` rounds, so the list of a document is short
    taken = per_round.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(F.col("part") > 0, F.struct("round", F.col("part").alias("words"), "slot")))).alias("rounds"), F.sum("part").alias("taken")
    )
    return taken.join(sources, "sidx").select("doc_id", "source", "size", "source_size", "target", "rounds", "taken")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the 1, 2, 3 mix takes of every document, and the slots at which it reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("rounds.slot").alias("slots"))
