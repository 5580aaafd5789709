"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's docs. All stages but
the last return the columns of `documents`, and each works on all rows that its
predecessor kept.

1. toxicity: documents whose class-conditional score is 0.5 or more are dropped.
2. jaccard: of each class of near-duplicates the document with the smallest id
   stays (of equal ids that with the smallest hash of its text); rows without an
   id stay.
3. pii: personal data is replaced by its kind in brackets.
4. mix: each document is repeated, shortened or left out as the source mix says.
5. pack: the texts become token sequences of 2048.

Nulls, blank texts, ties, very long texts, repeated rows and empty tables have the
results that the operators define; repeated rows count as one document from stage
2 on, rows that share an id with different texts are different documents, and a
document of no words is in no mix. Columns beside those that a stage needs are
handed through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import jaccard_orders, mix_schedule, pack_complement, pii_skipcrf, toxicity_kn
from tidewater.llm.common import cut, fold, scratch, words_column


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    model = toxicity_kn.fit_on(docs, labels)
    return docs.where(toxicity_kn.score_column(spark, model) < 0.5)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: that of the smallest doc_id, then of the smallest text hash.

    Rows that share a doc_id with different texts are told apart by their texts;
    of repeated rows one stays. Rows without doc_id stay, as they are of no class.
    """
    classes = jaccard_orders.jaccard_components(docs.select("doc_id", "text")).where("doc_id is not null")
    rows = classes.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    own = F.when(F.col("component").isNull(), F.struct("doc_id", "text_hash"))  # texts without words are classes of their own
    first = rows.groupBy("component", own.alias("own")).agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("f")).select(F.col("f.doc_id").alias("id"), F.col("f.text_hash").alias("hash"), F.col("f.n").alias("n"))
    # rows travel as one column, so no name of theirs can meet a name of ours
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    picked = whole.join(first, ["id", "hash"])
    repeated = picked.where("n > 1").dropDuplicates(["id", "hash"])
    return picked.where("n = 1").select("row.*").unionByName(repeated.select("row.*")).unionByName(docs.where("doc_id is null"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact personal data."""
    model = pii_skipcrf.fit_on(docs)
    clean = docs.withColumn("text", pii_skipcrf.redact_column(spark, model))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, shorten or leave out documents as the source mix says."""
    # nulls leave a hash as it was, so which values are null is hashed as well
    key = F.xxhash64(*[x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c))])
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"))  # rows travel as one column, see jaccard
    drawn = mix_schedule.mix(keyed.select(F.col("key").alias("doc_id"), "row.source", "row.text"))
    drawn = drawn.groupBy(F.col("doc_id").alias("key")).agg(F.flatten(F.collect_list("rounds")).alias("rounds"), F.first("size").alias("size"))
    texts = keyed.dropDuplicates(["key"]).join(drawn, "key").select("row", "size", F.explode("rounds.words").alias("words"))
    part = F.array_join(F.slice(words_column(F.col("row.text")), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(part)
    fresh = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return texts.select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixed texts into sequences."""
    import public_tokenizers

    return pack_complement.pack(pack_complement.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("pii", pii), ("mix", mix), ("pack", pack)]

#: Model scores, components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
