"""Quality rules: a threshold table compiled into one native projection.

A rule is a measure, a comparison and a threshold. `measures` computes all
measures of a text by built-in functions, `compile_rules` turns the table into
one boolean expression, and `apply_rules` adds both to a table. No user
function, pandas or shuffle is involved: the operator is a single scan.

Defined results: null or blank text has zero words and fails on length. Very
long texts are measured whole. Extra columns are carried through `apply_rules`;
measure columns replace columns of the same name. Repeated rows are judged
independently and alike; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE_CHARS, words_column

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Common function words of the languages handled (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "are", "this", "be",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht", "ein", "sich",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "pour", "dans", "du", "en",
    "el", "los", "las", "y", "que", "se", "por", "con", "para", "una", "del",
)


@dataclass(frozen=True)
class Rule:
    """Reject a text when `measure` `op` `threshold` holds and it has `min_words` words or more."""

    name: str
    measure: str
    op: str
    threshold: float
    min_words: int = 0


#: The production table. Ratios are per word unless the name says otherwise.
RULES = (
    Rule("too_short", "n_words", "<", 20),
    Rule("repeated_words", "repeat_ratio", ">", 0.30),
    Rule("too_long", "n_words", ">", 200_000),
    Rule("short_words", "mean_word_chars", "<", 2.0),
    Rule("long_words", "mean_word_chars", ">", 16.0),
    Rule("symbols", "symbol_ratio", ">", 0.25),
    Rule("few_stop_words", "stop_ratio", "<", 0.01, 50),
    Rule("duplicate_lines", "dup_line_ratio", ">", 0.30),
)


def _window_keys(hashes: Column, n_words: Column) -> Column:
    """A 64-bit key for each window of eight words, from the column of word hashes."""
    starts = F.sequence(F.lit(0), n_words.cast("int") - WINDOW)
    keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(n_words >= WINDOW, keys).otherwise(F.array().cast("array<long>"))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add every measure column to `df`.

    Intermediate arrays live in columns of one struct chain so that each is
    computed once per row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in df.columns if not c.startswith("__q_") and c not in MEASURES]
    out = df.select(*[F.col(f"`{c}`") for c in keep], words_column(F.col(text)).alias("__q_w"), t.alias("__q_t"))
    out = out.select(
        *[F.col(f"`{c}`") for c in keep],
        "__q_t",
        F.size("__q_w").cast("long").alias("n_words"),
        F.transform("__q_w", lambda w: F.xxhash64(w)).alias("__q_h"),
        F.size(F.filter("__q_w", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
    )
    out = out.withColumn("__q_win", _window_keys(F.col("__q_h"), F.col("n_words")))
    # most texts repeat no window; in the others one sort makes equal windows neighbours,
    # so the cost is n log n for any text
    pairs = F.when(
        F.size(F.array_distinct("__q_win")) < F.size("__q_win"),
        F.array_sort(F.transform("__q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    out = out.withColumn("__q_pairs", pairs)
    empty = F.lit(None).cast("struct<h:bigint,i:int>")
    neighbours = F.zip_with(
        F.zip_with("__q_pairs", F.concat(F.array(empty), F.slice("__q_pairs", 1, F.size("__q_pairs") - 1)), lambda a, b: F.struct(a.alias("x"), b["h"].alias("p"))),
        F.concat(F.slice("__q_pairs", 2, F.greatest(F.size("__q_pairs") - 1, F.lit(0))), F.array(empty)),
        lambda a, b: F.struct(a["x"]["i"].alias("i"), (F.coalesce(a["x"]["h"] == a["p"], F.lit(False)) | F.coalesce(a["x"]["h"] == b["h"], F.lit(False))).alias("dup")),
    )
    positions = F.array_sort(F.transform(F.filter(neighbours, lambda s: s["dup"]), lambda s: s["i"]))
    out = out.withColumn("__q_pos", F.when(F.col("__q_pairs").isNotNull(), positions))
    covered = F.aggregate(
        "__q_pos",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(WINDOW))).cast("long").alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    lines = F.filter(F.split("__q_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = out.withColumn("__q_lines", lines)
    bare = F.translate("__q_t", SPACE_CHARS, "")
    out = (
        out.withColumn("word_chars", F.length(bare).cast("long"))
        .withColumn("n_symbols", (F.length("__q_t") - F.length(F.translate("__q_t", SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("__q_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
    )
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words")), F.lit(0.0))
    out = (
        out.withColumn("mean_word_chars", per_word("word_chars"))
        .withColumn("symbol_ratio", per_word("n_symbols"))
        .withColumn("stop_ratio", per_word("n_stop_words"))
        .withColumn("repeat_ratio", per_word("n_repeat_words"))
        .withColumn("dup_line_ratio", F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")), F.lit(0.0)))
    )
    return out.select(*[F.col(f"`{c}`") for c in keep], *MEASURES)


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
    "mean_word_chars", "symbol_ratio", "stop_ratio", "repeat_ratio", "dup_line_ratio",
)


def compile_rule(rule: Rule) -> Column:
    """The boolean expression that says the rule rejects a row."""
    value, limit = F.col(rule.measure), F.lit(rule.threshold)
    test = {"<": value < limit, "<=": value <= limit, ">": value > limit, ">=": value >= limit}[rule.op]
    return test & (F.col("n_words") >= rule.min_words) if rule.min_words else test


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measures, `reasons` (names of the rules that reject, in table order) and `kept`."""
    measured = with_measures(df, text)
    carried = [c for c in measured.columns if c not in ("reasons", "kept")]
    reasons = F.filter(F.array(*[F.when(compile_rule(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return measured.select(*[F.col(f"`{c}`") for c in carried], reasons.alias("reasons")).withColumn("kept", F.size("reasons") == 0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality digest of every whole text of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = apply_rules(docs)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), F.array_join("reasons", ",").alias("reasons"),
    )
