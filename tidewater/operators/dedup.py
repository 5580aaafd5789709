"""Rolling-window dedup in arrival order, on one key or on either of two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a given order; equal rows in that order leave any one."""
    if all(isinstance(o, str) for o in order):  # a minimum is summed up before the shuffle and needs no sort
        rest = [c for c in df.columns if c not in keys]
        best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[F.coalesce(F.col(o).cast("string"), F.lit("")) if df.schema[o].nullable and df.schema[o].dataType.simpleString() == "string" else F.col(o) for o in order])).alias("__r"))
        return best.select(*keys, "__r.*").select(df.columns)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def anti_window(incoming: DataFrame, stored: DataFrame, days: int = 90) -> DataFrame:
    """Incoming rows without a stored row of the same URL, or title and source, in the window before them.

    Columns on both sides: canonical_url, normalized_title, source, created_at.
    The alternative is two equi-joins; an OR in one join would compare all rows.
    """
    s = stored.select(F.col("canonical_url").alias("__u"), F.col("normalized_title").alias("__t"), F.col("source").alias("__s"), F.col("created_at").alias("__at"))
    recent = (F.col("__at") <= F.col("created_at")) & (F.col("__at") >= F.col("created_at") - F.expr(f"interval {days} days"))
    by_url = s.where("__u <> ''").select("__u", "__at")
    out = incoming.join(by_url, (F.col("canonical_url") == F.col("__u")) & recent, "left_anti")
    return out.join(s, (F.col("normalized_title") == F.col("__t")) & (F.col("source") == F.col("__s")) & recent, "left_anti")


def keep_window(df: DataFrame, key: list[str], cut: Callable[[DataFrame], DataFrame], days: int = 90) -> DataFrame:
    """Rows kept on one key: the first, then each first one more than `days` after the last kept.

    A row with a null in its key repeats nothing and is kept. One round finds the
    next kept row of every key by a minimum, so rounds are bounded by the time the
    table spans and no key's rows are gathered.
    """
    known = F.expr(" and ".join(f"`{k}` is not null" for k in key))
    rows = cut(df.where(known).select("id", "created_at", *key))
    at = F.min(F.struct("created_at", "id")).alias("m")
    pick = [F.col("m.id").alias("id"), F.col("m.created_at").alias("last")]
    new = cut(rows.groupBy(*key).agg(at).select(*key, *pick))
    kept = new.select("id")
    while not new.isEmpty():
        after = rows.join(new.select(*key, "last"), key).where(F.col("created_at") > F.col("last") + F.expr(f"interval {days} days"))
        new = cut(after.groupBy(*key).agg(at).select(*key, *pick))
        kept = kept.union(new.select("id"))
    return df.join(kept.unionByName(df.where(~known).select("id")), "id", "left_semi")


def keep_disjunctive(df: DataFrame, cut: Callable[[DataFrame], DataFrame], days: int = 90) -> DataFrame:
    """Rows kept when either the URL, or title and source, may repeat: adds `kept`.

    Columns: id, canonical_url, normalized_title, source, created_at; arrival
    order is (created_at, id). A null or empty URL repeats no other, nor does a
    pair of title and source with a null in it. A row is dropped once a kept earlier row conflicts
    with it, and kept once all its earlier neighbours are dropped; rounds decide
    all rows that can be decided. Running maxima tell each row the last kept and
    the last undecided neighbour before it, so conflicts are never paired: a key
    with n rows costs a sort, not n squared links. The maxima run over a key's
    slices of `days` and take the slice before as two maxima more, so a key of
    very many rows (a title that is blank) is as many tasks as its slices. There
    are as many rounds as the longest chain of conflicts that alternates between
    dropped and kept rows, two for each `days` of time and chain at most. `cut`
    writes each round. Nothing is joined in a round, so nothing of it is broadcast.
    """
    own = F.col("id")
    rows = df.select(
        "id", "created_at", F.nullif("canonical_url", F.lit("")).alias("__u"), F.when(F.coalesce("canonical_url", F.lit("")) == "", own).alias("__ui"),
        F.when(F.col("source").isNotNull(), F.col("normalized_title")).alias("__t"), F.when(F.col("normalized_title").isNotNull(), F.col("source")).alias("__s"),
        F.when(F.col("normalized_title").isNull() | F.col("source").isNull(), own).alias("__ti"),
    )
    rows = cut(rows.withColumn("__slice", F.floor(F.datediff("created_at", F.lit("1970-01-01")) / days)).withColumn("kept", F.lit(None).cast("boolean")))
    states = {"conflict": F.col("kept"), "waiting": F.col("kept").isNull()}
    since = F.col("created_at") - F.expr(f"interval {days} days")
    while not rows.where("kept is null").isEmpty():
        seen = rows
        for n, keys in enumerate((["__u", "__ui"], ["__t", "__s", "__ti"])):
            # a row meets those of its own slice and of the one before, whose maxima stand first in its slice
            last = {f"__{name}": F.max(F.when(s, F.col("created_at"))) for name, s in states.items()}
            ended = rows.groupBy(*keys, (F.col("__slice") + 1).alias("__slice")).agg(*[m.alias(c) for c, m in last.items()]).withColumn("__row", F.lit(False))
            both = seen.withColumns({f"__{name}": F.when(s, F.col("created_at")) for name, s in states.items()}).withColumn("__row", F.lit(True)).unionByName(ended, allowMissingColumns=True)
            before = Window.partitionBy(*keys, "__slice").orderBy("__row", "created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
            running = both.withColumns({f"{name}{n}": F.coalesce(F.max(f"__{name}").over(before) >= since, F.lit(False)) for name in states})
            seen = running.where("__row").drop("__row", *[f"__{name}" for name in states])
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.expr("conflict0 or conflict1"), F.lit(False)).when(F.expr("not waiting0 and not waiting1"), F.lit(True))
        rows = cut(seen.withColumn("kept", verdict).select(rows.columns))
    return df.join(rows.select("id", "kept").hint("merge"), "id", "left")
