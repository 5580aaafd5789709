"""Evaluation: stratified sampling, labels, weighted confusion, intervals."""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.text import lenient_date
from tidewater.operators.filters import any_of
from tidewater.operators.state import ordered_positions
from tidewater.storage import cut

YES, NO = "是", "否"
POSITIVE_STATUSES = ("ai_confirmed", "ready_to_push", "push_failed", "pushed")
#: Words of the title adjudication (fixed values).
RESULT_WORDS = ("获奖", "授奖", "名单", "公示", "评审结果", "评选结果", "喜报", "荣获", "拟奖", "公布")
COMPETITION_WORDS = ("竞赛", "大赛", "比赛", "参赛")
APPLICATION_WORDS = ("申报", "提名", "推荐", "参评", "评选", "报名")
TRAINING_WORDS = ("培训", "课程", "会议", "论坛")
INDUSTRY_SOURCES = ("城市规划", "风景园林", "自然资源", "国土空间", "华夏建设")
INDUSTRY_TITLES = ("规划", "国土", "自然资源", "园林", "建设", "住建", "建筑", "城市", "设计", "测绘", "生态")


def stage(status: Column) -> Column:
    return F.when(status.isin(*POSITIVE_STATUSES), "ai_positive").when(status == "ai_rejected", "ai_negative").when(status.isin("new", "keyword_rejected"), "keyword_negative").otherwise("unresolved")


def predicted(stage_: Column) -> Column:
    return F.when(stage_ == "ai_positive", YES).when(stage_.isin("ai_negative", "keyword_negative"), NO).otherwise("")


def allocate(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Sample sizes by source: one each, then in proportion to what is left, by largest remainders.

    With fewer places than sources the largest sources get them. Quotas are
    exact fractions, so ties are ties; names decide them.
    """
    target = max(0, min(target, sum(sizes.values())))
    if target >= sum(sizes.values()):
        return dict(sizes)
    if target < len(sizes):
        largest = sorted(sizes, key=lambda s: (-sizes[s], s))[:target]
        return {s: int(s in largest) for s in sizes}
    given = {s: 1 for s in sizes}
    while (rest := target - sum(given.values())) > 0:
        room = {s: sizes[s] - given[s] for s in sorted(sizes) if sizes[s] > given[s]}
        quota = {s: Fraction(rest * r, sum(room.values())) for s, r in room.items()}
        for s in room:
            given[s] += min(int(quota[s]), room[s])
        rest = target - sum(given.values())
        for s in sorted(room, key=lambda s: (int(quota[s]) - quota[s], s))[:rest]:
            given[s] += given[s] < sizes[s]
    return given


def apportion(sizes: DataFrame, target: int, group: str = "source") -> DataFrame:
    """`allocate` for a table of any number of groups (group, population): adds sample_size.

    Every group has one place; the others go in proportion to the room that is left,
    so quotas never pass it and one round of largest remainders deals them out.
    Remainders have one denominator and are compared as whole numbers; two sums reach
    the driver, and ranks come from a distributed sort.
    """
    total, n = sizes.agg(F.coalesce(F.sum("population"), F.lit(0)), F.count("*")).first()
    target = max(0, min(target, total))
    if target >= total:
        return sizes.withColumn("sample_size", F.col("population"))
    if target < n:
        ranked = ordered_positions(sizes, F.col("population").desc(), group)
        return ranked.withColumn("sample_size", (F.col("__position") < target).cast("long")).drop("__position")
    big = lambda x: F.lit(x).cast("decimal(19,0)")
    share = big(target - n) * (F.col("population") - 1).cast("decimal(19,0)")
    quota = sizes.withColumns({"__floor": F.call_function("div", share, big(total - n)), "__rest": share % big(total - n)})
    left = target - n - quota.agg(F.sum("__floor")).first()[0]
    ranked = ordered_positions(quota, F.col("__rest").desc(), group)
    return ranked.withColumn("sample_size", 1 + F.col("__floor") + (F.col("__position") < left).cast("long")).drop("__floor", "__rest", "__position")


def bottom(rows: DataFrame, group: str, order: Column, most: str, parts: int = 64) -> DataFrame:
    """The first `most` (a column) rows of each group in an order.

    A group is dealt into `parts` by hash of the order; each part's first rows are
    merged, so a group of all rows is no single sort: `parts` times `most` rows meet.
    """
    keyed = rows.withColumn("__o", order).withColumn("__salt", F.pmod(F.xxhash64("__o"), F.lit(parts)))
    for by in ([group, "__salt"], [group]):
        keyed = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__o"))).where(F.col("__n") <= F.col(most))
    return keyed.drop("__o", "__salt", "__n")


def sample(rows: DataFrame, target: int, seed: int, group: str = "source") -> DataFrame:
    """Stratified sample: rows of each group with the smallest sha256(seed:id), with population, sample size and weight."""
    shares = apportion(rows.groupBy(group).agg(F.count("*").alias("population")), target, group)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    drawn = bottom(rows.join(shares, group), group, order, "sample_size")
    return drawn.withColumn("sampling_weight", F.format_string("%.8f", F.col("population") / F.col("sample_size")))


def review_rows(rows: DataFrame, target: int, seed: int) -> DataFrame:
    """Priority review queue: all model decisions and a weighted sample of keyword rejections."""
    staged = rows.withColumn("decision_stage", stage(F.col("status"))).withColumn("predicted_should_push", predicted(F.col("decision_stage")))
    full = staged.where(F.col("decision_stage").isin("ai_positive", "ai_negative"))
    n = F.count("*").over(Window.partitionBy("decision_stage"))
    full = full.withColumn("population", n).withColumn("sample_size", n).withColumn("sampling_weight", F.lit("1.00000000")).withColumn("sampling_stratum", F.col("decision_stage"))
    some = sample(staged.where(F.col("decision_stage") == "keyword_negative"), target, seed)
    return full.unionByName(some.withColumn("sampling_stratum", F.concat_ws("|", "decision_stage", "source")))


def parse_label(label: Column) -> Column:
    """Yes and no words to booleans, uncertain and blank to null, anything else an error."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    known = F.when(t.isin("是", "1", "true", "yes", "y"), F.lit(True)).when(t.isin("否", "0", "false", "no", "n"), F.lit(False))
    return F.when(t.isin("", "不确定", "uncertain"), F.lit(None).cast("boolean")).when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("no label: "), t)).cast("boolean"))


def event_time(publish_date: Column, first_seen: Column) -> Column:
    """struct(event_date, basis): the publish date, else when first seen, else unknown."""
    published, seen = lenient_date(publish_date), lenient_date(first_seen)
    date = F.when(published != "", published).otherwise(seen)
    basis = F.when(published != "", "published_at").when(seen != "", "first_seen_at").otherwise("unknown")
    return F.struct(date.alias("event_date"), basis.alias("event_time_basis"))


#: Kinds of a notice in the order they are tried, with the words of the title that admit them ("" admits
#: any title) and whether the verdict has to be positive.
KIND_RULES = (
    ("名单公示", ("名单", "公示"), False),
    ("获奖结果", RESULT_WORDS, False),
    ("竞赛报名", COMPETITION_WORDS, True),
    ("申报通知", ("",), True),
    ("培训会议", TRAINING_WORDS, False),
    ("其他", COMPETITION_WORDS, False),
    ("申报通知", APPLICATION_WORDS, False),
)
OTHER_KIND, UNSURE = "其他", "不确定"
#: What a verdict says by itself about kind, relation and label; null where the title decides.
VERDICTS = {"uncertain": (OTHER_KIND, UNSURE, UNSURE), "positive": (None, YES, YES), "stale": ("申报通知", YES, NO)}


def _said(verdict: Column, part: int) -> Column:
    """A part of what the verdict says, from a literal table."""
    table = F.create_map(*[F.lit(x) for name, parts in VERDICTS.items() if parts[part] for x in (name, parts[part])])
    return F.try_element_at(table, F.coalesce(verdict, F.lit("")))


def content_type(title: Column, verdict: Column) -> Column:
    """Kind of a notice: the first rule whose words the title has."""
    positive = F.coalesce(verdict == "positive", F.lit(False))
    tried = [F.when(any_of(title, words) & (positive if asked else F.lit(True)), F.lit(kind)) for kind, words, asked in KIND_RULES]
    return F.coalesce(*tried, F.lit(OTHER_KIND))


def adjudicate(title: Column, source: Column, verdict: Column) -> Column:
    """struct(content_type, related, actionable, label) from the title; `verdict`: uncertain, positive, stale or null."""
    related = F.when(any_of(source, INDUSTRY_SOURCES) | any_of(title, INDUSTRY_TITLES), YES).otherwise(NO)
    answer = F.coalesce(_said(verdict, 2), F.lit(NO))
    kind = F.coalesce(_said(verdict, 0), content_type(title, verdict))
    return F.struct(kind.alias("content_type"), F.coalesce(_said(verdict, 1), related).alias("related"), answer.alias("actionable"), answer.alias("label"))


def fill_label(old: Column, new: Column, force: bool = False) -> Column:
    """The old label where there is one, unless forced."""
    return new if force else F.when(F.trim(F.coalesce(old, F.lit(""))) != "", old).otherwise(new)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Weighted tp, fp, tn, fn of predicted, actual, weight (rows with null actual must be left out before)."""
    cell = lambda p, a: F.round(F.coalesce(F.sum(F.when((F.col("predicted") == p) & (F.col("actual") == a), F.col("weight"))), F.lit(0.0)), 6)
    return rows.groupBy(*by).agg(cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, False).alias("tn"), cell(False, True).alias("fn"))


def ratios(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1; null where nothing is counted."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    accuracy = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    out = counts.withColumn("accuracy", accuracy).withColumn("precision", p).withColumn("recall", r)
    out = out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


def metrics(rows: DataFrame) -> DataFrame:
    """Coverage and confusion of rows with predicted, label (boolean, null: uncertain), basis, weight and optional pending.

    Rows of unknown time are unassessable whatever their label; then null labels
    are uncertain; the rest are counted.
    """
    unknown = F.col("basis") == "unknown"
    uncertain = ~unknown & F.col("label").isNull()
    counted = ~unknown & F.col("label").isNotNull()
    waiting = F.col("pending") if "pending" in rows.columns else F.lit(False)  # nobody has looked at these yet
    uncertain = uncertain & ~waiting
    n = lambda c: F.count_if(c)
    w = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0.0)), 6)
    cell = lambda p, a: w(counted & (F.col("predicted") == p) & (F.col("label") == a))
    counts = rows.agg(
        F.count("*").alias("rows"), n(~unknown & waiting).alias("pending"), n(unknown).alias("unassessable"), w(unknown).alias("unassessable_weight"), n(uncertain).alias("uncertain"), w(uncertain).alias("uncertain_weight"),
        n(counted).alias("labelled"), cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, False).alias("tn"), cell(False, True).alias("fn"),
    )
    return ratios(counts)


def coverage(measured: DataFrame) -> DataFrame:
    """Adds the labelled share of all rows, and whether every row is labelled, uncertain or unassessable."""
    done = F.col("labelled") + F.col("uncertain") + F.col("unassessable")
    return measured.withColumn("coverage", F.coalesce(F.try_divide("labelled", "rows"), F.lit(0.0))).withColumn("complete", done == F.col("rows"))


def errors(rows: DataFrame) -> DataFrame:
    """The counted rows that are predicted wrongly, with `error`: false_positive or false_negative."""
    counted = rows.where("basis <> 'unknown' and label is not null and predicted <> label")
    return counted.withColumn("error", F.when(F.col("predicted"), "false_positive").otherwise("false_negative"))


def label_column(columns: list[str]) -> str:
    """The column that holds the labels: that of the event time if a file has it, else the snapshot's (fixed values)."""
    return "事件时点评估结论" if "事件时点评估结论" in columns else "人工审核结论"


#: Blocks that a stratum's cells are dealt into.
BLOCKS = 64
_OUTCOMES = ("tn", "fn", "fp", "tp")  # by 2 * predicted + actual


def _split(rng: np.random.Generator, total: np.ndarray, sizes: np.ndarray):
    """Draws of each part when `total` rows are drawn with replacement from parts of some sizes: conditional binomials, exactly."""
    left, rest = total.copy(), int(sizes.sum())
    for size in sizes.tolist():
        got = left.copy() if size == rest else rng.binomial(left, size / rest)
        left -= got
        rest -= size
        yield got


def bootstrap(spark: SparkSession, rows: DataFrame, iterations: int = 1000, seed: int = 20260710) -> DataFrame:
    """Percentile intervals of the ratios by stratified resampling with replacement: name, low, high.

    Each resample has exactly as many rows of a stratum as it has. Rows that are alike
    (outcome and weight) are a cell, and how often a cell is drawn is binomial given the
    draws of the cells before it. A stratum's cells lie in blocks by hash: first its
    draws are split between the blocks, then each block splits its own, so a stratum
    with a weight for each row is many tasks. A task adds up what its cells weigh and
    hands on `iterations` sums for each outcome. A stratum that is fully labelled
    (census) isn't resampled.
    """
    cells = rows.select("stratum", (F.col("predicted").cast("int") * 2 + F.col("actual").cast("int")).alias("outcome"), F.col("weight").cast("double").alias("weight"), "census")
    cells = cells.groupBy("stratum", "outcome", "weight", "census").agg(F.count("*").alias("n")).withColumn("block", F.pmod(F.xxhash64("outcome", "weight"), F.lit(BLOCKS)).cast("int"))
    cells = cut(cells)
    sizes = cells.groupBy("stratum", "block").agg(F.sum("n").alias("n"))

    def draws(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        n = frame["n"].to_numpy()
        drawn = list(_split(rng, np.full(iterations, n.sum()), n))
        return pd.DataFrame({"stratum": frame["stratum"], "block": frame["block"], "drawn": [d.tolist() for d in drawn]})

    # at most BLOCKS rows of a stratum
    drawn = sizes.groupBy("stratum").applyInPandas(draws, "stratum string, block int, drawn array<long>")
    part = [F.col("stratum"), F.col("block")]
    joined = cells.join(drawn, ["stratum", "block"]).repartition(*part).sortWithinPartitions(*part, "outcome", "weight", "census")
    # the rest of a block's size is needed by each of its cells
    after = F.sum("n").over(Window.partitionBy(*part).orderBy("outcome", "weight", "census").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    joined = joined.withColumn("rest", after)

    def weigh(batches):
        total, at, left, rng = np.zeros((4, iterations)), None, None, None
        for frame in batches:
            for r in frame.itertuples(index=False):
                if (r.stratum, r.block) != at:
                    at, left = (r.stratum, r.block), np.array(r.drawn, dtype=np.int64)
                    rng = np.random.default_rng([seed, 1 + r.block, zlib.crc32(str(r.stratum).encode())])
                got = left.copy() if r.n == r.rest else rng.binomial(left, r.n / r.rest)
                left = left - got
                total[r.outcome] += r.weight * (r.n if r.census else got)
        yield pd.DataFrame({"tn": [total[0].tolist()], "fn": [total[1].tolist()], "fp": [total[2].tolist()], "tp": [total[3].tolist()]})

    sums = joined.select("stratum", "block", "outcome", "weight", "census", "n", "rest", "drawn").mapInPandas(weigh, ", ".join(f"{c} array<double>" for c in _OUTCOMES))
    each = sums.select(F.posexplode(F.arrays_zip(*_OUTCOMES)).alias("i", "s")).groupBy("i").agg(*[F.sum(f"s.{c}").alias(c) for c in _OUTCOMES])
    names = ("accuracy", "precision", "recall", "f1")
    summary = ratios(each).agg(*[F.percentile(n, F.array(F.lit(0.025), F.lit(0.975))).alias(n) for n in names])
    return summary.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.get(n, F.lit(0)).alias("low"), F.get(n, F.lit(1)).alias("high")) for n in names])).alias("r")).select("r.*")


def recommend_workers(runs: DataFrame, least_speedup: float = 1.3) -> DataFrame:
    """Smallest worker count with enough speed-up, no errors and the decisions of one worker."""
    base = runs.where("workers = 1").select(F.col("decisions").alias("__d"))
    base = base.limit(1).withColumn("__one", F.lit(1))
    good = runs.withColumn("__one", F.lit(1)).join(base, "__one").where((F.col("workers") > 1) & (F.col("speedup") >= least_speedup) & (F.col("errors") == 0) & (F.col("invalid") == 0) & F.col("decisions").eqNullSafe(F.col("__d")))
    return good.agg(F.coalesce(F.min("workers"), F.lit(1)).alias("workers"))
