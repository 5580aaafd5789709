"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of length one with cosine c are sqrt(2 - 2c) apart, so a cosine
threshold is a distance epsilon. Vectors are projected on a few leading
principal directions, which never lengthens a distance, and sorted by label and
grid cells of width epsilon. The sorted sequence is cut into intervals with
bounding boxes; interval pairs whose boxes are farther apart than epsilon are
skipped, the others are joined recursively, halving both sides and skipping
again, down to small products computed in double precision.

Identical vectors are one vector with a multiplicity. A pair of intervals hands
on link counts per vector and a spanning forest of its links, never the links
themselves, so groups of thousands of near copies stay small.

Defined results: a null label, and vectors that are null, empty, zero or hold
null or non-finite components, link with nothing; vectors of different lengths
are not compared; rows that share a vec_id are one node; a null vec_id has no
links and is not kept. An empty table gives an empty result. Columns other than
the three are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import cut
from tidewater.llm.components import components

THRESHOLD = 0.98
DIRECTIONS = 6
INTERVAL = 1024
LEAF = 64
#: Intervals are looked up by cells of the first KEYS directions, coarser than the grid by this factor.
COARSE, KEYS = 2, 3
#: Lengths whose links are in one plan; then they are written.
PLANS = 50


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column (equal lengths) as vectors of length one, in double precision."""
    return _scaled(np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid_vectors(df: DataFrame) -> DataFrame:
    """Rows that can link, with `dim` and the embedding as doubles."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists(e, lambda v: v != 0)
    kind = df.schema["embedding"].dataType.elementType.simpleString()
    e_kept = e if kind in ("float", "double") else e.cast("array<double>")  # floats are as exact and half as long
    rows = df.where("vec_id is not null and label is not null and embedding is not null").where(~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False)))
    return rows.select("vec_id", "label", e_kept.alias("embedding"), F.size(e).alias("dim"), F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(1), e).alias("h2"))


def directions(vectors: DataFrame, dim: int, k: int = DIRECTIONS) -> np.ndarray:
    """Leading principal directions [dim, k] of all vectors of one length, from distributed moments."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(batch.column(0))
            total += x.T @ x
        at = np.arange(dim * dim)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["cell", "value"])

    rows = vectors.where(F.col("dim") == dim).select("embedding").mapInArrow(moments, "cell long, value double")
    found = rows.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # dim squared rows
    moment = np.zeros(dim * dim)
    moment[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    moment = moment.reshape(dim, dim)
    _, basis = np.linalg.eigh((moment + moment.T) / 2)
    return np.ascontiguousarray(basis[:, ::-1][:, : min(k, dim)])


def intervals(distinct: DataFrame, basis: np.ndarray, epsilon: float) -> DataFrame:
    """The epsilon grid order cut into intervals: block, label, low, high (boxes), ids, weights, data."""
    dim, k = basis.shape
    schema = distinct.schema

    def project(batches):
        for batch in batches:
            p = _unit(batch.column("embedding")) @ basis
            cells = np.floor(p / epsilon).astype(np.int32)
            extra = [pa.array(cells[:, i]) for i in range(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *[f"c{i}" for i in range(k)]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    order = ["label", *[f"c{i}" for i in range(k)], "rep"]
    gridded = cut(distinct.mapInArrow(project, f"{fields}, " + ", ".join(f"c{i} int" for i in range(k))))
    parts = max(1, math.ceil(gridded.count() / (8 * INTERVAL)))
    ordered = gridded.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def blocks(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table):
            nonlocal number
            x = _unit(rows.column("embedding").combine_chunks())
            p = x @ basis
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), pa.array([rows.column("label")[0].as_py()], rows.schema.field("label").type),
                    pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64())),
                    pa.array([rows.column("rep").to_pylist()], pa.list_(pa.int64())), pa.array([rows.column("weight").to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.asarray(rows.column("embedding").combine_chunks().flatten()).tobytes()], pa.binary()),
                ],
                names=["block", "label", "low", "high", "ids", "weights", "data"],
            )
            number += 1
            return out

        def full(final: bool):
            nonlocal held
            table = pa.Table.from_batches(held) if held else None
            held = []
            while table is not None and table.num_rows:
                labels = np.asarray(table.column("label").combine_chunks().to_numpy(zero_copy_only=False))
                same = int((labels != labels[0]).argmax()) if (labels != labels[0]).any() else len(labels)
                n = min(same, INTERVAL)
                if n == len(labels) and n < INTERVAL and not final:
                    break
                yield emit(table.slice(0, n))
                table = table.slice(n)
            if table is not None and table.num_rows:
                held = table.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from full(False)
        yield from full(True)

    label = schema["label"].dataType.simpleString()
    return cut(ordered.mapInArrow(blocks, f"block long, label {label}, low array<double>, high array<double>, ids array<long>, weights array<long>, data binary"))


def join_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, epsilon: float, threshold: float, same: bool) -> np.ndarray:
    """Matrix of links between two intervals, by recursion over halves of their order."""
    pa_, pb = a @ basis, b @ basis
    hits = np.zeros((len(a), len(b)), dtype=bool)

    def visit(i: int, j: int, m: int, n: int) -> None:
        if same and i >= n:  # below the diagonal: its mirror image is visited
            return
        low = np.maximum(pa_[i:j].min(0), pb[m:n].min(0))
        high = np.minimum(pa_[i:j].max(0), pb[m:n].max(0))
        gap = np.maximum(low - high, 0)
        if (gap * gap).sum() > epsilon * epsilon:
            return
        if j - i <= LEAF and n - m <= LEAF:
            hits[i:j, m:n] = a[i:j] @ b[m:n].T >= threshold
            return
        rows = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
        columns = [(m, n)] if n - m <= LEAF else [(m, (m + n) // 2), ((m + n) // 2, n)]
        for r in rows:
            for c in columns:
                visit(*r, *c)

    visit(0, len(a), 0, len(b))
    if same:
        hits = np.triu(hits, 1)
        hits |= hits.T
    return hits


def spanning(hits: np.ndarray) -> list[tuple[int, int]]:
    """Row and column links that connect what `hits` connects; a forest."""
    rows, columns = hits.any(1), hits.any(0)
    out = []
    for start in np.flatnonzero(rows):
        if not rows[start]:
            continue
        rows[start] = False
        front = [start]
        while len(front):
            fresh = []
            for r in front:
                new = np.flatnonzero(hits[r] & columns)
                columns[new] = False
                out += [(int(r), int(c)) for c in new]
                for c in new:
                    more = np.flatnonzero(hits[:, c] & rows)
                    rows[more] = False
                    out += [(int(q), int(c)) for q in more]
                    fresh += more.tolist()
            front = fresh
    return out


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `df` (vec_id, label, embedding)."""
    epsilon = math.sqrt(2 - 2 * threshold) + 1e-9
    vectors = cut(valid_vectors(df))
    # equal vectors have equal hashes (128 bits), so vectors themselves are neither keys nor joined
    distinct = cut(vectors.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")))
    # a vector that is alone with its label and length has no links; one row per length
    dims = [r[0] for r in distinct.groupBy("label", "dim").count().where("count > 1").select("dim").distinct().collect()]
    found = None
    for i, dim in enumerate(sorted(dims), 1):
        part = _links(distinct.where(F.col("dim") == dim), directions(distinct, dim), epsilon, threshold)
        found = part if found is None else found.unionByName(part)
        if i % PLANS == 0:
            found = cut(found)
    ids = df.select("vec_id")
    if found is None and not distinct.where("weight > 1").head(1):
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut(df.sparkSession.createDataFrame([], "rep long, links long, root long") if found is None else found)
    weight = found.groupBy("rep").agg(F.sum("links").alias("links"))
    same = ["label", "dim", "h1", "h2"]
    members = vectors.select("vec_id", *same).join(distinct.select(*same, "rep", "weight"), same).select("vec_id", "rep", "weight")
    members = cut(members)
    links = found.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    links = links.union(members.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    whole = components(links)
    counted = members.join(weight, "rep", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = ids.join(counted, "vec_id", "left").join(whole.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(distinct: DataFrame, basis: np.ndarray, epsilon: float, threshold: float) -> DataFrame:
    """Per interval pair: rep, links (weighted), root (another rep it is connected with, or null)."""
    dim = basis.shape[0]
    kind = np.float32 if distinct.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    blocks = intervals(distinct.select("label", "rep", "weight", "embedding"), basis, epsilon)
    boxes = blocks.select("block", "label", "low", "high")
    width = epsilon * COARSE
    cell = lambda c: F.floor(c / F.lit(width)).cast("int")
    keys = range(min(KEYS, basis.shape[1]))

    def celled(rows: DataFrame, low: str, high: str, margin: float) -> DataFrame:
        for i in keys:
            rows = rows.withColumn(f"cell{i}", F.explode(F.sequence(cell(F.get(low, F.lit(i)) - margin), cell(F.get(high, F.lit(i)) + margin))))
        return rows

    left = celled(boxes, "low", "high", 0.0)
    right = celled(boxes.select(F.col("block").alias("other"), "label", F.col("low").alias("low2"), F.col("high").alias("high2")), "low2", "high2", epsilon)
    gap = F.zip_with(
        F.zip_with("low", "low2", lambda x, y: F.greatest(x, y)), F.zip_with("high", "high2", lambda x, y: F.least(x, y)), lambda x, y: F.pow(F.greatest(x - y, F.lit(0.0)), 2)
    )
    pairs = left.join(right, ["label", *[f"cell{i}" for i in keys]]).where(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) <= epsilon * epsilon)
    pairs = pairs.where("block <= other").select("block", "other").distinct()
    pairs = cut(pairs)
    side = lambda c, s: blocks.select(F.col("block").alias(c), F.col("ids").alias(f"ids{s}"), F.col("weights").alias(f"weights{s}"), F.col("data").alias(f"data{s}"))
    work = pairs.join(side("block", 1), "block").join(side("other", 2), "other").select("block", "other", "ids1", "weights1", "data1", "ids2", "weights2", "data2")

    def verify(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = lambda c: batch.column(c)[row]
                ids = [np.array(one(c).as_py(), dtype=np.int64) for c in ("ids1", "ids2")]
                weights = [np.array(one(c).as_py(), dtype=np.int64) for c in ("weights1", "weights2")]
                x, y = (_scaled(np.frombuffer(one(c).as_py(), dtype=kind).astype(np.float64).reshape(-1, dim)) for c in ("data1", "data2"))
                same = one("block").as_py() == one("other").as_py()
                hits = join_pairs(x, y, basis, epsilon, threshold, same)
                if not hits.any():
                    continue
                reps, links, roots = [], [], []
                rows = np.flatnonzero(hits.any(1))
                reps.append(ids[0][rows])
                links.append(hits[rows] @ weights[1])
                if not same:
                    columns = np.flatnonzero(hits.any(0))
                    reps.append(ids[1][columns])
                    links.append(hits[:, columns].T @ weights[0])
                roots = np.full(sum(map(len, reps)), -1)
                forest = spanning(hits)
                tied = np.array([(ids[0][r], ids[1][c]) for r, c in forest], dtype=np.int64).reshape(-1, 2)
                all_reps = np.concatenate([*reps, tied[:, 0]])
                all_links = np.concatenate([*links, np.zeros(len(tied), dtype=np.int64)])
                root = pa.array(np.concatenate([roots, tied[:, 1]]), mask=np.concatenate([np.ones(len(roots), bool), np.zeros(len(tied), bool)]))
                yield pa.RecordBatch.from_arrays([pa.array(all_reps), pa.array(all_links.astype(np.int64)), root], names=["rep", "links", "root"])

    return work.mapInArrow(verify, "rep long, links long, root long")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all rows of `embeddings`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
