"""Exact Jaccard join of word shingle sets by prefix filters under several global orders.

Two sets with Jaccard similarity t or more share a token in their prefixes under
any global order of tokens, and in fact several: with c shared prefix tokens the
overlap is at most c + max(n_a - p_a, n_b - p_b). Orders here put common tokens
last and break ties by different hashes, so passages that many documents share
stay out of the prefixes of documents that have anything else.

1. One pass measures the sets (equal sets become one, by a fingerprint) and
   finds common tokens: each task reports tokens it meets repeatedly, and those
   reported often enough are common. Any such list gives valid orders.
2. A second pass emits prefix tokens under the first order; tokens of a single
   set are dropped in the sorted stream. Tokens of at most SMALL_GROUP sets give
   pairs; the others are crowded. A pair with a set that has no crowded token
   shares another one.
3. A third pass reads the texts that any pair or crowded token names. It hands
   on signatures, half of each set as the FILTERS orders have it, and for sets with crowded
   tokens new prefixes under the order that puts those last.
4. Pairs must share enough prefix tokens under every one of the orders: the counts
   are intersected here, before any set is fetched.
5. Families, sets that still share crowded tokens, are not paired. Each set is
   written as its difference from a pivot (the tokens that most of a sample of the
   family have): |A xor B| = |a| + |b| - 2 |a and b| for the differences a and b. Sets
   whose differences are small enough together are linked for certain, all of them
   through the one with the smallest; any other pair has to share tokens of its
   differences, so only the prefixes of these are joined, by position. Sets far
   from every pivot are their own difference. Only pairs of sets that the certain
   links have not connected are looked at.
6. The pairs left are verified on whole sets: first every set with one
   neighbour, then what still lies in different components.

A link between sets of one component changes no component, so none is lost.

Defined results: null or blank text has an empty set, links with nothing and is
its own component; texts of fewer words than a shingle are one shingle; rows
that share a doc_id each get their own text's component; a null doc_id takes part
only through an equal text. Equal texts are linked. Very long texts are handled
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import cut, scratch, slices, trim
from tidewater.llm.components import components
from tidewater.llm.shingles import column_shingles, mix

SHINGLE = 5
PERCENT = 80
#: Seeds of the orders: the one that generates pairs, and those that every pair has to pass as well.
ORDERS = (1, 2, 3)
FILTERS = ORDERS[1:]
#: Groups of a token up to this size are paired directly, those of new prefixes up to the second one.
SMALL_GROUP, FAMILY_GROUP = 16, 32
#: A token is common if tasks report it so often.
COMMON = 32
COUNT_TOKENS = 2_000_000
#: Sets are held in bitmaps of this many bits; sharing a bit changes an order or fetches a set too many, not the result.
BITS = 1 << 25
#: About so many sets of a family make its pivots, in every salt of so many members.
SAMPLE = 64
FAMILY_SALT = 1024
PAIR_SALT = 96


def prefix_length(n, percent: int = PERCENT):
    """Tokens of the prefix of a set of n: n - ceil(t n) + 1."""
    return n - (percent * n + 99) // 100 + 1


def half(n):
    """Tokens of the prefixes that pairs are filtered by; the longer, the sharper is the count."""
    return (n + 1) // 2


def needed_overlap(a, b, percent: int = PERCENT):
    """Smallest overlap of sets of a and b tokens that links them."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def bits_of(values: np.ndarray) -> np.ndarray:
    """A bitmap with the bits of some 64-bit values."""
    held = np.zeros(BITS, dtype=bool)
    held[values & (BITS - 1)] = True
    return np.packbits(held, bitorder="little").view(np.int64)


def in_bits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (BITS - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 > 0


def hashed(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64), 41).view(np.int64)


def collect_bits(rows: DataFrame, ids: bool = False) -> np.ndarray:
    """The bitmap of a column of tokens (hashes already) or ids; what reaches the driver is bounded by BITS."""

    def run(batches):
        held = np.zeros(BITS, dtype=bool)
        for batch in batches:
            values = batch.column(0).to_numpy()
            held[(hashed(values) if ids else values) & (BITS - 1)] = True
        words = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])

    found = rows.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def prefix(tokens: np.ndarray, common: np.ndarray, seed: int, crowded: np.ndarray | None = None, length=prefix_length) -> np.ndarray:
    """The prefix of a set under one order: tokens that aren't flagged as common (or, if given, crowded) first, then by hash."""
    p = length(len(tokens))
    return tokens[np.argpartition(_ranks(tokens, common, seed, crowded), p - 1)[:p]] if p < len(tokens) else tokens


def in_order(tokens: np.ndarray, common: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """All tokens of a set in the first order, crowded ones late."""
    return tokens[np.argsort(_ranks(tokens, common, ORDERS[0], crowded))]


def _ranks(tokens: np.ndarray, common: np.ndarray, seed: int, crowded: np.ndarray | None) -> np.ndarray:
    late = in_bits(common, tokens)
    if crowded is not None:
        late |= in_bits(crowded, tokens)
    return mix(tokens.view(np.uint64), seed) >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63)


def signature(tokens: np.ndarray, common: np.ndarray) -> bytes:
    """Prefixes under the FILTERS orders, each as sorted 16-bit values: two sets share no fewer of these than tokens."""
    parts = [np.sort(prefix(tokens, common, o, length=half).astype(np.uint16)) for o in FILTERS]
    return np.concatenate(parts).tobytes()


def passes(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    """Whether the signatures of sets of n_a and n_b tokens admit a link under every order."""
    p, q = half(n_a), half(n_b)
    least = needed_overlap(n_a, n_b) - max(n_a - p, n_b - q)
    x, y = a.reshape(-1, p), b.reshape(-1, q)
    for i in range(len(x)):
        at = np.searchsorted(y[i], x[i])
        at[at == q] = q - 1
        if int((y[i][at] == x[i]).sum()) < least:
            return False
    return True


def _measure(docs: DataFrame) -> DataFrame:
    """Rows (kind, a, b, c, d): 0: token, times met in the task; 1: doc_id, key, set size, hash of the text."""

    def run(batches):
        held: list[np.ndarray] = []
        n_held = 0
        names = ["kind", "a", "b", "c", "d"]

        def counted():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times > 1
            zero = pa.array(np.zeros(int(keep.sum()), np.int64))
            return pa.RecordBatch.from_arrays([zero.cast(pa.int8()), pa.array(tokens[keep]), pa.array(times[keep].astype(np.int64)), zero, zero], names=names)

        for batch in slices(batches, 1):
            keys, sizes = [], []
            for s in column_shingles(batch.column(1), SHINGLE):
                keys.append(set_key(s))
                sizes.append(len(s))
                held.append(s)
                n_held += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int8)), batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), batch.column(2)], names=names)
            if n_held > COUNT_TOKENS:
                yield counted()
                held, n_held = [], 0
        if held:
            yield counted()
        held = []
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "kind byte, a long, b long, c long, d long")


def set_key(tokens: np.ndarray) -> int:
    """Fingerprint of a set."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens.view(np.uint64), 99).sum(dtype=np.uint64) + np.uint64(len(tokens))]), 7).view(np.int64)[0])


def _postings(docs: DataFrame, common) -> DataFrame:
    """Prefix tokens under the first order that two sets or more have: token, key, n, g."""

    def emit(batches):
        own = common.value
        for batch in slices(batches, 0):
            tokens, keys, sizes = [], [], []
            for s in column_shingles(batch.column(0), SHINGLE):
                if len(s):
                    chosen = prefix(s, own, ORDERS[0])
                    tokens.append(chosen)
                    keys.append(np.full(len(chosen), set_key(s)))
                    sizes.append(np.full(len(chosen), len(s)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, sizes)], names=["token", "key", "n"])
        trim()

    return _live(docs.select("text").mapInArrow(emit, "token long, key long, n long"))


def _live(rows: DataFrame) -> DataFrame:
    """Rows (token, key, n) of the tokens that two keys or more have, with their number g."""

    def live(batches):
        # sorted by token and key: a token is kept once it is seen with a second key
        last = None  # (token, key, n, already handed on)
        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, n = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                t, k, n = (np.concatenate([[x], y]) for x, y in zip(last[:3], (t, k, n)))
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            handed = bool(last and last[3])
            t, k, n = t[fresh], k[fresh], n[fresh]
            same = np.zeros(len(t), bool)
            same[1:] |= t[1:] == t[:-1]
            same[:-1] |= t[1:] == t[:-1]
            done = bool(same[-1]) or (handed and len(t) == 1)
            out = same.copy()
            if handed:
                out[0] = False
            last = (t[-1], k[-1], n[-1], done)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(k[out]), pa.array(n[out])], names=["token", "key", "n"])

    ordered = rows.repartition(F.col("token")).sortWithinPartitions("token", "key")
    kept = cut(ordered.mapInArrow(live, "token long, key long, n long"))
    return cut(kept.join(kept.groupBy("token").agg(F.count("*").alias("g")).hint("merge"), "token"))


def _first_documents(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """One doc_id for each key of `wanted`."""
    return members.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


def _signatures(docs: DataFrame, named: np.ndarray, full: np.ndarray, common: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """Of the sets whose documents are `named`: key, n, sig, and again the prefix under the order with crowded tokens last for `full` ones."""
    shared = docs.sparkSession.sparkContext.broadcast((named, full, common, crowded))

    def run(batches):
        named, full, common, crowded = shared.value
        for batch in _held(batches, named):
            keys, sizes, sigs, again = [], [], [], []
            has = in_bits(full, hashed(batch.column(0).to_numpy())).tolist()
            for s, more in zip(column_shingles(batch.column(1), SHINGLE), has):
                if len(s):
                    keys.append(set_key(s))
                    sizes.append(len(s))
                    sigs.append(signature(s, common))
                    again.append(prefix(s, common, ORDERS[0], crowded).tobytes() if more else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(again, pa.binary())], names=["key", "n", "sig", "again"])
        trim()

    return cut(docs.select("doc_id", "text").mapInArrow(run, "key long, n long, sig binary, again binary"))


def _held(batches, bits: np.ndarray):
    """Slices of rows (doc_id, text) whose doc_id is in a bitmap."""

    def chosen():
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            if batch.num_rows:
                yield batch.filter(pa.array(in_bits(bits, hashed(batch.column(0).to_numpy()))))

    return slices(chosen(), 1)


def _sets(docs: DataFrame, named: np.ndarray) -> DataFrame:
    """Whole sets of the documents in a bitmap: key, tokens (binary). Others that share its bits come too."""
    shared = docs.sparkSession.sparkContext.broadcast(named)

    def build(batches):
        for batch in _held(batches, shared.value):
            sets = [s for s in column_shingles(batch.column(1), SHINGLE) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "tokens"])
        trim()

    return cut(docs.select("doc_id", "text").mapInArrow(build, "key long, tokens binary"))


def _recount(signatures: DataFrame) -> DataFrame:
    """Live prefix tokens of the sets with crowded tokens under the order that puts those last too."""

    def emit(batches):
        for batch in batches:
            found = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
            times = [len(x) for x in found]
            if found:
                columns = [np.concatenate(found), np.repeat(batch.column(0).to_numpy(), times), np.repeat(batch.column(1).to_numpy(), times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "n"])

    return _live(signatures.where("again is not null").select("key", "n", "again").mapInArrow(emit, "token long, key long, n long"))


def _intersected(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (key, key2, n, n2) that share enough prefix tokens under each of the FILTERS orders as well."""
    one = signatures.select("key", "sig").dropDuplicates(["key"])
    both = pairs.join(one.hint("merge"), "key").join(one.select(F.col("key").alias("key2"), F.col("sig").alias("sig2")).hint("merge"), "key2")

    def check(batches):
        for batch in batches:
            n, n2 = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [passes(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), x, y) for a, b, x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), n, n2)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["key", "key2"])

    return cut(both.select("key", "key2", "n", "n2", "sig", "sig2").mapInArrow(check, "key long, key2 long"))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among `pairs` (grp: the center's key, key: a member).

    A partition is sorted so that a center comes before its members; it alone is
    held. Members of a center with many are spread by a salt.
    """

    def run(batches):
        group, center = None, None
        for batch in batches:
            a, b = [], []
            grp, salt, role, key = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                s = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.int64)
                if role[i] == 0:
                    group, center = (grp[i], salt[i]), s.copy()
                elif (grp[i], salt[i]) == group and _overlap(s, center) >= needed_overlap(len(s), len(center)):
                    a.append(key[i])
                    b.append(grp[i])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    size = pairs.groupBy("grp").agg(F.expr(f"(count(*) + {PAIR_SALT - 1}) div {PAIR_SALT}").alias("salts"))
    members = pairs.join(size, "grp").select("grp", F.pmod(F.xxhash64(F.lit(22), "key"), "salts").alias("salt"), F.lit(1).alias("role"), "key")
    centers = size.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("grp").alias("key"))
    rows = members.unionByName(centers).join(sets.hint("merge"), "key")
    ordered = rows.repartition(F.col("grp"), F.col("salt")).sortWithinPartitions("grp", "salt", "role", "key")
    return cut(ordered.select("grp", "salt", "role", "key", "tokens").mapInArrow(run, "a long, b long").distinct())


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def _need(shared_bound: str):
    """SQL for: a pair of sizes n, n2 with at most so many shared prefix tokens can link."""
    rest = lambda n: f"(({PERCENT} * {n} + 99) div 100 - 1)"  # noqa: E731  n - prefix_length(n)
    overlap = f"({PERCENT} * (n + n2) + {99 + PERCENT}) div {100 + PERCENT}"
    return F.expr(f"{shared_bound} >= {overlap} - greatest({rest('n')}, {rest('n2')})")


def _near():
    return F.expr(f"100 * least(n, n2) >= {PERCENT} * greatest(n, n2)")


def _pairs(live: DataFrame) -> DataFrame:
    """Pairs that share tokens enough: key < key2, n, n2."""
    one = live.select("token", "key", "n")
    other = one.select("token", F.col("key").alias("key2"), F.col("n").alias("n2"))
    pairs = one.join(other, (one["token"] == other["token"]) & (F.col("key") < F.col("key2")) & _near())
    return pairs.groupBy("key", "key2", "n", "n2").agg(F.count("*").alias("shared")).where(_need("shared")).drop("shared")


def pivots(sample: list[np.ndarray]) -> list[np.ndarray]:
    """The empty set and token sets that a sample of a family gathers round.

    Sets are taken in turn; those that share half of their tokens with the first
    one left make a group, and the tokens that most of a group have are its pivot.
    """
    out, left = [], list(sample)
    while left:
        seed = left[0]
        near = [s for s in left if 3 * _overlap(s, seed) >= len(s) + len(seed) - _overlap(s, seed)]
        left = [s for s in left if 3 * _overlap(s, seed) < len(s) + len(seed) - _overlap(s, seed)]
        if len(near) > 1:
            tokens, times = np.unique(np.concatenate(near), return_counts=True)
            pivot = tokens[2 * times > len(near)]
            apart = np.array([len(s) + len(pivot) - 2 * _overlap(s, pivot) for s in near])
            # to sets farther off the empty pivot is as good
            if len(pivot) and 2 * (4 * apart <= [len(s) for s in near]).sum() >= len(near):
                out.append(pivot)
    return [np.zeros(0, np.int64)] + out


def places(tokens: np.ndarray, found: list[np.ndarray]) -> list[int]:
    """The pivots under which a set can meet a partner: its nearest one, and earlier ones that are nearly as near.

    Linked sets are at most min(n_a, n_b) / 4 apart. If a pivot is the nearest one
    to A, its distance to B exceeds that of B's own nearest by half of B at most;
    a pair meets under the earlier of its two nearest pivots.
    """
    apart = [len(tokens) + len(p) - 2 * _overlap(tokens, p) for p in found]
    home = int(np.argmin(apart))
    return [i for i in range(home) if 2 * apart[i] <= 2 * apart[home] + len(tokens)] + [home]


def least_shared(n: int, d: int, pivot: int) -> int:
    """Fewest difference tokens that a set of n tokens, d from a pivot of so many, shares with any partner that isn't certain."""
    size = min(max(pivot, 0.8 * n), 1.25 * n)
    return max(1, int(np.ceil((9 * (d + abs(size - pivot)) - n - size) / 18 - 1e-9)))


def _differences(crowd: DataFrame, sets: DataFrame, common: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """Differences of the sets of `crowd` (token, key, n) from the pivots of their family: sub, key, n, d, least, delta (binary).

    A difference from the empty pivot is a set itself. Handed on are the prefixes
    of differences, which any partner that isn't certain shares a token of, in the
    order with crowded tokens last.
    """
    # a token and the sets that have it are of one family
    families = components(crowd.select(F.col("token").alias("a"), F.col("key").alias("b")))
    members = cut(crowd.select(F.col("key").alias("node")).distinct().join(families, "node").select(F.col("node").alias("key"), F.col("component").alias("grp")))
    size = members.groupBy("grp").agg(F.count("*").alias("count")).withColumn("salts", F.expr(f"(count + {FAMILY_SALT - 1}) div {FAMILY_SALT}"))
    rows = members.join(size, "grp")
    salt = F.pmod(F.xxhash64(F.lit(22), "key"), F.col("salts"))
    sampled = F.pmod(F.xxhash64(F.lit(5), "key"), F.greatest(F.expr(f"count div {SAMPLE}"), F.lit(1))) == 0
    own = rows.select("grp", salt.alias("salt"), F.lit(1).alias("role"), "key")
    spread = rows.where(sampled).select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "key")
    flags = crowd.sparkSession.sparkContext.broadcast((common, crowded))

    def run(batches):
        group, sample, last, found = None, [], None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            grp, salt, role, key = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                if (grp[i], salt[i]) != group:
                    group, sample, last, found = (grp[i], salt[i]), [], None, None
                s = np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.int64)
                if role[i] == 0:
                    if key[i] != last:
                        sample.append(s.copy())
                    last = key[i]
                    continue
                if found is None:
                    found, last = pivots(sample), None
                if key[i] == last:
                    continue
                last = key[i]
                for number in places(s, found):
                    delta = np.setxor1d(s, found[number], assume_unique=True)
                    least = least_shared(len(s), len(delta), len(found[number]))
                    kept = in_order(delta, *flags.value)[: len(delta) - least + 1]
                    for c, v in zip(out, (f"{grp[i]}:{number}", key[i], len(s), len(delta), least, kept.tobytes())):
                        c.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["sub", "key", "n", "d", "least", "delta"])

    ordered = own.unionByName(spread).join(sets.hint("merge"), "key").repartition(F.col("grp"), F.col("salt")).sortWithinPartitions("grp", "salt", "role", "key")
    return cut(ordered.select("grp", "salt", "role", "key", "tokens").mapInArrow(run, "sub string, key long, n long, d long, least long, delta binary"))


def _certain(deltas: DataFrame) -> DataFrame:
    """Links (a, b) that follow from the distances to a pivot alone.

    9 (d_a + d_b) <= n_a + n_b is enough; whoever passes with anyone passes with the set of least 9 d - n.
    """
    hub = deltas.groupBy("sub").agg(F.min(F.struct(F.expr("9 * d - n").alias("w"), F.col("key").alias("hub"))).alias("m")).select("sub", "m.*")
    return cut(deltas.join(hub, "sub").where("key <> hub and 9 * d - n + w <= 0").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct())


def _family_pairs(deltas: DataFrame, place: DataFrame) -> DataFrame:
    """Pairs (key, key2, n, n2) of different components that share enough of their differences to be linked."""

    def emit(batches):
        for batch in batches:
            found = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
            times = [len(x) for x in found]
            if found:
                at = pa.array(np.repeat(np.arange(batch.num_rows), times))
                place = np.concatenate([np.arange(n) for n in times])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(found)), pa.array(place)], names=["sub", "key", "token", "place"])

    tokens = cut(deltas.select("sub", "key", "delta").mapInArrow(emit, "sub string, key long, token long, place long"))
    shared = tokens.groupBy("sub", "token").agg(F.count("*").alias("g")).where("g > 1").select("sub", "token")
    live = tokens.join(shared.hint("merge"), ["sub", "token"]).groupBy("sub", "key").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("t"))  # of one set
    live = live.join(deltas.select("sub", "key", "n", "d", "least"), ["sub", "key"]).join(place.select(F.col("node").alias("key"), "component"), "key", "left")
    live = live.select("sub", "key", "n", "d", "least", F.coalesce("component", "key").alias("component"), F.size("t").alias("live"), F.posexplode("t").alias("pos", "x"))
    # if this is the first token that a partner shares, it can share the live ones from here on, and what lies behind the prefix
    live = live.withColumn("reach", F.expr("live - pos + least - 1")).where("reach >= least")
    live = cut(live.select("sub", F.col("x.token").alias("token"), "key", "n", "d", "component", "reach"))
    other = live.select("sub", "token", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "d", "component", "reach")])
    enough = F.expr("key < key2 and component <> component2 and 9 * (d + d2) > n + n2 and 18 * least(reach, reach2) >= 9 * (d + d2) - n - n2")
    return live.join(other, ["sub", "token"]).where(enough & _near()).select("key", "key2", "n", "n2").distinct()


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs that the links don't connect."""
    place = cut(components(links))
    of = lambda c, name: place.select(F.col("node").alias(c), F.col("component").alias(name))
    placed = pairs.join(of("key", "x"), "key", "left").join(of("key2", "y"), "key2", "left")
    return cut(placed.where(F.coalesce("x", "key") != F.coalesce("y", "key2")).drop("x", "y"))


def _verified(pairs: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """`links` and those of `pairs` that join what they leave apart."""
    pairs = _apart(pairs, links)
    rank = lambda c: F.struct(F.xxhash64(F.lit(3), c).alias("h"), F.col(c).alias("k"))
    both = pairs.select("key", "key2").union(pairs.select("key2", "key"))
    first = both.groupBy("key").agg(F.min(rank("key2")).alias("m")).where(F.col("m") < rank("key")).select("key", F.col("m.k").alias("grp"))
    links = links.unionByName(_verify(cut(first), sets))
    tried = first.select(F.least("key", "grp").alias("key"), F.greatest("key", "grp").alias("key2"))
    rest = _apart(pairs.join(tried, ["key", "key2"], "left_anti"), links)
    return links.unionByName(_verify(rest.select(F.col("key").alias("grp"), F.col("key2").alias("key")), sets))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, key, component (of keys; null for empty sets) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = cut(_measure(docs), "kind")
    members = measured.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.col("c").alias("n_shingles"), F.col("d").alias("text_hash"))
    met = measured.where("kind = 0").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n"))
    common = collect_bits(met.where(F.col("n") >= COMMON).select("token"))
    live = _postings(docs, spark.sparkContext.broadcast(common))
    crowded = collect_bits(live.where(F.col("g") > SMALL_GROUP).select("token").distinct())
    full = cut(live.where(F.col("g") > SMALL_GROUP).select("key").distinct())
    flag = lambda c, name: full.select(F.col("key").alias(c), F.lit(True).alias(name))
    sure = _pairs(live.where(F.col("g") <= SMALL_GROUP)).join(flag("key", "x"), "key", "left").join(flag("key2", "y"), "key2", "left")
    sure = cut(sure.where("x is null or y is null").drop("x", "y"))
    known = members.where("doc_id is not null")
    names = lambda keys: collect_bits(_first_documents(known, keys).select("doc_id"), ids=True)
    signatures = _signatures(docs, names(sure.select("key").union(sure.select("key2")).union(full)), names(full), common, crowded)
    crowd = _recount(signatures)
    pairs = _intersected(sure.unionByName(_pairs(crowd.where(F.col("g") <= FAMILY_GROUP))).distinct(), signatures)
    family = crowd.where(F.col("g") > FAMILY_GROUP)
    sets = _sets(docs, names(pairs.select("key").union(pairs.select("key2")).union(family.select("key"))))
    links = spark.createDataFrame([], "a long, b long")
    if not family.isEmpty():
        deltas = _differences(family, sets, common, crowded)
        links = _certain(deltas)
        found = _family_pairs(deltas, cut(components(links)))
        pairs = pairs.unionByName(_intersected(found, signatures))
    links = _verified(pairs, links, sets)
    place = cut(components(links))
    nodes = members.join(place.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    return cut(nodes.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component"))))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, component (a number of the class, null for empty sets), component_id for every row of `docs` (doc_id, text)."""
    with scratch(docs.sparkSession) as keep:
        nodes = keep(_classes(docs))
    first = nodes.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = nodes.join(first, "component", "left")
    return out.select("doc_id", "text_hash", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by shingle Jaccard similarity of 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
