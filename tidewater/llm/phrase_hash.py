"""Phrase collocations by a minimal perfect hash over candidates.

Words are counted by language; a word's 64-bit hash (of language and bytes) is checked
to be its own, else the seed is changed, so phrases are exact tuples of word hashes.
Candidates grow by the Apriori rule: pairs of words that reach the least count, then
triples of which both pairs do; bitmaps of the parts, sized by their number, thin
phrases out before they are shuffled (a bit shared by chance lets one more through).

Candidates and the words in them are dealt by hash to shards of a bounded size, and
each shard gets a minimal perfect hash with its keys stored by slot. Mappers read all
texts again, send each slice's phrases, summed up and packed, to their shards; there
they are looked up, verified against the stored keys and added to a numpy array of
counts by `bincount`; arrays of several tasks of a shard are summed in a tree. The cuts
of a candidate are read by slot in the same way: its parts are sent to their shards and
come back with what the arrays hold. No task holds more than a shard, one slice of
texts and its bitmaps; a frequent phrase is one number of each slice.

Scores are exact: products are decimals of 38 digits.

Defined results: a null language is `und` and shares it; a null or blank text has no
words; very long texts are cut into runs of words that overlap by two; repeated rows
count each; an empty table gives no phrases. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, scratch, slices, trim
from tidewater.llm.perfect_hash import PerfectHash, folded
from tidewater.llm.shingles import _BYTE, _LOWER, _power_table, mix

LEAST, LONGEST, TOP, COVERED = 10, 3, 2000, 50
UNKNOWN = "und"
#: Keys of a shard, at most about this many on average.
SHARD_KEYS = 1 << 17
#: Tasks that may count for one shard.
FAN = 8
#: Bytes of text in a slice, and words in a run: ids of words in a run have 21 bits.
SLICE, RUN = 1_000_000, 1 << 20
#: Bits of a bitmap for each key in it, and the most bits that a bitmap has.
KEY_BITS, MOST_BITS = 16, 1 << 31

#: Characters that end a piece, and those that separate words in it.
_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK = np.zeros(256, dtype=np.int8)
_BREAK[list(_BLANKS)] = 1
_BREAK[list(_ENDS)] = 2


class Words:
    """Words of an Arrow column of texts: hashes, the piece of each, and its bytes."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        column = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        self.data = data = _LOWER[data]
        kind = _BREAK[data]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= kind[:-1] != 0
        rows = edges[:-1][(edges[:-1] < len(data)) & (edges[1:] > edges[:-1])]
        begins[rows] = inside[rows]
        self.starts = starts = np.flatnonzero(begins)
        self.names = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        if not len(starts):
            self.hashes = self.stops = np.zeros(0, np.int64)
            self.pieces = self.lang = np.zeros(0, np.int64)
            return
        stops = np.zeros(len(data) + 1, dtype=bool)
        stops[1:] = inside
        stops[:-1] &= ~inside
        stops[edges[1:][edges[1:] > 0]] |= inside[edges[1:][edges[1:] > 0] - 1]
        self.stops = np.flatnonzero(stops)
        # a piece ends at its marks and where a text ends
        row = np.searchsorted(edges, starts, side="right") - 1
        self.pieces = np.searchsorted(np.flatnonzero(kind == 2), starts) + row  # both only grow, so either's step is a new piece
        self.lang = np.asarray(self.names.indices)[row]
        length = self.stops - starts
        sums = np.empty(len(starts), dtype=np.uint64)
        powers = _power_table(int(length.max()) + 1)
        with np.errstate(over="ignore"):
            for a in range(0, len(starts), 1 << 16):  # a few megabytes at a time
                n = length[a : a + (1 << 16)]
                first = np.cumsum(n) - n
                place = np.arange(int(n.sum())) - np.repeat(first, n)
                sums[a : a + (1 << 16)] = np.add.reduceat(_BYTE[data[np.repeat(starts[a : a + (1 << 16)], n) + place]] * powers[place], first)
        salts = np.array([_name_hash(x, seed) for x in self.names.dictionary.to_pylist()], dtype=np.uint64)
        self.hashes = mix(sums ^ salts[self.lang], seed).view(np.int64)

    def runs(self):
        """(hashes, pieces) of runs of at most RUN words; runs overlap by LONGEST - 1, which are counted once."""
        step = RUN - LONGEST + 1
        for a in range(0, max(1, len(self.hashes)), step):
            yield self.hashes[a : a + RUN], self.pieces[a : a + RUN], min(step, len(self.hashes) - a)

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at some places."""
        starts, stops = self.starts[at], self.stops[at]
        length = stops - starts
        offsets = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(length, out=offsets[1:])
        body = self.data[np.repeat(starts - offsets[:-1], length) + np.arange(int(offsets[-1]))]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body.tobytes())]).cast(pa.string())


def _name_hash(name: str, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{seed}\n{name}".encode(), digest_size=8).digest(), "little")


def _unique_words(batches, seed: int):
    for batch in slices(batches, 0, SLICE):
        words = Words(batch.column(0), batch.column(1), seed)
        if not len(words.hashes):
            continue
        found, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
        lang = pa.DictionaryArray.from_arrays(pa.array(words.lang[first], pa.int32()), words.names.dictionary).dictionary_decode()
        yield pa.RecordBatch.from_arrays([lang, words.strings(first), pa.array(found), pa.array(n)], names=["lang", "word", "w", "n"])
    trim()


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, w (its hash), n of every word."""
    rows = texts.mapInArrow(lambda b: _unique_words(b, seed), "lang string, word string, w long, n long")
    return rows.groupBy("lang", "word", "w").agg(F.sum("n").alias("n"))


def _grams(hashes: np.ndarray, pieces: np.ndarray, own: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids by place, distinct words, places where a phrase of `size` words begins) of a run."""
    known, ids = np.unique(hashes, return_inverse=True)
    n = min(own, len(hashes) - size + 1)
    at = np.arange(max(n, 0))
    return ids.astype(np.int64), known, at[pieces[at] == pieces[at + size - 1]]


def _counted(ids: np.ndarray, known: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases [n, LONGEST] as word hashes, 0 beyond their size, and how often each stands in the run."""
    code = ids[at]
    for j in range(1, size):
        code = (code << 21) | ids[at + j]
    code, n = np.unique(code, return_counts=True)
    keys = np.zeros((len(code), LONGEST), dtype=np.int64)
    for j in range(size):
        keys[:, j] = known[(code >> (21 * (size - 1 - j))) & ((1 << 21) - 1)]
    return keys, n


class Bitmap:
    """Which keys a set may hold."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, np.uint64(len(bits) * 8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (folded(keys) % self.size).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, n: int) -> Bitmap:
    """Bitmap of n keys (w1, w2, w3): parts of it are made in tasks, so the driver gets each bit once."""
    size = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(max(1, n) * KEY_BITS))))
    part = min(size, 1 << 20)

    def spread(batches):
        for batch in batches:
            at = (folded(_matrix(batch)) % np.uint64(size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // part), pa.array(at % part)], names=["part", "bit"])

    def fill(batches):
        part_now, held = None, None
        for batch in batches:
            parts, bits = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for p in np.unique(parts).tolist():
                if p != part_now:
                    if held is not None:
                        yield _packed_bits(part_now, held)
                    part_now, held = p, np.zeros(part, dtype=bool)
                held[bits[parts == p]] = True
        if held is not None:
            yield _packed_bits(part_now, held)

    rows = keys.select("w1", "w2", "w3").mapInArrow(spread, "part long, bit long").repartition(_deal(keys.sparkSession), "part").sortWithinPartitions("part")
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.mapInArrow(fill, "part long, bits binary").toLocalIterator():
        out[r.part * (part // 8) : (r.part + 1) * (part // 8)] = np.frombuffer(r.bits, dtype=np.uint8)
    return Bitmap(out)


def _packed_bits(part: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.packbits(held, bitorder="little").tobytes()])], names=["part", "bits"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in range(LONGEST)], axis=1)


class Apriori:
    """Phrases of a run that can reach the least count, as far as the bitmaps of their parts tell."""

    def __init__(self, words, pairs=None, triples=None):
        self.words, self.pairs, self.triples = words, pairs, triples

    def phrases(self, hashes, pieces, own, sizes):
        """(keys, counts) for each size."""
        ids, known, at = _grams(hashes, pieces, own, 2)
        if not len(at):
            return
        frequent = self.words.value.has(_padded(known))
        whole = np.zeros(len(hashes), dtype=bool)  # does a pair that may be frequent begin here?
        whole[at] = frequent[ids[at]] & frequent[ids[at + 1]]
        if 2 in sizes:
            keys, n = _counted(ids, known, np.flatnonzero(whole[:own]), 2)
            if self.pairs is not None:
                good = self.pairs.value.has(keys)
                keys, n = keys[good], n[good]
            yield keys, n
        if 3 in sizes:
            # pairs of the overlap count here, as the triples of this run's words need them
            _, _, all_pairs = _grams(hashes, pieces, len(hashes), 2)
            all_pairs = all_pairs[frequent[ids[all_pairs]] & frequent[ids[all_pairs + 1]]]
            code = (ids[all_pairs] << 21) | ids[all_pairs + 1]
            distinct, back = np.unique(code, return_inverse=True)
            keys = np.zeros((len(distinct), LONGEST), dtype=np.int64)
            keys[:, 0], keys[:, 1] = known[distinct >> 21], known[distinct & ((1 << 21) - 1)]
            pair = np.zeros(len(hashes) + 1, dtype=bool)
            pair[all_pairs] = self.pairs.value.has(keys)[back] if len(distinct) else False
            first = np.flatnonzero(pair[:-1] & pair[1:])
            first = first[(first < own) & (first + 2 < len(hashes))]
            first = first[pieces[first] == pieces[first + 2]]
            keys, n = _counted(ids, known, first, 3)
            if self.triples is not None:
                good = self.triples.value.has(keys)
                keys, n = keys[good], n[good]
            yield keys, n


def _padded(words: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(words), LONGEST), dtype=np.int64)
    keys[:, 0] = words
    return keys


def grow(texts: DataFrame, size: int, known: Apriori, seed: int, least: int) -> DataFrame:
    """Candidates (w1, w2, w3) of `size` words: those that reach the least count."""

    def emit(batches):
        for batch in slices(batches, 0, SLICE):
            for run in Words(batch.column(0), batch.column(1), seed).runs():
                for keys, n in known.phrases(*run, (size,)):
                    if len(n):
                        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, c]) for c in range(LONGEST)), pa.array(n)], names=["w1", "w2", "w3", "n"])
        trim()

    rows = texts.mapInArrow(emit, "w1 long, w2 long, w3 long, n long")
    return rows.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("reach")).where(F.col("reach") >= least).select("w1", "w2", "w3")


def packed(number: int, keys: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
    """Keys and some numbers of each, packed for the shards that they belong to."""
    shard = (folded(keys) % np.uint64(number)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, keys, extra = shard[order], keys[order], extra[order]
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    body = lambda x: pa.array([_bytes(x[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]]), body(keys), body(extra)], names=["shard", "keys", "extra"])


CHUNKS = "shard long, keys binary, extra binary"


class Shards:
    """Keys (w1, w2, w3, n) dealt to shards, each with an array of numbers by slot."""

    def __init__(self, table: DataFrame, number: int):
        self.table, self.number, self.spark = table, number, table.sparkSession

    @classmethod
    def build(cls, keys: DataFrame, count: int) -> Shards:
        number = max(1, -(-count // SHARD_KEYS))

        def deal(batches):
            for batch in batches:
                shard = (folded(_matrix(batch)) % np.uint64(number)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", "w1", "w2", "w3", "n"])

        def gather(batches):
            for shard, found, n in _by_shard(batches):
                yield _shard_batch(shard, found, n)

        rows = keys.select("w1", "w2", "w3", "n").mapInArrow(deal, "shard long, w1 long, w2 long, w3 long, n long")
        ordered = rows.repartition(_deal(keys.sparkSession), "shard").sortWithinPartitions("shard")
        return cls(cut(ordered.mapInArrow(gather, "shard long, keys binary, counts binary")), number)

    def meet(self, chunks: DataFrame, work, schema: str) -> DataFrame:
        """Run `work(shard, hash, numbers)` over the chunks of each shard, which up to FAN tasks share."""
        fan = min(FAN, max(1, _deal(self.spark) // self.number))
        shards = self.table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("lane"), F.lit(0).alias("kind"), "keys", F.col("counts").alias("extra"))
        lanes = chunks.select("shard", F.pmod(F.spark_partition_id(), F.lit(fan)).alias("lane"), F.lit(1).alias("kind"), "keys", "extra")
        rows = shards.unionByName(lanes).repartition(_deal(self.spark), "shard", "lane").sortWithinPartitions("shard", "lane", "kind")

        def stream(batches):
            at = state = None
            for batch in batches:
                for r in range(batch.num_rows):
                    place = (batch.column("shard")[r].as_py(), batch.column("lane")[r].as_py())
                    keys = np.frombuffer(batch.column("keys")[r].as_py(), np.int64).reshape(-1, LONGEST)
                    extra = np.frombuffer(batch.column("extra")[r].as_py(), np.int64)
                    if place == at:
                        yield from state.take(keys, extra)
                        continue
                    if state is not None:
                        yield from state.end()
                    at, table = place, PerfectHash(keys)
                    numbers = np.empty_like(extra)
                    numbers[table.find(keys)] = extra
                    state = work(place[0], table, numbers)
            if state is not None:
                yield from state.end()

        return rows.select("shard", "lane", "keys", "extra").mapInArrow(stream, schema)


def _deal(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype=np.int64).tobytes()


def _by_shard(batches):
    """(shard, keys, n) of rows sorted by shard."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shard_now = None
    for batch in batches:
        shards = np.asarray(batch.column(0))
        keys, n = np.stack([np.asarray(batch.column(c)) for c in (1, 2, 3)], axis=1), np.asarray(batch.column(4))
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if shards[a] != shard_now and held:
                    yield shard_now, np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held])
                    held = []
                shard_now = int(shards[a])
                held.append((keys[a:b], n[a:b]))
    if held:
        yield shard_now, np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held])


def _shard_batch(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([_bytes(keys)], pa.binary()), pa.array([_bytes(counts)], pa.binary())], names=["shard", "keys", "counts"])


class _Counting:
    """Adds up what comes to a shard by slot."""

    def __init__(self, shard, table, counts):
        self.shard, self.table, self.total = shard, table, np.zeros(len(table), dtype=np.int64)

    def take(self, keys, n):
        slots = self.table.find(keys)
        known = slots >= 0
        whole = np.bincount(slots[known], weights=n[known], minlength=len(self.total))  # doubles: a chunk's sums are far below 2 ** 53
        self.total += whole.astype(np.int64)
        return ()

    def end(self):
        yield pa.RecordBatch.from_arrays([pa.array([self.shard]), pa.array([_bytes(self.total)], pa.binary())], names=["shard", "total"])


class _Reading:
    """Answers with the numbers of the keys that are asked for, beside what each question carried."""

    def __init__(self, shard, table, numbers):
        self.table, self.numbers = table, numbers

    def take(self, keys, extra):
        slots = self.table.find(keys)
        if (slots < 0).any():
            raise ValueError("a part of a candidate is not among the counted phrases")
        asked = extra.reshape(-1, LONGEST + 2)
        yield pa.RecordBatch.from_arrays([*(pa.array(asked[:, c]) for c in range(LONGEST + 2)), pa.array(self.numbers[slots])], names=["w1", "w2", "w3", "a", "side", "f"])

    def end(self):
        return ()


def _tree_sum(parts: DataFrame, spark: SparkSession) -> DataFrame:
    """One array of totals for each shard: arrays of a shard meet in one task, read from a sorted stream."""

    def add(batches):
        shard_now, total = None, None
        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(body, np.int64)
                if shard != shard_now:
                    if total is not None:
                        yield _total(shard_now, total)
                    shard_now, total = shard, x.copy()
                else:
                    total += x
        if total is not None:
            yield _total(shard_now, total)

    return parts.repartition(_deal(spark), "shard").sortWithinPartitions("shard").mapInArrow(add, "shard long, total binary")


def _total(shard: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([_bytes(total)], pa.binary())], names=["shard", "total"])


def count_phrases(texts: DataFrame, shards: Shards, known: Apriori, seed: int) -> Shards:
    """The shards with the counts of phrases of two words and more by slot; words keep the count they came with."""
    number = shards.number

    def emit(batches):
        for batch in slices(batches, 0, SLICE):
            for run in Words(batch.column(0), batch.column(1), seed).runs():
                for keys, n in known.phrases(*run, (2, 3)):
                    if len(n):
                        yield packed(number, keys, n)
        trim()

    chunks = texts.mapInArrow(emit, CHUNKS)
    totals = _tree_sum(shards.meet(chunks, _Counting, "shard long, total binary"), shards.spark)

    def filled(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys = np.frombuffer(batch.column("keys")[r].as_py(), np.int64).reshape(-1, LONGEST)
                table, counts = PerfectHash(keys), np.frombuffer(batch.column("counts")[r].as_py(), np.int64)
                by_slot = np.frombuffer(batch.column("total")[r].as_py(), np.int64)[table.find(keys)]
                yield _shard_batch(batch.column("shard")[r].as_py(), keys, np.where(keys[:, 1] != 0, by_slot, counts))

    joined = shards.table.join(totals, "shard").select("shard", "keys", "counts", "total")
    return Shards(cut(joined.mapInArrow(filled, "shard long, keys binary, counts binary")), number)


def phrases_of(table: DataFrame) -> DataFrame:
    """The candidates of two words and more of a table of shards: w1, w2, w3, a."""

    def rows(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, n = np.frombuffer(keys, np.int64).reshape(-1, LONGEST), np.frombuffer(counts, np.int64)
                long = k[:, 1] != 0
                yield pa.RecordBatch.from_arrays([*(pa.array(k[long, c]) for c in range(LONGEST)), pa.array(n[long])], names=["w1", "w2", "w3", "a"])

    return table.select("keys", "counts").mapInArrow(rows, "w1 long, w2 long, w3 long, a long")


def read_cuts(shards: Shards) -> DataFrame:
    """w1, w2, w3, a and cuts (k, l, r) of each candidate: its parts ask their shards for what the arrays hold."""
    number = shards.number
    sides = [(size, k, side) for size in range(2, LONGEST + 1) for k in range(1, size) for side in (0, 1)]

    def ask(batches):
        for batch in batches:
            words, a = _matrix(batch), np.asarray(batch.column(LONGEST))
            size = (words != 0).sum(axis=1)
            for n, k, side in sides:
                own = np.flatnonzero(size == n)
                if len(own):
                    part = words[own, k:n] if side else words[own, :k]
                    keys = np.zeros((len(own), LONGEST), dtype=np.int64)
                    keys[:, : part.shape[1]] = part
                    yield packed(number, keys, np.column_stack([words[own], a[own], np.full(len(own), 2 * k + side)]))

    chunks = phrases_of(shards.table).mapInArrow(ask, CHUNKS)
    answers = shards.meet(chunks, _Reading, "w1 long, w2 long, w3 long, a long, side long, f long")
    found = [F.max(F.when(F.col("side") == i, F.col("f"))).alias(f"f{i}") for i in range(2, 2 * LONGEST)]
    cuts = answers.groupBy("w1", "w2", "w3", "a").agg(*found)
    parts = [F.when(F.col(f"f{2 * k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))) for k in range(1, LONGEST)]
    return cuts.select("w1", "w2", "w3", "a", F.array_compact(F.array(*parts)).alias("cuts"))


def exact_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), in decimals of 38 digits."""
    big = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big(a) * big(a), big(l) * big(r))


def covered(found: DataFrame, percent: int) -> DataFrame:
    """Pairs that are in a triple with at least `percent` of their count."""
    pairs = F.explode(F.array(F.struct(F.col("w1").alias("x"), F.col("w2").alias("y")), F.struct(F.col("w2").alias("x"), F.col("w3").alias("y"))))
    longer = found.where("w3 <> 0").select(pairs.alias("p"), "a").groupBy(F.col("p.x").alias("w1"), F.col("p.y").alias("w2")).agg(F.max("a").alias("most"))
    return found.where("w3 = 0").join(longer, ["w1", "w2"]).where(F.col("most") * 100 >= F.col("a") * percent).select("w1", "w2", "w3")


def _words(docs: DataFrame) -> tuple[DataFrame, int]:
    """All words, and the seed under which no two have the same hash."""
    for seed in range(100):
        words = cut(count_words(docs, seed))
        if words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1 or w = 0").isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = COVERED) -> DataFrame:
    """The first `top` phrases of each language of texts (text, lang): lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    with scratch(spark) as keep:
        words, seed = _words(texts)
        frequent = words.where(F.col("n") >= least)
        single = frequent.select(F.col("w").alias("w1"), F.lit(0).cast("long").alias("w2"), F.lit(0).cast("long").alias("w3"), "n")
        sent = [spark.sparkContext.broadcast(bitmap(single, n_words := single.count()))]
        pairs = cut(grow(texts, 2, Apriori(sent[0]), seed, least))
        sent.append(spark.sparkContext.broadcast(bitmap(pairs, n_pairs := pairs.count())))
        triples = cut(grow(texts, 3, Apriori(*sent), seed, least))
        sent.append(spark.sparkContext.broadcast(bitmap(triples, n_triples := triples.count())))
        keys = single.unionByName(pairs.unionByName(triples).withColumn("n", F.lit(0).cast("long")))
        shards = count_phrases(texts, Shards.build(keys, n_words + n_pairs + n_triples), Apriori(*sent), seed)
        for b in sent:
            b.destroy()
        found = cut(read_cuts(shards))
        out = keep(cut(_ranked(found, words, frequent, top, percent)))
    return out


def _ranked(found: DataFrame, words: DataFrame, frequent: DataFrame, top: int, percent: int) -> DataFrame:
    scored = F.transform("cuts", lambda c: F.struct(exact_score(F.col("a"), c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = found.join(covered(found, percent), ["w1", "w2", "w3"], "left_anti").withColumn("c", F.array_min(scored)).select("w1", "w2", "w3", "a", "c.*")
    name = lambda i: frequent.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"s{i}"), *(["lang"] if i == 1 else []))
    order = [F.col("score").desc(), F.col("a").desc()]
    # ties are kept until their phrases are known
    near = best.join(name(1), "w1").withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    spelled = near.join(name(2), "w2").join(name(3), "w3", "left").withColumn("phrase", F.concat_ws(" ", "s1", "s2", "s3"))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of every language of the documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
