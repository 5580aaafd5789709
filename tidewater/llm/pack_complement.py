"""Packing token sequences by exact-complement hashing.

Documents become token ids; only those longer than a sequence are cut. How
pieces are packed depends on their lengths alone, and there are at most
`capacity` lengths, so the plan is made from the histogram: for the longest
length left, the availability table answers which single length, pair or triple
sums to the gap exactly; found combinations are consumed as often as counts
allow, and where none exists the best-fitting length is added and the search
repeated for the new gap. Pieces are then numbered within their length and the
number alone says which sequence and offset a piece gets. Neither texts nor
pieces meet in one task; the plan's size depends on the capacity, not the data.

Defined results: null or blank text is the end id alone; identical rows are
packed separately; pieces of equal length are numbered by hash bucket, then by
id, piece and checksum, and rows equal in all of these are alike; very long texts are a slice of their own; an
empty table gives no pieces; extra columns are ignored, and `pack` keeps those of
its pieces.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import cut, slices, split_words, trim

CAPACITY = 2048
END_ID = 0
#: Parts of texts whose ids a worker keeps at a time; a full cache is emptied.
CACHE_PARTS = 300_000
RANK_GROUP = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: How the tokenizer cuts a text, for characters up to U+00FF (fixed values: letters, digits, white space).
_LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LATIN_LETTERS}]+|[{_LATIN_DIGITS}]|[^\\t-\\r \x85\xa0{_LATIN_LETTERS}{_LATIN_DIGITS}]+")


class WordIds:
    """Ids of the parts of texts as little-endian bytes, behind a bounded cache.

    The tokenizer lower-cases, drops white space and encodes each run of letters,
    each digit and each run of other characters by itself, so a part has the same
    ids wherever it stands. Texts that hold the string of an added token, such as an
    end-of-text mark, are encoded whole, as the tokenizer does. Runs of letters not seen lately are encoded many to a
    call and cut apart after the ids that end a word. Texts with characters above
    U+00FF are cut at white space alone and their words are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings of added tokens, for which the tokenizer looks before it cuts a text
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        letters = [p for p in parts if p.isalpha() and _latin(p)]
        others = list(parts.difference(letters))
        for a in range(0, len(letters), 5000):
            some = letters[a : a + 5000]
            body = self._encode([" ".join(some)])[0]
            after = np.flatnonzero(self.ends[np.frombuffer(body, dtype="<u4")]) + 1
            if len(after) != len(some):  # not cut as expected: one by one
                self.known.update(zip(some, self._encode(some)))
                continue
            edges = [0, *(after * 4).tolist()]
            self.known.update((w, body[x:y]) for w, x, y in zip(some, edges, edges[1:]))
        for a in range(0, len(others), 5000):
            some = others[a : a + 5000]
            self.known.update(zip(some, self._encode(some)))

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without an end."""
        lowered = [t.lower() if t else "" for t in texts]
        whole = [i for i, t in enumerate(lowered) if any(a in t for a in self.added)]
        if whole:
            out: list[bytes | None] = [None] * len(texts)
            rest = sorted(set(range(len(texts))).difference(whole))
            for rows, found in ((whole, self._encode([texts[i] for i in whole])), (rest, self.texts([texts[i] for i in rest]))):
                for i, ids in zip(rows, found):
                    out[i] = ids
            return out
        cut = [_LATIN_PARTS.findall(t.lower()) if t and _latin(t) else split_words(t) for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        found = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            fresh = {flat[i] for i in missing}
            if len(self.known) + len(fresh) > CACHE_PARTS:
                self.known.clear()
            self._learn(fresh)
            for i in missing:
                found[i] = self.known[flat[i]]
        edges = [0, *itertools.accumulate(map(len, cut))]
        return [b"".join(found[x:y]) for x, y in zip(edges, edges[1:])]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own ids for a tokenizer file; they outlive a task."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def encode(batches):
        ids_of = word_ids(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        size = capacity * 4
        for batch in slices(batches, 1):
            rows = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.texts(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), size)):
                    body = ids[at : at + size]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(body) // 4, zlib.crc32(body))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        ids_of.known.clear()  # workers are used again by other steps
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES)


class PackPlan:
    """Patterns of lengths with multiplicities, from a histogram of lengths."""

    def __init__(self, counts: np.ndarray):
        """counts[l]: number of pieces of length l; the last index is the capacity."""
        self.capacity = len(counts) - 1
        self.counts = counts.astype(np.int64).copy()
        self.patterns: list[tuple[list[int], int]] = []
        for longest in range(self.capacity, 0, -1):
            while self.counts[longest] > 0:
                self._one(longest)

    def _fill(self, gap: int, left: np.ndarray) -> list[int] | None:
        """One, two or three available lengths that sum to the gap, the longest ones first."""
        if left[gap] > 0:
            return [gap]
        have = left > 0
        # complement look-up: a is in the table and so is gap - a
        both = np.flatnonzero(have[1 : gap // 2 + 1] & have[gap - 1 : gap - gap // 2 - 1 : -1]) + 1
        for a in both:
            if 2 * a != gap or left[a] > 1:
                return [gap - int(a), int(a)]
        for a in np.flatnonzero(have[1:gap])[::-1] + 1:
            a, rest = int(a), gap - int(a)
            if rest > 2 * a:
                break  # a would no longer be the longest of the three
            low = max(1, rest - a)
            pair = np.flatnonzero(have[low : rest // 2 + 1] & have[rest - low : rest - rest // 2 - 1 : -1]) + low
            for b in pair:
                want = [a, rest - int(b), int(b)]
                if all(left[x] >= want.count(x) for x in want):
                    return want
        return None

    def _one(self, longest: int) -> None:
        left = self.counts.copy()
        used, gap = [longest], self.capacity - longest
        left[longest] -= 1
        while gap > 0:
            if (exact := self._fill(gap, left)) is not None:
                used += exact
                break
            fits = np.flatnonzero(left[1 : gap + 1] > 0)
            if not len(fits):
                break
            best = int(fits[-1]) + 1
            used.append(best)
            left[best] -= 1
            gap -= best
        lengths, times = np.unique(used, return_counts=True)
        repeat = int((self.counts[lengths] // times).min())
        self.counts[lengths] -= times * repeat
        self.patterns.append((sorted(used, reverse=True), repeat))

    def tables(self) -> tuple[np.ndarray, ...]:
        """Look-up arrays sorted by (length, first rank): key, first sequence, uses, offset, length."""
        rows, taken, sequence = [], {}, 0
        for used, repeat in self.patterns:
            offset = 0
            for length in sorted(set(used), reverse=True):
                n = used.count(length)
                first = taken.get(length, 0)
                rows.append((length, first, sequence, n, offset))
                taken[length] = first + n * repeat
                offset += n * length
            sequence += repeat
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        return (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def length_ranks(pieces: DataFrame, n: int) -> DataFrame:
    """Number the pieces of each length from 0 (`__rank`), in groups small enough for any length."""
    groups = max(64, min(65536, n // RANK_GROUP))
    rows = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    ahead = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n")).select("length", "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return rows.withColumn("__nth", nth).join(base, ["length", "__bucket"]).withColumn("__rank", F.col("__base") + F.col("__nth") - 1).drop("__nth", "__base", "__bucket")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that hold `length`."""
    pieces = cut(pieces)
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram:
        counts[length] = n
    keys, firsts, sequences, uses, offsets = PackPlan(counts).tables()
    columns = [f.name for f in pieces.schema.fields]

    def assign(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            ahead = rank - firsts[at]
            sequence = sequences[at] + ahead // uses[at]
            offset = offsets[at] + ahead % uses[at] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    ranked = length_ranks(pieces, int(counts.sum())).select(*columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
