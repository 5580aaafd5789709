"""Repeated passages by sharded Aho-Corasick automata.

A window is a run of WINDOW words. A word is removed if it lies in a window
whose word sequence also starts in a document with a smaller id.

1. Each window is represented by its anchor, the smallest hash among the ANCHOR
   words long pieces in it, so equal windows have equal anchors and a document
   has few of them. Anchors that only one document has are dropped.
2. Documents that hold shared anchors hand on the windows around them; windows
   sorted by their 96-bit hash name the first document of each sequence, which
   confirms the recurring ones and where they recur.
3. The recurring passages of a slice of documents, cut into windows that cover
   them, are compiled into one Aho-Corasick automaton over words, through which
   the whole documents of the slice are streamed: each occurrence found removes
   its words. Automata are as small as the slices, however large the collection
   of passages grows.

Sorted streams hold one sequence at a time, so no passage, however common, is
gathered in a task.

Defined results: null or blank text has no words; texts of fewer words than a
window lose nothing; rows that share a doc_id don't count as sources for each
other; a row without doc_id is neither source nor changed; of equal sequences the
smallest id keeps its words. Kept words are joined
by one space. Very long texts are a shard of their own, an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import cut, release, scratch, slices, split_words, words_column
from tidewater.llm.shingles import column_words, window_hashes

WINDOW = 13
ANCHOR = 7
#: Bytes of text whose recurring sequences make one automaton.
SHARD_CHARS = 400_000


def window_anchors(ids: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor of each window of a text's word hashes, as int64."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    pieces = window_hashes(ids, anchor)
    out = pieces[:n].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(out, pieces[j : j + n], out=out)
    return out.view(np.int64)


def _same_key(columns: list[np.ndarray]) -> np.ndarray:
    """Where a sorted row's key equals the row before's."""
    out = np.zeros(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Anchors that two documents or more have: anchor, doc_id."""

    def emit(batches):
        for batch in slices(batches, 1):
            found, owners = [], []
            hashes, bounds = column_words(batch.column(1))
            anchors = window_anchors(hashes)
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a >= WINDOW:
                    own = np.unique(anchors[a : b - WINDOW + 1])
                    found.append(own)
                    owners.append(np.full(len(own), doc_id))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(owners))], names=["anchor", "doc_id"])

    def shared(batches):
        last = None  # anchor, doc_id, handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            a, d = (batch.column(i).to_numpy() for i in range(2))
            if last is not None:
                a, d = np.concatenate([[last[0]], a]), np.concatenate([[last[1]], d])
            handed = bool(last and last[2])
            fresh = ~_same_key([a, d])
            a, d = a[fresh], d[fresh]
            same = _same_key([a])
            out = same.copy()
            out[:-1] |= same[1:]
            done = bool(out[-1]) or (handed and len(a) == 1)
            if handed:
                out[0] = False
            last = (a[-1], d[-1], done)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(d[out])], names=["anchor", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(emit, "anchor long, doc_id long")
    return rows.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc_id").mapInArrow(shared, "anchor long, doc_id long")


def recurring_windows(held: DataFrame) -> DataFrame:
    """Windows that also start in a document with a smaller id: doc_id, place (text check and position).

    `held`: doc_id, text, anchors (the shared anchors of the document).
    """

    def emit(batches):
        for batch in slices(batches, 1):
            out: list[list[np.ndarray]] = [[], [], [], []]
            hashes, bounds = column_words(batch.column(1))
            all_anchors, h1, h2 = window_anchors(hashes), window_hashes(hashes, WINDOW, 1), window_hashes(hashes, WINDOW, 2)
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), bounds[:-1].tolist(), bounds[1:].tolist())
            for doc_id, text, anchors, a, b in rows:
                if b - a < WINDOW:
                    continue
                shared = np.sort(anchors.values.to_numpy())
                own = all_anchors[a : b - WINDOW + 1]
                at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                where = np.flatnonzero(shared[at] == own)
                if len(where):
                    place = (zlib.crc32(text.encode("utf-8", "surrogatepass")) << 32) + where.astype(np.uint64)
                    second = (h2[a + where] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    columns = (h1[a + where].view(np.int64), second, np.full(len(where), doc_id), place.view(np.int64))
                    for c, v in zip(out, columns):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["h1", "h2", "doc_id", "place"])

    def later(batches):
        key, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, d, p = (batch.column(i).to_numpy() for i in range(4))
            start = ~_same_key([h1, h2])
            owner = np.maximum.accumulate(np.where(start, np.arange(len(h1)), 0))
            least = d[owner]
            if key == (h1[0], h2[0]):
                least = np.where(owner == 0, first, least)
            key, first = (h1[-1], h2[-1]), least[-1]
            out = least < d
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(d[out]), pa.array(p[out])], names=["doc_id", "place"])

    rows = held.mapInArrow(emit, "h1 long, h2 int, doc_id long, place long")
    return rows.repartition(F.col("h1")).sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(later, "doc_id long, place long")


def compile_shard(sequences: dict[str, int]):
    """Automaton over encoded words: each sequence with the smallest id from which on it is removed."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for sequence, least in sequences.items():
        automaton.add_word(sequence, least)
    automaton.make_automaton()
    return automaton


#: Words that one character can stand for; with more distinct words in a shard each takes two.
ONE_CHARACTER = 1_000_000


def encode_words(documents: list[list[str]]) -> tuple[list[str], int]:
    """Each document as characters, equal words alike, and how many characters a word takes."""
    numbers: dict[str, int] = {}
    ids = [[numbers.setdefault(w, len(numbers)) for w in words] for words in documents]
    letter = lambda n: chr(n + 1 if n + 1 < 0xD800 else n + 0x801)  # noqa: E731  no surrogates
    width = 1 if len(numbers) <= ONE_CHARACTER else 2
    codes = [letter(n) if width == 1 else letter(n // ONE_CHARACTER) + letter(n % ONE_CHARACTER) for n in range(len(numbers))]
    return ["".join(map(codes.__getitem__, own)) for own in ids], width


def tiles(starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Starts that cover the same words: every window-th start of each unbroken run, and its last."""
    if not len(starts):
        return starts
    new = np.concatenate([[True], np.diff(starts) > 1])
    first = starts[np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))]
    last = np.concatenate([new[1:], [True]])
    return starts[((starts - first) % window == 0) | last]


def removal_masks(documents: list[tuple[int, list[str], np.ndarray]]) -> list[np.ndarray]:
    """Masks of removed words for a shard of (doc_id, words, starts of recurring windows)."""
    encoded, width = encode_words([words for _, words, _ in documents])
    size = WINDOW * width
    sequences: dict[str, int] = {}
    for (doc_id, _, starts), text in zip(documents, encoded):
        for s in tiles(np.sort(starts)).tolist():
            key = text[s * width : s * width + size]
            if sequences.get(key, doc_id) >= doc_id:
                sequences[key] = doc_id
    masks = [np.zeros(len(words), bool) for _, words, _ in documents]
    if not sequences:
        return masks
    automaton = compile_shard(sequences)
    for (doc_id, words, _), text, mask in zip(documents, encoded, masks):
        ends = np.array([e + 1 for e, least in automaton.iter(text) if least <= doc_id], dtype=np.int64)
        ends = ends[ends % width == 0] // width
        if len(ends):
            edge = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(edge, ends - WINDOW, 1)
            np.add.at(edge, ends, -1)
            mask[:] = np.cumsum(edge[:-1]) > 0
    return masks


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Changed rows of `docs` (doc_id, text): doc_id, text_crc32, n_removed, kept (text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    with scratch(docs.sparkSession) as keep:
        anchors = cut(shared_anchors(rows))
        # a document's anchors are fewer than its words
        per_doc = anchors.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        held = keep(cut(rows.join(per_doc, "doc_id").select("doc_id", "text", "anchors")))
    places = cut(recurring_windows(held))
    release(docs.sparkSession)
    starts = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    work = held.select("doc_id", "text").join(starts, "doc_id").select("doc_id", "text", "places")

    def stream(batches):
        for batch in slices(batches, 1, SHARD_CHARS):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            checks = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
            shard = []
            for doc_id, text, check, places in zip(ids, texts, checks, batch.column(2)):
                place = places.values.to_numpy().view(np.uint64)
                own = place[place >> np.uint64(32) == check] & np.uint64(0xFFFFFFFF)
                shard.append((doc_id, split_words(text), own.astype(np.int64)))
            out: tuple[list, ...] = ([], [], [], [])
            for (doc_id, words, _), check, mask in zip(shard, checks, removal_masks(shard)):
                removed = int(mask.sum())
                if removed:
                    kept = " ".join([w for w, m in zip(words, mask.tolist()) if not m])
                    for c, v in zip(out, (doc_id, check, removed, kept)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "text_crc32", "n_removed", "kept"])

    return work.mapInArrow(stream, "doc_id long, text_crc32 long, n_removed long, kept string")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every whole text of `documents` as repeats of earlier documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    changed = remove_repeats(docs).select("doc_id", "text_crc32", "n_removed", F.sha2("kept", 256).alias("sha")).distinct()
    words = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), words_column(F.col("text")).alias("w"))
    whole = words.select("doc_id", "text_crc32", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join("w", " "), 256).alias("whole"))
    out = whole.join(changed, ["doc_id", "text_crc32"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"))
