"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between
the labels of neighbouring words are learnt. Forward-backward gives each word's
label distribution, so text that switches between languages is labelled word by
word; a document's language is the label with the most expected words.

Training sequences are labelled texts cut into segments and dealt anew, so that
they switch languages as mixed text does. The sample of labelled rows is bounded
(`SAMPLE_PER_LANGUAGE` whole texts each, by a hash of the id, of `FIT_BYTES` bytes
together; longer texts than a sixteenth of that are no examples); every text is labelled
whole, in one pass without a shuffle. Forward-backward runs over all texts of a
slice at once: texts are cut into short chunks, chunk transfer matrices are
multiplied along each text, and the chunks are then finished in parallel.

Defined results: null texts and texts without a letter are `und` with score 0;
if no language can be learnt all are; words without letters follow their
neighbours. Equal shares go to the language first by code point. Very long texts
are a slice of their own. Repeated rows are labelled alike, an empty table stays
empty; other columns pass through.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import fit_in_task, fold, runs, split_words, whole_texts
from tidewater.llm.shingles import mix

SAMPLE_PER_LANGUAGE = 100
#: Bytes of all sampled texts of a language.
FIT_BYTES = 4_000_000
SEGMENT = 60
SEGMENTS_PER_SEQUENCE = 20
ITERATIONS = 25
CHUNK = 32
CACHE_WORDS = 400_000
#: Size of the table of hashed features.
FEATURES = 1 << 18
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + "«»“”‘’…–—¡¿"


def has_letter(text: str) -> bool:
    """Whether a text has a letter; characters such as a superscript two are word characters but no letters."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: feature ids, and where each word's begin.

    A word is lower-cased, freed of punctuation around it and marked with ^ and $.
    Its features are its 2- and 3-grams, the 4-grams at its ends (affixes of three
    letters; shorter ones are n-grams with a mark) and, last, the word as an entry
    of the lexicon. Words without a letter have the lexicon entry 0 alone.
    """
    marked = []
    entry = np.zeros(len(words), dtype=np.int64)
    for i, w in enumerate(words):
        w = w.lower().strip(_EDGES)
        if w.isalpha() or has_letter(w):
            marked.append(f"^{w}$")
            entry[i] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % (FEATURES - 1) + 1
        else:
            marked.append("")
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    owner = np.repeat(np.arange(len(size)), size)
    left = (start + size)[owner] - np.arange(len(code))  # characters from here to the word's end
    ids, owners = [], []
    gram = code.copy()
    with np.errstate(over="ignore"):
        for k in (2, 3, 4):
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[k - 1 :]
            fits = left[: len(gram)] >= k
            if k == 4:
                fits &= (left[: len(gram)] == k) | (np.arange(len(gram)) == start[owner[: len(gram)]])
            where = np.flatnonzero(fits)
            ids.append((mix(gram[where], k) % np.uint64(FEATURES - 1)).astype(np.int64) + 1)
            owners.append(owner[where])
    ids.append(entry)
    owners.append(np.arange(len(words)))
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return ids[order], np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(words) else counts


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks of a batch of sequences: positions [chunk, CHUNK] (-1: padding), sequence and number of each chunk."""
    per = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), per)
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    number = np.arange(len(owner)) - first[owner]
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = number[:, None] * CHUNK + np.arange(CHUNK)[None, :]
    position = np.where(inside < lengths[owner][:, None], start[owner][:, None] + inside, -1)
    return position, owner, first, per


def forward_backward(scores: np.ndarray, transition: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions [token, label] and expected transitions [label, label].

    `scores` holds the emission scores of all tokens, sequence after sequence.
    Before the first token every label is equally likely.
    """
    n, labels = scores.shape
    keep = lengths > 0
    lengths = lengths[keep]
    if not len(lengths):
        return np.zeros((n, labels)), np.zeros((labels, labels))
    position, owner, first, per = _layout(lengths)
    real = position >= 0
    emission = np.exp(scores - scores.max(1, keepdims=True))
    e = np.ones((*position.shape, labels))
    e[real] = emission[position[real]]
    a = np.exp(transition - transition.max())
    whole = real.all(1)
    # transfer matrix of each chunk
    m = np.broadcast_to(np.eye(labels), (len(owner), labels, labels)).copy()
    for t in range(CHUNK):
        step = (m @ a) * e[:, t, None, :]
        step /= step.max((1, 2), keepdims=True)
        m = step if whole.all() else np.where(real[:, t, None, None], step, m)
    # along each sequence, for all sequences side by side, the longest first
    into, out = np.empty((len(owner), labels)), np.empty((len(owner), labels))
    order = np.argsort(-per, kind="stable")
    deep = per[order]
    active = np.searchsorted(-deep, -np.arange(deep[0]), side="left")
    v = np.full((len(order), labels), 1.0 / labels)
    for k in range(int(deep[0])):
        rows = first[order[: active[k]]] + k
        into[rows] = v[: active[k]]
        v[: active[k]] = np.einsum("ni,nij->nj", v[: active[k]], m[rows])
        v[: active[k]] /= v[: active[k]].sum(1, keepdims=True)
    u = np.full((len(order), labels), 1.0 / labels)
    for k in range(int(deep[0]) - 1, -1, -1):
        rows = first[order[: active[k]]] + k
        out[rows] = u[: active[k]]
        u[: active[k]] = np.einsum("nij,nj->ni", m[rows], u[: active[k]])
        u[: active[k]] /= u[: active[k]].sum(1, keepdims=True)
    # inside the chunks
    alpha, before, beta = np.empty_like(e), np.empty_like(e), np.empty_like(e)
    x = into
    for t in range(CHUNK):
        before[:, t] = x
        step = (x @ a) * e[:, t]
        step /= step.sum(1, keepdims=True)
        x = np.where(real[:, t, None], step, x)
        alpha[:, t] = x
    x = out
    for t in range(CHUNK - 1, -1, -1):
        beta[:, t] = x
        step = (e[:, t] * x) @ a.T
        step /= step.sum(1, keepdims=True)
        x = np.where(real[:, t, None], step, x)
    gamma = np.zeros((n, labels))
    g = alpha[real] * beta[real]
    gamma[position[real]] = g / g.sum(1, keepdims=True)
    inner = real.copy()
    inner[first, 0] = False  # nothing stands before a sequence's first token
    left, right = before[inner], e[inner] * beta[inner]
    norm = ((left @ a) * right).sum(1, keepdims=True)
    return gamma, a * ((left / norm).T @ right)


class LanguageCrf:
    """Feature weights [feature, label], transitions and labels."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray):
        self.labels, self.weights, self.transition = labels, weights, transition
        self._known: dict[str, int] = {}
        self._scores = np.zeros((CACHE_WORDS + 1, len(labels)), dtype=np.float32)

    def __reduce__(self):
        return LanguageCrf, (self.labels, self.weights, self.transition)

    def _word_scores(self, words: list[str]) -> np.ndarray:
        ids, start = features(words)
        return np.add.reduceat(self.weights[ids], start, axis=0)

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self._known
        ids = list(map(known.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if not missing:
            return self._scores[np.array(ids, dtype=np.int64)]
        fresh = list({words[i] for i in missing})
        scores = self._word_scores(fresh)
        if len(known) + len(fresh) > CACHE_WORDS:
            place = {w: i for i, w in enumerate(fresh)}
            out = self._scores[np.array([0 if x is None else x for x in ids], dtype=np.int64)]
            out[missing] = scores[[place[words[i]] for i in missing]]
            known.clear()
            return out
        first = len(known)
        known.update(zip(fresh, range(first, first + len(fresh))))
        self._scores[first : first + len(fresh)] = scores
        for i in missing:
            ids[i] = known[words[i]]
        return self._scores[np.array(ids, dtype=np.int64)]

    def distributions(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Label distributions of all words of the texts, and the number of words of each."""
        words, lengths = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            own = split_words(t)
            lengths[i] = len(own)
            words += own
        if not words:
            return np.zeros((0, len(self.labels))), lengths
        return forward_backward(self.emissions(words), self.transition, lengths)[0], lengths

    def languages(self, texts: list) -> list[tuple[str, float]]:
        """Language and score of each text; the score is the language's share of expected words."""
        gamma, lengths = self.distributions(texts)
        out, at = [], 0
        for t, n in zip(texts, lengths.tolist()):
            share = gamma[at : at + n].mean(0) if n else None
            at += n
            if n and has_letter(t):
                best = int(np.argmax(share))
                out.append((self.labels[best], float(min(1.0, share[best]))))
            else:
                out.append((UNDETERMINED, 0.0))
        return out

    def spans(self, texts: list) -> list[list[tuple[int, int, str]]]:
        """Maximal runs of words of one language: (first word, word after the last, language)."""
        gamma, lengths = self.distributions(texts)
        best, out, at = gamma.argmax(1), [], 0
        for n in lengths.tolist():
            own = best[at : at + n]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else [0]
            out.append([(a, b, self.labels[own[a]]) for a, b in zip(cuts, cuts[1:])])
            at += n
        return out


def fit(texts: list[tuple[str, str]], iterations: int = ITERATIONS, seed: int = 1) -> LanguageCrf | None:
    """Fit on (text, language) pairs by gradient ascent with per-weight step sizes."""
    labels = sorted({lang for _, lang in texts})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    segments = []
    for text, lang in texts:
        words = split_words(text)
        segments += [(words[a : a + SEGMENT], labels.index(lang)) for a in range(0, len(words), SEGMENT)]
    order = rng.permutation(len(segments))
    index: dict[str, int] = {}
    ids, gold, lengths = [], [], []
    for a in range(0, len(order), SEGMENTS_PER_SEQUENCE):
        n = 0
        for k in order[a : a + SEGMENTS_PER_SEQUENCE]:
            words, label = segments[k]
            ids += [index.setdefault(w, len(index)) for w in words]
            gold += [label] * len(words)
            n += len(words)
        lengths.append(n)
    ids, gold, lengths = np.array(ids, dtype=np.int64), np.array(gold, dtype=np.int64), np.array(lengths, dtype=np.int64)
    feature_of, start = features(list(index))
    word_of = np.repeat(np.arange(len(index)), np.diff(np.append(start, len(feature_of))))
    frequency = np.bincount(feature_of, minlength=FEATURES)
    common = frequency[feature_of] >= 3
    if len(index):  # a word is in the lexicon if it is common in the sample
        last = np.append(start[1:], len(feature_of)) - 1
        common[last] = (np.bincount(ids, minlength=len(index)) >= 5) & (feature_of[last] > 0)
    seen_features, feature_of = np.unique(feature_of[common], return_inverse=True)
    word_of = word_of[common]
    weights, transition = np.zeros((len(seen_features), len(labels))), np.zeros((len(labels), len(labels)))
    seen, seen_t = np.full_like(weights, 1e-8), np.full_like(transition, 1e-8)
    target = np.eye(len(labels))[gold] if len(gold) else np.zeros((0, len(labels)))
    inner = np.ones(len(gold), dtype=bool)
    inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0]] = False
    observed = np.zeros_like(transition)
    if len(gold):
        np.add.at(observed, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    for _ in range(iterations):
        per = np.stack([np.bincount(word_of, weights=weights[feature_of, c], minlength=len(index)) for c in range(len(labels))], 1) if len(index) else weights
        gamma, expected = forward_backward(per[ids], transition, lengths)
        error = target - gamma
        by_word = np.stack([np.bincount(ids, weights=error[:, c], minlength=len(index)) for c in range(len(labels))], 1)
        grad = np.stack([np.bincount(feature_of, weights=by_word[word_of, c], minlength=len(seen_features)) for c in range(len(labels))], 1) - 0.5 * weights
        seen += grad**2
        weights += 0.3 * grad / np.sqrt(seen)
        grad_t = observed - expected - 0.5 * transition
        seen_t += grad_t**2
        transition += 0.3 * grad_t / np.sqrt(seen_t)
    table = np.zeros((FEATURES, len(labels)), dtype=np.float32)
    table[seen_features] = weights
    return LanguageCrf(labels, table, transition)


def fit_on(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageCrf | None:
    """Fit on about `sample_per_language` texts of each language of `docs` (doc_id, text, lang)."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return None
    # drawn by a hash threshold from the language's count, a fifth more than the sample, in the scan: only drawn rows are shuffled
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, (sample_per_language * 1.2 + 20) / n)]), F.col("lang"))
    drawn = known.withColumn("draw", F.xxhash64(F.lit(11), "doc_id")).where((F.col("draw").cast("double") + 2.0**63) / 2.0**64 <= share)
    chosen = whole_texts(drawn.select("lang", "draw", "doc_id", "text"), "lang", sample_per_language, FIT_BYTES)

    def learn(rows: list[dict]) -> LanguageCrf | None:
        rows.sort(key=lambda r: (r["lang"], r["draw"], r["doc_id"], r["text"]))
        return fit([(r["text"], r["lang"]) for r in rows]) if rows else None

    data = fit_in_task(chosen, learn)
    return pickle.loads(data) if data else None


def language_column(spark: SparkSession, model: LanguageCrf | None, text: str = "text") -> Column:
    """Column of struct(lang_pred, score) for the texts of a table."""
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            found = []
            for _, run in runs(batch.tolist()):
                found += own.languages(run)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return label(F.col(text))


def span_column(spark: SparkSession, model: LanguageCrf, text: str = "text") -> Column:
    """Column of array<struct(first, after, lang)>: the runs of words of one language."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<first:int,after:int,lang:string>>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            found = []
            for _, run in runs(batch.tolist()):
                found += [[{"first": a, "after": b, "lang": c} for a, b, c in s] for s in own.spans(run)]
            yield pd.Series(found)

    return label(F.col(text))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`, learnt outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = fit_on(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_column(spark, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
