"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary labelled texts, give each word a
probability after the word before it: discounted counts of pairs, backed off to
discounted counts of words, backed off to continuation counts that both classes
share. No word or pair of the sample is cut off: the discounts (estimated as
Chen and Goodman do) leave rare ones little of their own, and they get what the
shared counts give. All counts are of distinct words before, not of tokens, so
copies, and one text going on about a matter, count once.

The shared counts are tilted by how each class spells: a class-conditional
Kneser-Ney model of letters, again over shared lowest counts, so that a rare or
unseen form of an insult is closer to toxic text than any other rare word. The
tilt is bounded, and so is what a pair may add to its word.

A text is judged by the difference of its length-normalised log-likelihoods, over
the whole text and over its most toxic windows, so that a few insults in a long
text still count, and by how much of it lies well on the toxic side. A logistic
curve, fitted on out-of-fold differences, turns these into a score.

Fitting uses a bounded sample of labelled rows: of each class the
`sample_per_class` ids with the smallest hashes, whole texts of `FIT_BYTES` bytes
together (longer ones than a sixteenth of that are no examples). Every text is scored whole, in one pass without a shuffle;
very long ones are a run of their own.

Defined results: null and empty texts have no evidence (all differences 0) and
get the curve's value there; if a class has no labelled text, all scores are 0.
An id with labels of both kinds is toxic; of rows that share an id the smallest
text is learnt from. Equal hashes go by id. Repeated rows score alike, other columns pass through
untouched, an empty table stays empty.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import draw_limit, fold, split_words, text_slices, trim, whole_texts
from tidewater.llm.shingles import mix

SAMPLE_PER_CLASS = 3000
#: Bytes of all sampled texts of a class.
FIT_BYTES = 24_000_000
#: What rejecting an ordinary text costs, against passing a toxic one.
ORDINARY_COST = 3.0
WINDOWS = (1, 24, 96)
#: A word this far on the toxic side counts towards the text's toxic mass.
CLEARLY = 1.5
#: Letters that a letter's probability depends on, and itself.
LETTERS = 3
#: Bounds of logarithms: of the spelling's tilt, and of what a pair adds to its second word.
TILT, PAIR = 2.0, 1.0
CACHE_WORDS = 120_000
WORDS_AT_A_TIME = 20_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¡¿"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalise(word: str) -> str:
    return word.lower().strip(_EDGES)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What counts of 1, 2 and 3 or more are lowered by (index: the count, up to 3)."""
    n = [float((counts == i).sum()) for i in (1, 2, 3, 4)]
    y = n[0] / max(n[0] + 2 * n[1], 1)
    found = [0.0] + [k - (k + 1) * y * n[k] / max(n[k - 1], 1) for k in (1, 2, 3)]
    return np.clip(found, [0, 0.3, 0.5, 0.7], [0, 0.95, 1.8, 2.7])


def kept(counts: np.ndarray) -> np.ndarray:
    """Counts after their discounts."""
    return np.maximum(counts - discounts(counts)[np.minimum(counts, 3).astype(np.int64)], 0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether the wanted key is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def letter_grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each letter of the words (and a mark behind each): its word, and hashes of the last 1 to LETTERS letters."""
    marked = ["^" * (LETTERS - 1) + w + "$" for w in words]
    size = np.fromiter(map(len, marked), np.int32, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    at = np.flatnonzero(np.arange(len(code), dtype=np.int32) - (np.cumsum(size, dtype=np.int32) - size)[owner] >= LETTERS - 1).astype(np.int32)
    grams, gram = [], np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LETTERS):
            gram = gram + (code[at - k].astype(np.uint64) + np.uint64(1)) * _FACTOR ** np.uint64(k + 1)
            grams.append(gram)
    return owner[at], grams


@dataclass
class Level:
    """One order of letters of one class: discounted shares of grams, and what is left by context."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


class Spelling:
    """Letters of words by class: discounted counts, lower orders by distinct letters before, the lowest shared."""

    def __init__(self, words: list[str], weights: np.ndarray):
        """weights[c]: in how many texts of class c each word is."""
        owner, grams = letter_grams(words)
        self.levels: list[list[Level]] = [[], []]
        lowest = []
        for c in (0, 1):
            own = np.flatnonzero(weights[c][owner] > 0)
            for k in range(LETTERS - 1, -1, -1):
                if k == LETTERS - 1:
                    some, number = own, weights[c][owner[own]].astype(float)
                else:  # once for each distinct letter before
                    some = own[np.unique(grams[k + 1][own], return_index=True)[1]]
                    number = np.ones(len(some))
                keys, at, back = np.unique(grams[k][some], return_index=True, return_inverse=True)
                counts = np.bincount(back, weights=number, minlength=len(keys))
                if k == 0:
                    lowest.append((keys, counts))
                    continue
                with np.errstate(over="ignore"):
                    contexts, of = np.unique(grams[k][some[at]] - grams[0][some[at]], return_inverse=True)
                total = np.bincount(of, weights=counts, minlength=len(contexts))
                share = kept(np.floor(counts)) / total[of] if len(counts) else counts
                self.levels[c].insert(0, Level(keys, share, contexts, 1 - np.bincount(of, weights=share, minlength=len(contexts))))
        keys, back = np.unique(np.concatenate([k for k, _ in lowest]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([n for _, n in lowest]), minlength=len(keys))
        self.letters, self.common, self.rare = keys, counts / (counts.sum() + 1000), 1 / (counts.sum() + 1000)

    def log(self, words: list[str]) -> np.ndarray:
        """log p [class, word]."""
        parts = [self._log(words[a : a + WORDS_AT_A_TIME]) for a in range(0, len(words), WORDS_AT_A_TIME)]
        return np.concatenate([np.zeros((2, 0)), *parts], axis=1)

    def _log(self, words: list[str]) -> np.ndarray:
        owner, grams = letter_grams(words)
        at, hit = _find(self.letters, grams[0])
        base = np.where(hit, self.common[at], self.rare) if len(self.letters) else np.full(len(owner), self.rare)
        out = np.empty((2, len(words)))
        for c in (0, 1):
            p = base
            for k, level in enumerate(self.levels[c], 1):
                with np.errstate(over="ignore"):
                    inside, known = _find(level.contexts, grams[k] - grams[0])
                at, hit = _find(level.grams, grams[k])
                if len(level.contexts):
                    p = np.where(known, np.where(hit, level.share[at], 0.0) + level.left[inside] * p, p)
            out[c] = np.bincount(owner, weights=np.log(np.maximum(p, 1e-12)), minlength=len(words))
        return out

    def tilt(self, words: list[str]) -> np.ndarray:
        """How far the logarithm of each class lies above that of both together, within bounds [class, word]."""
        found = self.log(words)
        return np.clip(found - (np.logaddexp(found[0], found[1]) - np.log(2)), -TILT, TILT)


@dataclass
class KneserNey:
    """Two class models over the words of the sample (word ids; one more for all others)."""

    spelling: Spelling
    spare: np.ndarray  # [class]: what a unit of the tilted shared counts gets
    single: np.ndarray  # log p(word, toxic) - log p(word, ordinary)
    keys: np.ndarray  # sorted history * size + word; the last history stands before a text
    paired: np.ndarray  # the difference of a key's word after its history
    word: np.ndarray | None  # p [class, word]
    pair: np.ndarray | None  # p [class, key] of discounted counts
    left: np.ndarray | None  # [class, history]

    @staticmethod
    def fit(texts: list[list[np.ndarray]], words: list[str]) -> "KneserNey":
        """`texts[c]`: word ids of the texts of class c."""
        size = len(words) + 1
        mark = size - 1  # stands before a text
        counts, pairs = [], []
        for c in texts:
            # a word of a text, the one before and the one before that
            flat = np.concatenate([np.zeros(0, np.int32), *[part for t in c if len(t) for part in (np.array([mark, mark], np.int32), t.astype(np.int32))]])
            ends = np.cumsum([len(t) + 2 for t in c if len(t)])
            inside = np.ones(len(flat), bool)
            first = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
            inside[first] = inside[first + 1] = False
            at = np.flatnonzero(inside)
            after = flat[at - 1].astype(np.int64) * size + flat[at]
            check = mix(after.view(np.uint64), 3) + flat[at - 2].astype(np.uint64)
            # each pair once for each word before it
            after = after[np.unique(check, return_index=True)[1]]
            del flat, check, at, inside
            pairs.append(after)
            counts.append(np.bincount(np.unique(after) % size, minlength=size - 1))
        counts = np.stack(counts)
        seen = np.flatnonzero(counts.sum(0))
        spelling = Spelling([words[i] for i in seen], counts[:, seen])
        keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
        times = [np.bincount(part, minlength=len(keys)).astype(np.int32) for part in (back[: len(pairs[0])], back[len(pairs[0]) :])]
        del back, pairs
        # in how many distinct pairs of either class a word comes second
        shared = np.bincount(keys % size, minlength=size - 1) + 0.5
        shared = shared * np.exp(spelling.tilt(words))
        mass = shared.sum(1)
        word, spare = np.empty((2, size - 1)), np.empty(2)
        pair, left = np.empty((2, len(keys)), np.float32), np.empty((2, size))
        for c in (0, 1):
            total = max(1, counts[c].sum())
            own = kept(counts[c]) / total
            spare[c] = (1 - own.sum()) / mass[c]
            word[c] = own + spare[c] * shared[c]
            history = keys // size
            pair[c] = kept(times[c]) / np.maximum(np.bincount(history, weights=times[c], minlength=size), 1)[history]
            left[c] = np.maximum(1 - np.bincount(history, weights=pair[c], minlength=size), 1e-3)
        single = np.log(word[1]) - np.log(word[0])
        for i, w in enumerate(words):
            if not w:  # marks alone say nothing
                single[i] = 0.0
        history, second = keys // size, keys % size
        p = [pair[c] + left[c][history] * word[c][second] for c in (0, 1)]
        paired = np.clip(np.log(p[1] / p[0]), single[second] - PAIR, single[second] + PAIR)
        return KneserNey(spelling, spare, single.astype(np.float32), keys, paired.astype(np.float32), word, pair, left)

    def packed(self) -> "KneserNey":
        """What scoring needs; the keys as the steps between them."""
        return replace(self, keys=np.diff(self.keys, prepend=0).astype(np.uint64), paired=self.paired.astype(np.float16), word=None, pair=None, left=None)

    def unpacked(self) -> "KneserNey":
        return replace(self, keys=np.cumsum(self.keys).astype(np.int64), paired=self.paired.astype(np.float32))

    def unknown(self, words: list[str]) -> np.ndarray:
        """The same of words outside the sample: what spelling and the shared mass say."""
        tilt = self.spelling.tilt(words)
        return np.where([bool(w) for w in words], tilt[1] - tilt[0] + np.log(self.spare[1] / self.spare[0]), 0.0)

    def differences(self, ids: np.ndarray, single: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Differences of tokens in their places: `single` of each, moved by the pair with the token before.

        `first` holds the positions where a text begins.
        """
        out = single.copy()
        if len(ids) < 2:
            return out
        size = len(self.single) + 1
        at, hit = _find(self.keys, ids[:-1] * size + ids[1:])
        inside = np.ones(len(ids), dtype=bool)
        inside[first] = False
        where = np.flatnonzero(hit & inside[1:] & (ids[:-1] < size - 1) & (ids[1:] < size - 1))
        out[where + 1] = self.paired[at[where]]
        return out


def _features(diff: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: mean difference, for each window length the largest windowed mean, and the mass and share of clearly toxic words."""
    out = np.zeros((len(lengths), 3 + len(WINDOWS)))
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full]
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[full, 0] = np.add.reduceat(diff, start) / n
    cum = np.concatenate([[0.0], np.cumsum(diff)])
    owner = np.repeat(start, n)
    place = np.arange(len(diff))
    for k, w in enumerate(WINDOWS, 1):
        begin = np.maximum(place + 1 - w, owner)
        out[full, k] = np.maximum.reduceat((cum[1:] - cum[begin]) / w, start)
    mass = np.add.reduceat(np.maximum(diff - CLEARLY, 0), start)
    out[full, -2], out[full, -1] = np.log1p(mass), mass / n
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (last: intercept) by iteratively reweighted least squares, both classes weighing the same but for their cost."""
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 * ORDINARY_COST / max(1 - y.mean(), 1e-9))
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        w = w + np.linalg.solve(a.T @ (a * s[:, None]) + penalty, a.T @ (weight * (y - p)) - penalty @ w)
    return w


@dataclass
class ToxicityModel:
    language: KneserNey | None
    weights: np.ndarray | None
    index: dict[str, int] = field(default_factory=dict)

    def dump(self) -> bytes:
        """The model as bytes: half as many as its arrays, as it goes through the driver to every worker."""
        return zlib.compress(pickle.dumps((self.language.packed(), self.weights, "\n".join(self.index), list(self.index.values())[:1] + np.diff(list(self.index.values())).tolist())), 6)

    @staticmethod
    def load(data: bytes) -> "ToxicityModel":
        language, weights, words, steps = pickle.loads(zlib.decompress(data))
        return ToxicityModel(language.unpacked(), weights, dict(zip(words.split("\n"), np.cumsum(steps).tolist())) if steps else {})

    def lookup(self) -> "WordCache":
        return WordCache(self)

    def scores(self, texts: list, words: "WordCache") -> np.ndarray:
        flat, lengths = [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            own = split_words(t)
            lengths[i] = len(own)
            flat += own
        ids, single = words.find(flat)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0]
        x = _features(self.language.differences(ids, single, first), lengths)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


class WordCache:
    """Ids and differences of words as they stand in texts, behind a bounded cache."""

    def __init__(self, model: ToxicityModel):
        self.model, self.single = model, model.language.single.astype(float)
        self.known: dict[str, int] = {}
        self.ids, self.values = np.zeros(CACHE_WORDS + 1, np.int64), np.zeros(CACHE_WORDS + 1)

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = list(dict.fromkeys(words))
        if len(fresh) > CACHE_WORDS:  # one text of very many words
            half = len(words) // 2
            return tuple(np.concatenate(p) for p in zip(self.find(words[:half]), self.find(words[half:])))
        if fresh:
            forms = [normalise(w) for w in fresh]
            none = len(self.single)
            ids = np.array([self.model.index.get(f, none) for f in forms], dtype=np.int64)
            values = np.append(self.single, 0.0)[ids]
            new = np.flatnonzero(ids == none)
            values[new] = self.model.language.unknown([forms[i] for i in new])
            a = len(self.known)
            self.ids[a : a + len(fresh)], self.values[a : a + len(fresh)] = ids, values
            self.known.update(zip(fresh, range(a, a + len(fresh))))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.ids[at], self.values[at]


def fit(texts: list[str], toxic: list[int], half: list[int]) -> ToxicityModel:
    """Fit on labelled texts; `half` (0 or 1) splits them for the curve's out-of-fold differences."""
    y, half = np.array(toxic), np.array(half)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, None)
    index: dict[str, int] = {}
    ids = [np.fromiter((index.setdefault(normalise(w), len(index)) for w in split_words(t)), np.int32) for t in texts]
    words = list(index)

    def language(rows) -> KneserNey:
        return KneserNey.fit([[ids[i] for i in rows if y[i] == c] for c in (0, 1)], words)

    x = np.zeros((len(y), 3 + len(WINDOWS)))
    for h in (0, 1):
        rows = np.flatnonzero(half == h)
        if len(rows):
            model = language(np.flatnonzero(half != h))
            lengths = np.array([len(ids[i]) for i in rows])
            flat = np.concatenate([ids[i] for i in rows])
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0]
            x[rows] = _features(model.differences(flat, model.single.astype(float)[flat], first), lengths)
    index.pop("", None)
    return ToxicityModel(language(np.arange(len(y))), _logistic(x, y), index)


@dataclass
class FittedModel:
    """A dumped ToxicityModel; nothing if a class had no labelled text."""

    data: bytes


def fit_on(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> FittedModel:
    """Fit on at most `sample_per_class` labelled rows of each class, those with the smallest id hashes.

    `labels` holds doc_id and toxic (rows where either is null are left out).
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    if len(counts) < 2:
        return FittedModel(b"")
    draw = F.xxhash64(F.lit(3), "doc_id")
    limit = F.when(F.col("toxic") == 1, F.lit(draw_limit(counts[1], sample_per_class))).otherwise(F.lit(draw_limit(counts[0], sample_per_class)))
    chosen = known.where(draw <= limit).withColumn("draw", draw)  # a fifth more than the sample is expected, so broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "draw").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = whole_texts(rows, "toxic", sample_per_class, FIT_BYTES)
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2))).select("draw", "doc_id", "toxic", "half", "text")

    def learnt(batches: Iterator[pa.RecordBatch]) -> bytes:
        drawn = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["draw"], r["doc_id"]))
        drawn = [r for c in (0, 1) for r in [r for r in drawn if r["toxic"] == c][:sample_per_class]]
        model = fit([r["text"] for r in drawn], [r["toxic"] for r in drawn], [r["half"] for r in drawn])
        return model.dump() if model.language else b""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = learnt(batches)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["model"])

    # the sample is bounded, so one task learns from it, and the driver only hands the model on
    return FittedModel(b"".join(bytes(r[0]) for r in rows.coalesce(1).mapInArrow(train, "model binary").collect()))


def score_column(spark: SparkSession, model: FittedModel, text: str = "text") -> Column:
    """Column of scores for the texts of a table."""
    if not model.data:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model.data)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ToxicityModel.load(shared.value)
        lookup = own.lookup()
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *[own.scores(texts, lookup) for texts in text_slices(batch)]]))
        del own, lookup
        trim()

    return score(F.col(text))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`, learnt from labels outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    model = fit_on(docs, labels)
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score_column(spark, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
