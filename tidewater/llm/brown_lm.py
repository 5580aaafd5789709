"""Scoring texts by a Brown class bigram model.

Words are counted over all training texts. The most frequent ones are put into
classes by exchange clustering on their bigram counts; every other word that is
seen twice or more then joins the class under which its own neighbours are most
likely. Words seen once share one class, which stands for unseen words as well.
Transitions are counted over all training texts once every word has its class.
A text's probability is the product, over its tokens and a final end token, of a
smoothed class transition and a word emission.

Counting passes work with partial sums per partition. Exchange sees a table of
the head alone; the neighbours of all other words are summed by word and class
of neighbour in sorted streams, so their cost is linear in the tokens. The
number of classes grows as the cube root of the vocabulary. When texts are
turned into chains of classes, a bounded table of the commonest words answers
most tokens; the words outside it are joined with the classes of the whole
vocabulary, which may be of any size and is never collected.

Defined results: null text is an empty text, which consists of the end token;
identical rows are scored separately and alike; without training texts every
token has base probability 1 / (0 + 1 * (0 + 1)); an empty table stays empty; words
of equal counts are clustered in code point order, a word that several classes
suit as well goes to the first; very long texts are a slice of their own; columns
beside doc_id, held_out and text are handed on by `chains` and `score`, or ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import Lookup, cut, fold, slices, split_words

#: The least size of the head that exchange clusters, and the least number of classes.
CLUSTER_WORDS = 1500
CLASSES = 40
PASSES = 4
#: Words seen less often have no class of their own; they stand for unseen words.
CLASS_COUNT = 2
#: Words whose counts the scoring workers hold, at most; the rest is joined.
TABLE_WORDS = 250_000
#: Distinct words a counting worker holds before it hands partial sums on.
COUNTER_WORDS = 400_000
#: Tokens whose neighbours a worker holds before it hands partial sums on.
NEIGHBOUR_TOKENS = 2_000_000
#: Bytes of text that a counting or scoring step holds at a time.
SLICE_BYTES = 1_500_000
#: Neighbour counts that are weighed against all classes at a time.
WEIGHED_ROWS = 20_000


def tokens(text: str | None) -> list[str]:
    """Words with A-Z (and nothing else) lower-cased."""
    return split_words(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """Counts of all words: word, n."""

    def count(batches):
        held: Counter = Counter()
        for batch in slices(batches, 0, SLICE_BYTES):
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
            if len(held) > COUNTER_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_counts(docs: DataFrame, words: list[str]) -> np.ndarray:
    """Counts of neighbours among `words`, others (index len(words)) and the end (the last index).

    The end also stands before each text. The table's size is fixed by `words`.
    """
    spark, size = docs.sparkSession, len(words) + 2
    shared = spark.sparkContext.broadcast(words)

    def count(batches):
        index = {w: i for i, w in enumerate(shared.value)}
        lookup, end = Lookup(lambda w: index.get(w, size - 2)), size - 1
        table = np.zeros(size * size, dtype=np.int64)
        for batch in slices(batches, 0, SLICE_BYTES):
            chain = [end]
            for text in batch.column(0).to_pylist():
                own = tokens(text)
                if own:
                    chain.append(lookup.ids(own))
                chain.append(end)
            ids = np.concatenate([np.atleast_1d(np.asarray(c, dtype=np.int64)) for c in chain])
            table += np.bincount(ids[:-1] * size + ids[1:], minlength=size * size)
        at = np.flatnonzero(table)
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], names=["pair", "n"])

    summed = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, dtype=np.int64)
    out[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(table: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each index of a bigram table; the last two (others, end) keep classes of their own.

    Words are moved one by one, the frequent first, to the class that raises the
    class bigram likelihood most, until a pass moves none.
    """
    size = len(table)
    n_words = size - 2
    classes = max(1, min(classes, n_words))
    total = classes + 2
    cls = np.concatenate([np.arange(n_words) % classes, [classes, classes + 1]])
    fold_ = np.zeros((size, total))
    fold_[np.arange(size), cls] = 1
    grid = fold_.T @ table @ fold_
    columns = np.ascontiguousarray(table.T)
    for _ in range(passes):
        moved = 0
        for w in range(n_words):
            self_n = float(table[w, w])
            out = np.bincount(cls, weights=table[w], minlength=total)
            into = np.bincount(cls, weights=columns[w], minlength=total)
            a = cls[w]
            out[a] -= self_n
            into[a] -= self_n
            grid[a, :] -= out
            grid[:, a] -= into
            grid[a, a] -= self_n
            g = grid[:classes]
            gain = (_xlogx(g + out) - _xlogx(g)).sum(1) + (_xlogx(grid[:, :classes].T + into) - _xlogx(grid[:, :classes].T)).sum(1)
            d = np.diagonal(grid)[:classes]
            o, i = out[:classes], into[:classes]
            gain += _xlogx(d + o + i + self_n) - _xlogx(d + o) - _xlogx(d + i) + _xlogx(d)
            rows, cols = grid[:classes].sum(1), grid[:, :classes].sum(0)
            row_add, col_add = out.sum() + self_n, into.sum() + self_n
            # what comes in from or goes out to the word's own new class is in both sums
            gain -= _xlogx(rows + row_add + i) - _xlogx(rows) + _xlogx(cols + col_add + o) - _xlogx(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            moved += b != a
            cls[w] = b
            grid[b, :] += out
            grid[:, b] += into
            grid[b, b] += self_n
        if not moved:
            break
    return cls


def class_number(distinct: int) -> int:
    """Classes for a vocabulary of `distinct` words."""
    return max(CLASSES, round(distinct ** (1 / 3)))


class _Ids(dict):
    """Numbers for words as they come."""

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        return i


def neighbour_counts(docs: DataFrame, head: list[str], cls: np.ndarray) -> DataFrame:
    """Partial counts of the neighbours of all words outside `head`: word, slots, times.

    Slot c is a word of class c before it, slot size + c one behind it, with
    `cls` the classes of the head, of all other words and of the end.
    """
    shared = docs.sparkSession.sparkContext.broadcast((head, cls))
    size = int(cls.max()) + 1

    def count(batches):
        head, cls = shared.value
        first = len(head)
        index = _Ids((w, i) for i, w in enumerate(head))
        held, n = [], 0

        def handed():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            word = keys // (2 * size)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            names = list(index)
            offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
            slots = pa.ListArray.from_arrays(offsets, pa.array((keys % (2 * size)).astype(np.int32)))
            times = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
            words = pa.array([names[i] for i in word[starts].tolist()], pa.string())
            made = pa.RecordBatch.from_arrays([words, slots, times], names=["word", "slots", "times"])
            for a in range(0, made.num_rows, 10_000):
                yield made.slice(a, 10_000)

        for batch in slices(batches, 0, SLICE_BYTES):
            chain = [-1]
            for text in batch.column(0).to_pylist():
                chain += [index[w] for w in tokens(text)]
                chain.append(-1)
            ids = np.array(chain, dtype=np.int64)
            where = cls[np.where(ids < 0, first + 1, np.minimum(ids, first))]
            at = np.flatnonzero(ids >= first)
            if len(at):
                held += [ids[at] * (2 * size) + where[at - 1], ids[at] * (2 * size) + size + where[at + 1]]
                n += len(at)
            if n > NEIGHBOUR_TOKENS or len(index) > COUNTER_WORDS and n:
                yield from handed()
                index = _Ids((w, i) for i, w in enumerate(head))
                held, n = [], 0
        if n:
            yield from handed()

    return docs.select("text").mapInArrow(count, "word string, slots array<int>, times array<int>")


def class_weights(grid: np.ndarray) -> np.ndarray:
    """Log likelihood [slot, class] that a neighbour in a slot gives each word class of a class bigram table."""
    size = len(grid)
    p = np.log((grid + 0.5) / (grid.sum(1, keepdims=True) + 0.5 * size))
    return np.concatenate([p[:, : size - 2], p[: size - 2].T])


def tail_classes(neighbours: DataFrame, grid: np.ndarray) -> DataFrame:
    """word, n, cls of the words of `neighbours`: the class that makes their neighbours and themselves most likely.

    It is what exchange maximises, with the classes of the head held.
    """
    size = len(grid)
    shared = neighbours.sparkSession.sparkContext.broadcast((class_weights(grid), grid[:, : size - 2].sum(0)))

    def weigh(batches):
        weights, tokens_of = shared.value
        word, total, score = None, 0, None  # of the word that goes on

        def chosen(names, totals, scores):
            own = scores - totals[:, None] * np.log(tokens_of + totals[:, None])
            own[:, (tokens_of == 0) & tokens_of.any()] = -np.inf  # exchange has emptied the class
            best = np.argmax(own, 1)
            best[totals < CLASS_COUNT] = size - 2
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(totals), pa.array(best.astype(np.int32))], names=["word", "n", "cls"])

        for whole in batches:
            for a in range(0, whole.num_rows, WEIGHED_ROWS // 10):
                batch = whole.slice(a, WEIGHED_ROWS // 10)
                slots, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
                of = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
                names = batch.column(0).to_pylist()
                new = np.array([True] + [x != y for x, y in zip(names[1:], names)])
                group = np.cumsum(new) - 1
                at = group[of]
                totals = np.bincount(at, weights=times * (slots < size), minlength=group[-1] + 1).astype(np.int64)
                scores = np.zeros((group[-1] + 1, size - 2))
                for b in range(0, len(at), WEIGHED_ROWS):
                    part = at[b : b + WEIGHED_ROWS]
                    starts = np.flatnonzero(np.diff(part, prepend=-1))
                    scores[part[starts]] += np.add.reduceat(weights[slots[b : b + WEIGHED_ROWS]] * times[b : b + WEIGHED_ROWS, None], starts, axis=0)
                own = [names[i] for i in np.flatnonzero(new).tolist()]
                if word is not None:
                    if word == own[0]:
                        totals[0] += total
                        scores[0] += score
                    else:
                        yield chosen([word], np.array([total]), score[None])
                word, total, score = own[-1], int(totals[-1]), scores[-1]
                if len(own) > 1:
                    yield chosen(own[:-1], totals[:-1], scores[:-1])
        if word is not None:
            yield chosen([word], np.array([total]), score[None])

    return neighbours.repartition("word").sortWithinPartitions("word").mapInArrow(weigh, "word string, n long, cls int")


@dataclass
class BrownModel:
    """Everything that chains of classes need but the words outside the table."""

    table: dict[str, tuple[int, int]]  # word: (count, class)
    class_words: np.ndarray  # tokens in each class
    total: int  # N, tokens
    distinct: int  # V, distinct tokens
    texts: int  # training texts, the count of the end token
    rare_tokens: int
    rare_types: int

    @property
    def rare(self) -> int:
        return len(self.class_words) - 2

    def base_log(self, c):
        return np.log10((np.asarray(c, dtype=float) + 1) / (self.total + 1 * (self.distinct + 1)))

    def rare_log(self, c):
        return np.log10((np.asarray(c, dtype=float) + 1) / (self.rare_tokens + self.rare_types + 1))


def train(docs: DataFrame, cluster_words: int = CLUSTER_WORDS, table_words: int = TABLE_WORDS) -> tuple[BrownModel, DataFrame]:
    """The model and the table of all words (word, n, cls), from all rows of `docs`."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = docs.count()
    number = class_number(v)
    top = counts.where(F.col("n") >= CLASS_COUNT).orderBy(F.desc("n"), "word").limit(max(cluster_words, 4 * number)).toArrow()
    words, freq = top.column("word").to_pylist(), top.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-int(freq[i]), words[i]))
    words, freq = [words[i] for i in order], freq[order] if len(order) else freq
    pairs = bigram_counts(docs, words)
    cls = exchange(pairs, number)
    size = int(cls.max()) + 1
    grid = np.zeros((size, size))
    np.add.at(grid, (np.repeat(cls, len(cls)), np.tile(cls, len(cls))), pairs.ravel())
    head = pa.table([pa.array(words, pa.string()), pa.array(freq.astype(np.int64)), pa.array(cls[: len(words)].astype(np.int32))], names=["word", "n", "cls"])
    classes = cut(tail_classes(neighbour_counts(docs, words, cls), grid).union(spark.createDataFrame(head)))
    class_words, class_types = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for c, tokens_, types in classes.groupBy("cls").agg(F.sum("n"), F.count("*")).collect():
        class_words[c], class_types[c] = tokens_, types
    # the commonest words by steps of their counts, so that no task has to sort them
    step = F.floor(16 * F.log2("n")).cast("int")
    sizes = sorted(((k, n) for k, n in classes.groupBy(step.alias("k")).count().collect()), reverse=True)  # some hundred rows at most
    room, chosen = table_words, F.lit(False)
    for k, held in sizes:
        if held <= room:
            chosen, room = chosen | (step == k), room - held
        else:  # a share of the step that the room ends in, drawn by hash and surely within it
            share = max(0.0, room - 4 * room**0.5) / held
            chosen |= (step == k) & (F.pmod(F.xxhash64(F.lit(29), "word"), F.lit(1_000_000)) < int(share * 1_000_000))
            break
    top = classes.where(chosen).toArrow()
    table = dict(zip(top.column("word").to_pylist(), zip(top.column("n").to_pylist(), top.column("cls").to_pylist())))
    return BrownModel(table, class_words, n + texts, v + (texts > 0), texts, int(class_words[size - 2]), int(class_types[size - 2])), classes


def chains(docs: DataFrame, model: BrownModel, classes: DataFrame) -> DataFrame:
    """`docs` with n_tokens, n_known, base_score and emission in place of text, and the chain of their classes.

    The first pass takes what the table knows and lists the other words with
    their places; those are joined with `classes` and summed per row. chain holds
    16-bit classes, and `filled` (place << 16 | class) what goes into its gaps.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def first_pass(batches):
        from pyspark import TaskContext

        own = shared.value
        names = list(own.table)
        count = np.array([own.table[w][0] for w in names] + [0], dtype=np.int64)
        where = np.array([own.table[w][1] for w in names] + [own.rare], dtype=np.int64)
        index = {w: i for i, w in enumerate(names)}
        missing, end = len(names), own.rare + 1
        base = own.base_log(count)
        emission = np.where(where == own.rare, own.rare_log(count), np.log10(np.maximum(count, 1) / np.maximum(own.class_words[where], 1)))
        base[missing] = emission[missing] = 0.0
        key = TaskContext.get().partitionId() << 40
        for batch in slices(batches, len(others), SLICE_BYTES):
            texts = batch.column(len(others)).to_pylist()
            rows = ([], [], [], [], [])
            rare_words, rare_places, offsets = [], [], [0]
            for text in texts:
                words = tokens(text)
                ids = _table_ids(index, words, missing)
                unknown = np.flatnonzero(ids == missing).tolist()
                rare_words += [words[i] for i in unknown]
                rare_places += [i + 1 for i in unknown]
                offsets.append(len(rare_words))
                rows[0].append(len(words) + 1)
                rows[1].append(len(words) - len(unknown) + (own.texts > 0))
                rows[2].append(float(base[ids].sum() + own.base_log(own.texts)))
                rows[3].append(float(emission[ids].sum()))
                rows[4].append(np.concatenate([[end], where[ids], [end]]).astype(np.uint16).tobytes())
            keys = pa.array(np.arange(key, key + len(texts)))
            key += len(texts)
            rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.string()), pa.array(rare_places, pa.int64())], names=["word", "place"])
            made = [keys, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.float64()), pa.array(rows[4], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], *made], names=[*others, "__key", "n_tokens", "n_known", "base_score", "emission", "chain", "__rare"])

    first = docs.select(*others, "text").mapInArrow(first_pass, f"{schema}, __key long, n_tokens long, n_known long, base_score double, emission double, chain binary, __rare array<struct<word:string,place:bigint>>")
    first = cut(first)
    rest = first.select("__key", F.explode("__rare").alias("r")).select("__key", F.col("r.word").alias("word"), F.col("r.place").alias("place"))
    rest = rest.join(classes, "word", "left").select("__key", "place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(model.rare)).alias("cls"))
    class_words = F.element_at(F.array(*[F.lit(float(max(x, 1))) for x in model.class_words]), F.col("cls") + 1)
    base = F.log10((F.col("n") + 1) / F.lit(float(model.total + model.distinct + 1)))
    rare = F.log10((F.col("n") + 1) / F.lit(float(model.rare_tokens + model.rare_types + 1)))
    emission = F.when(F.col("cls") == model.rare, rare).otherwise(F.log10(F.col("n") / class_words))
    filled = F.collect_list(F.shiftleft("place", 16).bitwiseOR(F.col("cls").cast("long")))
    sums = rest.groupBy("__key").agg(F.sum(base).alias("b"), F.sum(emission).alias("s"), F.count_if(F.col("n") > 0).alias("k"), filled.alias("filled"))
    out = first.drop("__rare").join(sums, "__key", "left")
    plus = lambda a, b, zero: (F.col(a) + F.coalesce(F.col(b), F.lit(zero))).alias(a)
    return cut(out.select(*others, "n_tokens", plus("n_known", "k", 0), plus("base_score", "b", 0.0), plus("emission", "s", 0.0), "chain", "filled"))


def _chain(chain: bytes, filled) -> np.ndarray:
    own = np.frombuffer(chain, dtype=np.uint16).astype(np.int64)
    if filled is not None:
        own[filled >> 16] = filled & 0xFFFF
    return own


def _whole_chains(batch: pa.RecordBatch):
    """Chains of a batch whose last columns are chain and filled."""
    filled = batch.column(batch.num_columns - 1)
    values, offsets, there = filled.values.to_numpy(), filled.offsets.to_numpy(), filled.is_valid().to_pylist()
    for i, chain in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
        yield _chain(chain, values[offsets[i] : offsets[i + 1]] if there[i] else None)


def transitions(made: DataFrame, size: int) -> np.ndarray:
    """log10 p(class | class before), smoothed, from the chains of all rows."""

    def count(batches):
        table = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            pairs = [own[:-1] * size + own[1:] for own in _whole_chains(batch)]
            table += np.bincount(np.concatenate([*pairs, np.zeros(0, np.int64)]), minlength=size * size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["pair", "n"])

    summed = made.select("chain", "filled").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(size * size)
    grid[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    grid = grid.reshape(size, size)
    return np.log10((grid + 0.5) / (grid.sum(1, keepdims=True) + 0.5 * size))


def score(made: DataFrame, transition: np.ndarray) -> DataFrame:
    """`made` (of `chains`) with score in place of emission and chain."""
    shared = made.sparkSession.sparkContext.broadcast(transition)
    kept = [c for c in made.columns if c not in ("emission", "chain", "filled")]
    schema = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in kept)

    def add(batches):
        p = shared.value
        for batch in batches:
            sums = np.array([p[own[:-1], own[1:]].sum() for own in _whole_chains(batch)], dtype=np.float64)
            total = pa.array(batch.column(len(kept)).to_numpy() + sums)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], total], names=[*kept, "score"])

    return made.select(*kept, "emission", "chain", "filled").mapInArrow(add, f"{schema}, score double")


def _table_ids(index: dict, words: list[str], missing: int) -> np.ndarray:
    get = index.get
    return np.array([get(w, missing) for w in words], dtype=np.int64)


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brown model and base scores of all `documents`, learnt outside fold 2 of 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    model, classes = train(docs.where(~held_out))
    made = chains(docs.select("doc_id", held_out.alias("held_out"), "text"), model, classes)
    out = score(made, transitions(made.where(~F.col("held_out")), model.rare + 2))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
