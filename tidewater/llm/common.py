"""Pieces that the training-data operators share.

Everything here is input-agnostic: native word splitting, cutting a lineage
through the shared checkpoint folder, and walking Arrow batches in slices of a
bounded number of characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.storage import cut, release, scratch, shared_dir  # noqa: F401  handed on to the operators

#: The white space that separates words (space, tab to carriage return).
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Characters of text that one Python step holds at a time.
SLICE_CHARS = 800_000

#: White space to Python's str.split() that doesn't separate words here (fixed values).
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^\x20\x09-\x0D]+")


def split_words(text: str | None) -> list[str]:
    """Words of a text in Python, the same as `words_column` gives."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def words_column(text: Column) -> Column:
    """Words of a text, split natively; an empty array for null or blank text."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.size(words_column(text)).cast("long")


def fold(column: str, modulus: int) -> Column:
    """crc32 of a key written as text, modulo `modulus`; null keys give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def draw_limit(rows: int, sample: int) -> int:
    """The largest of the 64-bit draws to take, so that a fifth and 20 more than the sample are expected of any number of rows."""
    return min(2**64, (2**64 * (sample * 6 // 5 + 20)) // rows) - 2**63 - 1


def whole_texts(rows: DataFrame, group: str | None, sample: int, total: int) -> DataFrame:
    """The first rows of each group by `draw`: at most `sample`, and `total` bytes of texts, all of them whole.

    Texts of more than a sixteenth of `total` are no examples, so that no few of them
    stand for a group. `rows` (text, draw, `group`) is a sample already, so that no
    group of it is large.
    """
    size = F.octet_length("text")
    order = Window.partitionBy(*([group] if group else [])).orderBy("draw", "text")
    taken = rows.where(size <= total // 16).withColumns({"__nth": F.row_number().over(order), "__bytes": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return taken.where((F.col("__nth") <= sample) & (F.col("__bytes") <= total)).drop("__nth", "__bytes")


def fit_in_task(rows: DataFrame, fit) -> bytes:
    """Pickle of what `fit` makes of the rows (dicts) of a bounded sample, learnt in one task and not on the driver."""
    import pyarrow as pa

    def learn(batches):
        import pickle

        data = pickle.dumps(fit([r for b in batches for r in b.to_pylist()]))
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["model"])

    return b"".join(bytes(r[0]) for r in rows.coalesce(1).mapInArrow(learn, "model binary").collect())


def slices(batches, text_index: int, limit: int = SLICE_CHARS):
    """Cut Arrow record batches into runs of rows with about `limit` bytes of text.

    Yields record batches; a single row longer than the limit stands alone.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_index)), 0), dtype=np.int64)
        shard = np.cumsum(size) // limit
        starts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def text_slices(column, limit: int = SLICE_CHARS):
    """An Arrow string column as lists of texts of about `limit` bytes, so few are Python strings at a time."""
    import pyarrow as pa

    for batch in slices([pa.RecordBatch.from_arrays([column], names=["text"])], 0, limit):
        yield batch.column(0).to_pylist()


def trim() -> None:
    """Give freed memory back to the system: workers are used again by the steps that follow."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def runs(texts: list, limit: int = SLICE_CHARS):
    """Cut a list of texts into (start, texts) runs of about `limit` characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= limit:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


class Lookup:
    """Word ids behind a bounded cache: `rule(word)` decides for words not seen lately."""

    def __init__(self, rule, limit: int = 400_000):
        self.rule, self.limit, self.known = rule, limit, {}

    def ids(self, words: list[str], dtype=None):
        import numpy as np

        known = self.known
        got = list(map(known.get, words))
        if None in got:
            if len(known) > self.limit:
                known.clear()
            rule = self.rule
            for i, x in enumerate(got):
                if x is None:
                    w = words[i]
                    x = known.get(w)
                    if x is None:
                        x = known[w] = rule(w)
                    got[i] = x
        return np.array(got, dtype=dtype or np.int64)
