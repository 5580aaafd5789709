"""Personal data by patterns and a skip-chain conditional random field.

Patterns find emails, IP addresses, card and phone numbers exactly as the base
rules say. A skip-chain field then looks at every candidate of a document, also
the ones that the patterns refuse (a phone number without its plus, an address
spelled "name at host dot org", a card number with dots, a card or phone number
that a pattern drops with the digits behind it): candidates are chained
in text order, candidates with the same core (digits, or letters of an address)
are tied by skip edges wherever they stand, and loopy message passing makes
labels consistent across the document. Spans are added where the field is sure.

Weights and ties are learnt piecewise on a bounded sample of texts that hold a
digit or an at sign (SAMPLE_TEXTS whole ones of FIT_BYTES bytes together), with
the pattern labels as truth; the marks that the patterns insist
on are hidden from half of the examples, so shape, context and ties have to
carry weight too. Base spans are never dropped or changed.

Defined results: null or empty text has no spans; texts are searched whole and
positions count code points; repeated rows get equal spans; other columns pass
through; of added spans that overlap the likeliest stays; an empty table stays
empty. A document's cost is linear in its length and candidates (but for the
logarithm of a search): equal cores are tied to the next occurrence, not pair by
pair.
"""

from __future__ import annotations

import bisect
import pickle
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import draw_limit, fit_in_task, text_slices, trim, whole_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE_TEXTS = 2000
#: Bytes of all sampled texts.
FIT_BYTES = 8_000_000
#: Messages that are computed at a time.
MESSAGES = 16_384
SURE = 0.9

#: Characters of an address before the at sign, and the base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits that it could have begun before
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")

#: Candidates that the base patterns may refuse.
_NUMBER = re.compile(r"(?<![\w.+])\+?\(?[0-9](?:[\x20()./\[\]‐-—-]{0,3}[0-9]){6,24}(?![\w])")
_SPELLED = re.compile(r"([\w.%+-]{1,64})\s?(?:@|\(at\)|\[at\]|\sat\s)\s?([\w-]{1,64}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[\w-]{1,64}){1,4})", re.I)
#: What every match of _SPELLED holds.
_SEPARATOR = re.compile(r"@|\(at\)|\[at\]|\sat\s", re.I)
_STOP = re.compile(r"\.\s|\s\.")
_CONTEXT = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by kind as listed, then by start."""
    if not text:
        return []
    out = []
    at = text.find("@")
    bound = 0
    while at >= 0:
        before = text[bound:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if local else None
        if match:
            out.append(("email", at - local, match.end()))
            bound = match.end()
        else:
            bound = at + 1
        at = text.find("@", bound)
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


@dataclass
class Candidate:
    start: int
    end: int
    label: int  # of the base rules
    allowed: tuple[int, ...]
    core: str
    features: list[str] = field(default_factory=list)
    dropped: bool = False  # by the base rules for what stands beside it, so no example of anything


def _allowed(kind: str, raw: str) -> tuple[int, ...]:
    """Labels that the content admits at all."""
    if kind == "email":
        return (0, 1)
    d = _digits(raw)
    parts = re.split(r"[^0-9]+", raw.strip("+()[]"))
    out = [0]
    if len(parts) == 4 and all(map(_octet, parts)) and re.fullmatch(r"[0-9]+(?:\[?\.\]?[0-9]+){3}", raw):
        out.append(2)
    if 13 <= len(d) <= 19 and luhn(d):
        out.append(3)
    if 9 <= len(d) <= 15 and (raw[0] in "+(" or len(parts) > 1):
        out.append(4)
    return tuple(out)


def _features(text: str, c: Candidate, kind: str) -> list[str]:
    raw = text[c.start : c.end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", raw))[:24]
    left = _CONTEXT.findall(text[max(0, c.start - 24) : c.start])
    # a full stop beside a space ends a sentence ("at home. Then") rather than parts a host: such candidates share no weights with addresses
    loose = "loose " if kind == "email" and _STOP.search(raw) else ""
    out = [f"kind:{loose}{kind}", f"shape:{shape.lstrip('+')}", f"left:{left[-1].lower() if left else ''}", f"allowed:{loose}{c.allowed}"]
    if kind == "number":
        out += [f"digits:{len(_digits(raw))}", f"groups:{len(re.split('[^0-9]+', raw.strip('+()')))}"]
    marks = [f"mark:{m}" for m in "+@" if m in raw]
    return out + marks


def parts(text: str) -> list[tuple[int, int]]:
    """Spans inside matches that the base rules drop whole: a card or phone number that other digits follow or precede.

    Of a run of digit groups that is no card number: single groups of 13 to 19
    digits, and runs of groups of four that have so many. Of a number with a plus
    that is too long: its beginnings of 9 to 15 digits that end with a group.
    """
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13 or (13 <= len(d := _digits(m.group())) <= 19 and luhn(d)):
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m.group())]
        for i, (a, b) in enumerate(groups):
            n, j = b - a, i
            while n < 13 and groups[j][1] - groups[j][0] == 4 and j + 1 < len(groups):
                j += 1
                n += groups[j][1] - groups[j][0]
            if 13 <= n <= 19:
                out.append((a, groups[j][1]))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if len(_digits(m.group())) > 15:
            n = 0
            for g in _GROUP.finditer(m.group()):
                n += g.end() - g.start()
                if n > 15:
                    break
                if n >= 9:
                    out.append((m.start(), m.start() + g.end()))
    alone = lambda a, b: not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    return [(a, b) for a, b in out if alone(a, b)]


class Spans:
    """Spans that others may overlap, looked up in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(itertools.accumulate((b for _, b in spans), max))

    def overlap(self, a: int, b: int) -> bool:
        n = bisect.bisect_left(self.starts, b)
        return n > 0 and self.reach[n - 1] > a


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[Candidate]:
    """Candidates in text order: the base spans, and look-alikes that overlap none of them."""
    out = []
    for kind, a, b in base:
        raw = text[a:b]
        core = re.sub(r"[^a-z0-9@]", "", raw.lower()) if kind == "email" else _digits(raw)
        out.append(Candidate(a, b, LABELS.index(kind), (0, LABELS.index(kind)), core, []))
    kinds = ["email" if k == "email" else "number" for k, _, _ in base]
    taken = Spans([(a, b) for _, a, b in base])
    fresh: dict[tuple[int, int], str] = {}
    dropped: set[tuple[int, int]] = set()
    if _DIGIT.search(text):
        dropped = set(parts(text))
        fresh |= {m.span(): "number" for m in _NUMBER.finditer(text)} | {span: "number" for span in sorted(dropped)}
    if _SEPARATOR.search(text):
        fresh |= {m.span(): "email" for m in _SPELLED.finditer(text)}
    for (a, b), kind in fresh.items():
        if taken.overlap(a, b):
            continue
        raw = text[a:b]
        allowed = _allowed(kind, raw)
        if len(allowed) == 1:
            continue
        if kind == "email":
            m = _SPELLED.fullmatch(raw)
            host = re.sub(r"\s|\(dot\)|\[dot\]|dot", ".", m[2].lower())
            core = re.sub(r"[^a-z0-9@]", "", f"{m[1].lower()}@{host}")
        else:
            core = _digits(raw)
        out.append(Candidate(a, b, 0, allowed, core, [], (a, b) in dropped))
        kinds.append(kind)
    for c, kind in zip(out, kinds):
        c.features = _features(text, c, kind)
    return sorted(out, key=lambda c: (c.start, c.end, c.label))


def edges(found: list[Candidate]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours and skip edges from each core to its next occurrence."""
    chain = [(i, i + 1) for i in range(len(found) - 1)]
    last: dict[str, int] = {}
    skip = []
    for i, c in enumerate(found):
        # national and international writing of a number share their last nine digits
        key = c.core if "@" in c.core else c.core[-9:]
        if key in last:
            skip.append((last[key], i))
        last[key] = i
    return chain, skip


@dataclass
class SkipChain:
    index: dict[str, int]
    weights: np.ndarray  # [feature, label]
    chain: np.ndarray  # log potentials [label, label]
    skip: np.ndarray

    def _unary(self, c: Candidate) -> np.ndarray:
        own = [self.index[f] for f in c.features if f in self.index]
        out = self.weights[own].sum(0) if own else np.zeros(len(LABELS))
        masked = np.full(len(LABELS), -1e9)
        masked[list(c.allowed)] = out[list(c.allowed)]
        if c.label:  # base spans stay
            masked[:] = -1e9
            masked[c.label] = 0.0
        return masked

    def marginals(self, found: list[Candidate], rounds: int = 20, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product over chain and skip edges, all messages of a round at once.

        Messages are computed a block of edges at a time, so what is held grows by a few
        numbers for each candidate, however many a text has.
        """
        unary = np.stack([self._unary(c) for c in found])
        chain, skip = edges(found)
        pairs = np.array(chain + skip, dtype=np.int64).reshape(-1, 2)
        n, k = len(pairs), len(LABELS)
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        # chain and skip potentials, and the same for messages the other way
        potential = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])
        kind = np.tile(np.arange(n) >= len(chain), 2).astype(np.int8) + 2 * (np.arange(2 * n) >= n).astype(np.int8)
        reverse = np.concatenate([np.arange(n) + n, np.arange(n)])

        def beliefs(message: np.ndarray) -> np.ndarray:
            return unary + np.stack([np.bincount(target, weights=message[:, c], minlength=len(found)) for c in range(k)], axis=1) if n else unary.copy()

        message = np.zeros((2 * n, k))
        for _ in range(rounds if n else 0):
            belief, fresh = beliefs(message), np.empty_like(message)
            for a in range(0, 2 * n, MESSAGES):
                at = slice(a, a + MESSAGES)
                send = (belief[source[at]] - message[reverse[at]])[:, :, None] + potential[kind[at]]
                top = send.max(1, keepdims=True)
                fresh[at] = np.log(np.exp(send - top).sum(1)) + top[:, 0]
            fresh -= fresh.max(1, keepdims=True)
            change = np.abs(fresh - message).max()
            message = damping * message + (1 - damping) * fresh
            if change < 1e-4:
                break
        belief = beliefs(message)
        belief = np.exp(belief - belief.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans that the field adds to the base spans of a text."""
        found = candidates(text, base)
        if all(c.label for c in found):
            return []
        belief = self.marginals(found)
        sure = []
        for c, p in zip(found, belief):
            best = int(p[1:].argmax()) + 1
            if not c.label and p[best] >= SURE:
                sure.append((-float(p[best]), -(c.end - c.start), c.start, c.end, LABELS[best]))
        # of spans that overlap the likeliest stays, then the longest, then the first
        out: list[tuple[str, int, int]] = []
        starts: list[tuple[int, int]] = []
        for *_, a, b, kind in sorted(sure):
            i = bisect.bisect_left(starts, (b, -1))
            if not i or starts[i - 1][1] <= a:
                bisect.insort(starts, (a, b))
                out.append((kind, a, b))
        return out

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and all spans of a text, by kind as listed, then by start."""
        base = base_spans(text)
        if not text:
            return base, base
        more = self.added(text, base)
        return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


def fit(texts: list[str], steps: int = 60) -> SkipChain:
    """Piecewise fit with base labels as truth; marks are hidden from every second example."""
    documents = [candidates(t, base_spans(t)) for t in texts if t]
    flat = [c for d in documents for c in d if not c.dropped]
    counts = Counter(f for c in flat for f in c.features)
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 2))}
    weights, seen = np.zeros((len(index), len(LABELS))), np.full((len(index), len(LABELS)), 1e-8)
    hidden = [zlib.crc32(f"{c.core}:{c.start}".encode()) % 2 for c in flat]
    rows, columns = [], []
    for i, (c, hide) in enumerate(zip(flat, hidden)):
        for f in c.features:
            if f in index and not (hide and f.startswith("mark:")):
                rows.append(i)
                columns.append(index[f])
    rows, columns = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)
    gold = np.eye(len(LABELS))[[c.label for c in flat]] if flat else np.zeros((0, len(LABELS)))
    for _ in range(steps if len(rows) else 0):
        score = np.zeros_like(gold)
        np.add.at(score, rows, weights[columns])
        p = np.exp(score - score.max(1, keepdims=True))
        error = gold - p / p.sum(1, keepdims=True)
        grad = np.zeros_like(weights)
        np.add.at(grad, columns, error[rows])
        grad -= 0.1 * weights
        seen += grad**2
        weights += 0.5 * grad / np.sqrt(seen)

    def tied(pairs: list[tuple[int, int]]) -> np.ndarray:
        joint = np.full((len(LABELS), len(LABELS)), 1.0)
        for a, b in pairs:
            joint[a, b] += 1
            joint[b, a] += 1
        joint /= joint.sum()
        return np.log(joint) - np.log(joint.sum(1))[:, None] - np.log(joint.sum(0))[None, :]

    chains, skips = [], []
    for d in [[c for c in d if not c.dropped] for d in documents]:
        chain, skip = edges(d)
        chains += [(d[a].label, d[b].label) for a, b in chain]
        # ties are learnt between spans that the rules recognise; refused twins are what is to be found
        skips += [(d[a].label, d[b].label) for a, b in skip if d[a].label and d[b].label]
    return SkipChain(index, weights, 0.25 * tied(chains), tied(skips))


def fit_on(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> SkipChain:
    """Fit on about `sample_texts` texts that hold a digit or an at sign, chosen by a hash of the text, copies once."""
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64(F.lit(13), "text").alias("draw"))
    n = rows.count()
    if not n:
        return fit([])
    drawn = rows.where(F.col("draw") <= draw_limit(n, sample_texts)).distinct()
    data = fit_in_task(whole_texts(drawn, None, sample_texts, FIT_BYTES), lambda found: fit([r["text"] for r in sorted(found, key=lambda r: (r["draw"], r["text"]))]))
    return pickle.loads(data) if data else fit([])


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are joined."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def span_column(spark: SparkSession, model: SkipChain, text: str = "text") -> Column:
    """Column of struct(base, spans): the base spans and all spans, as text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("base string, spans string")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [tuple(map(written, shared.value.spans(t))) for texts in text_slices(batch) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["base", "spans"])

    return find(F.col(text))


def redact_column(spark: SparkSession, model: SkipChain, text: str = "text") -> Column:
    """Column of texts with every span redacted."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([redact(t, shared.value.spans(t)[1]) for texts in text_slices(batch) for t in texts], pa.string())
        trim()

    return clean(F.col(text))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = docs.select("doc_id", span_column(spark, fit_on(docs)).alias("f")).select("doc_id", F.col("f.base").alias("base"), F.col("f.spans").alias("spans"))
    count = lambda k: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
