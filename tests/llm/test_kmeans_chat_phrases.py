"""Clustering, chat formatting and collocations against plain versions, and on messy, empty and all-null tables."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import ball_kmeans, chat_format, phrase_hash
from tidewater.llm.perfect_hash import PerfectHash

MARKS = "<|im_end|><|im_start|>assistant ok"


def plain_kmeans(vectors, k=8, rounds=10, dim=64):
    """(cluster, distance, ...) by (vec_id, components), all comparisons made."""
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v], v) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[2]))
    centroids = [v for _, v, _ in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if groups[j] else old for j, old in enumerate(centroids)]
    found = [(i, *reversed(near(v))) for i, v, _ in kept]
    sums = Counter()
    for _, j, d in found:
        sums[j] += d
    long = 2**63 - 1
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, min(d, long), min(sums[j], long), min(sum(sums.values()), long), digest[j]) for i, j, d in found)


def cluster_rows(wide):
    rnd = random.Random(3)
    middle = [[rnd.gauss(0, 0.4) for _ in range(64)] for _ in range(12)]
    rows = [(i, [round(m + rnd.gauss(0, 0.05 if i % 3 else 0.6), 3) for m in middle[i % 12]]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [rows[3], rows[3], (None, rows[5][1]), (400, rows[9][1][:63]), (401, [None] * 64), (402, None), (403, []), (404, [float("nan")] * 64), (405, [float("inf")] + [0.0] * 63), (406, [-0.0] * 64), (407, [1 / 2048] * 64)]
    if wide:
        rows += [(500 + i, [1e6 * rnd.gauss(0, 1) for _ in range(64)]) for i in range(6)] + [(510, [1e300] * 64), (511, [-1e300] * 64), (512, [2.0**60] * 64)]
    return rows


@pytest.mark.parametrize("wide", [False, True])
def test_kmeans_against_all_comparisons(spark, tmp_path, wide):
    rows = cluster_rows(wide)
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, data string").repartition(5)
    got = ball_kmeans.ball_kmeans(table)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == [f.replace(" long", " bigint") for f in ball_kmeans.RESULT.split(", ")]
    assert Counter(map(tuple, got.collect())) == plain_kmeans(rows)


def test_kmeans_with_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    blank = spark.createDataFrame([(None, None, None)] * 3, "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, ball_kmeans.ball_kmeans(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect())) == plain_kmeans(few)
    assert ball_kmeans.ball_kmeans(empty).collect() == [] and ball_kmeans.ball_kmeans(blank).collect() == []


def test_balls_compare_less_and_alike():
    rnd = np.random.default_rng(2)
    middles = rnd.integers(-3000, 3000, (8, 64))
    x = middles[rnd.integers(0, 8, 2000)] + rnd.integers(-200, 200, (2000, 64))
    balls = ball_kmeans.Balls(middles.tolist())
    every = np.stack([ball_kmeans.squared(x, c) for c in balls.centroids], axis=1)
    for held in (np.zeros(2000, dtype=np.int64), every.argmin(axis=1)):
        cluster, distance, computed = balls.assign(x, held)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 2 * len(x)  # near the end of the rounds most members lie in stable cores
    tied = ball_kmeans.Balls([[4, 0], [0, 0], [0, 0]])
    assert tied.assign(np.array([[2, 0], [0, 0]]), np.array([2, 2]))[0].tolist() == [0, 1]  # ties go to the smaller number


def chat_rows():
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", MARKS), (1, 2, "assistant", "line\nline <|im_end|>\n<\\|x|> \\"), (2, 5, "assistant", "later"), (2, None, "user", "no turn"), (2, 0, "user", None),
            (3, 0, "as\nsis\\tant<|", "odd role"), (3, 1, None, "no role"), (None, 0, "user", "no id"), (4, 0, "assistant", ""), (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (5, 1, "assistant", "ä🎉 " * 50_000), (6, 0, "assistant", "<\\\\\\|" * 3)]
    return rows + [(7, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(400)]


def plain_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)]:
        by[conv].append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def write_chat(spark, folder, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, record int").repartition(3)
    table.write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("which", ["messy", "empty", "nulls"])
def test_chat_digests(spark, tmp_path, which):
    rows = {"messy": chat_rows(), "empty": [], "nulls": [(None,) * 4] * 3}[which]
    got = chat_format.op12_chat_format(spark, write_chat(spark, tmp_path, rows)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain_chat(rows)
    assert len(got) == len({r.conv_id for r in got})


def test_segments_parse_back(spark):
    turns = spark.createDataFrame([(1, t, r, x) for _, t, r, x in chat_rows()], "conv_id long, turn long, role string, text string")
    for r in chat_format.segments(turns).collect():
        assert r.segment.count(chat_format.START) == r.segment.count(chat_format.END) == 1
        role, _, body = r.segment[len(chat_format.START) : -len(chat_format.END) - 1].partition("\n")
        assert chat_format.unescape_role(role) == (r.role or "") and chat_format.unescape(body) == (r.text or "")
        assert chat_format.unescape(r.segment[r.loss_start : r.loss_end]) == ((r.text or "") if r.role == "assistant" else "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="<|\\\nan", max_size=12), min_size=1, max_size=8))
def test_escapes_are_undone(texts):
    plain = lambda t: __import__("re").sub(r"<(\\*)\|", r"<\1\\|", t)  # noqa: E731  what `escape` has Spark do
    for t in texts:
        assert chat_format.unescape(plain(t)) == t and "<|" not in plain(t)
        assert chat_format.unescape_role(plain(t.replace("\\", "\\\\").replace("\n", "\\n"))) == t


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "more", "output": "a"}, {"instruction": "q", "output": "a", "meta": {"id": 3}}, {"prompt": "q", "response": "a", "system": "s"}, {"prompt": "q", "completion": None},
        {"question": "q", "answer": "a", "context": "c"}, {"turn": 4, "role": "user", "text": "q"}, {"unknown": [1, {"x": 2}]}, {}, [], 5,
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{broken"), (92, "")]
    got = defaultdict(list)
    for r in chat_format.canonical_turns(spark.createDataFrame(rows, "key long, record string"), "key").collect():
        got[r.key].append((r.layout, r.turn, r.role, r.text))
    qa = lambda name: [(name, 0, "user", "q"), (name, 1, "assistant", "a")]
    assert got[0] == qa("messages") and got[1] == qa("conversations") and got[3] == qa("instruction")
    assert got[2] == [("instruction", 0, "user", "q\nmore"), ("instruction", 1, "assistant", "a")]
    assert got[4] == [("prompt_response", 0, "system", "s"), ("prompt_response", 1, "user", "q"), ("prompt_response", 2, "assistant", "a")]
    assert got[5] == [("prompt_completion", 0, "user", "q"), ("prompt_completion", 1, "assistant", "")]
    assert got[6] == [("question_answer", 0, "user", "c\nq"), ("question_answer", 1, "assistant", "a")]
    assert got[7] == [("turn", 4, "user", "q")]
    assert all(got[i] == [(None, None, None, None)] for i in (8, 9, 10, 11, 90, 91, 92))


def test_fingerprints_depend_on_paths_alone():
    mark = lambda r: chat_format.fingerprint(chat_format.field_paths(r))
    assert mark({"a": 1, "b": {"c": "x"}}) == mark({"b": {"c": None}, "a": [][:0] or 2})
    assert mark({"a": [{"b": 1}, {"c": 2}]}) == mark({"a": [{"c": 1, "b": 3}]}) != mark({"a": {"b": 1, "c": 2}})


def plain_phrases(docs, least=10, top=2000, percent=50):
    import re

    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if len(p) == 2 and any(100 * cand[t] >= percent * a for t in cand if len(t) == 3 and p in (t[:2], t[1:])):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return Counter(out)


def phrase_docs():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(12)] + ["Ünï", "wide space", "x" * 200]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b", " ! "]) for _ in range(n))
    rows = [(text(60), ["en", "de", None, "und"][i % 4]) for i in range(60)]
    rows += [(None, "en"), ("", "en"), (" .. \n", None), ("alone", "xx"), ("New York City new york CITY " * 20, "en"), ("a a a a " * 30, "fr"), ("long run " * 40_000, "de"), ("no.space,at;all:here!or?there", "en")] + [rows[0]] * 3
    return rows


def phrase_table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "w") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, w1 int, word string").repartition(3)


def test_phrases_against_plain_counts(spark):
    rows = phrase_docs()
    table = phrase_table(spark, rows)
    for kwargs in ({}, {"least": 2, "top": 25}):
        assert Counter(map(tuple, phrase_hash.collocations(table, **kwargs).collect())) == plain_phrases(rows, **kwargs)


def test_phrases_in_small_slices_runs_and_shards(spark, monkeypatch):
    # the limits are module values that workers import, so they are set in what is shipped
    rows = phrase_docs()[:40]
    for i, (text, lang) in enumerate(rows):
        words = phrase_hash.Words(pa.array([text]), pa.array([lang], pa.string()), 0)
        monkeypatch.setattr(phrase_hash, "RUN", 7)
        counts = {2: Counter(), 3: Counter()}
        for hashes, pieces, own in words.runs():
            for size in (2, 3):
                ids, known, at = phrase_hash._grams(hashes, pieces, own, size)
                for key, n in zip(*phrase_hash._counted(ids, known, at, size)):
                    counts[size][tuple(key.tolist())] += n
        monkeypatch.setattr(phrase_hash, "RUN", 1 << 20)
        for size in (2, 3):
            (hashes, pieces, own), = words.runs()
            ids, known, at = phrase_hash._grams(hashes, pieces, own, size)
            assert counts[size] == {tuple(k.tolist()): n for k, n in zip(*phrase_hash._counted(ids, known, at, size))}, i


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_phrases_of_nothing(spark, kind):
    table = phrase_table(spark, []) if kind == "empty" else spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, lang string")
    assert phrase_hash.collocations(table).collect() == []


def test_perfect_hash_is_minimal_and_verifies():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rnd.integers(-(2**62), 2**62, (n, 3)), axis=0)
        table = PerfectHash(keys)
        assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
        assert (table.keys[table.find(keys)] == keys).all() and (table.find(keys + 1) == -1).all()


def test_perfect_hash_tells_equal_folds_apart(monkeypatch):
    from tidewater.llm import perfect_hash

    monkeypatch.setattr(perfect_hash, "folded", lambda keys: np.abs(keys[:, 0]).astype(np.uint64) % np.uint64(3))
    keys = np.arange(60, dtype=np.int64).reshape(20, 3)
    table = PerfectHash(keys)
    assert sorted(table.find(keys).tolist()) == list(range(20)) and (table.find(keys + 100) == -1).all()


def test_scores_past_64_bits(spark):
    cases = [(9_999_999_999_999, 99_999_999_999_999, 99_999_999_999_998), (10, 10, 10), (3, 7, 3), (2**40, 2**41 + 1, 2**40 + 3)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", phrase_hash.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got)


def test_phrases_are_read_a_megabyte_at_a_time():
    """What a task holds of its texts at a time is part of an executor's memory."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["some words " * 1000] * 400), pa.array(["en"] * 400)], names=["text", "lang"])
    found = list(phrase_hash._unique_words([batch], 1))
    assert len(found) >= 4 and sum(sum(b.column(3).to_pylist()) for b in found) == 800_000
