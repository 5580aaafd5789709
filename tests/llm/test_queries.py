"""Every query over messy, empty and all-null tables, and against brute force."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests_llm_reference import luhn, split
from tidewater.llm import registry

QUERIES = {name: query for name, query in registry.queries().items() if int(name[2:].split("_")[0]) <= 10}  # the others: test_kmeans_chat_phrases.py


@pytest.fixture(scope="session")
def results(spark, messy):
    found = {}

    def get(name):
        if name not in found:
            found[name] = QUERIES[name](spark, messy).collect()
        return found[name]

    return get


@pytest.fixture(scope="session")
def docs(spark, messy):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{messy}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def fold(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_all_null_tables(spark, nulls, name):
    assert QUERIES[name](spark, nulls).count() == 3


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith(("op7_", "op9_"))])
def test_a_row_for_each_row(results, docs, name):
    assert Counter(r.doc_id for r in results(name)) == Counter(d[0] for d in docs)


def test_language(results, docs):
    got = results("op1_language")
    text = {d[0]: d[1] for d in docs}
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (None if r.doc_id is None else fold(r.doc_id, 4) == 2)
        no_letter = not any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und") == no_letter
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}


def sets_of(docs):
    out = {}
    for i, text, *_ in docs:
        words = split((text or "").encode().lower().decode())
        out[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    return out


def test_jaccard_against_all_pairs(results, docs):
    sets = {i: s for i, s in sets_of(docs).items() if i is not None}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in results("op2_jaccard"):
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)), r.doc_id


def test_toxicity(results):
    got = {r.doc_id: r for r in results("op3_toxicity")}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[60].score == got[61].score == got[62].score
    insulted, ordinary = [i for i in range(60) if i % 6 == 5 and i % 4], [i for i in range(60) if i % 6 == 0]
    assert np.mean([got[i].score for i in insulted]) > np.mean([got[i].score for i in ordinary])


def test_brown_base_score(results, docs):
    low = lambda t: split((t or "").encode().lower().decode())
    train = [d for d in docs if d[0] is not None and fold(d[0], 7) != 2]
    counts = Counter(w for d in train for w in low(d[1]))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    text = {d[0]: d[1] for d in docs}
    for r in results("op4_brown"):
        words = low(text[r.doc_id])
        c = [counts[w] for w in words] + [len(train)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (n + v + 1)) for x in c), rel=1e-9)
        assert r.score < 0 and (len(words) < 1000 or r.score > r.base_score)


def water_fill(sizes, weights, cap):
    target, left = {}, sum(sizes.values())
    free = dict(weights)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > cap * sizes[s]]
        if not over:
            target |= {s: level * w for s, w in free.items()}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_mix_targets(spark, messy, results, docs):
    sizes = defaultdict(int)
    for _, text, _, source in docs:
        sizes[source] += len(split(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3.0)
    taken = defaultdict(int)
    for r in results("op5_mix"):
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in sizes)
    again = QUERIES["op5_mix"](spark, messy).collect()
    key = lambda r: repr(sorted(r.asDict().items(), key=lambda x: x[0]))
    assert sorted(map(key, again)) == sorted(map(key, results("op5_mix")))


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(results, docs):
    text = {d[0]: "" if d[1] is None or len(d[1]) > 50_000 else d[1] for d in docs}
    for r in results("op6_pii"):
        if r.doc_id in (65, 66):
            continue
        base = base_spans(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k, _ in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_pii_of_very_many_candidates_in_bounded_memory():
    """Messages are computed in blocks: 30,000 candidates of one text give what small blocks give, in little memory."""
    import tracemalloc

    from tidewater.llm import pii_skipcrf

    model = pii_skipcrf.fit([f"mail a{i}@b{i}.example.com or call +49 (0) 30 {1000000 + i * 37} from 10.0.0.{i % 256}" for i in range(100)])
    found = pii_skipcrf.candidates(text := " ".join(f"0{30 + i % 60} {1000000 + i % 9000 * 7}; x" for i in range(30_000)), pii_skipcrf.base_spans(text))
    tracemalloc.start()
    whole = model.marginals(found, rounds=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000 * len(found)
    before, pii_skipcrf.MESSAGES = pii_skipcrf.MESSAGES, 1000
    assert np.allclose(whole, model.marginals(found, rounds=5))
    pii_skipcrf.MESSAGES = before


def test_whole_texts_are_learnt_from(spark):
    from tidewater.llm.common import whole_texts

    rows = [("a", i, "x" * n) for i, n in enumerate((10, 500, 30, 40, 50))] + [("b", 9, "y" * 5)]
    got = whole_texts(spark.createDataFrame(rows, "g string, draw int, text string"), "g", 3, 1600).collect()
    assert sorted((r.g, r.draw, len(r.text)) for r in got) == [("a", 0, 10), ("a", 2, 30), ("a", 3, 40), ("b", 9, 5)]
    assert [r.draw for r in whole_texts(spark.createDataFrame(rows, "g string, draw int, text string").where("g = 'a'"), None, 9, 8000).collect()] == [0, 1, 2, 3, 4]


def test_packing_round_trip(results, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[(i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    got = results("op7_pack")
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 2048) + 1


def test_substrings_against_brute_force(results, docs):
    first = {}
    words = {}
    for i, text, *_ in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words[i] = split(text or "")
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for r in results("op8_substrings"):
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        own = words[r.doc_id]
        gone = [False] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < r.doc_id:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), r.doc_id


def test_embeddings_against_all_pairs(spark, messy, results):
    rows = spark.read.parquet(f"{messy}/embeddings.parquet").collect()
    good = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    unit = [np.array(r.embedding, dtype=float) / np.linalg.norm(np.array(r.embedding, dtype=float) / 1e20) / 1e20 for r in good]
    links, root = Counter(), {r.vec_id: r.vec_id for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(good)):
        for j in range(i):
            a, b = good[i], good[j]
            if a.label == b.label and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[a.vec_id] += 1
                links[b.vec_id] += 1
                x, y = find(a.vec_id), find(b.vec_id)
                root[max(x, y)] = min(x, y)
    got = results("op9_embeddings")
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], find(r.vec_id), find(r.vec_id) == r.vec_id), r.vec_id


def test_quality_measures(results, docs):
    text = {d[0]: d[1] or "" for d in docs}
    for r in results("op10_quality"):
        t = text[r.doc_id]
        words = split(t)
        lines = [x for x in t.split("\n") if split(x)]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        hit = [False] * len(words)
        for k, w in enumerate(windows):
            if w in often:
                hit[k : k + 8] = [True] * 8
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (len(words) < 20 or 100 * sum(hit) > 30 * len(words))
        assert not (r.kept and r.base_failed)


def test_pipeline_stages(spark, messy, docs):
    table = spark.read.parquet(f"{messy}/documents.parquet")
    kept = corpus_pipeline.jaccard(spark, table, messy).collect()
    sets = {i: s for i, s in sets_of(docs).items() if i is not None}
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {i for i in sets if i % 6 == 0 and i < 60} <= set(ids)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a])
    clean = {r.doc_id: r.text for r in corpus_pipeline.pii(spark, table, messy).collect()}
    assert clean[60] is None and "[EMAIL]" in clean[4] and "[PHONE]" in clean[4] and "@" not in clean[4]
    mixed = corpus_pipeline.mix(spark, table, messy)
    assert mixed.columns == table.columns
    targets = {r.source: r.target for r in QUERIES["op5_mix"](spark, messy).collect()}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(split(r.text))
    assert all(abs(words[s] - t) <= 0.02 * t + 50 for s, t in targets.items())
    rejected = {r.doc_id for r in table.collect()} - {r.doc_id for r in corpus_pipeline.toxicity(spark, table, messy).collect()}
    assert {r.doc_id for r in QUERIES["op3_toxicity"](spark, messy).where("predicted = 1").collect()} == rejected


def test_pipeline_keeps_texts_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, "other words of a text that nobody else has"), (1, ""), (1, None), (1, None), (2, long), (2, long + " more"), (0, "b " + long), (3, "x y"), (3, "x y"), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.jaccard(spark, docs, "").collect())
    assert kept == Counter([(0, "b " + long), (1, rows[1][1]), (1, ""), (1, None), (3, "x y"), (None, long)])


def test_pipeline_stages_keep_columns_of_any_name(spark, messy):
    """Helper columns of the stages meet no column of the input, and nulls of different columns are told apart."""
    names = ["__id", "__hash", "__n", "id", "hash", "n", "row", "key", "words", "rounds", "__key", "__words", "__rounds", "__size", "__text", "component", "own"]
    rows = [(i, f"word{i} " * (i + 5), "en", f"s{i % 2}", None, *[f"{c}{i}" for c in names]) for i in range(6)]
    rows += [(None, None, "en", "a b", None, *names), (None, "a b", "en", None, None, *names)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, table, messy)
        assert out.columns == table.columns, name
        for r in out.collect():
            assert r.doc_id is None or all(r[c] == f"{c}{r.doc_id}" for c in names), name
    mixed = corpus_pipeline.mix(spark, table, messy).collect()
    assert any(r.source is None and r.text == "a b" for r in mixed) and not any(r.source == "a b" for r in mixed)


def test_pipeline_from_end_to_end(spark, messy):
    """Each stage's plain version in turn, and the pieces that come out at the end."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidewater.llm import pii_skipcrf

    table = spark.read.parquet(f"{messy}/documents.parquet")
    toxic = Counter((r.doc_id, r.text) for r in table.join(QUERIES["op3_toxicity"](spark, messy).where("predicted = 1").select("doc_id").distinct(), "doc_id").collect())
    rows = [r for r in table.collect() if (r.doc_id, r.text) not in toxic]
    shingles = lambda t: sets_of([(0, t)])[0]
    keyed = sorted({(r.doc_id, r.text or "") for r in rows if r.doc_id is not None}, key=lambda k: (k[0], k[1]))
    root = {k: k for k in keyed}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    own = {k: shingles(k[1]) for k in keyed}
    for a, b in itertools.combinations(keyed, 2):
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    first = {find(k)[0] for k in keyed}
    kept = {}
    for r in rows:
        if r.doc_id is not None and find((r.doc_id, r.text or ""))[0] == r.doc_id and r.doc_id in first and root[(r.doc_id, r.text or "")] == (r.doc_id, r.text or ""):
            kept[(r.doc_id, r.text)] = r
    left = [*kept.values(), *[r for r in rows if r.doc_id is None]]
    docs = spark.createDataFrame(left, table.schema)
    model = pii_skipcrf.fit_on(docs)
    clean = [r.asDict() | {"text": (t := pii_skipcrf.redact(r.text, model.spans(r.text)[1])), "n_chars": None if t is None else len(t)} for r in left]
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame([tuple(r[c] for c in table.columns) for r in clean], table.schema), messy).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[(r.doc_id, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))] += 1
    got = corpus_pipeline.run(spark, messy).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(int)
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


@pytest.mark.parametrize("which", ["messy", "empty", "nulls"])
def test_pipeline_runs(spark, request, which):
    folder = request.getfixturevalue(which)
    out = corpus_pipeline.run(spark, folder).collect()
    assert (which == "empty" and not out) or which != "empty"
    assert all(1 <= r.length <= 2048 for r in out)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = spark.read.parquet(f"{folder}/documents.parquet")
        assert stage(spark, table, folder).columns == table.columns, name
