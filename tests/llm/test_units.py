"""Parts of the operators against plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_reference import split

from tidewater.llm import brown_lm, components, embedding_ego, jaccard_orders, language_crf, pack_complement, pii_skipcrf, shingles, substring_automata, toxicity_kn
from tidewater.llm.common import split_words

TEXT = st.text(alphabet=st.sampled_from("abAB é你 \t\n\x0b\x1c \xa0.'"), max_size=40)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_contract(text):
    assert split_words(text) == split(text)


@given(st.lists(st.none() | TEXT, max_size=8))
@settings(max_examples=200, deadline=None)
def test_column_words(texts):
    hashes, bounds = shingles.column_words(pa.array(texts, pa.string()), lower=True)
    words = [split((t or "").encode().lower().decode()) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words] if texts else True
    flat = [w for own in words for w in own]
    assert len({*flat}) == len({*zip(flat, hashes.tolist())}) == len({*hashes.tolist()})


@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), max_size=20))
@settings(max_examples=300, deadline=None)
def test_prefixes_of_linked_sets_share_enough_tokens(a, b, late):
    overlap = len(a & b)
    flags = jaccard_orders.bits_of(np.array([3, 5]))
    crowded = jaccard_orders.bits_of(np.array(sorted(late), dtype=np.int64))
    linked = 100 * overlap >= 80 * len(a | b)
    assert linked == (overlap >= jaccard_orders.needed_overlap(len(a), len(b)))
    if linked:
        for seed in jaccard_orders.ORDERS:
            x, y = (jaccard_orders.prefix(np.array(sorted(s), dtype=np.int64), flags, seed, crowded) for s in (a, b))
            rest = max(len(a) - len(x), len(b) - len(y))
            assert len(set(x.tolist()) & set(y.tolist())) >= max(1, jaccard_orders.needed_overlap(len(a), len(b)) - rest)
        x, y = (np.frombuffer(jaccard_orders.signature(np.array(sorted(s), dtype=np.int64), flags), np.uint16) for s in (a, b))
        assert jaccard_orders.passes(x, y, len(a), len(b))


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_differences_keep_every_linked_pair(data):
    draw = lambda least=0: np.array(sorted(data.draw(st.sets(st.integers(0, 40), min_size=least, max_size=30))), dtype=np.int64)
    a = draw(1)
    b = np.array(sorted((set(a.tolist()) | data.draw(st.sets(st.integers(0, 60), max_size=4))) - data.draw(st.sets(st.integers(0, 40), max_size=3))), dtype=np.int64)
    overlap = len(set(a.tolist()) & set(b.tolist()))
    if not len(b) or overlap < jaccard_orders.needed_overlap(len(a), len(b)):
        return
    found = jaccard_orders.pivots([draw(1) for _ in range(data.draw(st.integers(0, 6)))])
    x, y = ({i: np.setxor1d(s, found[i]) for i in jaccard_orders.places(s, found)} for s in (a, b))
    meet = set(x) & set(y)
    assert meet
    for i in meet:
        shared = len(set(x[i].tolist()) & set(y[i].tolist()))
        assert len(a) + len(b) - 2 * overlap == len(x[i]) + len(y[i]) - 2 * shared
        if 9 * (len(x[i]) + len(y[i])) > len(a) + len(b):
            assert shared >= max(jaccard_orders.least_shared(len(s), len(d[i]), len(found[i])) for s, d in ((a, x), (b, y)))


def test_families_against_all_pairs(spark):
    """Families larger than SMALL_GROUP, one of them with a passage that other documents hold as well."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**9)}"
    texts = []
    for family in range(3):
        base = [word() for _ in range(90)]
        for i in range(90):
            own = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 2, 3, 3, 4, 6))):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own[rnd.choice((0, 0, 0, 3)) :]))
        if family == 0:
            for size in (3, 40, 200):
                texts += [" ".join(base + [word() for _ in range(size)]) for _ in range(40)]
    texts += texts[5:9]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, texts)]
    root = list(range(len(sets)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = jaccard_orders.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in range(len(sets))}


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(30)]
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in got} == {n: find(n) for n in linked}


@given(st.lists(st.integers(1, 32), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_plan_packs_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=33)
    plan = pack_complement.PackPlan(counts)
    used = np.zeros(33, dtype=int)
    for pattern, times in plan.patterns:
        assert sum(pattern) <= 32
        for length in pattern:
            used[length] += times
    assert (used == counts).all()
    keys = plan.tables()[0]
    assert (np.diff(keys) > 0).all()


def test_exact_complements_fill_sequences():
    counts = np.zeros(101, dtype=int)
    counts[[60, 25, 15, 50, 90, 4, 3]] = [10, 10, 10, 20, 5, 10, 10]
    plan = pack_complement.PackPlan(counts)
    assert sum(t for _, t in plan.patterns) <= -(-int((np.arange(101) * counts).sum()) // 100) + 1


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([5, 0, 1, 4])
    scores, transition = rng.normal(size=(10, 3)), rng.normal(size=(3, 3))
    gamma, expected = language_crf.forward_backward(scores, transition, lengths)
    want, pairs, at = np.zeros((10, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        if not n:
            continue
        total, own, own_pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            # every label may stand before the first token, with equal weight
            p = np.exp(transition[:, path[0]]).sum() * np.exp(sum(scores[at + i, c] for i, c in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, c in enumerate(path):
                own[i, c] += p
            for a, b in zip(path, path[1:]):
                own_pairs[a, b] += p
        want[at : at + n] = own / total
        pairs += own_pairs / total
        at += n
    assert np.allclose(gamma, want) and np.allclose(expected, pairs)


def test_long_sequences_are_the_sum_of_chunks():
    rng = np.random.default_rng(4)
    scores, transition = rng.normal(size=(300, 3)), rng.normal(size=(3, 3))
    gamma, _ = language_crf.forward_backward(scores, transition, np.array([300]))
    alpha = np.zeros((300, 3))
    beta = np.ones((300, 3))
    a, e = np.exp(transition), np.exp(scores)
    x = np.ones(3) / 3
    for t in range(300):
        x = (x @ a) * e[t]
        x /= x.sum()
        alpha[t] = x
    for t in range(298, -1, -1):
        beta[t] = a @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    want = alpha * beta
    assert np.allclose(gamma, want / want.sum(1, keepdims=True))


def test_code_switching_is_found():
    english, spanish = "the of and with that from this have", "el los que para con una por pero"
    rnd = random.Random(1)
    make = lambda words: " ".join(rnd.choice(words.split()) for _ in range(120))
    model = language_crf.fit([(make(english), "en") for _ in range(6)] + [(make(spanish), "es") for _ in range(6)])
    assert [s[2] for s in model.spans([f"{english} {spanish} {english}"])[0]] == ["en", "es", "en"]


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(5)
    labels = len(pii_skipcrf.LABELS)
    model = pii_skipcrf.SkipChain({"f0": 0, "f1": 1, "f2": 2}, rng.normal(size=(3, labels)), rng.normal(size=(labels, labels)), np.zeros((labels, labels)))
    found = [pii_skipcrf.Candidate(i * 10, i * 10 + 5, 0, tuple(range(labels)), str(i) * 9, [f"f{i}"]) for i in range(3)]
    want = np.zeros((3, labels))
    for path in itertools.product(range(labels), repeat=3):
        p = np.exp(sum(model.weights[i, c] for i, c in enumerate(path)) + sum(model.chain[a, b] for a, b in zip(path, path[1:])))
        for i, c in enumerate(path):
            want[i, c] += p
    assert np.allclose(model.marginals(found, damping=0.0), want / want.sum(1, keepdims=True), atol=1e-6)


def test_skip_edges_find_the_twin_of_a_phone_number():
    texts = [f"call +1 (2{i:02}) 555-01{i:02} or 10.0.0.{i} or a{i}@b.example.com now" for i in range(60)]
    model = pii_skipcrf.fit(texts)
    base, spans = model.spans("call +1 (201) 555-0199 now; again: 1 (201) 555-0199 please")
    assert [s[0] for s in base] == ["phone"] and [s[0] for s in spans] == ["phone", "phone"]
    assert pii_skipcrf.redact("x a@b.c y", [("email", 2, 7)]) == "x [EMAIL] y"


def test_exchange_finds_word_classes():
    # words 0-4 are followed by 5-9 and the other way round
    table = np.zeros((12, 12), dtype=np.int64)
    rng = np.random.default_rng(1)
    for a in range(5):
        for b in range(5, 10):
            table[a, b], table[b, a] = rng.integers(5, 20, 2)
    cls = brown_lm.exchange(table, classes=2, passes=6)
    assert len(set(cls[:5])) == 1 and len(set(cls[5:10])) == 1 and cls[0] != cls[5]


def test_spelled_addresses_are_found_whatever_else_the_text_holds():
    prose = ["We met 9 friends at home. Then we left.", "The 3 of us looked at it. Rain fell.", "It was 4 o'clock at sea. Nobody spoke."]
    model = pii_skipcrf.fit([f"call 1{i} or a{i}@b.example.com now. {prose[i % 3]}" for i in range(60)])
    forms = ["jane.doe @ example.com", "jane.doe at example.com", "JANE AT EXAMPLE DOT ORG", "jane at example dot org", "jane(at)example.org"]
    for form in forms:
        for rest in ("", " an anecdote"):
            text = f"Write {form} please{rest}"
            assert [text[c.start : c.end] for c in pii_skipcrf.candidates(text, [])] == [form]
            assert pii_skipcrf.redact(text, model.spans(text)[1]) == f"Write [EMAIL] please{rest}"
    for text in prose + ["An anecdote of them at home. Then silence."]:
        assert not [s for s in model.spans(text)[1] if s[0] == "email"]


def test_language_sample_is_drawn_at_any_size():
    for rows in (141, 10**6, 70 * 10**6, 140 * 10**6 + 1, 10**10):
        expected = (language_crf.draw_limit(rows, 100) + 2**63 + 1) / 2**64 * rows
        assert expected == pytest.approx(140, rel=1e-6)
    assert language_crf.draw_limit(140, 100) == language_crf.draw_limit(1, 100) == 2**63 - 1


def test_words_outside_the_head_get_classes_too(spark):
    # sentences alternate nouns and verbs; only the six commonest of the 40 words are in the head
    rnd = random.Random(2)
    pick = lambda kind: f"{kind}{min(rnd.randrange(20), rnd.randrange(20), rnd.randrange(20))}"
    rows = [(" ".join(pick("noun" if i % 2 else "verb") for i in range(1, 13)),) for _ in range(400)] + [("noun0 once verb0",)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string").repartition(3)
    counts = Counter(w for (t,) in rows for w in t.split())
    model, classes = brown_lm.train(docs, cluster_words=6, table_words=10)
    assert len(model.table) == 10 and model.rare >= 2
    got = {r.word: (r.n, r.cls) for r in classes.collect()}
    assert {w: n for w, (n, _) in got.items()} == counts
    assert all((c == model.rare) == (n == 1) for n, c in got.values())
    of = {kind: {c for w, (n, c) in got.items() if w.startswith(kind) and n >= 5} for kind in ("noun", "verb")}
    assert of["noun"] and of["verb"] and not of["noun"] & of["verb"]
    # what the table answers and what is joined give the same scores and transitions
    whole, _ = brown_lm.train(docs, cluster_words=6)
    made = [brown_lm.chains(docs, m, classes) for m in (model, whole)]
    p = [brown_lm.transitions(x, model.rare + 2) for x in made]
    assert np.array_equal(*p)
    a, b = (sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in brown_lm.score(x, p[0]).collect()) for x in made)
    assert np.allclose(a, b)
    assert brown_lm.class_number(10**9) > brown_lm.class_number(10**6) > brown_lm.class_number(100) == brown_lm.CLASSES


def test_kneser_ney_sums_to_one():
    words = ["a", "b", "c", "x", "never"]
    texts = [[np.array([0, 1, 0, 2] * 3), np.array([2, 1])] * 6, [np.array([0, 2, 2, 3] * 3)] * 6]
    model = toxicity_kn.KneserNey.fit(texts, words)
    size = len(words) + 1
    for c in (0, 1):
        assert model.word[c].sum() == pytest.approx(1) and (model.word[c] > 0).all()
        for h in range(size):
            own = model.keys // size == h
            assert model.pair[c][own].sum() + model.left[c][h] * model.word[c].sum() == pytest.approx(1, abs=2e-3)
    # counts are of distinct words before: copies change nothing
    again = toxicity_kn.KneserNey.fit([[*texts[0], *texts[0]], texts[1]], words)
    assert np.array_equal(again.word, model.word) and np.array_equal(again.pair, model.pair)


def test_kneser_ney_against_plain_counts():
    """Words and pairs against counts kept in dictionaries, with the same discounts and tilt."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    texts = [[np.array([min(11, int(rnd.expovariate(0.3 + c / 4))) for _ in range(30)]) for _ in range(9)] for c in (0, 1)]
    model = toxicity_kn.KneserNey.fit(texts, words)
    contexts = [{(a, b, w) for t in c for a, b, w in zip(["", "", *t.tolist()], ["", *t.tolist()], t.tolist())} for c in texts]
    pairs = [Counter((b, w) for _, b, w in c) for c in contexts]
    single = [Counter(w for _, w in p) for p in pairs]
    tilt = model.spelling.tilt(words)
    both = Counter(w for _, w in {*pairs[0], *pairs[1]})
    for c in (0, 1):
        less = toxicity_kn.discounts(np.array([single[c][w] for w in range(12)]))
        own = {w: max(0.0, single[c][w] - less[min(3, single[c][w])]) / sum(single[c].values()) for w in range(12)}
        shared = {w: (both[w] + 0.5) * np.exp(tilt[c][w]) for w in range(12)}
        for w in range(12):
            assert model.word[c][w] == pytest.approx(own[w] + (1 - sum(own.values())) * shared[w] / sum(shared.values()))
        every = {*pairs[0], *pairs[1]}
        less = toxicity_kn.discounts(np.array([pairs[c][p] for p in every]))
        for key, p in zip(model.keys.tolist(), model.pair[c].tolist()):
            h, w = divmod(key, 13)
            h = "" if h == 12 else h
            total = sum(n for (b, _), n in pairs[c].items() if b == h)
            assert p == pytest.approx(max(0.0, pairs[c][h, w] - less[min(3, pairs[c][h, w])]) / max(1, total))


def test_unseen_forms_lean_to_the_class_that_spells_so():
    toxic = [f"grublo{e} and the {w} day" for e in ("sk", "n", "ter", "mi", "pa") for w in ("fine", "cold", "long")]
    plain = [f"the {a} {b} of a day" for a in ("fine", "cold", "long") for b in ("house", "river", "stone", "light", "garden")]
    model = toxicity_kn.fit(toxic + plain, [1] * 15 + [0] * 15, [i % 2 for i in range(30)])
    s = model.scores(["a grublovar here", "a house there", "", None], model.lookup())
    assert s[0] > s[1] and s[2] == s[3]
    again = toxicity_kn.ToxicityModel.load(model.dump())
    assert again.index == model.index and np.array_equal(again.language.keys, model.language.keys)
    assert np.allclose(again.scores(["a grublovar here", "the cold day"], again.lookup()), model.scores(["a grublovar here", "the cold day"], model.lookup()), atol=1e-3)
    assert toxicity_kn.fit(plain, [0] * 15, [0] * 15).language is None


def test_automata_remove_what_windows_say():
    a = [f"w{i}" for i in range(30)]
    b = ["x", *a[3:25], "y"]
    starts = np.arange(1, 11)
    assert substring_automata.tiles(np.array([1, 2, 3, 20, 40, 41]), 13).tolist() == [1, 3, 20, 40, 41]
    masks = substring_automata.removal_masks([(5, b, starts), (1, a, np.zeros(0, np.int64)), (9, a, np.zeros(0, np.int64))])
    assert masks[0].tolist() == [False, *[True] * 22, False] and not masks[1].any() and masks[2].any()


def test_automata_of_very_many_words(monkeypatch):
    a, b = [f"w{i}" for i in range(60)], ["x", *[f"w{i}" for i in range(9, 40)], "y"]
    documents = [(1, a, np.zeros(0, np.int64)), (5, b, np.arange(1, 20))]
    want = [m.tolist() for m in substring_automata.removal_masks(documents)]
    monkeypatch.setattr(substring_automata, "ONE_CHARACTER", 7)
    texts, width = substring_automata.encode_words([a, b])
    assert width == 2 and texts[0][2 * 9 : 2 * 40] == texts[1][2:-2]
    assert [m.tolist() for m in substring_automata.removal_masks(documents)] == want
    monkeypatch.undo()
    texts, width = substring_automata.encode_words([[str(i) for i in range(1_200_000)]])
    assert width == 2 and len(texts[0]) == 2_400_000 and len({texts[0][i : i + 2] for i in range(0, 2_400_000, 2)}) == 1_200_000


def test_vectors_of_every_length_are_joined(spark, monkeypatch):
    lengths = range(1, 1003)
    rows = [(2 * n + i, 0, [float(x == 0 or i) for x in range(n)] if n > 1 else [1.0 + i]) for n in lengths for i in (0, 1)]
    rows += [(5000, 0, [1.0] * 1500), (5001, 0, [1.0] * 1501), (5002, 0, [1.0] * 1501)]
    seen = []
    blank = spark.createDataFrame([], "rep long, links long, root long")
    monkeypatch.setattr(embedding_ego, "directions", lambda distinct, dim: dim)
    monkeypatch.setattr(embedding_ego, "_links", lambda part, dim, *_: seen.append(dim) or blank)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r.vec_id: r for r in embedding_ego.near_duplicates(frame).collect()}
    assert seen == list(lengths)  # those that hold one vector have no links to look for
    assert [found[i].n_links for i in (5000, 5001, 5002)] == [0, 1, 1] and found[5002].component_id == 5001
    few = frame.where("vec_id >= 5000")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_ego.near_duplicates(few).collect()} == {5000: (0, 5000, True), 5001: (1, 5001, True), 5002: (1, 5001, False)}


def test_recursive_join_is_the_product():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(5, 8))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(np.repeat(centers, 40, 0) + rng.normal(size=(200, 8)) * 0.1)
    b = unit(np.repeat(centers, 30, 0) + rng.normal(size=(150, 8)) * 0.1)
    basis = np.linalg.qr(rng.normal(size=(8, 3)))[0]
    epsilon = np.sqrt(2 - 2 * 0.98) + 1e-9
    assert (embedding_ego.join_pairs(a, b, basis, epsilon, 0.98, False) == (a @ b.T >= 0.98)).all()
    own = a @ a.T >= 0.98
    np.fill_diagonal(own, False)
    assert (embedding_ego.join_pairs(a, a, basis, epsilon, 0.98, True) == own).all()
    assert len(embedding_ego.spanning(own)) < 2 * len(a)


def planted(rnd, n):
    """Texts with personal data that the base rules find, and with such that they drop or refuse; and what stands where."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))

    def card():
        body = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        return next(body + str(d) for d in range(10) if pii_skipcrf.luhn(body + str(d)))

    phone = lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    decoy = lambda: next(x for x in iter(lambda: "".join(str(rnd.randrange(10)) for _ in range(16)), "") if not pii_skipcrf.luhn(x))
    texts, dropped = [], []
    for i in range(n):
        kinds = [[card()], [phone()], [f"{word()}.{i}@{word()}.example.com"], [decoy()], [".".join(str(rnd.randrange(256)) for _ in range(4))], [phone(), card()], [card(), decoy()]]
        text, spans = word(), []
        for pieces in rnd.sample(kinds, 3):
            text += f" {word()} "
            for k, piece in enumerate(pieces):
                at = len(text)
                text += piece + (" " if k + 1 < len(pieces) else "")
                if len(pieces) > 1 and piece[0] in "+4" and pii_skipcrf.luhn("".join(c for c in piece if c.isdigit())) | (piece[0] == "+"):
                    spans.append(("phone" if piece[0] == "+" else "card", at, at + len(piece)))
            text += f" {word()}"
        texts.append(text)
        dropped.append(spans)
    return texts, dropped


def test_field_adds_what_the_rules_drop():
    rnd = random.Random(12)
    model = pii_skipcrf.fit(planted(rnd, 600)[0])
    texts, dropped = planted(rnd, 300)
    right = wrong = want = 0
    for text, spans in zip(texts, dropped):
        base, every = model.spans(text)
        added = set(every) - set(base)
        assert set(base) <= set(every)
        right += len(added & set(spans))
        wrong += len(added - set(spans))
        want += len(spans)
    assert want > 150 and right >= 0.8 * want and wrong <= 0.05 * right


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=12), st.integers(0, 45), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_overlaps_by_search(spans, a, n):
    spans = [(s, s + k) for s, k in spans]
    assert pii_skipcrf.Spans(spans).overlap(a, a + n) == any(s < a + n and e > a for s, e in spans)


def test_brown_scores_against_plain_loops(spark):
    """Transitions and emissions counted in dictionaries, given the classes."""
    rnd = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(9)], [f"v{i}" for i in range(9)]
    say = lambda: " ".join(w for _ in range(rnd.randrange(1, 6)) for w in ("the", rnd.choice(nouns), rnd.choice(verbs)))
    texts = [say() for _ in range(60)] + ["the odd one", None, ""]
    docs = spark.createDataFrame([(i, i % 3 == 0, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").repartition(3)
    model, classes = brown_lm.train(docs.where("not held_out"), table_words=5)
    made = brown_lm.chains(docs, model, classes)
    got = {r.doc_id: r for r in brown_lm.score(made, brown_lm.transitions(made.where("not held_out"), model.rare + 2)).collect()}
    known = {r.word: (r.n, r.cls) for r in classes.collect()}
    rare, end = model.rare, model.rare + 1
    chain = lambda t: [end, *[known.get(w, (0, rare))[1] for w in (t or "").split()], end]
    pairs = Counter(p for i, t in enumerate(texts) if i % 3 for p in zip(chain(t), chain(t)[1:]))
    total = Counter()
    for (a, _), n in pairs.items():
        total[a] += n
    own = Counter()
    for n, c in known.values():
        own[c] += n
    types = sum(c == rare for _, c in known.values())
    for i, t in enumerate(texts):
        want = sum(math.log10((pairs[p] + 0.5) / (total[p[0]] + 0.5 * (rare + 2))) for p in zip(chain(t), chain(t)[1:]))
        for w in (t or "").split():
            n, c = known.get(w, (0, rare))
            want += math.log10((n + 1) / (own[rare] + types + 1)) if c == rare else math.log10(n / own[c])
        assert got[i].score == pytest.approx(want), t
    held = [got[i] for i in range(0, 60, 3)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def spoken(rnd, n):
    """Texts of invented languages that share some words: (text, language)."""
    parts = {"xa": ("tha", "ing", "wor", "led"), "yo": ("sch", "keit", "zu", "ver"), "zi": ("eau", "oux", "tion", "ré")}
    common = ["a", "in", "me"]
    word = lambda lang: rnd.choice(common) if rnd.random() < 0.2 else "".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4)))
    return [(" ".join(word(lang) for _ in range(rnd.randrange(4, 40))), lang) for lang in parts for _ in range(n)]


def test_languages_of_held_out_texts():
    rnd = random.Random(3)
    model = language_crf.fit(spoken(rnd, 40))
    held = spoken(rnd, 60)
    found = model.languages([t for t, _ in held])
    assert sum(lang == want for (lang, _), (_, want) in zip(found, held)) >= 0.97 * len(held)
    assert [lang for lang, _ in model.languages(["² ½ ① 12", "", None, "²a"])][:3] == ["und"] * 3 and model.languages(["²tha"])[0][0] == "xa"


def test_toxicity_of_held_out_texts():
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(900)}" for _ in range(900)]
    insults = [f"{a}{b}" for a in ("grub", "snark", "vlot") for b in ("en", "ig", "ster", "ling", "o", "er", "ix", "um")]

    def made(n, known):
        texts, labels = [], []
        for i in range(n):
            text = [rnd.choice(words) for _ in range(rnd.randrange(5, 120))]
            if i % 4 == 0:
                for _ in range(rnd.randrange(1, 4)):
                    text.insert(rnd.randrange(len(text)), rnd.choice(known))
            texts.append(" ".join(text))
            labels.append(int(i % 4 == 0))
        return texts, labels

    train, labels = made(400, insults[::2] + insults[1::4])
    model = toxicity_kn.fit(train, labels, [i % 2 for i in range(len(train))])
    texts, truth = made(400, insults[::2])
    score = model.scores(texts, model.lookup())
    assert (score[np.array(truth) == 1] >= 0.5).mean() >= 0.95 and (score[np.array(truth) == 0] >= 0.5).mean() <= 0.05
    texts, truth = made(400, insults[3::4])  # forms that were never seen, spelt alike
    score = model.scores(texts, model.lookup())
    assert np.median(score[np.array(truth) == 1]) > np.quantile(score[np.array(truth) == 0], 0.7)


def test_prefixes_of_the_schedule_follow_the_targets(spark):
    """Every prefix of the schedule has of each source nearly what its share says: the points' discrepancy, not that of chance."""
    import math

    from tidewater.llm import mix_schedule

    words = {0: 300_000, 1: 120_000, 2: 40_000, 3: 900}
    sources = spark.createDataFrame([(i, 3 * w // 4 + 1, w) for i, w in words.items()], "sidx int, source_size long, words long")
    rows = sorted((r.slot, r.sidx, r.length) for r in mix_schedule.schedule(spark, sources, 2000).collect())
    total, seen = sum(words.values()), dict.fromkeys(words, 0)
    assert {i: sum(n for _, s, n in rows if s == i) for i in words} == words
    largest = {i: max(n for _, s, n in rows if s == i) for i in words}
    for at, (_, sidx, length) in enumerate(rows):
        seen[sidx] += length
        if at % 50 == 0:
            for i, w in words.items():
                assert abs(seen[i] - sum(seen.values()) * w / total) <= (4 + math.log2(at + 2)) * max(largest.values()), (at, i)


def test_readings_have_their_slots(spark):
    from tidewater.llm import mix_schedule

    docs = spark.createDataFrame([(i, f"s{i % 3}", f"w{i} " * (20 + i)) for i in range(120)], "doc_id long, source string, text string")
    for r in mix_schedule.mix(docs, block_words=50).collect():
        assert all(x.slot is not None and x.slot >= 0 and x.words > 0 for x in r.rounds) and sum(x.words for x in r.rounds) == r.taken
        assert [x.slot for x in r.rounds] == sorted(x.slot for x in r.rounds)  # a source is read round after round
