import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string, token string, n int, kept boolean, place string, taken string, component_id string, rank int, length int"
LABELS = "doc_id long, quality int, toxic int, score double"
VECTORS = "vec_id long, embedding array<float>, label int, rep long, dim string"
EXTRA = (0.5, 7, "k", "t", 1, True, "p", "q", "c", 1, 1)


def prose(rnd, n, words="the of and to in is that it for was alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()):
    return " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(n))


def messy_rows():
    """Documents with nulls, blanks, long texts, copies, near copies and repeated rows."""
    rnd = random.Random(4)
    rows = []
    base = prose(rnd, 120)
    passage = prose(rnd, 40)
    for i in range(60):
        kind = i % 6
        words = base.split()
        if kind == 0:
            text = prose(rnd, 60 + i)
        elif kind == 1:
            words[rnd.randrange(len(words))] = f"edit{i}"
            text = " ".join(words)
        elif kind == 2:
            text = base
        elif kind == 3:
            text = f"{prose(rnd, 30)}\n{passage}\t{prose(rnd, 30)}"
        elif kind == 4:
            text = f"call +1 (017) 555-77{10 + i} or mail a{i}@b.example.com from 10.0.0.{i} with 4111 1111 1111 1111\nline\nline\n{prose(rnd, 9)}"
        else:
            text = "idiot scum " + prose(rnd, 25) if i % 4 else prose(rnd, 3)
        rows.append((i, text, ["en", "de", "fr"][i % 3], f"src{i % 4}", len(text)))
    rows += [
        (60, None, None, None, None), (61, "", "en", "src0", 0), (62, " \n\t ", "en", None, 4), (63, "!!! 123 ###", None, "src1", 11), (64, "x", "de", "src2", 1),
        (65, "word " * 60_000, "en", "src3", 300_000), (66, "0" * 30_000 + "." + "a" * 30_000, "en", "src3", 60_001), (67, "Ünïcode　wide space ｆｕｌｌ 你好 🎉 " * 4, "fr", "src0", 100),
        (68, "a mark <|endoftext|> and <|STARTOFTEXT|> or <|startoftext|>x² ½ ①", "en", "src2", 50), (69, "² ½ ① 12", "de", "src2", 8),
        (None, "a row without an id but with some words in it for good measure", "en", "src1", 60), (5, rows[5][1], "fr", "src1", 10), rows[2], rows[2],
    ]
    return [(*r, *EXTRA) for r in rows]


def messy_labels():
    return [(i, i % 2, int(i % 6 == 5), 0.1) for i in range(60)] + [(60, None, None, None), (None, 1, 1, 0.0), (5, 1, 1, 0.1), (65, 1, 0, 0.0)]


def messy_vectors():
    rnd = random.Random(6)
    rows = []
    centers = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    for i in range(200):
        c = centers[i % 4]
        near = 0.02 if i % 3 else 0.5
        rows.append((i, [x + rnd.gauss(0, near) for x in c] if i % 5 else c, i % 2))
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [nan] * 16, 0), (204, [inf] * 16, 1), (205, [1.0, None] * 8, 1), (206, rows[0][1], None), (207, [1.0] * 8, 0), (208, [2.0] * 8, 0), (None, rows[0][1], 0), rows[5], (209, [3e30 * x for x in rows[5][1]], 1)]
    return [(*r, 1, "d") for r in rows]


def write(spark, folder, docs, labels, vectors):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("embeddings", vectors, VECTORS)):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("messy"), messy_rows(), messy_labels(), messy_vectors())


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(scope="session")
def nulls(spark, tmp_path_factory):
    """Tables whose every value is null."""
    blank = lambda schema, n: [tuple(None for _ in schema.replace("<float>", "").split(","))] * n
    return write(spark, tmp_path_factory.mktemp("nulls"), blank(DOCS, 3), blank(LABELS, 2), blank(VECTORS, 3))
