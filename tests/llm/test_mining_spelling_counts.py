"""Hard negatives, spelling variants and token counts against brute force and the library."""

import random

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from oracle import connection, rows
from pyspark.sql import functions as F

from quillon.llm import hard_negatives, queries, spelling, token_counts

SF = "/root/testdata/sf0.001"


# Hard negatives


def brute_negatives(vectors, positives=5, negatives=10, low=30, high=90):
    """vectors: (id, label, ints); anchors are those whose id 100 divides."""
    wide = max((len(v) for _, _, v in vectors), default=0)
    full = [(i, lab, list(v) + [0] * (wide - len(v))) for i, lab, v in vectors]
    out = []
    for a, lab, v in full:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in full if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, vectors, **options):
    rows_ = spark.createDataFrame([(i, lab, v) for i, lab, v in vectors], "vec_id long, label long, v array<long>")
    return sorted(map(tuple, hard_negatives.mine(rows_, F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("shape", [(64, 64, 64), (1, 1, 1), (7, 33, 65), (40, 3, 90), (130, 65, 33)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    dice = np.random.default_rng(m)
    a, b = dice.integers(-(2**20), 2**20, (m, k)), dice.integers(-(2**20), 2**20, (k, n))
    want = np.array(a.astype(object) @ b.astype(object), dtype=np.int64)
    for leaf in (1, 4, 16):
        assert (hard_negatives.strassen(a, b, leaf) == want).all()
    assert (hard_negatives.scores(a, b.T, 8) == want).all()


def test_scores_refuse_what_could_overflow():
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.scores(np.full((2, 4), 2**40), np.full((2, 4), 2**40))


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("broadcast_bytes", [8_000_000, 0])
def test_negatives_equal_brute_force(spark, seed, broadcast_bytes):
    dice = random.Random(seed)
    vectors = [(i, dice.choice([0, 0, 0, 1, 2]), [dice.randint(-9, 9) for _ in range(5)]) for i in range(0, 900, 3)]
    vectors += [(100000 + i, 1, [3, 3, 3, 3, 3]) for i in range(40)]  # one vector many times
    got = mined(spark, vectors, broadcast_bytes=broadcast_bytes, anchor_rows=2, candidate_rows=16, leaf=2)
    assert got == brute_negatives(vectors)


def test_negatives_of_odd_rows(spark):
    ragged = [(0, 1, [5, 5]), (1, 1, [5]), (2, 1, [5, 5, 5]), (3, 2, [3]), (4, 2, [2, 2, 9]), (100, 9, [1]), (200, 2, [])]
    assert mined(spark, ragged) == brute_negatives(ragged)
    assert mined(spark, []) == []
    same = mined(spark, [(100, 1, [4]), (1, 1, [4]), (1, 1, [4]), (2, 2, [3]), (2, 2, [3])])
    assert same == [(100, 1, r, 2, 16, 12) for r in (1, 1, 2, 2)]  # rows that repeat an id stand each for itself


def test_scaling_leaves_out_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame(
        [(1, 1, [0.5, -0.001], "x"), (2, None, [1.0], "x"), (3, 1, None, "x"), (4, 1, [nan], "x"), (5, 1, [inf], "x"), (6, 1, [1.0, None], "x"), (None, 1, [1.0], "x"), (7, 2, [], None)],
        "vec_id long, label int, embedding array<float>, v string",
    )
    assert sorted(map(tuple, hard_negatives.scaled(frame).collect())) == [(1, 1, [128, -1]), (7, 2, [])]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_spelling_variants"])
def test_queries_equal_their_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), connection(SF).sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# Spelling variants


def brute_variants(counts, ratio=5):
    letters, form, n_near = set("".join(counts)), {}, {}
    for w in counts:
        near = {w[:i] + a + w[i + d :] for i in range(len(w) + 1) for a in [*letters, ""] for d in (0, 1)}
        near = {x for x in near if x != w and x in counts and abs(len(x) - len(w)) <= 1}
        best = min(near, key=lambda x: (-counts[x], x.encode())) if near else None
        form[w], n_near[w] = (best if best is not None and counts[best] >= ratio * counts[w] else None), len(near)
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], n_near[w], counts[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_variants_equal_brute_force(spark, seed):
    dice = random.Random(seed)
    counts = {"".join(dice.choice("ab") for _ in range(dice.randint(1, 9))): dice.choice([1, 2, 5, 30, 200, 1000]) for _ in range(400)}
    counts |= {"".join(dice.choice("abcéÿ") for _ in range(dice.randint(1, 6))): dice.choice([1, 5, 30, 200]) for _ in range(200)}
    counts |= {"x" * 60: 5, "x" * 59: 50, "x" * 30 + "y" + "x" * 29: 3, "x" * 30 + "y" + "x" * 30: 3}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variant_groups(frame, salts=2).collect()), key=str) == brute_variants(counts)


def test_words_of_odd_documents(spark):
    docs = spark.createDataFrame(
        [(1, "Straße straße STRASSE " * 3, 7), (1, "straße2straße", 7), (None, "straße\nstraße", None), (2, None, 1), (3, "", 1), (4, "été " * 9, 1)],
        "doc_id long, text string, word int",
    )
    got = dict(map(tuple, spelling.corpus_words(docs, least_count=1, edit_every=0).collect()))
    assert got == {"straße": 10, "strasse": 3}
    assert spelling.variant_groups(spelling.corpus_words(docs.limit(0))).count() == 0


def test_planted_edit_follows_crc32(spark):
    import zlib

    texts = [(i, f"planted{'abcdefghij'[i % 10]}words") for i in range(2000)]
    want: dict[str, int] = {}
    for i, w in texts:
        h = zlib.crc32(f"{i}:{w}".encode())
        if h % 199 == 0:
            w = w[: h % len(w)] + w[h % len(w) + 1 :]
        want[w] = want.get(w, 0) + 1
    got = spelling.corpus_words(spark.createDataFrame(texts, "doc_id long, text string"), least_count=1)
    assert dict(map(tuple, got.collect())) == want
    assert len(want) > 10


# Token counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())


def odd_texts():
    dice = random.Random(5)
    letters = list("abcdeéÀ ▁\n\t  ABthe,.<s>0123梦벨ゼ☃😀­\x00")
    texts = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 60))) for _ in range(400)]
    texts += ["".join(dice.choice("abt he") for _ in range(900)) for _ in range(9)]
    texts += ["".join(dice.choice("aetnh") for _ in range(n)) for n in (500, 5000)]
    texts += [" " * n for n in (1, 2, 15, 16, 17, 33, 700)] + ["a" * 3000, "ab" * 2000, "▁" * 700 + "x", "</s><s><unk><0x41>", "一二三" * 100]
    return texts


def test_counts_equal_the_library(library):
    texts = odd_texts()
    parts = iter([pd.Series(texts[i : i + 50]) for i in range(0, len(texts), 50)])
    got = np.concatenate(list(token_counts._text_counts(parts, token_counts.model_path(), 300)))
    assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_rounds_and_heap_agree(monkeypatch, library):
    texts = ["aabaabaaab" * 30, " " * 90 + "the", "tionation" * 40]
    for most in (1, 10_000):
        monkeypatch.setattr(token_counts, "LONG_SEQUENCE", most)
        got = list(token_counts._text_counts(iter([pd.Series(texts)]), token_counts.model_path(), 300))[0]
        assert got.tolist() == [len(x) for x in library.encode(texts)]


def test_count_tokens_of_odd_rows(spark, library):
    docs = spark.createDataFrame(
        [(1, "the cat " * 4000, 5), (1, "the cat", 5), (None, "é", None), (2, None, 1), (3, "", 1)], "doc_id long, text string, n_tokens int"
    )
    got = sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=str)
    n = len(library.encode("the cat " * 4000))
    assert n > 4096
    short, accent = len(library.encode("the cat")), len(library.encode("é"))
    assert got == sorted([(1, 32000, n, True), (1, 7, short, False), (None, 2, accent, False), (2, 0, 0, False), (3, 0, 0, False)], key=str)
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def test_query_counts_every_document(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    counts = library.encode([d.text or "" for d in docs])
    assert got == {d.doc_id: (len((d.text or "").encode()), len(c), len(c) > 4096) for d, c in zip(docs, counts, strict=True)}
