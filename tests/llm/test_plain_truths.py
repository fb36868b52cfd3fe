"""Operators 5 and 6 against versions written without their own helpers."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from quillon.llm import quality, simhash
from quillon.session import table

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    """The rules of operator 6, word by word and bit by bit."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_the_plain_ones(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    texts |= {-1: None, -2: "", -3: " \t\n", -4: "one", -5: "One TWO", -6: "a b \u0085 c\x1cd É é", -7: "x " * 9, -8: "a b c a b c a b c"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(frame).collect()}
    assert got == {k: plain_fingerprint(t) for k, t in texts.items()}


def plain_classes(text):
    data, out = (text or "").encode(), set()
    for n in (2, 3, 4):
        for at in range(len(data) - n + 1):
            code = n
            for byte in data[at : at + n]:
                code = (code * 0x01000193 % 2**32) ^ byte
            out.add((code * 0x9E3779B1 % 2**32) >> 16)
    return out


@pytest.fixture(scope="module")
def labelled():
    dice = random.Random(2)
    good, bad = "a clear sentence of plain words about rivers and hills".split(), "click buy now !!! $$$ free win xxx".split()
    rows = [(i, " ".join(dice.choices(good if i % 2 else bad, k=dice.randint(3, 12)) + dice.choices(good + bad, k=4)), i % 2) for i in range(90)]
    return [*rows, (900, "", 1), (901, "é", 0)]


def test_ratios_are_the_plain_ones(spark, labelled):
    """Log-count ratios of documents that hold an n-gram, over the rows that may be learnt from."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    df = np.ones((2, quality.FEATURES))
    for i, text, y in labelled:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for c in plain_classes(text):
                df[y, c] += 1
    want = np.log(df[1] / df[1].sum()) - np.log(df[0] / df[0].sum())
    assert np.allclose(model.ratios, want, atol=1e-12)
    # Scores follow from the model by the stated formula.
    for row in quality.score(docs, model).collect():
        text = next(t for i, t, _ in labelled if i == row["doc_id"])
        own = sorted(plain_classes(text))
        norm = np.sqrt((want[own] ** 2).sum())
        margin = (model.folded[own].sum() / norm if norm else 0.0) + model.bias
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30))), abs=1e-9)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)


def test_descent_reaches_the_optimum_of_the_dual():
    """At the end of dual coordinate descent the duality gap of the hinge loss is small, on any table."""
    dice = np.random.default_rng(1)
    x = dice.normal(size=(40, 6)) * (dice.random((40, 6)) < 0.6)
    y = np.where(x @ dice.normal(size=6) + 0.3 * dice.normal(size=40) > 0, 1.0, -1.0)
    rows = [np.flatnonzero(r) for r in x]
    epochs, quality.EPOCHS = quality.EPOCHS, 400
    try:
        w, bias = quality._descend(rows, [r[np.flatnonzero(r)] for r in x], y)
    finally:
        quality.EPOCHS = epochs
    primal = 0.5 * (w @ w + bias * bias) + quality.C * np.maximum(0, 1 - y * (x @ w[:6] + bias)).sum()
    # The best value of the same problem by plain subgradient steps cannot be lower by more than a little.
    v, best = np.zeros(7), np.inf
    full = np.column_stack([x, np.ones(40)])
    for step in range(1, 20001):
        short = y * (full @ v) < 1
        v = v - (v - (full[short] * y[short, None]).sum(0) * quality.C) / (step + 50)
        best = min(best, 0.5 * v @ v + quality.C * np.maximum(0, 1 - y * (full @ v)).sum())
    assert primal <= best * 1.001 + 1e-6
