"""The near-copy stage of the pipeline against brute-force shingle similarity."""

import collections
import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import words

from quillon.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string"


def brute_shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_kept(rows):
    own = [brute_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8:
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return sorted(min(ks) for ks in least.values())


def changed(text, n, seed):
    w, r = text.split(), random.Random(seed)
    for i in r.sample(range(len(w)), n):
        w[i] = f"changed{seed}"
    return " ".join(w)


def test_stage_drops_near_copies_beyond_three_bits(spark):
    rows = []
    for i in range(30):
        base = words(1000 + i, 150 + 20 * i)
        n = len(base.split())
        rows += [(10 * i + 1, base), (10 * i + 2, changed(base, n // 60, i)), (10 * i + 3, changed(base, n // 12, 100 + i))]
    far = [(a, b) for a, b in zip(rows[::3], rows[1::3], strict=True) if (simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() > 3]
    assert len(far) > 10
    # A group whose members are chained: each is a near copy of the one before only.
    chain = words(5000, 300)
    for i in range(12):
        rows.append((2000 + i, chain))
        chain = changed(chain, 4, 500 + i)
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one two"), (3004, "ONE  two"), (3005, "one three")]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows] + [(None, words(1000, 150), "en", "s")], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == brute_kept(rows)
    assert sum(r["doc_id"] is None for r in kept) == 1 and kept[0].asDict().keys() == set(docs.columns)


def test_near_copies_of_nothing(spark):
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_of_a_key_lose_no_link_and_multiply_none(spark):
    base = words(7, 200)
    rows = [(i, changed(base, 2, i)) for i in range(60)] + [(100 + i, words(900 + i, 40)) for i in range(5)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], SCHEMA)
    keys = near_copies._band_keys(docs)
    for key_rows in (4, 16, 2048):
        blocks = -(-60 // key_rows)
        assert sorted(r["doc_id"] for r in near_copies.keep_one(docs, key_rows).collect()) == brute_kept(rows)
        # Keys that all sixty share: each gives a forest of the blocks and one link for each pair of them at most.
        shared = near_copies.links(docs, keys, key_rows).distinct().count()
        assert shared <= near_copies.BANDS * (60 - 1 + blocks * (blocks - 1) // 2)
    sets = [near_copies.shingles(t) for _, t in rows[:60]]
    assert len(near_copies.across(sets, [i % 2 for i in range(60)])) == 1


def test_simhash_groups_are_candidates_and_held_against_the_texts(spark):
    rows = [(0, words(1, 900))]
    rows += [(1 + i, changed(rows[0][1], 1, i)) for i in range(40)]
    # Lines that are said again and again make up the fingerprint, but not the set of shingles.
    rows += [(100 + i, " ".join(words(2, 60).split()[:13] * 200) + " " + words(20 + i, 40)) for i in range(2)]
    bits = [simhash.fingerprint(t) for _, t in rows]
    assert (bits[-1] ^ bits[-2]).bit_count() <= 3 and len(brute_kept(rows)) == 3
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], SCHEMA)
    # No two texts share a key of bands here: what is found is found by fingerprints.
    keys = near_copies._band_keys(docs).withColumn("keys", F.array("node"))
    groups = collections.defaultdict(set)
    for r in simhash.near_duplicates(docs).collect():
        groups[r["component_id"]].add(r["doc_id"])
    want = sorted(sorted(g - {100, 101}) for g in groups.values() if len(g - {100, 101}) > 1)
    assert sum(map(len, want)) > 20
    for key_rows in (8, 2048):
        parts = collections.defaultdict(list)
        for r in simhash.components(near_copies.links(docs, keys, key_rows)).collect():
            parts[r["component"]].append(r["node"])
        assert sorted(sorted([c, *ns]) for c, ns in parts.items()) == want
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)


def test_sets_go_out_once_for_keys_with_the_same_texts(spark, monkeypatch):
    rows = []
    for i in range(12):
        base = words(3000 + i, 240)
        rows += [(10 * i, base), (10 * i + 1, changed(base, 4, i))]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], SCHEMA)
    compared, sent = near_copies._compared, []
    monkeypatch.setattr(near_copies, "_compared", lambda dealt: sent.append(dealt.count()) or compared(dealt))
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == brute_kept(rows) == list(range(0, 120, 10))
    assert sum(sent) == len(rows)
