"""Near copies by SimHash and shingle similarity: links from the real Jaccard value.

Two texts are near copies when their sets of SHINGLE_WORDS-word shingles have a Jaccard similarity of
at least SIMILARITY. Candidates are the groups of ``simhash.near_duplicates`` (fingerprints that links of
at most three bits connect) and, for near copies further apart, MinHash bands: each distinct text gets
BANDS keys of BAND_ROWS minima each, and texts that share a key are candidates. A pair at similarity 0.8
shares no key with a probability of (1 - 0.8**5)**24, about seven in a hundred thousand. No link is taken
from fingerprints or keys alone.

1. Distinct texts get their fingerprint and keys; the operator groups the fingerprints.
2. The texts of a group are read once more: their shingle sets are dealt out by group, and the task of a
   group compares the sets by an inverted index. It emits the links of a spanning forest, so n texts give
   at most n - 1 rows, and no pairs are listed. A group with more than KEY_ROWS texts or KEY_BYTES of
   shingles is cut into chunks, each with the text that names the group. What chunks leave apart, and
   texts of one group that are not alike, is left to the keys.
3. Keys whose texts the links have connected already are done with, and of keys with the same texts only one
   is compared. The texts under these keys are dealt out by key and compared in the same manner. A key with more than KEY_ROWS texts or KEY_BYTES
   of shingles is cut into b blocks; its sets go to every pair of blocks, b times each, so that no task
   holds more than two blocks and no pair is left out. A block by itself gives the links of its forest,
   and two blocks only links between parts that their own forests leave apart: where all texts are near
   copies these are n - b and b (b - 1) / 2 rows.
4. Components come from repeated large-star and small-star steps, as in ``simhash``.

Edge cases: a null text counts as empty; texts without words are near copies of each other; with fewer
than five words the whole sequence is the one shingle. Letters are lowered in ASCII only, as in
``simhash``. Equal texts are one node, so copies in any number cost nothing after the first step. Rows
without a doc_id stay. Rows repeated with one doc_id stay together. An empty table gives an empty
result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.session import bounded_batches, given_back, materialize, unused

#: Words in a shingle, and the least Jaccard similarity of near copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Keys of a text, and minima in a key.
BANDS, BAND_ROWS = 24, 5
#: Seed of XXH64 and of the multipliers.
SEED = 42
#: Texts of one key, or of one block of it, that a task compares, and bytes of their shingles.
KEY_ROWS, KEY_BYTES = 2048, 128_000_000
#: Texts of an Arrow batch; the stages after it in the pipeline keep to it as well.
TEXT_ROWS = 500
#: Candidates up to which their ids are broadcast; with more the join is shuffled.
BROADCAST_ROWS = 500_000

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(k, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    stops = (ends - 1)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def band_keys(own: np.ndarray) -> np.ndarray:
    """The BANDS keys of a shingle set."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        np.minimum(least, (own[at : at + 2048, None] * _FACTORS).min(0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).astype(np.int64)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of sets under the relation of a similarity of SIMILARITY or more."""
    n = len(sets)
    if n == 2:
        return [(0, 1)] if similarity(*sets) >= SIMILARITY else []
    sizes = np.array([len(s) for s in sets])
    empty = np.flatnonzero(sizes == 0).tolist()
    links = [(empty[0], j) for j in empty[1:]]
    # Inverted index: who holds a shingle lies in holders[begins[c] : begins[c + 1]].
    codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    holders = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    begins = np.concatenate(([0], np.cumsum(counts)))
    own = np.split(codes, np.cumsum(sizes)[:-1])
    waiting = sizes > 0
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front and waiting.any():
            x = front.pop()
            spans = [holders[begins[c] : begins[c + 1]] for c in own[x].tolist()]
            common = np.bincount(np.concatenate(spans), minlength=n)
            near = np.flatnonzero(waiting & (common >= SIMILARITY * (sizes[x] + sizes - common)))
            waiting[near] = False
            links += [(x, y) for y in near.tolist()]
            front += near.tolist()
    return links


def across(sets: list[np.ndarray], block: list[int]) -> list[tuple[int, int]]:
    """Links that, together with those of each block's own forest, connect what is alike in both blocks."""
    label = list(range(len(sets)))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for one in set(block):
        own = [i for i, b in enumerate(block) if b == one]
        for i, j in forest([sets[i] for i in own]) if len(own) > 1 else []:
            label[root(own[i])] = root(own[j])
    kept = []
    for i, j in forest(sets):
        if root(i) != root(j):
            label[root(i)] = root(j)
            kept.append((i, j))
    return kept


def _digest() -> Column:
    """What names a distinct text."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _band_keys(docs: DataFrame) -> DataFrame:
    """node (the smallest doc_id of a distinct text), its digest, keys, fingerprint and number of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [shingles(x) for x in b["text"]]
            fps = np.array([simhash.fingerprint(x) for x in b["text"]], np.uint64).astype(np.int64)
            yield b[["doc_id", "digest"]].assign(keys=[band_keys(x) for x in own], size=[len(x) for x in own], fp=fps)

    bounded_batches(docs.sparkSession, TEXT_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), "text").filter("doc_id is not null")
    found = rows.mapInPandas(given_back(run), "doc_id long, digest binary, keys array<long>, size long, fp long")
    return found.groupBy("digest").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("keys", "size", "fp")))


def _compared(dealt: DataFrame) -> DataFrame:
    """Links (a, b) of nodes, verified under each key; dealt: node, key, block pair (x, y), own block (mine) and own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, nodes, sets, block = None, [], [], []

        def done() -> pd.DataFrame:
            found = [] if len(sets) < 2 else forest(sets) if at[1] == at[2] else across(sets, block)
            return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, dtype="int64")

        for b in batches:
            for key, x, y, mine, node, own in zip(*(b[c] for c in ("key", "x", "y", "mine", "node", "own")), strict=True):
                if at != (key, x, y):
                    yield done()
                    at, nodes, sets, block = (key, x, y), [], [], []
                block.append(mine)
                nodes.append(node)
                sets.append(np.frombuffer(own, "<u8"))
        yield done()

    placed = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return placed.mapInPandas(given_back(run), "a long, b long")


def _verified(docs: DataFrame, keys: DataFrame, met: DataFrame, places: str, label: str) -> DataFrame:
    """Verified links (a, b) of the nodes under each key.

    met: node, key, blocks (of the key); places: SQL for the pairs of blocks (x, y) that get the node's set,
    by node, key, blocks and mine (the node's own block).
    """
    wanted = materialize(met.groupBy("node").agg(F.collect_list(F.struct("key", "blocks")).alias("met")), "near-nodes")
    wanted = wanted.join(keys.select("node", "digest").hint("merge"), "node")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # One row of a text is enough: copies and rows of other texts under one id do not match.
    text = docs.select(F.col("doc_id").cast("long").alias("node"), _digest().alias("digest"), "text")
    rows = text.join(wanted, ["node", "digest"]).select("node", "met", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["node", "met"]].assign(own=[shingles(x).astype("<u8").tobytes() for x in b["text"]])

    sets = rows.mapInPandas(given_back(cut), "node long, met array<struct<key:long,blocks:int>>, own binary")
    dealt = sets.select("node", "own", F.explode("met").alias("m")).select("node", "own", "m.*")
    mine = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("at", F.explode(F.expr(places)))
    return materialize(_compared(dealt.select("node", "key", "at.x", "at.y", "mine", "own")), label)


def _blocks(key_rows: int) -> Column:
    """The number of blocks of a key with n texts and so many bytes of shingles."""
    return F.ceil(F.greatest(F.col("n") / key_rows, F.col("bytes") / KEY_BYTES, F.lit(1))).cast("int").alias("blocks")


def _totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), (8 * F.sum("size")).alias("bytes")]


def simhash_links(docs: DataFrame, keys: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Verified links (a, b) of nodes whose fingerprints are in one group; keys as for ``links``."""
    found = simhash.near_duplicates(keys.select(F.col("node").alias("doc_id"), "fp"), prints=lambda rows: rows)
    groups = found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("key")).distinct()
    groups = materialize(groups.join(keys.groupBy("node").agg(F.sum("size").alias("size")).hint("merge"), "node"), "simhash-groups")
    large = groups.groupBy("key").agg(*_totals()).filter("n > 1").select("key", _blocks(key_rows))
    met = groups.join(large.hint("merge"), "key").select("node", "key", "blocks")
    # The text that names the group goes to all its chunks, any other one to its own.
    places = "transform(if(node = key, sequence(0, blocks - 1), array(mine)), i -> named_struct('x', i, 'y', i))"
    return _verified(docs, keys, met, places, "simhash-links")


def links(docs: DataFrame, keys: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Verified links (a, b) of nodes; keys: node, digest, keys, size and fp of the distinct texts of docs."""
    first = simhash_links(docs, keys, key_rows)
    joined = materialize(simhash.components(first), "simhash-joined")
    each = keys.select("node", "size", F.explode("keys").alias("key"))
    shared = each.groupBy("key").count().filter("count > 1").select("key")
    met = each.join(materialize(shared, "shared-keys").hint("merge"), "key")
    met = materialize(met.join(joined.hint("merge"), "node", "left").select("node", "size", "key", F.coalesce("component", "node").alias("part")), "met")
    # Keys that still meet what is apart; of those with the same nodes (number, ends and hash) one is enough.
    nodes = [F.min("node").alias("head"), F.max("node").alias("tail"), F.bit_xor(F.xxhash64("node")).alias("hash")]
    apart = met.groupBy("key").agg(*_totals(), *nodes, F.min("part").alias("least"), F.max("part").alias("most")).filter("least <> most")
    once = apart.groupBy("n", "head", "tail", "hash").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes"))
    met = met.join(once.select("key", _blocks(key_rows)).hint("merge"), "key").select("node", "key", "blocks")
    places = "transform(sequence(0, blocks - 1), i -> named_struct('x', least(mine, i), 'y', greatest(mine, i)))"
    return first.unionByName(_verified(docs, keys, met, places, "near-links"))


def near_copies(docs: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """digest of each distinct text with a doc_id, its node and component_id (the smallest node that links reach)."""
    keys = materialize(_band_keys(docs), "band-keys")
    comps = simhash.components(links(docs, keys, key_rows)).withColumnRenamed("node", "linked")
    named = keys.join(comps, F.col("node") == F.col("linked"), "left")
    return materialize(named.select("digest", "node", F.coalesce("component", "node").alias("component_id")), "near-components")


def keep_one(docs: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """The documents that name their component of near copies (the smallest doc_id), with all columns.

    Rows without a doc_id stay: nothing tells which of them to keep.
    """
    kept = near_copies(docs, key_rows).filter("component_id = node").select(F.col("node").alias(unused(docs, "kept"))).distinct()
    found = docs.join(materialize(kept, "kept"), F.col("doc_id").cast("long") == F.col(kept.columns[0]), "left_semi")
    return found.unionByName(docs.filter("doc_id is null"))
