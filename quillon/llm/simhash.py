"""SimHash near-duplicates, linked through deletion-variant signatures.

Fingerprints of 64 bits link when at most three bits differ. Cut into two segments of 32 bits, one
of the segments then differs by at most one bit. So each distinct fingerprint is indexed under 64
keys: either segment with one of its 32 bits deleted (a wildcard at that place). Two fingerprints
that link share at least one key; rows are dealt out by key, and those under a key are verified by
counting differing bits.

No pairs are listed. Under a key only the links of a spanning forest are emitted, so a group of n
fingerprints gives at most n - 1 rows. A key with more than BUCKET_ROWS fingerprints is indexed once
more in the same manner: the other segment differs by at most three bits, so one of its halves
differs by at most one; with one bit of that half deleted, a key leaves 18 bits open, which bounds
any group to 2**18 fingerprints. Components come from repeated large-star and small-star steps.

Edge cases: a null text counts as empty; texts without words have the fingerprint zero and are
linked like any others; with fewer than three words the whole sequence is the one shingle. Equal
fingerprints are one node, so copies in any number cost nothing after the first step. Rows repeated
with one doc_id stay separate rows, each in the component of its fingerprint. A null doc_id never
names a component unless nothing else does, but its fingerprint links like any other. An empty table
gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import bounded_batches, materialize, unused

#: Seed of XXH64.
SEED = 42
#: Words in a shingle.
SHINGLE_WORDS = 3
#: Most differing bits of a link.
MAX_BITS = 3
#: Fingerprints under one key that are compared directly; larger keys are indexed once more.
BUCKET_ROWS = 8192


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: a bit is set where it is set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(SHINGLE_WORDS, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    stops = (ends - 1)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), a row for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _deleted(segment: str, bits: int, tag: int) -> str:
    """SQL for the keys of one segment: each bit deleted in turn, the place of the bit kept in the key.

    A key holds the tag of the segment, the place of the deleted bit and the segment without it.
    """
    return (
        f"transform(sequence(0, {bits - 1}), i -> shiftleft(cast({tag * bits} + i as bigint), 40)"
        f" | ({segment} & ~shiftleft(1L, i)))"
    )


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints under the relation of at most MAX_BITS."""
    n, links = len(fps), []
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= MAX_BITS else []
    label = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= MAX_BITS) + i + 1
        if len(near) == 0:
            continue
        found, at = np.unique(label[near], return_index=True)
        for other, j in zip(found.tolist(), near[at].tolist(), strict=True):
            if other != label[i]:
                label[label == other] = label[i]
                links.append((i, j))
        if len(links) == n - 1:
            break
    return links


def _runs(batches: Iterator[pd.DataFrame], most: int | None) -> Iterator[tuple[int, np.ndarray | None]]:
    """Keys with two or more fingerprints, from rows sorted by key; None in place of more than most."""
    key, held, size = None, [], 0

    def done() -> Iterator[tuple[int, np.ndarray | None]]:
        if size > 1:
            yield key, (np.concatenate(held) if most is None or size <= most else None)

    for b in batches:
        keys, fps = b["key"].to_numpy(), b["fp"].to_numpy().astype(np.int64).view(np.uint64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        edges = [0, *cuts.tolist(), len(keys)] if len(keys) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if key is None or keys[lo] != key:
                yield from done()
                key, held, size = keys[lo], [], 0
            size += hi - lo
            if most is None or size <= most:
                held.append(fps[lo:hi])
            else:
                held = []
    yield from done()


def _links(indexed: DataFrame, most: int | None) -> DataFrame:
    """Verified links (a, b) of the rows under each key; a null a names an oversized key in b."""

    def frame(rows: list[tuple[int | None, int]]) -> pd.DataFrame:
        # Made column by column: integers beside nulls must not pass through floats.
        return pd.DataFrame({c: pd.array([r[i] for r in rows], "Int64") for i, c in enumerate("ab")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int | None, int]] = []
        for key, fps in _runs(batches, most):
            if fps is None:
                out.append((None, int(key)))
            else:
                own = np.unique(fps)
                signed = own.astype(np.int64)
                out += [(int(signed[i]), int(signed[j])) for i, j in _forest(own)]
            if len(out) >= 50_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    dealt = indexed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "a long, b long")


def links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links between distinct fingerprints (column fp) that connect whatever links directly."""
    low, high = "(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"
    indexed = distinct.select(
        "fp", F.explode(F.expr(f"concat({_deleted(low, 32, 0)}, {_deleted(high, 32, 1)})")).alias("key")
    )
    first = materialize(_links(indexed, bucket_rows), "links")
    large = first.filter("a is null").select(F.col("b").alias("key"))
    if large.isEmpty():
        return first
    # The segment that the key leaves whole differs by at most three bits: it is cut and indexed in turn.
    other = f"case when shiftright(key, 40) < 32 then {high} else {low} end"
    refined = (
        indexed.join(large, "key")
        .withColumn("other", F.expr(other))
        .select(
            "fp",
            "key",
            F.explode(
                F.expr(f"concat({_deleted('(other & 65535L)', 16, 0)}, {_deleted('shiftright(other, 16)', 16, 1)})")
            ).alias("part"),
        )
        .select("fp", F.xxhash64("key", "part").alias("key"))
    )
    return first.filter("a is not null").unionByName(_links(refined, None))


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) for the nodes of edges (a, b)."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while True:
        # Large star: every greater neighbour of a node is tied to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), "large-star")
        # Small star: the smaller neighbours of a node, and the node, are tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges = materialize(small.unionByName(own).filter("a <> b").distinct(), "small-star")
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def near_duplicates(
    docs: DataFrame, bucket_rows: int = BUCKET_ROWS, prints: Callable[[DataFrame], DataFrame] = fingerprints
) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach), a row for each row of docs."""
    prints = materialize(prints(docs), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    # Fingerprints are the nodes, so that those whose rows have no doc_id still carry links.
    found = components(links(classes.select("fp"), bucket_rows).filter("a is not null"))
    grouped = classes.join(found.hint("merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    grouped = materialize(grouped, "groups")
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = materialize(grouped.join(least.hint("merge"), "component").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that name their component (one for each), with all their columns.

    Rows without a doc_id stay: nothing tells which of them to keep.
    """
    ids = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(unused(docs, "kept"))).distinct()
    kept = docs.join(materialize(ids, "kept"), F.col("doc_id").cast("long") == F.col(ids.columns[0]), "left_semi")
    return kept.unionByName(docs.filter("doc_id is null"))
