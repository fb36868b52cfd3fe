"""Removal of repeated byte strings by prefix doubling on sampled suffixes.

A byte goes if some string of LENGTH bytes that covers it also starts anywhere else, in the same
document or another one. Texts are UTF-8 bytes; strings never cross documents.

1. Suffixes are sampled: in every string of LENGTH bytes the GRAM-byte gram with the smallest hash
   (the rightmost of equal ones) is its anchor. Equal strings have their anchor at the same place, so
   a string can only repeat where its anchor's gram repeats. About one position in 85 is an anchor.
2. Spark ranks the anchors by gram and drops the unique ones.
3. Each remaining anchor fetches its stretch: the bytes of all strings that it is the anchor of.
   Stretches meet, sorted by gram, and are resolved by prefix doubling: positions are ranked by their
   8 bytes, then by pairs of ranks at offsets 8, 16, 32, 64 and 72 until the rank stands for LENGTH
   bytes. Anchors whose whole stretch occurs twice need no further rounds, nor do grams left with a
   single stretch. No step trusts a hash: the gram's hash only decides who meets.
4. Repeated starts become intervals, merged for each text, and the kept bytes are hashed.

Equal texts are handled once (the digest of the text is the key); their bytes all go if there are
LENGTH of them. A gram with more than HOT_ROWS anchors is not gathered: its distinct strings are
exploded, shuffled and counted by content.

Edge cases: a null text counts as empty; texts under LENGTH bytes lose nothing. Very long texts are
read whole. Rows repeated with one doc_id are documents of their own, so they are copies of each
other. A null doc_id is kept. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import bounded_batches, materialize

#: Bytes of a repeated string; bytes of a gram.
LENGTH, GRAM = 200, 32
#: Anchors of one gram that are resolved together in a task.
HOT_ROWS = 50_000
#: Bytes of stretches that are resolved in one go.
BATCH_BYTES = 4_000_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash and position of each anchor, and the first and last start of its strings."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    size, power = 1, _BASE
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power & _MASK
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    # The complement of the position in the low half makes the smallest key the rightmost minimum.
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    keys = np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])
    at = (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return h[at[first]].astype(np.int64), at[first], first, last


def _ranks(pairs: np.ndarray) -> np.ndarray:
    """Dense ranks of values."""
    return np.unique(pairs, return_inverse=True)[1].astype(np.uint64)


def repeated_starts(stretches: list[bytes]) -> list[np.ndarray]:
    """For each of some distinct stretches, which of its strings start in more than one of them.

    Prefix doubling: ranks of 8 bytes, then of pairs of ranks at growing offsets.
    """
    sizes = np.array([len(s) for s in stretches])
    data = np.frombuffer(b"".join(stretches) + bytes(LENGTH), np.uint8).astype(np.uint64)
    eight = data
    for size in (1, 2, 4):
        eight = (eight[:-size] << np.uint64(8 * size)) | eight[size:]
    rank, size = _ranks(eight), 8
    while 2 * size <= LENGTH:
        rank = _ranks((rank[:-size] << np.uint64(32)) | rank[size:])
        size *= 2
    if size < LENGTH:
        rank = (rank[: len(rank) - (LENGTH - size)] << np.uint64(32)) | rank[LENGTH - size :]
    begins = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    starts = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    _, inverse, number = np.unique(rank[starts], return_inverse=True, return_counts=True)
    return np.split(number[inverse] > 1, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of the runs of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, data (bytes), sha (their digest), n_bytes and t and u, a key of 128 bits of the digest."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).withColumns(
        {"sha": F.unhex(F.sha2("data", 256)), "n_bytes": F.length("data").cast("long")}
    ).withColumns({"t": F.xxhash64("sha"), "u": F.xxhash64("sha", F.lit(1))})


def _find_anchors(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [anchors(bytes(data)) for data in b["data"]]
            n = [len(f[0]) for f in found]
            h, at, first, last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
            yield pd.DataFrame({
                "h": h, "t": np.repeat(b["t"].to_numpy(), n), "u": np.repeat(b["u"].to_numpy(), n),
                "at": at, "p1": first, "p2": last,
            })

    rows = keyed.filter(F.col("n_bytes") >= LENGTH).select("t", "u", "data")
    return rows.mapInPandas(run, "h long, t long, u long, at long, p1 long, p2 long")


def _stretches(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, t, u, p1, off (place of the anchor) and stretch of the wanted anchors of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, u, data, found in zip(b["t"], b["u"], b["data"], b["found"], strict=True):
                data = bytes(data)
                for a in found:
                    p1 = a["p1"]
                    out.append((a["h"], t, u, p1, a["at"] - p1, data[p1 : a["p2"] + LENGTH]))
            if out:
                yield pd.DataFrame(out, columns=["h", "t", "u", "p1", "off", "stretch"])

    w = wanted.withColumnsRenamed({"t": "wt", "u": "wu"})
    on = (F.col("t") == F.col("wt")) & (F.col("u") == F.col("wu")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    both = keyed.join(w, on).select("t", "u", "data", "found")
    return both.mapInPandas(run, "h long, t long, u long, p1 long, off long, stretch binary")


def _resolve(stretches: DataFrame) -> DataFrame:
    """t, u and intervals [lo, hi) of bytes to remove, from stretches that meet by gram."""

    def settle(groups: list[dict]) -> list[tuple[int, int, int, int]]:
        """groups: for each gram the texts and starts of each distinct stretch."""
        out, open_ = [], []
        for g in groups:
            several = len(g) > 1
            for (_, stretch), owners in g.items():
                if len(owners) > 1:
                    out += [(t, u, p, p + len(stretch)) for t, u, p in owners]
                if several:
                    open_.append((stretch, owners))
        if open_:
            for (_, owners), flags in zip(open_, repeated_starts([s for s, _ in open_]), strict=True):
                if len(owners) == 1:
                    ((t, u, p),) = owners
                    out += [(t, u, p + lo, p + hi + LENGTH) for lo, hi in _runs(flags)]
        return out

    def frame(rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["t", "u", "lo", "hi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, done, held = None, {}, [], 0
        for b in batches:
            for h, t, u, p1, off, stretch in zip(*(b[c] for c in ("h", "t", "u", "p1", "off", "stretch")), strict=True):
                if h != key:
                    if group:
                        done.append(group)
                    if held >= BATCH_BYTES:
                        yield frame(settle(done))
                        done, held = [], 0
                    key, group = h, {}
                stretch = bytes(stretch)
                owners = group.get((off, stretch))
                if owners is None:
                    group[(off, stretch)] = {(t, u, p1)}
                    held += len(stretch)
                else:
                    owners.add((t, u, p1))
        if group:
            done.append(group)
        yield frame(settle(done))

    dealt = stretches.repartition("h").sortWithinPartitions("h")
    return dealt.mapInPandas(run, "t long, u long, lo long, hi long")


def _resolve_hot(stretches: DataFrame) -> DataFrame:
    """The same for grams with too many anchors for one task: strings are counted by content."""
    # These tables pack so well that their file size says nothing of their size in memory: no broadcast.
    stretches = materialize(stretches.select("t", "u", "p1", "stretch").distinct(), "hot-stretches")
    distinct = stretches.groupBy("stretch").agg(F.count(F.lit(1)).alias("owners"))
    starts = F.sequence(F.lit(0), F.length("stretch") - LENGTH)
    strings = distinct.select("stretch", "owners", F.explode(starts).alias("s")).withColumn(
        "string", F.expr(f"substring(stretch, s + 1, {LENGTH})")
    )
    repeated = materialize(
        strings.groupBy("string").agg(F.sum("owners").alias("n")).filter("n > 1").select("string"), "hot-strings"
    )
    found = strings.select("stretch", "s", "string").join(repeated, "string", "left_semi").select("stretch", "s")
    return stretches.join(materialize(found, "hot-starts").hint("merge"), "stretch").select(
        "t", "u", (F.col("p1") + F.col("s")).alias("lo"), (F.col("p1") + F.col("s") + LENGTH).alias("hi")
    )


def _cut(keyed: DataFrame, covers: DataFrame) -> DataFrame:
    """t, u, n_removed, n_spans and kept_sha of the texts in covers (found: their intervals)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, u, data, found in zip(b["t"], b["u"], b["data"], b["found"], strict=True):
                data, at, removed, spans = bytes(data), 0, 0, 0
                digest = hashlib.sha256()
                end = -1
                for lo, hi in sorted((x["lo"], x["hi"]) for x in found):
                    if lo > end:
                        digest.update(data[at:lo])
                        spans += 1
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                    at = end
                digest.update(data[at:])
                out.append((t, u, removed, spans, digest.digest()))
            yield pd.DataFrame(out, columns=["t", "u", "n_removed", "n_spans", "kept_sha"])

    c = covers.withColumnsRenamed({"t": "ct", "u": "cu"})
    both = keyed.join(c, (F.col("t") == F.col("ct")) & (F.col("u") == F.col("cu")))
    rows = both.select("t", "u", "data", "found")
    return rows.mapInPandas(run, "t long, u long, n_removed long, n_spans long, kept_sha binary")


def remove_repeats(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row for each row of docs."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    heads = materialize(keyed.select("doc_id", "t", "u", "n_bytes", "sha"), "heads")
    texts = materialize(
        heads.groupBy("t", "u").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "texts"
    )
    found = materialize(_find_anchors(keyed), "anchors")
    counts = found.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for k, f in (("min", F.min), ("max", F.max)) for c in ("t", "at")]
    )
    grams = materialize(
        counts.filter("min_t <> max_t or min_at <> max_at").select("h", (F.col("n") > hot_rows).alias("hot")), "grams"
    )
    # Copies of one text give the same anchors: they are joined once, through the text's representative.
    wanted = (
        found.join(grams.select("h"), "h", "left_semi")
        .groupBy("t", "u", "at").agg(F.first("h").alias("h"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
        .groupBy("t", "u").agg(F.collect_list(F.struct("h", "at", "p1", "p2")).alias("found"))
        .join(texts.select("t", "u", "rep"), ["t", "u"])
    )
    stretches = _stretches(keyed, materialize(wanted, "wanted"))
    hot = materialize(grams.filter("hot").select("h"), "hot-grams")
    if hot.isEmpty():
        covers = _resolve(stretches)
    else:
        stretches = materialize(stretches, "stretches")
        covers = _resolve(stretches.join(hot, "h", "left_anti")).unionByName(
            _resolve_hot(stretches.join(hot, "h", "left_semi"))
        )
    covers = materialize(covers, "covers")
    single = texts.filter("copies = 1").select("t", "u")
    lists = covers.groupBy("t", "u").agg(F.collect_list(F.struct("lo", "hi")).alias("found")).join(
        single, ["t", "u"], "left_semi"
    )
    cut = materialize(_cut(keyed, materialize(lists, "cover-lists")), "cut")
    facts = materialize(
        texts.select("t", "u", "copies").join(cut, ["t", "u"], "left"), "facts"
    )
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return heads.join(facts, ["t", "u"]).select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha"))))
        .alias("kept_sha256"),
    )
