"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; in each window of consecutive k-grams the smallest
hash is selected, the rightmost of equal ones; neighbouring windows that select the same k-gram
record it once, with its position. Two texts that share a passage of WINDOW + GRAM - 1 code points
share a selected k-gram, and no shared passage shorter than GRAM is reported.

The next document of each document (by ascending doc_id, the first after the last) is found without
a global window: documents are dealt into ranges of doc_id, sorted within them, and the first
document of each range is sent to the range before as well.

Edge cases: a null text counts as empty. A text shorter than GRAM is one gram as a whole; an empty
text has an empty fingerprint. Likeness is the number of shared distinct hashes over the number of
all; two empty fingerprints are alike (1), an empty and a full one are not (0). Rows repeated with
one doc_id follow each other in order of text; a null doc_id sorts first. A single document follows
itself. An empty table gives an empty result. Other columns are never looked at. Very long texts are
hashed whole (positions up to 2**32).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import bounded_batches, materialize

#: Code points in a gram, and grams in a window.
GRAM, WINDOW = 5, 8
#: Multiplier of the rolling hash.
BASE = 0x9E3779B97F4A7C15
#: Documents of one range, about.
RANGE_ROWS = 1000
#: Relative error of the range bounds.
RANGE_ERROR = 0.0005
#: Ranges whose bounds are quantiles, held on the driver; where more are needed each is cut evenly.
LEVEL_RANGES = 4096
#: Ranges up to which their first ids are broadcast; with more the join is shuffled.
BROADCAST_RANGES = 500_000
#: Characters of fingerprints after which rows are handed on.
FLUSH_CHARS = 16_000_000

_MASK = (1 << 64) - 1


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams; a polynomial doubled up to k, then mixed."""
    done, length, power = None, 0, BASE
    block, size = points.astype(np.uint64) + np.uint64(1), 1
    rest = k
    while rest:
        if rest & 1:
            if done is None:
                done, length = block, size
            else:
                n = len(points) - length - size + 1
                done, length = done[:n] * np.uint64(power) + block[length : length + n], length + size
        rest >>= 1
        if rest:
            block = block[:-size] * np.uint64(power) + block[size:]
            size, power = 2 * size, power * power & _MASK
    done = done ^ (done >> np.uint64(31))
    done = done * np.uint64(0xBF58476D1CE4E5B9)
    return (done >> np.uint64(32)).astype(np.uint64)


def winnow(text: str | None, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and their positions."""
    points = _points(text or "")
    if len(points) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    hashes = gram_hashes(points, min(k, len(points)))
    n = len(hashes)
    # The complement of the position in the low half makes the smallest value the rightmost minimum.
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width = min(window, n)
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if size < width:
        keys = np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])
    chosen = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """hash@position of every selected gram, the hash in hex."""
    return " ".join([f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes."""
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    n = len(text)
    return text[: n - n // 4] + following[: n // 4]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hashes and positions of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [winnow(x) for x in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "hashes": [h.astype(np.int64) for h, _ in found],
                "positions": [p.astype(np.int64) for _, p in found],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, hashes array<long>, positions array<long>"
    )


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """bucket, doc_id, text and ahead, dealt by range and sorted: a row is followed by its next document.

    Rows with ahead set are only there to be read by the row before them.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, n // range_rows)
    coarse = min(LEVEL_RANGES, ranges)
    fine = -(-ranges // coarse)
    cuts = []
    if coarse > 1:
        cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], RANGE_ERROR)})
    span = _count_at_most(F.col("doc_id"), cuts)
    part = F.lit(0)
    if fine > 1:
        bounds = F.array(*[F.lit(x) for x in (low, *cuts, high + 1)])
        start, stop = F.get(bounds, F.col("span")), F.get(bounds, F.col("span") + 1)
        share = (F.col("doc_id") - start) / F.greatest(stop - start, F.lit(1))
        part = F.least(F.greatest(F.coalesce(F.floor(share * fine), F.lit(0)), F.lit(0)), F.lit(fine - 1))
    placed = rows.withColumn("span", span).withColumn("bucket", F.col("span").cast("long") * fine + part)
    nulls = F.max(F.col("doc_id").isNull()).alias("nulls")
    firsts = materialize(placed.groupBy("bucket", "span").agg(F.min("doc_id").alias("first"), nulls), "range-heads")
    # The first document of a range is also sent to the range before, that of the first to the last.
    ends = firsts.groupBy("span").agg(F.max("bucket")).orderBy("span").collect()  # LEVEL_RANGES rows at most
    spark = docs.sparkSession
    turns = [(r[0], ends[i - 1][1]) for i, r in enumerate(ends)]
    turns = F.broadcast(spark.createDataFrame(turns, "span int, wrapped long"))
    before = F.lag("bucket").over(Window.partitionBy("span").orderBy("bucket"))
    heads = firsts.withColumn("before", before).join(turns, "span").select(
        F.when(~F.col("nulls"), F.col("first")).alias("first"), F.coalesce("before", "wrapped").alias("to")
    )
    heads = F.broadcast(heads) if ranges <= BROADCAST_RANGES else heads.hint("merge")
    ahead = (
        rows.join(heads, F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("to").alias("bucket"), "doc_id").agg(F.min("text").alias("text")).withColumn("ahead", F.lit(True))
    )
    everything = placed.select("bucket", "doc_id", "text", F.lit(False).alias("ahead")).unionByName(ahead)
    return everything.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.asc_nulls_first("doc_id"), "text")


def _count_at_most(column: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most the value: a binary decision tree of comparisons."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def compare(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to it and to the next document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def made(row, following):
            _, key, text, print_ = row
            changed = edited(text, following[2])
            other = winnow(changed)
            return (
                key,
                len(text),
                hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                as_text(*print_),
                as_text(*other),
                likeness(print_[0], other[0]),
                likeness(print_[0], following[3][0]),
            )

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        def frame(rows):
            ids = pd.array([r[0] for r in rows], "Int64")
            return pd.DataFrame([r[1:] for r in rows], columns=names[1:]).assign(doc_id=ids)[names]

        for b in batches:
            out, size = [], 0
            for bucket, key, text, ahead in zip(b["bucket"], b["doc_id"], b["text"], b["ahead"], strict=True):
                if held is None and ahead:
                    continue
                row = (bucket, None if pd.isna(key) else int(key), text, winnow(text))
                if held is not None:
                    out.append(made(held, row))
                    size += len(out[-1][3]) + len(out[-1][4])
                    if size > FLUSH_CHARS:
                        yield frame(out)
                        out, size = [], 0
                held = None if ahead else row
            if out:
                yield frame(out)

    return with_next(docs, range_rows).mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
