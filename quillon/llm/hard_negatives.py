"""Hard negatives for anchors by Strassen multiplication of integer tiles and mergeable heaps.

Vectors are scaled to integers and packed into tiles of some rows. Every tile of anchors meets every
tile of candidates (a stated set of queries against all rows, in blocks), and a task multiplies the
two by Strassen's recursion: seven products of halves with exact int64 additions, odd sides padded
with zeros. Small halves are multiplied directly, in float64 where a bound on all partial sums shows
that to be exact and in int64 otherwise.

Two passes are made over the candidates. The first keeps for each anchor a heap of its best rows of
the same label; these positives give each anchor windows of scores. The second keeps for each window
a heap of the best rows of other labels inside it. Heaps of a task cover all tiles that it has seen,
and those of different tasks are merged by rank, so no label, hot vector or anchor is ever gathered
in one task.

Anchor tiles are broadcast up to BROADCAST_BYTES, a size that is counted first. Beyond that, they are
dealt into parts, each part meets the candidates dealt over salts in a shuffled join, and the
candidates travel once for each part.

Edge cases: rows with a null id, label, vector or component, or a component that is not finite, take
no part. Vectors of different lengths are padded with zeros. Rows that repeat an id stand each for
itself, but a row never is a partner of an anchor with its own id; a repeated anchor gives its rows
again. Equal scores are ordered by id. An anchor without positives, or a positive without rows in
its window, gives no rows. Components so large that scores could pass 2**58 are an error. An empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import materialize

#: Rows of a tile of anchors and of a tile of candidates.
ANCHOR_ROWS = 512
CANDIDATE_ROWS = 2048
#: Side of a block from which on it is multiplied directly.
LEAF = 32
#: Bytes of anchor tiles that are broadcast.
BROADCAST_BYTES = 8_000_000
#: Tiles of anchors in a part, and salts of the candidates, where anchors are too large for that.
PART_TILES = 64
SALTS = 32
#: Anchor tiles whose heaps a task holds at once.
OPEN_TILES = 128
#: Score of an empty place in a heap, below any real one, and the id beside it.
NOTHING = np.iinfo(np.int64).min + 1
NOBODY = np.iinfo(np.int64).max

TILE = "tile long, ids binary, labels binary, width int, kind string, data binary"


def scaled(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label and v (components as floor(scale * x)) of the rows that take part."""
    usable = "vec_id is not null and label is not null and embedding is not null"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(usable).filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"),
    )


def tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """Rows (vec_id, label, v) packed where they are into tiles of at most tile_rows."""

    def packed(number: int, ids: list, labels: list, vectors: list) -> dict:
        width = max(map(len, vectors))
        block = np.zeros((len(vectors), width), np.int64)
        for at, v in enumerate(vectors):
            block[at, : len(v)] = v
        most = int(np.abs(block).max(initial=0)) if block.min(initial=0) > np.iinfo(np.int64).min else NOBODY
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
        long = lambda x: np.array(x, "<i8").tobytes()
        return {"tile": number, "ids": long(ids), "labels": long(labels), "width": width, "kind": kind, "data": block.astype(kind).tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, labels, vectors = TaskContext.get().partitionId() << 32, [], [], []
        for b in batches:
            for at in range(0, len(b), tile_rows):
                part = b.iloc[at : at + tile_rows]
                ids += part["vec_id"].tolist()
                labels += part["label"].tolist()
                vectors += part["v"].tolist()
                while len(ids) >= tile_rows:
                    yield pd.DataFrame([packed(number, ids[:tile_rows], labels[:tile_rows], vectors[:tile_rows])])
                    number += 1
                    del ids[:tile_rows], labels[:tile_rows], vectors[:tile_rows]
        if ids:
            yield pd.DataFrame([packed(number, ids, labels, vectors)])

    return rows.mapInPandas(run, TILE)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF, exact: bool = False) -> np.ndarray:
    """The product of two int64 matrices; exact says that float64 holds all partial sums of leaves."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if exact else a @ b
    if m % 2 or k % 2 or n % 2:
        wide = np.zeros((m + m % 2, k + k % 2), np.int64)
        tall = np.zeros((k + k % 2, n + n % 2), np.int64)
        wide[:m, :k], tall[:k, :n] = a, b
        return strassen(wide, tall, leaf, exact)[:m, :n]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf, exact)
    p2 = strassen(a21 + a22, b11, leaf, exact)
    p3 = strassen(a11, b12 - b22, leaf, exact)
    p4 = strassen(a22, b21 - b11, leaf, exact)
    p5 = strassen(a11 + a12, b22, leaf, exact)
    p6 = strassen(a21 - a11, b11 + b12, leaf, exact)
    p7 = strassen(a12 - a22, b21 + b22, leaf, exact)
    out = np.empty((m, n), np.int64)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def scores(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """All inner products of the rows of a with the rows of b."""
    k = max(a.shape[1], b.shape[1], 1)
    bound = k * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound >= 2**58:
        raise ValueError("components are too large for exact scores")
    a, b = (np.pad(x, ((0, 0), (0, k - x.shape[1]))) for x in (a, b))
    # Each level at most doubles the operands on either side, and the side k halves.
    levels = max(0, min(min(a.shape[0], k, b.shape[0]) // leaf, 2**16)).bit_length()
    return strassen(a, np.ascontiguousarray(b.T), leaf, bound * 4**levels < 2**53)


class Heaps:
    """The best k entries (score downwards, id upwards) of each of n queues."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NOTHING), np.full((n, k), NOBODY)

    def welcome(self, queues: np.ndarray | slice, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of a block of scores (queues x ids) would enter."""
        last, who = self.score[queues, -1][:, None], self.id[queues, -1][:, None]
        return (score > last) | ((score == last) & (ids[None, :] < who))

    def offer(self, queue: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(queue):
            return
        own, k = np.unique(queue), self.score.shape[1]
        queue = np.append(np.repeat(own, k), queue)
        score, ids = np.append(self.score[own].ravel(), score), np.append(self.id[own].ravel(), ids)
        order = np.lexsort((ids, -score, queue))
        queue = queue[order]
        rank = np.arange(len(queue)) - np.searchsorted(queue, queue)
        best = order[rank < k]
        self.score[own], self.id[own] = score[best].reshape(-1, k), ids[best].reshape(-1, k)


def _blocks(n: int) -> Iterator[slice]:
    """Columns in growing blocks: heaps are filled by a few before they meet the many."""
    at, size = 0, 64
    while at < n:
        yield slice(at, at + size)
        at, size = at + size, size * 4


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _block(kind: str, width: int, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, width)


def _meet(anchors: DataFrame, candidates: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Every tile of anchors beside every tile of candidates (columns c_*)."""
    count, size = anchors.agg(F.count(F.lit(1)), F.sum(F.octet_length("data"))).first()
    whole = (size or 0) <= broadcast_bytes
    parts = 1 if whole else -(-count // PART_TILES)
    mine = anchors.withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int"))
    theirs = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    if whole:
        return theirs.join(F.broadcast(mine), "part")
    mine = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    theirs = theirs.withColumn("salt", F.pmod(F.xxhash64("c_tile"), F.lit(SALTS)).cast("int"))
    return theirs.join(mine.hint("merge"), ["part", "salt"])


HEAP = "tile long, pos int, slot int, anchor_id long, score long, partner long"


def _heaps(met: DataFrame, slots: int, k: int, leaf: int, windowed: bool) -> DataFrame:
    """Heap entries of every task: of the anchors' own label, or of other labels inside their windows."""

    def opened(row) -> dict:
        ids = _longs(row.ids)
        bounds = np.frombuffer(row.bounds, "<i8").reshape(len(ids), slots, 2) if windowed else None
        return {
            "ids": ids, "labels": _longs(row.labels), "block": _block(row.kind, row.width, row.data, len(ids)),
            "bounds": bounds, "heaps": Heaps(len(ids) * slots, k),
        }

    def entries(number: int, state: dict) -> pd.DataFrame:
        heaps, n = state["heaps"], len(state["ids"])
        queue, place = np.nonzero(heaps.score != NOTHING)
        pos, slot = queue // slots, queue % slots
        assert n or not len(pos)
        return pd.DataFrame({
            "tile": np.int64(number), "pos": pos.astype(np.int32), "slot": slot.astype(np.int32), "anchor_id": state["ids"][pos],
            "score": heaps.score[queue, place], "partner": heaps.id[queue, place],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_tiles: dict[int, dict] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                if row.tile not in open_tiles:
                    if len(open_tiles) >= OPEN_TILES:
                        number = next(iter(open_tiles))
                        yield entries(number, open_tiles.pop(number))
                    open_tiles[row.tile] = opened(row)
                state = open_tiles[row.tile]
                ids, labels = _longs(row.c_ids), _longs(row.c_labels)
                product = scores(state["block"], _block(row.c_kind, row.c_width, row.c_data, len(ids)), leaf)
                same = state["labels"][:, None] == labels[None, :]
                heaps, other = state["heaps"], state["ids"][:, None] != ids[None, :]
                for cols in _blocks(len(ids)):
                    got = product[:, cols]
                    for slot in range(slots):
                        fits = other[:, cols] & (~same[:, cols] if windowed else same[:, cols])
                        if windowed:
                            fits &= (got >= state["bounds"][:, slot, :1]) & (got <= state["bounds"][:, slot, 1:])
                        fits &= heaps.welcome(slice(slot, None, slots), got, ids[cols])
                        at, col = np.nonzero(fits)
                        heaps.offer(at * slots + slot, got[at, col], ids[cols][col])
        for number, state in open_tiles.items():
            yield entries(number, state)

    return met.mapInPandas(run, HEAP)


def _merged(entries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k entries of each key out of the heaps of all tasks, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "partner")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _with_bounds(anchors: DataFrame, positives: DataFrame, slots: int, low: int, high: int) -> DataFrame:
    """Anchor tiles with the bounds of their windows: low and high percent of each positive's score."""
    lists = positives.groupBy("tile").agg(F.collect_list(F.struct("pos", "slot", "score")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ids, found in zip(b["ids"], b["found"], strict=True):
                bounds = np.full((len(ids) // 8, slots, 2), NOTHING)
                bounds[:, :, 0] = NOBODY
                for one in found:
                    score = int(one["score"])
                    bounds[one["pos"], one["slot"]] = -(-low * score // 100), high * score // 100
                out.append(bounds.astype("<i8").tobytes())
            yield b.drop(columns="found").assign(bounds=out)

    return anchors.join(lists, "tile").mapInPandas(run, f"{TILE}, bounds binary")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    leaf: int = LEAF,
    broadcast_bytes: int = BROADCAST_BYTES,
    anchor_rows: int = ANCHOR_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    rows has vec_id, label and v (integers). Each anchor's positives are its best other rows of the same
    label; each positive's negatives are the anchor's best rows of another label with a score from low to
    high percent of the positive's.
    """
    few = rows.filter(is_anchor)
    count = few.count()
    anchors = materialize(tiles(few.repartition(max(1, -(-count // anchor_rows)), "vec_id"), anchor_rows), "anchors")
    candidates = tiles(rows, candidate_rows)
    found = _heaps(_meet(anchors, candidates, broadcast_bytes), 1, positives, leaf, windowed=False)
    best = _merged(found, ["tile", "pos"], positives).withColumn("slot", F.col("rank") - 1)
    best = materialize(best.select("tile", "pos", "slot", "anchor_id", F.col("partner").alias("positive_id"), "score"), "positives")
    windows = materialize(_with_bounds(anchors, best, positives, low, high), "windows")
    inside = _heaps(_meet(windows, candidates, broadcast_bytes), positives, negatives, leaf, windowed=True)
    worst = _merged(inside, ["tile", "pos", "slot"], negatives).select("tile", "pos", "slot", "rank", F.col("partner").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.withColumnRenamed("score", "positive_score")
    return worst.join(named, ["tile", "pos", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
