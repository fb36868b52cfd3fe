"""Exact dense-vector search over unit vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of one block: a task multiplies two matrices of so many rows.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 50_000


def inner_product(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed as doubles."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def top_k(vectors: DataFrame, query: list[float], k: int, threshold: float | None = None, keep: Column | None = None) -> DataFrame:
    """The k nearest vectors: filters come before the cut, so none is lost to them."""
    rows = vectors if keep is None else vectors.filter(keep)
    scored = rows.withColumn("score", inner_product(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    if threshold is not None:
        scored = scored.filter(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, same: str) -> DataFrame:
    """For each query vector its k nearest others within its group, the column same."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col(same).alias("g"))
    on = (F.col("vec_id") != F.col("query_id")) & (F.col(same) == F.col("g"))
    return _nearest(vectors.join(q, on).withColumn("score", inner_product(F.col("embedding"), F.col("q"))), k)


def nearest_in_blocks(queries: DataFrame, vectors: DataFrame, k: int, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """For each of a stated set of query vectors its k nearest others among all vectors: query_id, vec_id, score and rank.

    Both sides are dealt into blocks; each pair of blocks is one product of matrices in one task, which
    hands on k rows of a query. Equal scores go to the smaller vec_id.
    """
    nq, nv = (max(1, -(-df.count() // size)) for df, size in ((queries, query_block), (vectors, vector_block)))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("vec_id", "embedding", deal(nq, 1).alias("i"), every(nv).alias("j"))
    v = vectors.select("vec_id", "embedding", every(nq).alias("i"), deal(nv, 2).alias("j"))

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        ids = v["vec_id"].to_numpy()
        scores = np.stack(q["embedding"]).astype(np.float64) @ np.stack(v["embedding"]).astype(np.float64).T if len(q) and len(v) else np.zeros((0, 0))
        out = []
        for key, row in zip(q["vec_id"].tolist(), scores, strict=False):
            row = np.where(ids == key, -np.inf, row)
            edge = np.partition(-row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
            at = np.flatnonzero(-row <= edge)  # ties at the edge stay
            at = at[np.lexsort((ids[at], -row[at]))][:k]
            out += [(key, int(ids[i]), float(row[i])) for i in at if row[i] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    pairs = q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInPandas(best, "query_id long, vec_id long, score double")
    return _nearest(pairs, k)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")
