"""Lexical search: substring hits, postings, BM25, boolean term queries, facets and containment joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.session import bounded_batches, materialize

K1, B = 1.2, 0.75
#: A-Z in lower case, as ascii_fold() does it.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def equality_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters that are set; book_key wins over scope_subject."""
    if wanted.get("book_key") is not None:
        wanted = {k: v for k, v in wanted.items() if k != "scope_subject"}
    if "scope_subject" in wanted:
        wanted["subject"] = wanted.pop("scope_subject")
    conditions = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def textbook_rows(source: Column) -> Column:
    """Rows of the textbook corpus: its own source, or none."""
    return (source == "mineru") | source.isNull()


def not_exam(source: Column) -> Column:
    """Rows that are not exam questions; null sources fall away as in SQL."""
    return source != "gaokao"


def substring_search(docs: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Rows whose text holds the term, A-Z in either case: hits as written, snippet; best first."""
    out = docs.filter(tx.has_term(F.col("text"), term)).select(
        "id", "subject", "book_key",
        tx.occurrences(F.col("text"), term).alias("hits"),
        tx.window_snippet(F.col("text"), term).alias("snippet"),
    ).orderBy(F.desc("hits"), "id")
    return out if limit is None else out.limit(limit)


def postings(docs: DataFrame) -> DataFrame:
    """term, id and tf of every word of every text."""
    return docs.select("id", F.explode(tx.words(F.col("text"))).alias("term")).groupBy("term", "id").agg(
        F.count(F.lit(1)).alias("tf")
    )


def phrase_digests(docs: DataFrame, longest: int) -> DataFrame:
    """id, n and digest of rows with words: how many different phrases of 1 to longest words a text has, and the MD5 of them in order, joined by |.

    Phrases are not sorted: their order is that of their words (a blank comes before all letters), so the
    places of a text are sorted by the ranks of the words that follow, and each place gives the phrases
    that it does not share with the place before it.
    """

    def digests(text: str) -> tuple[int, str]:
        words = text.split(" ")
        rank = {w: i for i, w in enumerate(sorted(set(words)))}
        ranks = np.fromiter(map(rank.__getitem__, words), np.int64, len(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        padded = np.append(ranks, np.full(longest, -1))  # a phrase at the end of the text comes before longer ones
        following = [padded[i : i + len(words)] for i in range(longest)]
        order = np.lexsort(following[::-1])
        same = np.ones(len(words) - 1, bool)
        shared = np.zeros(len(words), np.int64)
        for f in following:
            same &= f[order[1:]] == f[order[:-1]]
            shared[1:] += same
        size = np.minimum(longest, len(words) - order)
        new = np.maximum(0, size - shared)
        at = np.repeat(order, new)
        last = at + np.repeat(shared, new) + np.arange(len(at)) - np.repeat(np.cumsum(new) - new, new)
        found = [text[a:b] for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)]
        return len(found), hashlib.md5("|".join(found).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column("words"), ""))  # null texts go too
            made = [digests(t) for t in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in made], pa.int64()), pa.array([d for _, d in made], pa.string())], names=["id", "n", "digest"])

    bounded_batches(docs.sparkSession)
    joined = docs.select("id", F.trim(F.regexp_replace(F.lower("text"), r"\P{L}+", " ")).alias("words"))
    return joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, n long, digest string")


def _count_of(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == term)).cast("long")


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """id and score (lower is better) of rows with any of the terms.

    Texts are cut into words once: the length of each row and its counts of the terms are written to the
    shared scratch folder, and corpus statistics and scores come from there.
    """
    lengths = docs.select("id", tx.words(F.col("text")).alias("ws")).select(
        "id",
        F.size("ws").cast("long").alias("dl"),
        F.array(*[_count_of(F.col("ws"), t) for t in terms]).alias("tfs"),
    )
    lengths = materialize(lengths, "term-counts")
    stats = lengths.agg(
        F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col("tfs")[i] > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    parts = []
    for i in range(len(terms)):
        tf, df = F.col("tfs")[i], F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return (
        lengths.filter(F.exists("tfs", lambda x: x > 0))
        .crossJoin(F.broadcast(stats))  # one row of corpus constants
        .select("id", (-reduce(lambda a, b: a + b, parts)).alias("score"))
    )


def best_rows(docs: DataFrame, term: str, limit: int) -> DataFrame:
    """Ids of the rows that hold a word most often; only rows with the literal are cut into words, and no word is exploded."""
    rows = docs.filter(F.lower("text").contains(term)).select("id", _count_of(tx.words(F.col("text")), term).alias("tf"))
    return rows.filter("tf > 0").orderBy(F.desc("tf"), "id").limit(limit).select("id")


def all_terms(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of rows with every term."""
    return (
        posts.filter(F.col("term").isin(terms)).groupBy("id")
        .agg(F.count_distinct("term").alias("n"), F.sum("tf").alias("hits"))
        .filter(F.col("n") == len(set(terms))).drop("n")
    )


def any_term(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of rows with one of the terms, and how many they have."""
    return posts.filter(F.col("term").isin(terms)).groupBy("id").agg(
        F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("hits")
    )


def facet_counts(docs: DataFrame, term: str, word: str) -> DataFrame:
    """Rows per subject that hold a substring or a word, each counted once."""
    like = docs.filter(tx.has_term(F.col("text"), term)).select("id", "subject")
    match = docs.filter(F.array_contains(tx.words(F.col("text")), word)).select("id", "subject")
    return like.union(match).distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("cnt"))


def capped_hits(docs: DataFrame, terms: list[str], cap: int) -> DataFrame:
    """For each term the number of rows that hold it (A-Z in either case), but cap at most; one scan for all terms."""
    sums = docs.select(tx.ascii_fold(F.col("text")).alias("folded")).agg(*[F.count_if(F.contains("folded", F.lit(t.translate(_LOWER)))).alias(f"c{i}") for i, t in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.least(F.col(f"c{i}"), F.lit(cap).cast("long")).alias("hits")) for i, t in enumerate(terms)])
    return sums.select(F.explode(rows).alias("r")).select("r.term", "r.hits")


#: Terms up to which rows are checked against all of them in place; with more, both sides meet in a shuffle.
NEEDLE_KEYS = 20_000


def _held(docs: DataFrame, needles: list[tuple[str, str]]) -> DataFrame:
    """id and needle of rows (id, text) that hold a needle; each needle comes with its gram, told as its length and the gram.

    A row's grams say which needles are looked for in it, and its text is not handed on.
    """
    by_gram: dict[int, dict[str, list[str]]] = {}
    for gram, needle in needles:
        by_gram.setdefault(int(gram[0]), {}).setdefault(gram[1:], []).append(needle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, some in by_gram.items() if text else ():
                    own = map("".join, zip(*(text[j:] for j in range(n)), strict=False)) if n > 1 else text
                    held = [x for g in some.keys() & set(own) for x in some[g] if x in text]
                    found += held
                    rows += [i] * len(held)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["id", "needle"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, needle string")


def contained_terms(terms: DataFrame, docs: DataFrame, key_words: int = 4) -> DataFrame:
    """Pairs (term_id, id) where the term's text occurs in the row's text.

    A term's key is a run of key_words of its inner words, or if it has fewer (or none) the characters
    that it begins with, three at most. Rows offer their runs and grams; what meets is verified by the
    substring predicate. With up to NEEDLE_KEYS terms this happens inside a row, before anything is exploded.
    """
    # Inner words only: the first and last word of a term may be the end and the start of longer ones.
    ws = tx.words(F.col("text"))
    inner = F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 2, F.lit(0)))
    size = F.least(F.length("text"), F.lit(3))
    key = F.when(F.size(inner) >= key_words, F.concat(F.lit("w"), F.array_join(F.slice(inner, 1, key_words), " "))).otherwise(
        F.concat(size.cast("string"), F.substring("text", F.lit(1), size))
    )
    needles = terms.filter("text <> ''").select("term_id", F.col("text").alias("needle"), F.xxhash64(key).alias("key"), F.substring(key, 1, 1).alias("kind"), F.when(~key.startswith("w"), key).alias("gram"))
    kinds = {r["kind"] for r in needles.select("kind").distinct().collect()}  # four at most

    def runs(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - key_words)
        hashed = F.transform(starts, lambda i: F.xxhash64(F.concat(F.lit("w"), F.array_join(F.slice(tokens, i + 1, key_words), " "))))
        return F.when(F.size(tokens) >= key_words, hashed).otherwise(F.array().cast("array<bigint>"))

    def grams(n: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
        return F.transform(found, lambda g: F.xxhash64(F.concat(F.lit(n), g)))

    offered = [tx.bound(tx.words(F.col("text")), runs)] if "w" in kinds else []
    offered += [grams(n) for n in sorted(kinds - {"w"})]
    keys = F.array_distinct(F.concat(*offered, F.array().cast("array<bigint>")))
    if needles.count() <= NEEDLE_KEYS:
        short = needles.filter("kind <> 'w'")
        asked = [(r["gram"], r["needle"]) for r in short.select("gram", "needle").distinct().collect()]
        met = _held(docs, asked).join(F.broadcast(short.select("term_id", "needle")), "needle").select("term_id", "id")
        if "w" in kinds:
            long = needles.filter("kind = 'w'")
            some = F.array(*[F.lit(r["key"]) for r in long.select("key").distinct().collect()])
            offered = F.array_distinct(tx.bound(tx.words(F.col("text")), runs))
            near = docs.select("id", "text", F.array_intersect(offered, some).alias("keys")).filter(F.size("keys") > 0)
            more = near.select("id", "text", F.explode("keys").alias("key")).join(long, "key").filter(F.col("text").contains(F.col("needle")))
            met = met.unionByName(more.select("term_id", "id"))
        return met
    pairs = docs.select("id", F.explode(keys).alias("key")).join(needles.select("term_id", "key").hint("merge"), "key")
    met = pairs.select("id", "term_id").join(docs.select("id", "text"), "id").join(needles.select("term_id", "needle"), "term_id")
    return met.filter(F.col("text").contains(F.col("needle"))).select("term_id", "id")


def suppress_nested(matches: DataFrame) -> DataFrame:
    """Matches (id, concept) without those contained in a longer match of the same row."""
    longer = matches.select("id", F.col("concept").alias("outer"))
    return matches.join(
        longer,
        (matches["id"] == longer["id"]) & (F.col("outer") != F.col("concept")) & F.col("outer").contains(F.col("concept")),
        "left_anti",
    )
