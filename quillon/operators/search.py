"""Search over a term plan: substring and full-text channels together, candidates, joins of vector hits, shaped results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import lexical
from quillon.operators.selection import first_by
from quillon.session import materialize

#: Rank of rows that hold the term literally: before any full-text score.
EXACT_RANK = -100.0
# Bonuses of the channels of a precise candidate.
PRECISE_BONUS = {"exact": 42.0, "fts": 24.0}


def terms_rows(docs: DataFrame, terms: list[str]) -> DataFrame:
    """turn (place of the term), id, rank and channel of the rows that hold any of some terms.

    A row holds a term literally (exact), else as all of its words by BM25 (fts). Texts are read and cut
    into words once for all terms: what is counted in a row is written to the shared scratch folder, and
    corpus statistics and scores come from there.
    """
    split = [[w for w in t.lower().split() if w] for t in terms]
    words = list(dict.fromkeys(w for ws in split for w in ws))
    tokens = docs.select("id", tx.words(F.col("text")).alias("ws"), F.array(*[tx.has_term(F.col("text"), t) for t in terms]).alias("exact"))
    count = lambda w: F.size(F.filter("ws", lambda x: x == w)).cast("long")
    counts = F.array(*[count(w) for w in words]) if words else F.array().cast("array<bigint>")
    facts = materialize(tokens.select("id", F.size("ws").cast("long").alias("dl"), counts.alias("tfs"), "exact"), "term-counts")
    stats = facts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col("tfs")[i] > 0).alias(f"df{i}") for i in range(len(words))])

    def share(w: str) -> Column:
        i = words.index(w)
        tf, df = F.col("tfs")[i], F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - df + 0.5) / (df + 0.5)))
        return idf * tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * F.col("dl") / F.col("avgdl")))

    found = []
    for i, own in enumerate(split):
        hit = lambda rank, channel: F.struct(F.lit(i).alias("turn"), rank.alias("rank"), F.lit(channel).alias("channel"))  # noqa: B023, E731
        at = F.when(F.col("exact")[i], hit(F.lit(EXACT_RANK), "exact"))
        if own:
            every = reduce(lambda a, b: a & b, [F.col("tfs")[words.index(w)] > 0 for w in own])
            at = at.when(every, hit(-reduce(lambda a, b: a + b, map(share, own)), "fts"))
        found.append(at)
    some = facts.filter(F.exists("tfs", lambda x: x > 0) | F.array_contains("exact", True))
    hits = some.crossJoin(F.broadcast(stats)).select("id", F.explode(F.array_compact(F.array(*found))).alias("hit"))  # one row of corpus constants
    return first_by(hits.select("hit.turn", "id", "hit.rank", "hit.channel"), ["turn", "id"], [F.col("rank"), F.col("channel")])


def term_rows(docs: DataFrame, term: str) -> DataFrame:
    """id, rank and channel of rows that hold a term: literally (exact), else as all of its words by BM25 (fts)."""
    return terms_rows(docs, [term]).select("id", "rank", "channel")


def _named(turn: Column, values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])[turn]


def _first_rows(hits: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The n first rows of each turn."""
    place = F.row_number().over(Window.partitionBy("turn").orderBy(*order))
    return hits.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def plan_rows(docs: DataFrame, plan: list[tuple[str, str]], shift: float = 0.0) -> DataFrame:
    """id, rank, channel, matched_term and basis of rows found by a plan of (term, basis), under the first term that finds them."""
    best = first_by(terms_rows(docs, [t for t, _ in plan]), ["id"], [F.col("turn")])
    return best.select(
        "id", (F.col("rank") + F.col("turn") * 0.001 + shift).alias("rank"), "channel", F.col("turn").alias("priority"),
        _named(F.col("turn"), [t for t, _ in plan]).alias("matched_term"), _named(F.col("turn"), [b for _, b in plan]).alias("basis"),
    )


def precise_candidates(docs: DataFrame, terms: list[str], dense: DataFrame | None = None, window: int = 18, kept: int = 12) -> DataFrame:
    """id, base_score, matched_term and channel of the best candidate of each id.

    Each term gives its first rows, scored 210 - 14 x place of the term plus a bonus of the channel;
    dense hits (id) score 170.
    """
    rows = _first_rows(terms_rows(docs, terms), min(window, kept), ["rank", F.col("id").cast("string")])
    bonus = F.coalesce(*[F.when(F.col("channel") == c, b) for c, b in PRECISE_BONUS.items()], F.lit(10.0))
    found = rows.select("id", (210.0 - 14.0 * F.col("turn") + bonus).alias("base_score"), _named(F.col("turn"), terms).alias("matched_term"), "channel", "turn")
    if dense is not None:
        found = found.unionByName(dense.select("id", F.lit(170.0).alias("base_score"), F.lit(terms[0]).alias("matched_term"), F.lit("semantic").alias("channel"), F.lit(len(terms)).alias("turn")))
    return first_by(found, ["id"], [F.desc("base_score"), F.col("turn")]).drop("turn")


def hit_rows(hits: DataFrame, rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """Rows of vector hits (id, score) in order of score, filtered after the search; place is the rank among all hits."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # over the k hits only
    found = F.broadcast(hits.withColumn("place", place)).join(rows, "id")
    return found if keep is None else found.filter(keep)


def has_image(text: Column) -> Column:
    """Whether a text embeds an image, in Markdown or HTML."""
    return text.contains("![") | text.contains("<img")


def image_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"!\[|<img"))


def url_rows(rows: DataFrame, part: str) -> DataFrame:
    """Rows whose url holds a literal part."""
    return rows.filter(F.col("url").contains(part))


def excerpt(summary: Column, text: Column, limit: int = 180) -> Column:
    """The summary, or else the beginning of the text without images."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " "))
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.substring(plain, 1, limit))


def token_snippet(text: Column, word: str, tokens: int = 40) -> Column:
    """As many tokens around the first one equal to the word, that word marked wherever it stands, ellipses where text was cut."""

    def of(ws: Column) -> Column:
        at = F.array_position(F.transform(ws, F.lower), word).cast("int")
        start = F.greatest(F.lit(1), at - tokens // 2)
        shown = F.transform(
            F.slice(ws, start, F.lit(tokens)), lambda w: F.when(F.lower(w) == word, F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)
        )
        cut = F.concat(
            F.when(start > 1, "…").otherwise(""), F.array_join(shown, " "), F.when(start + tokens - 1 < F.size(ws), "…").otherwise("")
        )
        return F.when(at > 0, cut)

    return tx.bound(F.regexp_extract_all(text, F.lit(tx.WORD), F.lit(0)), of)


def shaped(rows: DataFrame, longest: int = 2000) -> DataFrame:
    """Results as they are shown: id, subject, page_num (0 if unknown), image_count, the beginning of the text and what was left out."""
    return rows.select(
        "id", "subject", F.coalesce("page", F.lit(0)).alias("page_num"), image_count(F.col("text")).alias("image_count"),
        F.substring("text", 1, longest).alias("text"), F.greatest(F.length("text") - longest, F.lit(0)).alias("left_out"),
    )


def chat_rows(docs: DataFrame, terms: list[str], side: DataFrame, per_term: int, limit: int) -> DataFrame:
    """Rows for a chat: each term's best rows in turn, an id once, with the side table's note, spread over books.

    The first row of each book comes before second ones.
    """
    found = first_by(_first_rows(terms_rows(docs, terms), per_term, ["rank", "id"]), ["id"], [F.col("turn")])
    rows = F.broadcast(found).join(docs.select("id", "book_key"), "id").join(side.select("id", "note"), "id", "left")
    again = F.row_number().over(Window.partitionBy("book_key").orderBy("turn", "rank", "id"))
    return rows.withColumn("round", again).orderBy("round", "turn", "rank", "id").limit(limit)
