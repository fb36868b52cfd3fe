"""Links from questions to pages, and from pages to pages of other subjects, for whole tables of them.

Each link is found through one of several channels (references that are known, words and concepts in
full text, near vectors), and all links are scored by the same rule. Concepts and terms are present in
a page if their words stand in it one after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import linking, ranked
from quillon.session import materialize

#: A known reference's score, what is taken off for each further one, and its least.
REFERENCE_SCORE, REFERENCE_STEP, LEAST_REFERENCE_SCORE = 96, 3, 80
#: Most points for terms and for concepts, for one of either, and for the subject.
TERM_POINTS, CONCEPT_POINTS, ONE_TERM, ONE_CONCEPT, SUBJECT_POINTS = 35, 40, 3, 15, 15
#: Pages with fewer characters lose points; links need a least score; near vectors of other subjects have one score.
SHORT_PAGE, SHORT_LOSS, LEAST_SCORE, VECTOR_SCORE = 50, 20, 15, 60


def concept_places(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """qid, term and place of the concepts that each row (id, text) names, long ones first."""
    found = linking.match_concepts(rows, concepts).withColumnRenamed("id", "qid")
    order = Window.partitionBy("qid").orderBy(F.desc(F.length("concept")), "concept")
    return found.select("qid", F.col("concept").alias("term"), F.row_number().over(order).alias("place"))


def first_terms(parts: list[tuple[DataFrame, int]], n: int) -> DataFrame:
    """qid, term and place of the first n different terms out of several tables (qid, term, place), each cut at its own place."""
    together = None
    for priority, (terms, most) in enumerate(parts):
        some = terms.filter(F.col("place") <= most).select("qid", "term", F.struct(F.lit(priority).alias("priority"), "place").alias("at"))
        together = some if together is None else together.unionByName(some)
    once = together.groupBy("qid", "term").agg(F.min("at").alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("at", "term"))).filter(F.col("place") <= n).select("qid", "term", "place")


def _listed(terms: DataFrame, name: str) -> DataFrame:
    """Terms of each qid in order, as an array; a query has a handful."""
    return terms.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias(name))


def search_words(terms: DataFrame) -> DataFrame:
    """qid and the different words of its terms."""
    return terms.select("qid", F.explode(tx.words(F.col("term"))).alias("term")).distinct()


def resolve_references(refs: DataFrame, pages: DataFrame, limit: int) -> DataFrame:
    """qid, id, place and score of references such as subject·title·p12 (qid, place from 0, ref).

    A reference is the page of its subject and number whose title is the same, else the first one. Of
    references to one page the first counts, and a question has limit of them.
    """
    pattern = "^([^·]+)·(.+)·p(-?[0-9]+)$"
    part = lambda i: F.trim(F.regexp_extract(F.trim("ref"), pattern, i))
    parsed = refs.filter(F.trim("ref").rlike(pattern)).select("qid", "place", part(1).alias("subject"), part(2).alias("wanted"), part(3).cast("long").alias("page"))
    met = parsed.join(pages.select("id", "subject", "title", "page"), ["subject", "page"])
    best = met.groupBy("qid", "place").agg(F.min(F.struct((F.col("title") != F.col("wanted")).alias("other"), "id"))["id"].alias("id"))
    once = best.groupBy("qid", "id").agg(F.min("place").alias("place"))
    kept = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).filter(F.col("rank") <= limit)
    score = F.greatest(F.lit(LEAST_REFERENCE_SCORE), REFERENCE_SCORE - REFERENCE_STEP * F.col("place"))
    return kept.select("qid", "id", "place", score.cast("long").alias("score"))


def _present(terms: str) -> Column:
    """The terms of an array column whose words stand in the page (words, padded and joined by blanks)."""
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains("words", F.concat(F.lit(" "), t, F.lit(" "))))


def relevance(terms: Column, concepts: Column, same: Column, text: Column) -> Column:
    """Score from 0 to 100 of a page by the terms and concepts that it has."""
    total = lambda some, one: F.aggregate(some, F.lit(0), lambda s, t: s + one(F.length(t)))
    points = F.least(F.lit(TERM_POINTS), total(terms, lambda n: F.least(F.lit(ONE_TERM), n - 1)))
    points += F.least(F.lit(CONCEPT_POINTS), total(concepts, lambda n: F.least(F.lit(ONE_CONCEPT), 2 * n)))
    points += F.when(same, SUBJECT_POINTS).otherwise(0)
    short = F.length(F.coalesce(text, F.lit(""))) < SHORT_PAGE
    return F.least(F.lit(100), F.when(short, F.greatest(F.lit(0), points - SHORT_LOSS)).otherwise(points)).cast("long")


def _judged(candidates: DataFrame, pages: DataFrame, terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """Candidates (qid, qsubject, id, ...) with the terms and concepts present in the page, and its score."""
    texts = pages.select("id", "subject", "text")
    rows = candidates.join(texts, "id").join(_listed(terms, "terms"), "qid", "left").join(_listed(concepts, "concepts"), "qid", "left")
    words = F.concat(F.lit(" "), F.array_join(tx.words(F.coalesce("text", F.lit(""))), " "), F.lit(" "))
    rows = rows.withColumn("words", words)
    judged = rows.withColumn("present", _present("concepts")).withColumn("same_subject", F.col("subject").eqNullSafe(F.col("qsubject")))
    return judged.withColumn("points", relevance(_present("terms"), F.col("present"), F.col("same_subject"), F.col("text"))).drop("text", "words")


def link_questions(
    questions: DataFrame, pages: DataFrame, index: ranked.Index, concepts: DataFrame, points: DataFrame, refs: DataFrame, near: DataFrame, limit: int = 10
) -> DataFrame:
    """qid, id, same_subject, link_type, score, matched and rank: the best pages of the question's subject and of others.

    questions: id, subject, text. pages: id, subject, title, page, text, all of them in the index.
    concepts: concept. points (qid, term, place from 1) and refs (qid, ref, place from 0): what is known
    of a question. near (qid, id, place): pages with near vectors. Channels are tried in the order of
    known references (precomputed), full text (explicit) and vectors (implicit); a page counts for the
    first that has it. Links that are not known need a score of LEAST_SCORE. Equal scores keep that order.
    """
    asked = questions.select(F.col("id").alias("qid"), F.col("subject").alias("qsubject"))
    matched = materialize(concept_places(questions.select("id", "text"), concepts), "matched")
    top = materialize(ranked.weighted_terms(index, questions, 15).select("qid", "term", "place"), "weighted-terms")
    points = materialize(points, "points")
    words = search_words(first_terms([(points, 6), (top, 8), (matched, 5)], 12)).join(asked, "qid")
    found = ranked.top_k_in_blocks(index, words, 3 * limit)
    known = resolve_references(refs, pages, limit)
    channels = [
        (known.select("qid", "id", F.col("place").alias("at"), "score"), "precomputed"),
        (found.select("qid", "id", F.col("rank").alias("at"), F.lit(None).cast("long").alias("score")), "explicit"),
        (near.select("qid", "id", F.col("place").alias("at"), F.lit(None).cast("long").alias("score")), "implicit"),
    ]
    candidates = None
    for channel, (rows, name) in enumerate(channels):
        some = rows.filter("id <> qid").select("qid", "id", F.struct(F.lit(channel).alias("channel"), F.col("at").cast("long").alias("at"), F.lit(name).alias("link_type"), "score").alias("via"))
        candidates = some if candidates is None else candidates.unionByName(some)
    candidates = materialize(candidates.groupBy("qid", "id").agg(F.min("via").alias("via")), "candidates").join(asked, "qid")
    judged = _judged(candidates, pages, first_terms([(points, 6), (top, 10)], 15), first_terms([(points, 6), (matched, 8)], 14))
    score = F.coalesce("via.score", "points")
    kept = judged.withColumn("score", score).filter((F.col("via.link_type") == "precomputed") | (F.col("score") >= LEAST_SCORE))
    order = Window.partitionBy("qid", "same_subject").orderBy(F.desc("score"), "via.channel", "via.at", "id")
    ranked_rows = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked_rows.select("qid", "id", "same_subject", "via.link_type", "score", F.array_join(F.slice("present", 1, 5), "|").alias("matched"), "rank")


def link_pages(pages: DataFrame, chosen: DataFrame, index: ranked.Index, concepts: DataFrame, clusters: DataFrame, near: DataFrame, limit: int = 10) -> DataFrame:
    """qid, id, link_type, score, matched and rank: pages of other subjects for each chosen page (id, subject, text).

    clusters: cluster, concept. Full-text links are implicit if they hold a concept that only a cluster
    leads to, else explicit; pages with near vectors (qid, id, place) that full text has not are implicit
    and have the score VECTOR_SCORE. Pages without a search term have no links.
    """
    asked = chosen.select(F.col("id").alias("qid"), F.col("subject").alias("qsubject"))
    matched = materialize(concept_places(chosen.select("id", "text"), concepts), "matched")
    top = materialize(ranked.weighted_terms(index, chosen, 10).select("qid", "term", "place"), "weighted-terms")
    wanted = first_terms([(top, 6), (matched, 4)], 10)
    elsewhere = (F.col("id") != F.col("qid")) & (F.col("subject") != F.col("qsubject"))
    found = ranked.top_k_in_blocks(index, search_words(wanted).join(asked, "qid"), 2 * limit, "other")
    expanded = linking.expand_through_clusters(matched.select(F.col("qid").alias("id"), F.col("term").alias("concept")), clusters)
    expanded = expanded.groupBy(F.col("id").alias("qid")).agg(F.collect_set("expanded").alias("expanded"))
    judged = _judged(materialize(found.select("qid", "id", "rank"), "found").join(asked, "qid"), pages, top, matched)
    led = F.exists("present", lambda c: F.array_contains(F.coalesce("expanded", F.array().cast("array<string>")), c))
    by_text = materialize(judged.join(expanded, "qid", "left").select(
        "qid", "id", F.when(led, "implicit").otherwise("explicit").alias("link_type"), F.col("points").alias("score"),
        F.array_join(F.slice("present", 1, 5), "|").alias("matched"), F.lit(0).alias("channel"), F.col("rank").cast("long").alias("at"),
    ), "links-by-text")
    others = near.join(asked, "qid").join(wanted.select("qid").distinct(), "qid", "left_semi").join(pages.select("id", "subject"), "id").filter(elsewhere)
    others = others.join(by_text.select("qid", "id"), ["qid", "id"], "left_anti").select(
        "qid", "id", F.lit("implicit").alias("link_type"), F.lit(VECTOR_SCORE).cast("long").alias("score"), F.lit("").alias("matched"),
        F.lit(1).alias("channel"), F.col("place").cast("long").alias("at"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "channel", "at", "id")
    best = by_text.unionByName(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return best.select("qid", "id", "link_type", "score", "matched", "rank")
