"""Corpus analytics: term statistics, coverage, heat maps and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.session import materialize


def corpus_stats(docs: DataFrame, exam: Column) -> DataFrame:
    """Counts in one pass: rows, exam rows, books, shortest and longest text."""
    return docs.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(exam).alias("exam_chunks"),
        F.count_distinct("book_key").alias("books"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
    )


def concept_counts(docs: DataFrame) -> DataFrame:
    """concept, subject and count of every word: the materialised concept map."""
    return docs.select("subject", F.explode(tx.words(F.col("text"))).alias("concept")).groupBy("concept", "subject").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def breadth(concepts: DataFrame, least: int = 2) -> DataFrame:
    """Concepts of several subjects."""
    return concepts.groupBy("concept").agg(
        F.count_distinct("subject").alias("subject_count"), F.sum("cnt").alias("total_count")
    ).filter(F.col("subject_count") >= least)


def word_frequency(concepts: DataFrame, k: int, subject: str | None = None) -> DataFrame:
    """The k most frequent terms."""
    rows = concepts if subject is None else concepts.filter(F.col("subject") == subject)
    return rows.groupBy("concept").agg(F.sum("cnt").alias("freq")).orderBy(F.desc("freq"), "concept").limit(k)


def coverage(terms: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """Terms (term, side, cnt) with the highest and with the lowest ratio of one side to the other."""
    by = terms.groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("side") == left, F.col("cnt"))), F.lit(0)).cast("long").alias("left_cnt"),
        F.coalesce(F.sum(F.when(F.col("side") == right, F.col("cnt"))), F.lit(0)).cast("long").alias("right_cnt"),
    ).filter("left_cnt > 0 and right_cnt > 0")
    by = by.withColumn("ratio", F.bround(F.col("left_cnt") / F.greatest(F.col("right_cnt"), F.lit(1)), 3))
    high = by.orderBy(F.desc("ratio"), "term").limit(k).withColumn("part", F.lit("high"))
    low = by.orderBy("ratio", "term").limit(k).withColumn("part", F.lit("low"))
    return high.unionByName(low)


def heatmap(concepts: DataFrame) -> DataFrame:
    """For each pair of subjects how many concepts they share; zero-filled, the diagonal is the own count.

    A concept's subjects meet in one row and are paired there; subjects are few.
    """
    held = concepts.groupBy("concept").agg(F.collect_set("subject").alias("subjects"))
    pairs = F.flatten(F.transform("subjects", lambda a: F.transform("subjects", lambda b: F.struct(a.alias("s1"), b.alias("s2")))))
    shared = materialize(held.select(F.explode(pairs).alias("p")).groupBy("p.s1", "p.s2").agg(F.count(F.lit(1)).alias("shared")), "shared-concepts")
    # The grid is subjects times subjects: a dimension, not rows of the corpus. Each is paired with itself.
    s = shared.filter("s1 = s2")
    grid = s.select("s1").crossJoin(s.select("s2"))
    return grid.join(shared, ["s1", "s2"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))


def cross_links(concepts: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of subjects and the weight of the concepts that link them (the smaller count of each); concepts have a row for each subject."""
    held = concepts.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("subject", "cnt"))).alias("own")).filter(F.size("own") >= least)
    rest = lambda i: F.slice("own", i + 2, F.size("own"))
    pairs = F.flatten(F.transform("own", lambda a, i: F.transform(rest(i), lambda b: F.struct(a["subject"].alias("s1"), b["subject"].alias("s2"), F.least(a["cnt"], b["cnt"]).alias("both")))))
    return held.select(F.explode(pairs).alias("p")).groupBy("p.s1", "p.s2").agg(F.sum("p.both").alias("weight"), F.count(F.lit(1)).alias("n_concepts"))


def doc_frequency(docs: DataFrame) -> DataFrame:
    """term, tf and df over all texts."""
    posts = docs.select("id", F.explode(tx.words(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return posts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def share_ceiling(stats: DataFrame, n_docs: int, most_share: float = 0.12) -> DataFrame:
    """Terms without those that are in too many texts and hardly repeated in them."""
    return stats.filter(~((F.col("df") / F.lit(n_docs) > most_share) & (F.col("tf") / F.col("df") < 2)))


def weighted_terms(posts: DataFrame, idf: DataFrame) -> DataFrame:
    """tf x idf over the largest idf; terms without an idf get half of the largest."""
    top = idf.agg(F.max("idf").alias("max_idf"))
    return posts.join(idf, "term", "left").crossJoin(F.broadcast(top)).withColumn(
        "weight", F.col("tf") * F.coalesce("idf", 0.5 * F.col("max_idf")) / F.col("max_idf")
    ).drop("max_idf")


def inverse_frequency(stats: DataFrame, n_docs: int) -> DataFrame:
    """term and idf = ln((1 + N) / (1 + df)) + 1."""
    return stats.select("term", (F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def top_terms(posts: DataFrame, k: int) -> DataFrame:
    """The k most frequent terms of each text."""
    w = Window.partitionBy("id").orderBy(F.desc("tf"), "term")
    return posts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def cooccurrence(posts: DataFrame, k: int = 8) -> DataFrame:
    """Pairs of terms that are both among a text's k most frequent; k bounds the pairs of a text."""
    top = top_terms(posts, k).groupBy("id").agg(F.array_sort(F.collect_list("term")).alias("ts"))
    pairs = F.flatten(F.transform("ts", lambda a, i: F.transform(F.slice("ts", i + 2, F.lit(k)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return top.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def surface_modes(docs: DataFrame) -> DataFrame:
    """For each lower-case English word its most frequent written form.

    Ties go to a form with an upper-case letter, then to the longer one, then to the greater one.
    """
    raw = docs.select(F.explode(F.regexp_extract_all("text", F.lit(tx.ENGLISH_WORD), F.lit(0))).alias("surface"))
    counts = raw.groupBy(F.lower("surface").alias("canonical"), "surface").agg(F.count(F.lit(1)).alias("n"))
    upper = F.col("surface").rlike("[A-Z]").cast("int")
    return counts.groupBy("canonical").agg(
        F.max_by("surface", F.struct("n", upper, F.length("surface"), "surface")).alias("display"), F.sum("n").alias("total")
    )


def english_postings(docs: DataFrame, stopwords: list[str], acronyms: list[str] = ()) -> DataFrame:
    """id, token, surface (as it is written) and n of the valid English words of each text; written once for all statistics."""
    tokens = docs.select("id", F.explode(tx.english_forms(F.col("text"), stopwords, acronyms)).alias("w")).select("id", "w.token", "w.surface")
    return materialize(tokens.groupBy("id", "token", "surface").agg(F.count(F.lit(1)).alias("n")), "english-postings")


def english_statistics(posts: DataFrame) -> DataFrame:
    """token, total, docs and display (the most frequent form; ties as in surface_modes) of English postings."""
    forms = posts.groupBy("token", "surface").agg(F.sum("n").alias("n"))
    upper = F.col("surface").rlike("[A-Z]").cast("int")
    shown = forms.groupBy("token").agg(F.sum("n").alias("total"), F.max_by("surface", F.struct("n", upper, F.length("surface"), "surface")).alias("display"))
    docs = posts.select("token", "id").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    return shown.join(docs, "token")


def english_pairs(posts: DataFrame, statistics: DataFrame, k: int = 100, least: int = 2) -> DataFrame:
    """a, b and docs: how many texts hold both of two of the k most frequent tokens; k bounds the pairs of a text."""
    top = statistics.orderBy(F.desc("total"), "token").limit(k).select("token")
    held = posts.join(F.broadcast(top), "token").groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("ts"))
    pairs = F.flatten(F.transform("ts", lambda a, i: F.transform(F.slice("ts", i + 2, F.lit(k)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return held.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least)


def pattern_counts(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """For each label how many rows match its pattern; one pass."""
    sums = rows.agg(*[F.count_if(F.col(text).rlike(p)).alias(f"c{i}") for i, p in enumerate(patterns.values())])
    made = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"c{i}").alias("n")) for i, k in enumerate(patterns)])
    return sums.select(F.explode(made).alias("r")).select("r.label", "r.n")


def offset_mode(pairs: DataFrame, group: str, index: str, printed: str) -> DataFrame:
    """The most frequent difference of two page numbers in each group; ties go to the smaller one."""
    counts = pairs.groupBy(group, (F.col(index) - F.col(printed)).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "offset")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def occurrence_summary(rows: DataFrame) -> DataFrame:
    """Occurrences (headword, year, kind, question, gloss, pos) as one row for each headword."""
    by_kind = rows.groupBy("headword", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("headword").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string")))), ",").alias("kinds")
    )
    first = rows.groupBy("headword", "gloss").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("headword").orderBy("pos", "gloss")
    glosses = first.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").groupBy("headword").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "gloss"))), lambda x: x["gloss"]), "|").alias("glosses")
    )
    main = rows.groupBy("headword").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("question").alias("questions"),
        F.array_join(F.transform(F.array_sort(F.collect_set("year")), lambda y: y.cast("string")), ",").alias("years"),
    )
    return main.join(by_kind, "headword").join(glosses, "headword")
