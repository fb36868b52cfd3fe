"""Analysis of a whole table of queries against a catalogue of concepts, synonyms and the texts themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import lexical
from quillon.plans import query_plan
from quillon.session import materialize

#: Characters of the grams through which strings meet.
GRAM = 3
#: Scores of the ways in which a concept or a synonym's term matches a query.
EXACT, CONTAINED, EXPANDED, PHRASE, SAME_TERM, ALIAS, ONE_ALIAS = 300, 220, 200, 180, 260, 210, 10
#: Matches of either kind in the plan, aliases of a term that are looked at and that are searched, synonym rows of a query.
MATCHES, LOOKED_AT, SEARCHED, SYNONYM_ROWS = 4, 8, 3, 24


def _grams(text: str, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containment(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """needle and hay: every pair of a needle (needle) and a short string (hay) that contains it; both are distinct.

    Strings offer their grams of GRAM characters (shorter ones for shorter needles), which are counted. A
    needle looks only under its rarest gram, and what meets there is verified, so common grams cost nothing
    unless a needle has no other.
    """
    needles = needles.filter("needle <> ''").distinct().withColumn("n", F.least(F.length("needle"), F.lit(GRAM)))
    offered = F.flatten(F.array(*[_grams("hay", n) for n in range(1, GRAM + 1)]))
    grams = materialize(haystacks.distinct().select("hay", F.explode(offered).alias("gram")), "grams")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("count"))
    own = F.coalesce(*[F.when(F.col("n") == n, _grams("needle", n)) for n in range(1, GRAM + 1)])
    asked = needles.select("needle", F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = asked.groupBy("needle").agg(
        F.max(F.col("count").isNull()).alias("absent"), F.min_by("gram", F.struct("count", "gram")).alias("gram")
    ).filter("not absent")
    return grams.join(rarest.select("needle", "gram"), "gram").filter(F.contains("hay", "needle")).select("needle", "hay")


def _stands_apart(term: str, text: str) -> Column:
    """Whether a term stands in a text, in any case, with no Latin letter or digit beside it."""
    literal = F.regexp_replace(F.lower(term), r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit("(^|[^0-9a-z])"), literal, F.lit("($|[^0-9a-z])")))


def concept_matches(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """q, term, match_type and score: the concepts (concept) that each distinct query (q) equals, contains, is part of or names."""
    names = concepts.select("concept").filter("concept <> ''").distinct()
    exact = queries.join(names, F.col("q") == F.col("concept")).select("q", "concept", F.lit(0).alias("way"))
    inside = containment(names.select(F.col("concept").alias("needle")), queries.select(F.col("q").alias("hay"))).select(F.col("hay").alias("q"), F.col("needle").alias("concept"), F.lit(1).alias("way"))
    around = containment(queries.select(F.col("q").alias("needle")), names.select(F.col("concept").alias("hay"))).select(F.col("needle").alias("q"), F.col("hay").alias("concept"), F.lit(2).alias("way"))
    # Phrases differ from contained concepts in case only, so lower-case forms meet first.
    low = containment(names.select(F.lower("concept").alias("needle")), queries.select(F.lower("q").alias("hay")))
    named = low.join(names, F.col("needle") == F.lower("concept")).join(queries, F.col("hay") == F.lower("q")).filter(_stands_apart("concept", "q")).select("q", "concept", F.lit(3).alias("way"))
    ways = exact.unionByName(inside).unionByName(around).unionByName(named).groupBy("q", "concept").agg(F.min("way").alias("way"))
    names_of, base = F.array(*map(F.lit, ("exact", "contained", "expanded", "phrase"))), F.array(*map(F.lit, (EXACT, CONTAINED, EXPANDED, PHRASE)))
    length = F.when(F.col("way") == 2, F.length("q")).otherwise(F.length("concept"))
    return ways.select("q", F.col("concept").alias("term"), names_of[F.col("way")].alias("match_type"), (base[F.col("way")] + length).alias("score"))


def alias_matches(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """q, term, match_type, aliases and score of the synonym records (term, synonyms: JSON) that each query (q) touches.

    Records whose term or an alias contains the query are looked at, SYNONYM_ROWS of a query in order of
    term. They match if their term is the query, or one of the first LOOKED_AT aliases equals, contains or
    is part of it.
    """
    listed = query_plan.aliases(synonyms)
    strings = synonyms.select("term", F.col("term").alias("hay")).unionByName(listed.select("term", F.col("alias").alias("hay"))).withColumn("hay", tx.ascii_fold(F.col("hay")))
    met = containment(queries.select(tx.ascii_fold(F.col("q")).alias("needle")), strings.select("hay"))
    touched = met.join(strings, "hay").select("needle", "term").distinct().join(queries, F.col("needle") == tx.ascii_fold(F.col("q"))).select("q", "term")
    few = touched.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("term"))).filter(F.col("rank") <= SYNONYM_ROWS).drop("rank")
    place = F.row_number().over(Window.partitionBy("term").orderBy("pos", "alias"))
    first = listed.withColumn("place", place).filter(F.col("place") <= LOOKED_AT).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]).alias("first"))
    rows = few.join(first, "term", "left").withColumn("first", F.coalesce("first", F.array().cast("array<string>")))

    def touches(alias: Column) -> Column:
        flat = tx.compact(alias)
        return (flat != "") & (F.col("q").contains(flat) | flat.contains(F.col("q")))

    rows = rows.withColumn("aliases", F.filter("first", touches)).withColumn("same", tx.compact(F.col("term")) == F.col("q"))
    rows = rows.filter((tx.compact(F.col("term")) != "") & (F.col("same") | (F.size("aliases") > 0)))
    score = F.when(F.col("same"), SAME_TERM).otherwise(ALIAS + ONE_ALIAS * F.size("aliases"))
    return rows.select("q", "term", F.when(F.size("aliases") > 0, "alias").otherwise("term").alias("match_type"), F.slice("aliases", 1, MATCHES).alias("aliases"), score.alias("score"))


def candidate_terms(queries: DataFrame, limit: int = 18) -> DataFrame:
    """q and term: the query itself and the parts of it that may be searched instead, limit at most.

    Queries of two or more runs of one script give up to four neighbouring runs; one run of four or more
    CJK characters gives its windows of eight to three characters (of two in a run of four).
    """
    runs = F.regexp_extract_all("q", F.lit(r"[A-Za-z0-9]+|[\x{0370}-\x{03ff}]+|[\x{4e00}-\x{9fff}]+|[^A-Za-z0-9\x{0370}-\x{03ff}\x{4e00}-\x{9fff}]+"), F.lit(0))

    def windows(parts: Column, longest: Column | int, shortest: Column | int) -> Column:
        n = F.size(parts)
        sizes = F.sequence(F.least(F.lit(longest), n), F.lit(shortest) if isinstance(shortest, int) else shortest, F.lit(-1))
        return F.flatten(F.transform(sizes, lambda w: F.transform(F.sequence(F.lit(0), n - w), lambda i: F.array_join(F.slice(parts, i + 1, w), ""))))

    one_run = F.col("q").rlike(r"^[\x{4e00}-\x{9fff}]+$") & (F.length("q") >= 4)
    letters = F.split("q", "(?!^)")
    parts = (
        F.when(F.size("runs") >= 2, windows(F.col("runs"), 4, 1))
        .when(one_run, windows(letters, 8, F.when(F.length("q") <= 4, 2).otherwise(3)))
        .otherwise(F.array().cast("array<string>"))
    )
    every = F.filter(F.array_distinct(F.concat(F.array("q"), parts)), lambda t: F.length(t) >= 2)
    return queries.withColumn("runs", runs).select("q", F.explode(F.slice(every, 1, limit)).alias("term"))


def fallback_terms(queries: DataFrame, texts: DataFrame, more_texts: DataFrame) -> DataFrame:
    """q, term, primary_hits, extra_hits, score and place of the candidate terms that rows of texts or more_texts (id, text) hold."""
    asked = materialize(candidate_terms(queries), "candidate-terms")
    terms = asked.select(tx.ascii_fold(F.col("term")).alias("text")).distinct().withColumn("term_id", F.col("text"))

    def hits(rows: DataFrame, name: str) -> DataFrame:
        folded = rows.select("id", tx.ascii_fold(F.coalesce("text", F.lit(""))).alias("text"))
        return lexical.contained_terms(terms, folded).groupBy(F.col("term_id").alias("folded")).agg(F.count(F.lit(1)).alias(name))

    counted = asked.withColumn("folded", tx.ascii_fold(F.col("term"))).join(hits(texts, "primary_hits"), "folded", "left").join(hits(more_texts, "extra_hits"), "folded", "left")
    counted = counted.drop("folded").fillna(0, ["primary_hits", "extra_hits"])
    scored = query_plan.fallback_scores(counted, F.col("q"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc(F.col("primary_hits") + F.col("extra_hits")), F.desc(F.length("term")), "term")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= query_plan.PLAN_LIMIT)


def _best(matches: DataFrame, fields: list[str], name: str) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc(F.length("term")), "term")
    top = matches.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MATCHES)
    return top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias(name))


def analyse(queries: DataFrame, concepts: DataFrame, synonyms: DataFrame, texts: DataFrame, more_texts: DataFrame) -> DataFrame:
    """Each distinct query (query) with mode, display_term, concept_terms, fallback_terms, plan and used_more_texts.

    Modes, in this order: invalid (nothing is left of the query), concept, alias, fallback and direct. Only
    queries without a concept or alias are looked up in the texts. plan holds up to PLAN_LIMIT terms, each
    with the way it came in; concept_terms and fallback_terms hold what was found, best first.
    """
    rows = queries.select("query").distinct().withColumn("q", F.coalesce(tx.compact(F.col("query")), F.lit("")))
    asked = materialize(rows.filter("q <> ''").select("q").distinct(), "queries")
    found = _best(concept_matches(asked, concepts), ["term", "match_type", "score"], "by_concept")
    also = _best(alias_matches(asked, synonyms), ["term", "match_type", "score", "aliases"], "by_alias")
    known = materialize(asked.join(found, "q", "left").join(also, "q", "left"), "known")
    missed = known.filter("by_concept is null and by_alias is null").select("q")
    fallback = fallback_terms(missed, texts, more_texts).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("place", "term", "score", "primary_hits", "extra_hits"))).alias("by_text")
    )
    out = rows.join(known, "q", "left").join(fallback, "q", "left")
    pair = lambda term, basis: F.struct(tx.compact(term).alias("term"), basis.alias("basis"))
    empty = F.array().cast("array<struct<term:string,basis:string>>")
    some = lambda c, f: F.coalesce(F.transform(c, f), empty)
    with_aliases = F.flatten(F.transform("by_alias", lambda m: F.concat(F.array(pair(m["term"], m["match_type"])), F.transform(F.slice(m["aliases"], 1, SEARCHED), lambda a: pair(a, F.lit("alias"))))))
    every = F.concat(
        some("by_concept", lambda m: pair(m["term"], m["match_type"])), F.coalesce(with_aliases, empty),
        some("by_text", lambda m: pair(m["term"], F.lit("fallback"))), F.array(pair(F.col("q"), F.lit("query"))),
    )

    def once(plan: Column) -> Column:
        names = F.transform(plan, lambda p: p["term"])
        return F.filter(plan, lambda p, i: (F.length(p["term"]) >= 2) & (F.array_position(names, p["term"]) == i + 1))

    line = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["term"], m["match_type"], m["score"].cast("string"))), "|")
    concept_terms = F.concat_ws("|", F.nullif(line(F.col("by_concept")), F.lit("")), F.nullif(line(F.col("by_alias")), F.lit("")))
    fallback_line = F.array_join(F.transform("by_text", lambda m: F.concat_ws(":", m["term"], m["score"].cast("string"))), "|")
    mode = F.when(F.col("q") == "", "invalid").when(F.col("by_concept").isNotNull(), "concept").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_text").isNotNull(), "fallback").otherwise("direct")
    shown = F.coalesce(F.col("by_concept")[0]["term"], F.col("by_alias")[0]["term"], F.col("by_text")[0]["term"], F.col("q"))
    elsewhere = F.coalesce(~F.exists("by_text", lambda m: m["primary_hits"] > 0) & F.exists("by_text", lambda m: m["extra_hits"] > 0), F.lit(False))
    plan = F.transform(F.slice(tx.bound(every, once), 1, query_plan.PLAN_LIMIT), lambda p: F.concat_ws(":", p["term"], p["basis"]))
    return out.select(
        "query", mode.alias("mode"), shown.alias("display_term"), concept_terms.alias("concept_terms"), F.coalesce(fallback_line, F.lit("")).alias("fallback_terms"),
        F.array_join(plan, "|").alias("plan"), elsewhere.alias("used_more_texts"),
    )
