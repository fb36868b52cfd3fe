"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import policy
from quillon.functions import text as tx
from quillon.operators import analytics, dictionary, etl, fusion, graph, integrity, lexical, linking, logs, selection, vector
from quillon.plans import query_plan
from quillon.session import materialize, table
from quillon.streaming import trending

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Search terms of the registered queries.
TERM, TERMS = "tion", ["the", "tion", "reanti", "heit", "eaux"]
WORDS = ["the", "that", "und", "les"]

# Common parts of the SQL.
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DOCS = "docs AS (SELECT doc_id AS id, lang AS subject, source AS book_key, n_chars, text FROM documents)"
TOKENS = "tokens AS (SELECT doc_id AS id, lang AS subject, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents)"
POSTS = f"{TOKENS}, posts AS (SELECT term, id, count(*) AS tf FROM tokens GROUP BY ALL)"
CONCEPTS = f"{TOKENS}, concepts AS (SELECT term AS concept, subject, count(*) AS cnt FROM tokens GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the roles of the corpus: id, subject, book_key, n_chars, text."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("book_key"), "n_chars", "text")


def query_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the roles of a search log."""
    e = table(spark, sf, "events")
    count = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "ts", "user_id", F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("query_normalized"),
        F.upper(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string"))).alias("query"),
        count.alias("result_count"), "event_type", (F.col("value") > 50).alias("success"),
    )


LOGS = """logs AS (SELECT ts, user_id, event_type || '-' || CAST(user_id % 50 AS VARCHAR) AS query_normalized,
    upper(event_type || '-' || CAST(user_id % 50 AS VARCHAR)) AS query,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS result_count, event_type, value > 50 AS success FROM events)"""


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the roles of concept clusters: brand, type and size class."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("cluster"), F.col("p_type").alias("concept"), (F.col("p_size") % 5).cast("string").alias("subject"))


CLUSTERS = "clusters AS (SELECT p_brand AS cluster, p_type AS concept, CAST(p_size % 5 AS VARCHAR) AS subject FROM part)"


# Lexical search

@query(f"""WITH {DOCS} SELECT id, subject, book_key, (length(text) - length(replace(text, '{TERM}', ''))) // 4 AS hits,
    replace(substr(text, greatest(1, instr(text, '{TERM}') - 30), 160), '{TERM}', '<mark>{TERM}</mark>') AS snippet
    FROM docs WHERE contains({FOLDED}, '{TERM}') ORDER BY hits DESC, id LIMIT 20""")
def lexical_search(spark, sf):
    return lexical.substring_search(docs(spark, sf), TERM, 20)


@query(f"""WITH {DOCS}, {TOKENS}, hits AS (SELECT id, subject FROM docs WHERE contains({FOLDED}, '{TERM}')
    UNION SELECT id, subject FROM tokens WHERE term = 'the') SELECT subject, count(*) AS cnt FROM hits GROUP BY subject""")
def facet_counts_union(spark, sf):
    return lexical.facet_counts(docs(spark, sf), TERM, "the")


@query(f"SELECT term, CAST(least((SELECT count(*) FROM documents WHERE contains({FOLDED}, term)), 100) AS BIGINT) AS hits FROM (VALUES "
       + ", ".join(f"('{t}')" for t in TERMS) + ") t(term)")
def capped_hit_counts(spark, sf):
    return lexical.capped_hits(docs(spark, sf), TERMS, 100)


@query(f"""WITH {POSTS}, dl AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '\\p{{L}}+')) AS dl FROM documents),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM dl),
    df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM posts WHERE term IN ('that', 'und', 'les') GROUP BY term)
    SELECT p.id, round(-sum(greatest(CAST(1e-6 AS DOUBLE), ln((n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))) * tf * CAST(2.2 AS DOUBLE)
      / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score
    FROM posts p JOIN df USING (term) JOIN dl ON dl.id = p.id CROSS JOIN s GROUP BY p.id""")
def bm25_search(spark, sf):
    return lexical.bm25(docs(spark, sf), ["that", "und", "les"]).withColumn("score", F.round("score", 6))


@query(f"""WITH {POSTS} SELECT id, CAST(sum(tf) AS BIGINT) AS hits FROM posts WHERE term IN ('the', 'that') GROUP BY id HAVING count(*) = 2""")
def fts_and(spark, sf):
    return lexical.all_terms(lexical.postings(docs(spark, sf)), ["the", "that"])


@query(f"""WITH {POSTS} SELECT id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS hits FROM posts WHERE term IN ('the', 'that', 'und', 'les') GROUP BY id""")
def fts_or(spark, sf):
    return lexical.any_term(lexical.postings(docs(spark, sf)), WORDS)


@query("""SELECT item_id AS term_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def containment_join(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("term_id"), "text")
    return lexical.contained_terms(terms, docs(spark, sf))


@query("""WITH m AS (SELECT doc_id AS id, c.concept FROM documents, (VALUES ('the'), ('then'), ('en'), ('tion'), ('nation'), ('ation')) c(concept) WHERE contains(text, c.concept))
    SELECT id, concept FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.id = m.id AND o.concept <> m.concept AND contains(o.concept, m.concept))""")
def nested_term_suppression(spark, sf):
    terms = ["the", "then", "en", "tion", "nation", "ation"]
    found = F.filter(F.array(*[F.when(F.col("text").contains(t), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return lexical.suppress_nested(docs(spark, sf).select("id", F.explode(found).alias("concept")))


# Corpus analytics

@query(f"""WITH {DOCS} SELECT count(*) AS chunks, count(*) FILTER (book_key = 'src1') AS exam_chunks, count(DISTINCT book_key) AS books,
    min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM docs""")
def corpus_stats(spark, sf):
    return analytics.corpus_stats(docs(spark, sf), F.col("book_key") == "src1")


@query("SELECT lang AS subject, count(*) AS cnt, count(DISTINCT source) AS books FROM documents GROUP BY lang")
def subject_counts(spark, sf):
    return docs(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("book_key").alias("books"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def year_histogram(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers")
    )


@query(f"WITH {CONCEPTS} SELECT concept, subject, cnt FROM concepts")
def concept_subject_counts(spark, sf):
    return analytics.concept_counts(docs(spark, sf))


@query(f"WITH {CONCEPTS} SELECT concept, count(DISTINCT subject) AS subject_count, CAST(sum(cnt) AS BIGINT) AS total_count FROM concepts GROUP BY concept HAVING count(DISTINCT subject) >= 2")
def concept_breadth(spark, sf):
    return analytics.breadth(analytics.concept_counts(docs(spark, sf)))


@query(f"WITH {CONCEPTS} SELECT concept, CAST(sum(cnt) AS BIGINT) AS freq FROM concepts GROUP BY concept ORDER BY freq DESC, concept LIMIT 50")
def word_freq(spark, sf):
    return analytics.word_frequency(analytics.concept_counts(docs(spark, sf)), 50)


@query(f"""WITH {TOKENS}, t AS (SELECT term, coalesce(sum(CASE WHEN subject = 'en' THEN 1 END), 0) AS l, coalesce(sum(CASE WHEN subject <> 'en' THEN 1 END), 0) AS r FROM tokens GROUP BY term),
    k AS (SELECT term, CAST(l AS BIGINT) AS left_cnt, CAST(r AS BIGINT) AS right_cnt, round_even(CAST(l AS DOUBLE) / greatest(r, 1), 3) AS ratio FROM t WHERE l > 0 AND r > 0)
    (SELECT *, 'high' AS part FROM k ORDER BY ratio DESC, term LIMIT 10) UNION ALL (SELECT *, 'low' AS part FROM k ORDER BY ratio, term LIMIT 10)""")
def coverage_pivot(spark, sf):
    c = analytics.concept_counts(docs(spark, sf))
    rows = c.select(F.col("concept").alias("term"), F.when(F.col("subject") == "en", "en").otherwise("other").alias("side"), "cnt")
    return analytics.coverage(rows, "en", "other", 10)


@query(f"""WITH {CONCEPTS}, s AS (SELECT DISTINCT subject FROM concepts), o AS (SELECT DISTINCT concept, subject FROM concepts)
    SELECT a.subject AS s1, b.subject AS s2, (SELECT count(*) FROM o x JOIN o y USING (concept) WHERE x.subject = a.subject AND y.subject = b.subject) AS shared FROM s a, s b""")
def heatmap_matrix(spark, sf):
    return analytics.heatmap(analytics.concept_counts(docs(spark, sf)))


@query(f"""WITH {CONCEPTS} SELECT a.subject AS s1, b.subject AS s2, CAST(sum(least(a.cnt, b.cnt)) AS BIGINT) AS weight, count(*) AS n_concepts
    FROM concepts a JOIN concepts b ON a.concept = b.concept AND a.subject < b.subject GROUP BY ALL""")
def cross_links(spark, sf):
    return analytics.cross_links(analytics.concept_counts(docs(spark, sf)))


@query(f"WITH {POSTS} SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM posts GROUP BY term")
def token_doc_freq(spark, sf):
    return analytics.doc_frequency(docs(spark, sf))


@query(f"""WITH {POSTS}, n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT term, ln((1.0::DOUBLE + any_value(n)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM posts, n GROUP BY term),
    m AS (SELECT max(idf) AS m FROM idf), w AS (SELECT id, term, tf, round(tf * idf / m, 6) AS weight FROM posts JOIN idf USING (term), m)
    SELECT id, term, tf, weight FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) <= 5""")
def tfidf_terms(spark, sf):
    d = docs(spark, sf)
    posts = materialize(lexical.postings(d), "postings")  # read three times below, made once
    n = d.count()
    idf = analytics.inverse_frequency(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n)
    w = analytics.weighted_terms(posts, idf).withColumn("weight", F.round("weight", 6))
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "term"))
    return w.withColumn("rn", rn).filter("rn <= 5").select("id", "term", "tf", "weight")


@query(f"""WITH {POSTS}, s AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM posts GROUP BY term)
    SELECT * FROM s WHERE NOT (df::DOUBLE / (SELECT count(*) FROM documents) > 0.12 AND tf::DOUBLE / df < 2)""")
def share_ceiling(spark, sf):
    d = docs(spark, sf)
    return analytics.share_ceiling(analytics.doc_frequency(d), d.count())


@query(f"""WITH {POSTS}, t AS (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY tf DESC, term) <= 8)
    SELECT x.term AS a, y.term AS b, count(*) AS weight FROM t x JOIN t y ON x.id = y.id AND x.term < y.term GROUP BY ALL""")
def cooccur_pairs(spark, sf):
    return analytics.cooccurrence(lexical.postings(docs(spark, sf)))


@query("""WITH r AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)*')) AS s FROM documents), c AS (SELECT lower(s) AS canonical, s, count(*) AS n FROM r GROUP BY ALL)
    SELECT canonical, s AS display, CAST(sum(n) OVER (PARTITION BY canonical) AS BIGINT) AS total FROM c
    QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY n DESC, regexp_matches(s, '[A-Z]') DESC, length(s) DESC, s DESC) = 1""")
def surface_mode(spark, sf):
    return analytics.surface_modes(docs(spark, sf))


@query("""SELECT 'license' AS label, count(*) FILTER (regexp_matches(text, 'License|CC BY')) AS n FROM documents
    UNION ALL SELECT 'table', count(*) FILTER (regexp_matches(text, '\\|')) FROM documents UNION ALL SELECT 'digits', count(*) FILTER (regexp_matches(text, '[0-9]{3}')) FROM documents""")
def pattern_counts(spark, sf):
    return analytics.pattern_counts(docs(spark, sf), "text", {"license": "License|CC BY", "table": r"\|", "digits": "[0-9]{3}"})


@query("""WITH c AS (SELECT l_returnflag AS grp, l_orderkey % 97 - l_linenumber AS "offset", count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT grp, "offset", n FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, "offset") = 1""")
def page_offset_mode(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") % 97).alias("i"), F.col("l_linenumber").alias("p"))
    return analytics.offset_mode(rows, "grp", "i", "p")


@query("""WITH r AS (SELECT o_orderpriority AS headword, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS kind, o_custkey AS question, 'g' || CAST(o_custkey % 40 AS VARCHAR) AS gloss, o_orderkey AS pos FROM orders),
    g0 AS (SELECT headword, gloss, min(pos) AS pos FROM r GROUP BY headword, gloss), g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY headword ORDER BY pos, gloss) <= 5),
    k AS (SELECT headword, string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY kind || ':' || CAST(n AS VARCHAR)) AS kinds FROM (SELECT headword, kind, count(*) AS n FROM r GROUP BY ALL) GROUP BY headword)
    SELECT r.headword, count(*) AS total, count(DISTINCT question) AS questions, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years, any_value(k.kinds) AS kinds,
      any_value((SELECT string_agg(gloss, '|' ORDER BY pos, gloss) FROM g WHERE g.headword = r.headword)) AS glosses FROM r JOIN k ON k.headword = r.headword GROUP BY r.headword""")
def exam_term_summary(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderpriority").alias("headword"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("kind"),
        F.col("o_custkey").alias("question"), F.concat(F.lit("g"), (F.col("o_custkey") % 40).cast("string")).alias("gloss"), F.col("o_orderkey").alias("pos"),
    )
    return analytics.occurrence_summary(rows)


# Joins, dictionary, registry


RANGES = "r AS (SELECT s_nationkey AS book_key, s_suppkey AS range_id, s_acctbal - 400 AS lo, s_acctbal + 400 AS hi FROM supplier), p AS (SELECT c_custkey AS id, c_nationkey AS book_key, c_acctbal AS page FROM customer)"


def _pages_and_ranges(spark, sf):
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("book_key"), F.col("c_acctbal").alias("page"))
    ranges = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("book_key"), F.col("s_suppkey").alias("range_id"), (F.col("s_acctbal") - 400).alias("lo"), (F.col("s_acctbal") + 400).alias("hi")
    )
    return pages, ranges


@query(f"WITH {RANGES} SELECT id, range_id FROM p JOIN r ON p.book_key = r.book_key AND page BETWEEN lo AND hi")
def interval_page_join(spark, sf):
    return dictionary.pages_by_bin(*_pages_and_ranges(spark, sf)).select("id", "range_id")


@query(f"WITH {RANGES} SELECT range_id, count(id) AS pages, min(id) AS first_page FROM r LEFT JOIN p ON p.book_key = r.book_key AND page BETWEEN lo AND hi GROUP BY range_id")
def range_page_scan(spark, sf):
    pages, ranges = _pages_and_ranges(spark, sf)
    hits = dictionary.pages_by_bin(pages, ranges).groupBy("range_id").agg(F.count("id").alias("pages"), F.min("id").alias("first_page"))
    return ranges.select("range_id").join(hits, "range_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))


@query("SELECT d.doc_id AS id, quality, toxic, quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def side_table_lookup(spark, sf):
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return docs(spark, sf).select("id").join(lab, "id", "left").withColumn("unlabelled", F.col("quality").isNull())


@query("SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def subject_family_rollup(spark, sf):
    n, r, c = (table(spark, sf, x) for x in ("nation", "region", "customer"))
    per = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).join(per, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""WITH reg AS (SELECT c_mktsegment || CAST(c_nationkey AS VARCHAR) AS k, count(*) AS n, min(c_custkey) AS entry FROM customer GROUP BY 1 HAVING count(*) = 1)
    SELECT s_suppkey AS id, entry FROM supplier LEFT JOIN reg ON k = 'BUILDING' || CAST(s_nationkey AS VARCHAR)""")
def registry_match_unique(spark, sf):
    reg = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("k"), F.col("c_custkey").alias("entry"))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("BUILDING"), F.col("s_nationkey").cast("string")).alias("k"))
    return dictionary.unique_match(rows, reg, "k").select("id", "entry")


IDENTITY = """e AS (SELECT p_partkey AS id, p_brand AS subject, p_type AS title, CAST(p_size AS VARCHAR) AS edition FROM part WHERE p_partkey % 2 = 1),
    p AS (SELECT p_partkey AS id, p_brand AS subject, p_type AS title, CAST(p_size AS VARCHAR) AS edition FROM part WHERE p_partkey % 2 = 0)"""


@query(f"""WITH {IDENTITY}, f AS (SELECT subject, title, edition, count(*) AS n, min(id) AS pid FROM p GROUP BY ALL), b AS (SELECT subject, title, count(*) AS n FROM p GROUP BY ALL)
    SELECT e.id, CASE WHEN f.n = 1 THEN 'bound' WHEN b.n > 0 THEN 'split' ELSE 'new' END AS status, CASE WHEN f.n = 1 THEN pid END AS primary_id
    FROM e LEFT JOIN f USING (subject, title, edition) LEFT JOIN b USING (subject, title)""")
def reconcile_identity(spark, sf):
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("title"), F.col("p_size").cast("string").alias("edition"))
    return dictionary.reconcile(b.filter("id % 2 = 1"), b.filter("id % 2 = 0"))


@query("""SELECT o_orderkey AS key, o_custkey AS pages, coalesce(r.flag, o_orderstatus) AS flag FROM orders
    LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS flag FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) r ON l_orderkey = o_orderkey""")
def review_merge(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("pages"), F.col("o_orderstatus").alias("flag"))
    r = table(spark, sf, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_returnflag").alias("flag"))
    return dictionary.merge_review(c, r)


@query("""WITH refs AS (SELECT s_suppkey AS ref, s_nationkey AS page, 'Customer#' AS title FROM supplier),
    pg AS (SELECT c_custkey AS id, c_name AS page_title, c_nationkey AS logical_page, CAST(c_custkey % 25 AS INTEGER) AS section FROM customer),
    m AS (SELECT ref, id, page = logical_page AS lp, CASE WHEN page_title = title THEN 100 WHEN starts_with(page_title, title) THEN 95 WHEN starts_with(title, page_title) THEN 90 WHEN contains(page_title, title) THEN 80 END AS score
          FROM refs JOIN pg ON page = logical_page OR page = section)
    SELECT ref, id, score FROM m WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref ORDER BY score DESC, lp DESC, id) = 1""")
def resolve_references(spark, sf):
    refs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ref"), F.col("s_nationkey").alias("page"), F.lit("Customer#").alias("title"))
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("logical_page"), (F.col("c_custkey") % 25).cast("int").alias("section"))
    return dictionary.resolve_reference(refs, pages)


@query("""SELECT source AS book_key, 'primary' AS origin FROM documents WHERE lang = 'en' GROUP BY 1
    UNION ALL SELECT source, 'extra' FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'en') GROUP BY 1""")
def books_union(spark, sf):
    d = docs(spark, sf)
    primary = d.filter("subject = 'en'").select("book_key").distinct().withColumn("origin", F.lit("primary"))
    return dictionary.books(primary, d.select("book_key").distinct().withColumn("origin", F.lit("extra")))


@query("SELECT l_shipdate IS NOT NULL AND l_returnflag = 'R' AS verified_flag, l_linestatus AS source, count(*) AS total FROM lineitem GROUP BY ALL")
def dictionary_status(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_shipdate").isNotNull() & (F.col("l_returnflag") == "R")).alias("verified_flag"), F.col("l_linestatus").alias("source")).agg(F.count(F.lit(1)).alias("total"))


# Selection

@query("""WITH q AS (SELECT doc_id AS id, lang, source, text, 2 * length(regexp_replace(text, '[^\\p{L}]', '', 'g')) + length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) + length(text) AS quality FROM documents)
    SELECT id, lang AS subject, source AS book_key, quality FROM q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY quality DESC, length(text) DESC, id) = 1""")
def keep_best_page(spark, sf):
    return etl.keep_best_page(docs(spark, sf), ["subject", "book_key"]).select("id", "subject", "book_key", "quality")


@query("SELECT doc_id AS id, 2 * length(regexp_replace(text, '[^\\p{L}]', '', 'g')) + length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) + length(text) AS quality FROM documents")
def page_quality(spark, sf):
    return docs(spark, sf).select("id", tx.page_quality(F.col("text")).alias("quality"))


@query("""SELECT doc_id AS id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS mark FROM documents
    QUALIFY row_number() OVER (PARTITION BY md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) ORDER BY length(text) DESC, doc_id) = 1""")
def dedupe_fingerprint(spark, sf):
    return etl.dedupe_by_fingerprint(docs(spark, sf)).select("id", "mark")


@query("SELECT min(o_orderkey) AS id, o_custkey, o_orderstatus, o_orderpriority FROM orders GROUP BY ALL EXCEPT SELECT NULL, NULL, NULL, NULL")
def dedupe_composite(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    return selection.first_by(o, ["o_custkey", "o_orderstatus", "o_orderpriority"], [F.col("id")]).select("id", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("""WITH a AS (SELECT o_custkey AS id, o_totalprice AS rank, 0 AS grp FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice, 1 FROM orders WHERE o_orderstatus <> 'F')
    SELECT id, rank, grp FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY grp, rank) = 1""")
def merge_first_wins(spark, sf):
    o = table(spark, sf, "orders")
    take = lambda c: o.filter(c).select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("rank"))
    return selection.merge_groups([take("o_orderstatus = 'F'"), take("o_orderstatus <> 'F'")])


@query("SELECT o_custkey AS id, o_totalprice AS base_score, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def keep_max_per_id(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("base_score"), F.col("o_orderkey").alias("seq"))
    return selection.first_by(o, ["id"], [F.desc("base_score"), F.col("seq")])


@query("""WITH r AS (SELECT doc_id AS id, lang AS subject, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS group_total FROM documents)
    SELECT CAST(rn AS INTEGER) AS rn, id, subject, n_chars, group_total FROM r WHERE rn <= 2""")
def top2_per_subject(spark, sf):
    return selection.top_per_group(docs(spark, sf).select("id", "subject", "n_chars"), "subject", [F.desc("n_chars"), F.col("id")], 2)


RANKED = "r AS (SELECT lang AS scope, source AS book, n_chars // 500 AS page, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents)"


def _ranked(spark, sf):
    pos = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n_chars"), "id"))
    return docs(spark, sf).select(F.col("subject").alias("scope"), F.col("book_key").alias("book"), F.floor(F.col("n_chars") / 500).alias("page"), "id", pos.alias("pos"))


@query(f"""WITH {RANKED}, a AS (SELECT *, row_number() OVER (PARTITION BY scope, book, page ORDER BY pos) <= 2 AS okp FROM r),
    b AS (SELECT *, sum(okp::INT) OVER (PARTITION BY scope, book ORDER BY pos) AS rb FROM a), c AS (SELECT *, okp AND rb <= 3 AS allowed FROM b)
    SELECT scope, book, page, id, CAST(pos AS INTEGER) AS pos, allowed, CAST(row_number() OVER (PARTITION BY scope ORDER BY allowed DESC, pos) AS INTEGER) AS final_pos FROM c""")
def reorder_caps(spark, sf):
    return selection.reorder_with_caps(_ranked(spark, sf), "book", "page", 2, 3)


@query(f"""WITH {RANKED}, a AS (SELECT *, row_number() OVER (PARTITION BY scope, book ORDER BY pos) AS rn, min(pos) OVER (PARTITION BY scope, book) AS bf FROM r),
    b AS (SELECT *, CASE WHEN rn = 1 THEN 1 WHEN rn <= 3 THEN 2 ELSE 3 END AS step FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY step, CASE WHEN step < 3 THEN bf ELSE pos END, rn) AS place FROM b)
    SELECT scope, id, step, CAST(place AS INTEGER) AS place FROM c WHERE place <= 40""")
def book_diversity(spark, sf):
    return selection.diverse(_ranked(spark, sf), "book", 3, 40).select("scope", "id", "step", "place")


ISLANDS = "d AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey AS v FROM lineitem), i AS (SELECT grp, v, v - row_number() OVER (PARTITION BY grp ORDER BY v) AS k FROM d), runs AS (SELECT grp, min(v) AS run_start, max(v) AS run_end, count(*) AS n FROM i GROUP BY grp, k)"


def _runs(spark, sf):
    return selection.islands(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_orderkey").alias("v")), "grp", "v")


@query(f"""WITH {ISLANDS} SELECT grp, string_agg(CASE WHEN run_start = run_end THEN CAST(run_start AS VARCHAR) ELSE CAST(run_start AS VARCHAR) || '-' || CAST(run_end AS VARCHAR) END, ',' ORDER BY run_start) AS pages FROM runs GROUP BY grp""")
def islands_compress(spark, sf):
    return selection.page_ranges(_runs(spark, sf), "grp")


@query("SELECT DISTINCT l_suppkey AS grp, l_orderkey AS page FROM lineitem")
def islands_expand(spark, sf):
    return selection.expand_ranges(selection.page_ranges(_runs(spark, sf), "grp"), "pages").select("grp", "page")


@query("SELECT o_custkey AS grp, o_orderkey AS start, greatest(o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, o_orderkey)) AS span_end FROM orders")
def lead_spans(spark, sf):
    return selection.lead_spans(table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("start")), "grp", "start")


@query("SELECT p_partkey AS id, unnest(range(greatest(1, p_size - 2), least(50, p_size + 2) + 1)) AS context_page FROM part")
def page_context_window(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("page"), F.lit(1).cast("long").alias("lo"), F.lit(50).cast("long").alias("hi"))
    return selection.context_pages(p, "page", "lo", "hi", 2).select("id", "context_page")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b""")
def adjacent_dedupe(spark, sf):
    return selection.drop_adjacent_repeats(table(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "user_id", "event_type")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations""")
def section_headers(spark, sf):
    c = table(spark, sf, "conversations")
    return selection.sections(c, "conv_id", "turn", F.col("role") == "user", "text").select("conv_id", "turn", "header")


@query("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
    SELECT id, pos::INTEGER AS pos, length(line) AS n, length(lag(line) OVER w) AS n_before, length(lead(line) OVER w) AS n_after FROM l WINDOW w AS (PARTITION BY id ORDER BY pos)""")
def neighbour_lines(spark, sf):
    size = lambda c: F.length(c).cast("long")
    return etl.flagged_lines(docs(spark, sf)).select("id", "pos", size("line").alias("n"), size("before").alias("n_before"), size("after").alias("n_after"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS age FROM conversations)
    SELECT conv_id, turn, CAST(age AS INTEGER) AS age, CASE WHEN age <= 2 THEN text ELSE substr(text, 1, 60) END AS text FROM m WHERE age <= 4""")
def chat_history_tail(spark, sf):
    return logs.history_tail(table(spark, sf, "conversations"), 4, 2, 60).select("conv_id", "turn", "age", "text")


@query("SELECT c_custkey AS id, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def pagination(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "id").offset(40).limit(20).drop("c_acctbal")


# Vectors

def _first_vector(spark, sf):
    v = table(spark, sf, "embeddings")
    return v, v.filter("vec_id = 0").first()["embedding"]


DOT = "list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT v.vec_id, round({DOT}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0 ORDER BY {DOT} DESC, v.vec_id LIMIT 20")
def vector_topk(spark, sf):
    v, q = _first_vector(spark, sf)
    return vector.top_k(v, q, 20).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT v.vec_id, round({DOT}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0 AND v.label = 3 AND {DOT} > 0.05 ORDER BY {DOT} DESC, v.vec_id LIMIT 20")
def vector_topk_filtered(spark, sf):
    v, q = _first_vector(spark, sf)
    return vector.top_k(v, q, 20, 0.05, F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT q.vec_id AS query_id, v.vec_id, round({DOT}, 6) AS score FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DOT} DESC, v.vec_id) <= 3""")
def knn_per_group(spark, sf):
    v = table(spark, sf, "embeddings")
    return vector.neighbours(v.filter("vec_id % 50 = 0"), v, 3, "label").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"""SELECT q.vec_id AS query_id, v.vec_id, round({DOT}, 6) AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {DOT} DESC, v.vec_id) <= 5""")
def knn_all(spark, sf):
    v = table(spark, sf, "embeddings")
    return vector.nearest_in_blocks(v.filter("vec_id % 50 = 0"), v, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


# Planning, fusion, scoring

@query("""SELECT term, primary_hits, extra_hits, CAST((CASE WHEN term = 'thenation' THEN 240 ELSE 0 END) + (CASE WHEN contains('thenation', term) THEN length(term) * 24 + 40
      + (CASE WHEN starts_with('thenation', term) THEN 45 ELSE 0 END) + (CASE WHEN ends_with('thenation', term) THEN 65 ELSE 0 END) + (CASE WHEN length(term) >= 4 THEN 30 ELSE 0 END) ELSE length(term) * 12 END)
      + least(h, 6) * 10 + (CASE WHEN extra_hits > 0 AND primary_hits <= 0 THEN 22 ELSE 0 END) + (CASE WHEN h <= 4 THEN (5 - h) * 8 ELSE 0 END) - (CASE WHEN h > 12 THEN least(60, (h - 12) * 2) ELSE 0 END) AS BIGINT) AS score
    FROM (SELECT term, (SELECT count(*) FROM documents WHERE lang = 'en' AND contains(text, term)) AS primary_hits, (SELECT count(*) FROM documents WHERE lang <> 'en' AND contains(text, term)) AS extra_hits,
      (SELECT count(*) FROM documents WHERE contains(text, term)) AS h FROM (VALUES ('the'), ('then'), ('nation'), ('thenation'), ('heit'), ('zzz')) t(term)) WHERE h > 0""")
def query_terms_fallback_score(spark, sf):
    terms = ["the", "then", "nation", "thenation", "heit", "zzz"]
    d = docs(spark, sf)
    sums = d.agg(*[F.count_if(F.col("text").contains(t) & ((F.col("subject") == "en") == en)).alias(f"c{i}_{int(en)}") for i, t in enumerate(terms) for en in (True, False)])
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c{i}_1").alias("primary_hits"), F.col(f"c{i}_0").alias("extra_hits")) for i, t in enumerate(terms)])
    return query_plan.fallback_scores(sums.select(F.explode(rows).alias("r")).select("r.*"), "thenation")


PLAN = [("reanti", "exact"), ("tion", "phrase"), ("heit", "fallback")]


@query("""WITH p AS (SELECT doc_id AS id, CASE WHEN contains(lower(text), 'reanti') THEN 0 WHEN contains(lower(text), 'tion') THEN 1 WHEN contains(lower(text), 'heit') THEN 2 END AS priority, lower(text) AS t FROM documents),
    h AS (SELECT id, priority, (['reanti', 'tion', 'heit'])[priority + 1] AS term, t FROM p WHERE priority IS NOT NULL),
    c AS (SELECT id, priority, term, (length(t) - length(replace(t, term, ''))) // length(term) AS hits FROM h)
    SELECT id, term, hits, 420 - 24 * priority + least(90, 18 * hits) + least(24, 3 * length(term)) AS score FROM c""")
def supplemental_rank(spark, sf):
    return query_plan.first_plan_term(docs(spark, sf), PLAN).select("id", "term", "hits", "score")


@query("""WITH l AS (SELECT doc_id AS id, 168.0::DOUBLE - 10 * p.prio + p.bonus + 44 AS base_score, 0.0::DOUBLE AS semantic_score, p.term, 'exact' AS channel FROM documents JOIN (VALUES (0, 'reanti', 54.0::DOUBLE), (1, 'tion', 44.0::DOUBLE), (2, 'heit', 24.0::DOUBLE)) p(prio, term, bonus) ON contains(text, p.term)),
    s AS (SELECT v.vec_id AS id, 164.0::DOUBLE AS base_score, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS semantic_score, 'vector' AS term, 'semantic' AS channel FROM embeddings v, embeddings q WHERE q.vec_id = 0 ORDER BY list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 50)
    SELECT id, base_score, semantic_score, term, channel FROM (SELECT * FROM l UNION ALL SELECT * FROM s) QUALIFY row_number() OVER (PARTITION BY id ORDER BY base_score DESC, semantic_score DESC, channel, term) = 1""")
def hybrid_fusion(spark, sf):
    d = docs(spark, sf)
    hits = F.filter(F.array(*[F.when(F.col("text").contains(t), F.struct(F.lit(i).alias("p"), F.lit(t).alias("t"), F.lit(b).alias("b"))) for i, (t, b) in enumerate(PLAN)]), lambda x: x.isNotNull())
    lex = d.select("id", F.explode(hits).alias("h")).select(
        "id", fusion.lexical_base(F.col("h.p"), F.col("h.b"), F.lit("exact")).alias("base_score"), F.lit(0.0).alias("semantic_score"), F.col("h.t").alias("term"), F.lit("exact").alias("channel")
    )
    v, q = _first_vector(spark, sf)
    sem = vector.top_k(v, q, 50).select(F.col("vec_id").alias("id"), F.lit(164.0).alias("base_score"), F.round("score", 6).alias("semantic_score"), F.lit("vector").alias("term"), F.lit("semantic").alias("channel"))
    return fusion.fuse([lex, sem])


@query("""WITH r AS (SELECT doc_id AS id, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM documents),
    s AS (SELECT id, t, (contains(t, 'th')::INT + contains(t, 'he')::INT + contains(t, 'en')::INT + contains(t, 'na')::INT + contains(t, 'at')::INT) / 5.0::DOUBLE AS big, (contains(t, 't')::INT + contains(t, 'h')::INT + contains(t, 'e')::INT + contains(t, 'n')::INT + contains(t, 'a')::INT) / 5.0::DOUBLE AS ch FROM r)
    SELECT id, round(CASE WHEN t = '' THEN 0.0::DOUBLE ELSE greatest(-18.0::DOUBLE, least(68.0::DOUBLE, (CASE WHEN contains(t, 'thenat') THEN 42 ELSE 0 END) + big * 28 + ch * 18 - (CASE WHEN ch < 0.42 THEN 18 ELSE 0 END))) END, 6) AS bonus FROM s""")
def coverage_bonus(spark, sf):
    flat = F.regexp_replace(F.lower("text"), r"\s+", "")
    return docs(spark, sf).select("id", F.round(fusion.coverage_bonus("thenat", flat), 6).alias("bonus"))


@query("""WITH r AS (SELECT doc_id AS id, text, lang, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents),
    s AS (SELECT id, text, least(35, (CASE WHEN list_contains(w, 'the') THEN 2 ELSE 0 END) + (CASE WHEN list_contains(w, 'that') THEN 3 ELSE 0 END) + (CASE WHEN list_contains(w, 'of') THEN 1 ELSE 0 END))
      + least(40, (CASE WHEN list_contains(w, 'with') THEN 8 ELSE 0 END) + (CASE WHEN list_contains(w, 'and') THEN 6 ELSE 0 END)) + (CASE WHEN lang = 'en' THEN 15 ELSE 0 END) AS s FROM r)
    SELECT id, CAST(least(100, CASE WHEN length(text) < 50 THEN greatest(0, s - 20) ELSE s END) AS BIGINT) AS score FROM s""")
def score_result(spark, sf):
    return docs(spark, sf).select("id", fusion.relevance(tx.words(F.col("text")), F.col("text"), ["the", "that", "of"], ["with", "and"], F.col("subject") == "en").alias("score"))


@query("""WITH p AS (SELECT 'the' AS term, doc_id AS id, -n_chars AS rank FROM documents WHERE contains(text, 'the') UNION ALL SELECT 'tion', doc_id, -n_chars FROM documents WHERE contains(text, 'tion')),
    k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY rank, id) <= 20) SELECT term, id, rank FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, term) = 1""")
def quota_per_term(spark, sf):
    d = docs(spark, sf)
    found = F.filter(F.array(*[F.when(F.col("text").contains(t), F.lit(t)) for t in ("the", "tion")]), lambda x: x.isNotNull())
    return fusion.quota_per_term(d.select(F.explode(found).alias("term"), "id", (-F.col("n_chars")).alias("rank")), 40, 2)


@query("""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents), n AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w), m AS (SELECT id, w, i, unnest(range(1, least(6, len(w) - i + 1) + 1)) AS n FROM n),
    p AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM m)
    SELECT id, count(*) AS n, md5(string_agg(phrase, '|' ORDER BY phrase)) AS digest FROM p GROUP BY id""")
def token_phrases(spark, sf):
    return lexical.phrase_digests(docs(spark, sf), 6)


# Graphs

@query(f"""WITH {POSTS}, h AS (SELECT id FROM posts WHERE term = 'with' ORDER BY tf DESC, id LIMIT 100), c AS (SELECT term FROM posts GROUP BY term HAVING count(*) BETWEEN 3 AND 400)
    SELECT term, count(*) AS n_docs FROM posts WHERE id IN (SELECT id FROM h) AND term IN (SELECT term FROM c) AND term <> 'with' GROUP BY term HAVING count(*) >= 2 ORDER BY n_docs DESC, term LIMIT 20""")
def related_terms(spark, sf):
    d = docs(spark, sf)
    hits = lexical.best_rows(d, "with", 100)
    posts = lexical.postings(d.join(F.broadcast(hits), "id", "left_semi")).filter(F.col("term") != "with")
    df = lexical.postings(d).join(posts.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return graph.related_terms(posts, df.filter(F.col("df").between(3, 400)).select("term"), 20)


@query(f"""WITH {POSTS} SELECT a.term AS t1, b.term AS t2, count(*) AS weight FROM posts a JOIN posts b ON a.id = b.id AND a.term < b.term
    WHERE a.term IN ('the', 'that', 'und', 'les') AND b.term IN ('the', 'that', 'und', 'les') GROUP BY ALL HAVING count(*) >= 2""")
def subject_pair_cooccur(spark, sf):
    return graph.pair_cooccurrence(lexical.postings(docs(spark, sf)), WORDS)


@query(f"""WITH {CLUSTERS}, t AS (SELECT min(concept) AS c FROM clusters) SELECT concept, count(DISTINCT cluster) AS shared_clusters, min(subject) AS subject
    FROM clusters WHERE cluster IN (SELECT cluster FROM clusters, t WHERE concept = t.c) AND concept <> (SELECT c FROM t) GROUP BY concept""")
def cluster_siblings(spark, sf):
    c = clusters(spark, sf)
    return graph.siblings(c, c.agg(F.min("concept")).first()[0])


@query(f"""WITH {CLUSTERS} SELECT cluster, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects, count(DISTINCT concept) AS n_concepts, count(DISTINCT subject) AS n_subjects FROM clusters GROUP BY cluster HAVING count(DISTINCT subject) >= 2""")
def cluster_summary(spark, sf):
    return graph.cluster_summary(clusters(spark, sf))


@query(f"""WITH {POSTS}, h AS (SELECT id FROM posts WHERE term = 'with'), m AS (SELECT term AS target, count(*) AS weight, 2 AS priority FROM posts WHERE id IN (SELECT id FROM h) AND term <> 'with' GROUP BY term HAVING count(*) >= 2),
    cl AS (SELECT DISTINCT substr(term, 1, 3) AS cluster, term AS concept FROM posts WHERE length(term) >= 4),
    s AS (SELECT concept AS target, count(DISTINCT cluster) AS weight, 1 AS priority FROM cl WHERE cluster IN (SELECT cluster FROM cl WHERE concept = 'with') AND concept <> 'with' GROUP BY concept)
    SELECT target, weight, priority FROM (SELECT * FROM m UNION ALL SELECT * FROM s) QUALIFY row_number() OVER (PARTITION BY target ORDER BY priority) = 1 ORDER BY priority, weight DESC, target LIMIT 15""")
def ego_graph_edges(spark, sf):
    """Words that begin alike are a cluster."""
    posts = materialize(lexical.postings(docs(spark, sf)), "postings")
    words = posts.filter(F.length("term") >= 4).select(F.substring("term", 1, 3).alias("cluster"), F.col("term").alias("concept"), F.lit("").alias("subject")).distinct()
    return graph.ego_graph(graph.siblings(words, "with"), graph.comentions("with", posts))


RELATIONS = "r AS (SELECT CAST(o_custkey % 60 AS VARCHAR) AS a, CAST(o_orderkey % 60 AS VARCHAR) AS b, o_orderpriority AS kind, o_orderdate AS ts FROM orders)"


def _relations(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 60).cast("string").alias("a"), (F.col("o_orderkey") % 60).cast("string").alias("b"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("ts"))


@query(f"WITH {RELATIONS} SELECT least(a, b) AS x, greatest(a, b) AS y, kind, ts FROM r QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ts DESC, kind) = 1")
def relation_pairs(spark, sf):
    return graph.unordered_pairs(_relations(spark, sf))


@query(f"""WITH {RELATIONS}, p AS (SELECT least(a, b) AS x, greatest(a, b) AS y, kind, ts FROM r QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ts DESC, kind) = 1)
    SELECT CASE WHEN x IN ('1', '2', '3') THEN x ELSE y END AS anchor, CASE WHEN x IN ('1', '2', '3') THEN y ELSE x END AS related, kind, ts, CASE WHEN x IN ('1', '2', '3') AND y IN ('1', '2', '3') THEN 1 ELSE 2 END AS priority
    FROM p WHERE x IN ('1', '2', '3') OR y IN ('1', '2', '3') ORDER BY priority, ts DESC, anchor, related LIMIT 12""")
def relation_hints(spark, sf):
    return graph.relation_hints(_relations(spark, sf), ["1", "2", "3"])


# Document processing, integrity, logs

@query("""WITH a AS (SELECT page_id, regexp_replace(html, '(?i)<br\\s*/?>|</p>', chr(10), 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
    SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ') AS text FROM c""")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


@query("SELECT doc_id AS id, 'supp:' || substr(md5(source || ':' || CAST(doc_id AS VARCHAR)), 1, 16) AS record_id FROM documents")
def record_ids(spark, sf):
    return docs(spark, sf).select("id", tx.short_id("supp:", F.col("book_key"), F.col("id")).alias("record_id"))


@query()
def ocr_merge_blocks(spark, sf):
    d = docs(spark, sf).select(F.col("book_key").alias("path"), F.col("id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return selection.merge_blocks(d).select("path", "page", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("SELECT lang AS subject, count(DISTINCT source) AS books, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def build_stats(spark, sf):
    return etl.build_stats(docs(spark, sf))


@query("SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS n_flags FROM part GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT p_size) > 1")
def conflict_groups(spark, sf):
    return etl.conflicts(table(spark, sf, "part"), ["p_brand", "p_type"], "p_size")


@query("SELECT DISTINCT d.doc_id AS doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing_keys(spark, sf):
    return integrity.missing_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT doc_id // 1000 AS chunk, sha256(string_agg(sha256(CAST(doc_id AS VARCHAR) || ':' || text), chr(10) ORDER BY doc_id)) AS digest, count(*) AS n_rows FROM documents GROUP BY 1""")
def ordered_sha(spark, sf):
    return integrity.digest_tree(table(spark, sf, "documents"), "doc_id", "text")


@query()
def table_fingerprint(spark, sf):
    return integrity.manifest({n: table(spark, sf, n) for n in ("documents", "orders", "lineitem", "conversations")})


@query("SELECT doc_id AS id, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def page_offsets(spark, sf):
    lines = docs(spark, sf).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return integrity.prefix_offsets(lines, "id", "pos", "line").select("id", "pos", "offset")


@query(f"""WITH {LOGS} SELECT query_normalized, max(ts) AS last_ts, max(result_count) AS best_count, arg_max(query, row(result_count, ts, query)) AS query FROM logs GROUP BY query_normalized ORDER BY last_ts DESC, query_normalized LIMIT 20""")
def trending_recent(spark, sf):
    return logs.trending_recent(query_logs(spark, sf), 20)


@query(f"""WITH {LOGS} SELECT query_normalized, count(*) AS freq FROM logs WHERE ts > (SELECT max(ts) FROM logs) - INTERVAL 7 DAY GROUP BY query_normalized HAVING count(*) >= 2 ORDER BY freq DESC, query_normalized LIMIT 20""")
def trending_popular(spark, sf):
    return logs.trending_popular(query_logs(spark, sf), 20)


@query(f"WITH {LOGS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS searches, count(DISTINCT user_id) AS users, count(*) FILTER (result_count = 0) AS zero_hits FROM logs GROUP BY 1")
def daily_activity(spark, sf):
    return logs.daily_activity(query_logs(spark, sf))


@query(f"WITH {LOGS} SELECT event_type, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed FROM logs GROUP BY event_type")
def provider_success(spark, sf):
    return logs.success_by(query_logs(spark, sf), "event_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"""WITH {LOGS}, w AS (SELECT query_normalized, unnest(range(0, 7)) AS i, date_trunc('day', ts) AS d FROM logs) SELECT CAST(d - to_days(CAST(i AS INTEGER)) AS TIMESTAMP) AS window_start, query_normalized, count(*) AS freq FROM w GROUP BY ALL""")
def windowed_trending(spark, sf):
    out = trending.windowed_counts(query_logs(spark, sf))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Linking and chat context

@query("""WITH d AS (SELECT doc_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
    SELECT id, length(t) >= 40 AND (regexp_matches(t, '[。！？；.!?]') OR regexp_matches(t, '[，、：:;；,]') AND length(t) >= 80) AS signal FROM d""")
def high_signal_chunks(spark, sf):
    return docs(spark, sf).select("id", linking.high_signal(F.col("text")).alias("signal"))


@query("""WITH d AS (SELECT doc_id AS id, source, contains(text, '$$$') AS keep FROM documents), a AS (SELECT *, bool_or(keep) OVER (PARTITION BY source) AS any_kept FROM d) SELECT id, source FROM a WHERE keep OR NOT any_kept""")
def filter_with_fallback(spark, sf):
    rows = docs(spark, sf).select("id", F.col("book_key").alias("source"), "text")
    return linking.with_fallback(rows, F.col("text").contains("$$$"), ["source"]).select("id", "source")


@query(f"""WITH {TOKENS}, c AS (SELECT * FROM (VALUES ('the'), ('of the'), ('that'), ('und der'), ('der')) v(concept)), w AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(text), '\\p{{L}}+'), ' ') || ' ' AS t FROM documents),
    m AS (SELECT DISTINCT id, concept FROM w JOIN c ON contains(t, ' ' || concept || ' ')) SELECT id, concept FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.id = m.id AND o.concept <> m.concept AND contains(o.concept, m.concept))""")
def concept_matches(spark, sf):
    c = spark.createDataFrame([(x,) for x in ("the", "of the", "that", "und der", "der")], "concept string")
    return linking.match_concepts(docs(spark, sf), c)


@query(f"""WITH {CLUSTERS}, q AS (SELECT p_partkey AS id, p_type AS concept FROM part)
    SELECT DISTINCT q.id, q.concept, o.concept AS expanded FROM q JOIN clusters c ON c.concept = q.concept JOIN clusters o ON o.cluster = c.cluster WHERE o.concept <> q.concept""")
def cross_subject_expansion(spark, sf):
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("concept"))
    return linking.expand_through_clusters(q, clusters(spark, sf).select("cluster", "concept").distinct())


@query("""WITH w AS (SELECT doc_id AS id, lang AS subject, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents), posts AS (SELECT id, subject, term, count(*) AS tf FROM w GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    t AS (SELECT p.id AS qid, p.subject AS qsubject, p.term FROM posts p JOIN df USING (term) WHERE p.id % 50 = 0 AND length(term) >= 3 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY tf::DOUBLE / df DESC, term) <= 30),
    s AS (SELECT qid, qsubject, p.id, p.subject, count(*) AS n_terms FROM t JOIN posts p ON p.term = t.term AND p.id <> t.qid GROUP BY ALL),
    k AS (SELECT *, subject = qsubject AS same_subject, CAST(least(35, 6 * n_terms) + CASE WHEN subject = qsubject THEN 15 ELSE 0 END AS BIGINT) AS score FROM s)
    SELECT qid, id, same_subject, score, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY qid, same_subject ORDER BY score DESC, n_terms DESC, id) AS rn FROM k WHERE score >= 15) WHERE rn <= 5""")
def exam_textbook_links(spark, sf):
    d = docs(spark, sf)
    return linking.link_by_terms(d.filter("id % 50 = 0"), d, 30, 15, 5)


@query()
def chat_search_terms(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return linking.chat_terms(c, ["the", "and", "of", "die", "der", "les", "des"]).select("id", F.array_join("terms", "|").alias("terms"))


@query("""WITH r AS (SELECT doc_id AS id, lang AS subject, source AS title, n_chars AS page, text, count(*) OVER (PARTITION BY lang) AS group_total, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents)
    SELECT subject, group_total, string_agg('[' || subject || '·' || title || '·p' || CAST(page AS VARCHAR) || '] ' || substr(text, 1, 60), chr(10) ORDER BY rn) AS context FROM r WHERE rn <= 2 GROUP BY ALL""")
def chat_context_groups(spark, sf):
    rows = docs(spark, sf).select("id", "subject", F.col("book_key").alias("title"), F.col("n_chars").alias("page"), "text")
    return linking.context_groups(rows)


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand = 'Brand#11' OR (p_type LIKE 'PROMO%' AND p_brand = 'Brand#12') ELSE p_brand = 'Brand#11' END AS shown FROM part""")
def edition_policy(spark, sf):
    p = table(spark, sf, "part")
    edition = F.when(F.col("p_brand") == "Brand#11", policy.MAIN_EDITION).when(F.col("p_brand") == "Brand#12", "鲁科版").otherwise("other")
    subject = F.when(F.col("p_type").startswith("PROMO"), "化学").otherwise("语文")
    phase = F.when(F.col("p_size") % 2 == 0, "高中").otherwise("初中")
    return p.select(F.col("p_partkey").alias("id"), policy.edition_allowed(phase, subject, edition).alias("shown"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, md5(event_type || ':' || CAST(user_id AS VARCHAR)) AS digest FROM events""")
def record_digests(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.md5(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).alias("digest"))


@query("""SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z]+ License|License, Version [0-9.]+')) AS mark FROM documents""")
def emphasis_tokens(spark, sf):
    return docs(spark, sf).select("id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ License|License, Version [0-9.]+"), F.lit(0))).alias("mark"))


@query("""WITH s AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) % 3 AS number FROM s)
    SELECT id, CAST(number AS BIGINT) AS number, line FROM u QUALIFY row_number() OVER (PARTITION BY id, number ORDER BY length(line) DESC, line) = 1""")
def longest_sections(spark, sf):
    lines = docs(spark, sf).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    rows = lines.select("id", ((F.col("pos") + 1) % 3).cast("long").alias("number"), "text")
    return etl.longest_section(rows).withColumnRenamed("text", "line")


@query("""SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, max(l_linenumber) AS max_section, count(DISTINCT l_linenumber) AS sections FROM lineitem GROUP BY 1""")
def book_sections(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("qty"), F.max("l_linenumber").alias("max_section"), F.count_distinct("l_linenumber").alias("sections")
    )
