"""Registered queries on tables of queries: batched full text, links of questions and pages, and query analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import linking, query_analysis, question_links, ranked, vector
from quillon.plans.catalogue import DOT, docs, query
from quillon.session import materialize, table

# SQL of the full-text scores of tables of terms, in whole millionths.
IMPACTS = """tokens AS (SELECT doc_id AS id, lang AS subject, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents),
    posts AS (SELECT term, id, subject, count(*) AS tf FROM tokens GROUP BY ALL),
    dl AS (SELECT id, count(*) AS dl FROM tokens GROUP BY id),
    st AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS avgdl),
    dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df, greatest(CAST(1e-6 AS DOUBLE), ln((any_value(n) - count(*) + CAST(0.5 AS DOUBLE)) / (count(*) + CAST(0.5 AS DOUBLE)))) AS idf FROM posts, st GROUP BY term),
    imp AS (SELECT p.term, p.id, p.subject, tf, idf, CAST(round(idf * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)) * 1000000) AS BIGINT) AS impact
      FROM posts p JOIN dfs USING (term) JOIN dl USING (id), st)"""
WEIGHTED = "wt AS (SELECT id AS qid, subject AS qsubject, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * idf, 9) DESC, term) AS place FROM imp WHERE id % 50 = 0 AND length(term) >= 3)"


def _index(spark, sf):
    return ranked.build_index(docs(spark, sf))


@query(f"""WITH {IMPACTS}, {WEIGHTED}, s AS (SELECT qid, i.id, sum(impact) AS score FROM wt JOIN imp i ON i.term = wt.term AND i.id <> qid WHERE place <= 12 GROUP BY ALL)
    SELECT qid, id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""")
def bm25_many(spark, sf):
    """The 20 best rows for each row whose id 50 divides, by its 12 weightiest words."""
    index = _index(spark, sf)
    terms = ranked.weighted_terms(index, docs(spark, sf).filter("id % 50 = 0"), 12)
    return ranked.top_k_in_blocks(index, terms, 20).select("qid", "id", "score", "rank")


# Links. Concepts are long words that some rows of a subject share; clusters are those that begin alike.
# What is known of a question: its three longest words, and references to the three rows after it.

_LINKS = f"""{IMPACTS}, {WEIGHTED},
    concepts AS (SELECT DISTINCT term AS concept FROM (SELECT term, subject FROM posts WHERE length(term) >= 7 GROUP BY ALL HAVING count(*) >= 5)),
    found AS (SELECT DISTINCT id AS qid, concept FROM posts JOIN concepts ON concept = term WHERE id % 50 = 0),
    named AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.qid = f.qid AND o.concept <> f.concept AND contains(o.concept, f.concept))),
    mc AS (SELECT qid, concept AS term, row_number() OVER (PARTITION BY qid ORDER BY length(concept) DESC, concept) AS place FROM named),
    points AS (SELECT id AS qid, term, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS place FROM posts WHERE id % 50 = 0 QUALIFY place <= 3),
    near AS (SELECT qid, id, place, score FROM (SELECT q.vec_id AS qid, v.vec_id AS id, {DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DOT} DESC, v.vec_id) AS place
      FROM embeddings v JOIN embeddings q ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE place <= 20 AND score > 0.62)"""


def _firsts(name: str, parts: list[tuple[str, int]], n: int) -> str:
    union = " UNION ALL ".join(f"SELECT qid, term, {i} AS priority, place FROM {t} WHERE place <= {most}" for i, (t, most) in enumerate(parts))
    return f"""{name}_u AS ({union}), {name}_o AS (SELECT qid, term, min((priority, place)) AS seat FROM {name}_u GROUP BY ALL),
    {name} AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY seat, term) AS place FROM {name}_o QUALIFY place <= {n})"""


_TEXTS = "words AS (SELECT doc_id AS id, lang AS subject, length(coalesce(text, '')) AS n, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS ws FROM documents)"
_POINTS = """CAST(least(100, CASE WHEN n < 50 THEN greatest(0, p) ELSE p END) AS BIGINT)"""


def _sides(spark, sf, index):
    d = table(spark, sf, "documents")
    pages = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("source").alias("title"), F.col("n_chars").alias("page"), "text")
    shared = index.spread.filter(F.length("term") >= 7).filter("rows >= 5")
    concepts = shared.select(F.col("term").alias("concept")).distinct()
    v = table(spark, sf, "embeddings")
    near = vector.nearest_in_blocks(v.filter("vec_id % 50 = 0"), v, 20).filter("score > 0.62").select(F.col("query_id").alias("qid"), F.col("vec_id").alias("id"), F.col("rank").alias("place"))
    return pages, pages.filter("id % 50 = 0"), concepts, near


@query(f"""WITH {_LINKS}, {_firsts("wanted", [("points", 6), ("wt", 8), ("mc", 5)], 12)}, {_firsts("st_terms", [("points", 6), ("wt", 10)], 15)}, {_firsts("st_concepts", [("points", 6), ("mc", 8)], 14)}, {_TEXTS},
    bm AS (SELECT qid, i.id, sum(impact) AS s FROM wanted JOIN imp i ON i.term = wanted.term AND i.id <> qid GROUP BY ALL),
    explicit AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS seat FROM bm QUALIFY seat <= 30),
    refs AS (SELECT q.doc_id AS qid, r.doc_id - q.doc_id - 1 AS place, r.lang, r.source, r.n_chars FROM documents q JOIN documents r ON r.doc_id BETWEEN q.doc_id + 1 AND q.doc_id + 3 WHERE q.doc_id % 50 = 0),
    resolved AS (SELECT qid, place, arg_min(d.doc_id, (d.source <> r.source, d.doc_id)) AS id FROM refs r JOIN documents d ON d.lang = r.lang AND d.n_chars = r.n_chars GROUP BY ALL),
    known AS (SELECT qid, id, min(place) AS seat FROM resolved GROUP BY qid, id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY min(place)) <= 10),
    u AS (SELECT qid, id, 0 AS channel, seat, greatest(80, 96 - 3 * seat) AS given, 'precomputed' AS link_type FROM known UNION ALL SELECT qid, id, 1, seat, NULL, 'explicit' FROM explicit
      UNION ALL SELECT qid, id, 2, place, NULL, 'implicit' FROM near),
    c AS (SELECT * FROM u WHERE id <> qid QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY channel, seat) = 1),
    tt AS (SELECT c.qid, c.id, sum(least(3, length(term) - 1)) AS tp FROM c JOIN st_terms t ON t.qid = c.qid JOIN words w ON w.id = c.id WHERE list_contains(ws, term) GROUP BY ALL),
    cc AS (SELECT c.qid, c.id, sum(least(15, 2 * length(term))) AS cp, list(term ORDER BY place) AS present FROM c JOIN st_concepts t ON t.qid = c.qid JOIN words w ON w.id = c.id WHERE list_contains(ws, term) GROUP BY ALL),
    j AS (SELECT c.*, w.subject = q.subject AS same_subject, w.n, least(35, coalesce(tp, 0)) + least(40, coalesce(cp, 0)) + CASE WHEN w.subject = q.subject THEN 15 ELSE 0 END - CASE WHEN w.n < 50 THEN 20 ELSE 0 END AS p, coalesce(array_to_string(present[1:5], '|'), '') AS matched
      FROM c JOIN words w ON w.id = c.id JOIN words q ON q.id = c.qid LEFT JOIN tt ON tt.qid = c.qid AND tt.id = c.id LEFT JOIN cc ON cc.qid = c.qid AND cc.id = c.id),
    k AS (SELECT *, CAST(coalesce(given, {_POINTS}) AS BIGINT) AS score FROM j)
    SELECT qid, id, same_subject, link_type, score, matched, CAST(row_number() OVER (PARTITION BY qid, same_subject ORDER BY score DESC, channel, seat, id) AS INTEGER) AS rank
    FROM k WHERE link_type = 'precomputed' OR score >= 15 QUALIFY rank <= 10""")
def question_page_links(spark, sf):
    index = _index(spark, sf)
    pages, questions, concepts, near = _sides(spark, sf, index)
    words = ranked.word_rows(questions).select(F.col("id").alias("qid"), "term")
    points = ranked.first_by_length(words, 3)
    after = pages.select(F.col("id").alias("rid"), F.concat_ws("·", "subject", "title", F.concat(F.lit("p"), F.col("page").cast("string"))).alias("ref"))
    asked = questions.select(F.col("id").alias("qid"), F.posexplode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("place", "rid"))
    return question_links.link_questions(questions, pages, index, concepts, points, asked.join(after, "rid").select("qid", "place", "ref"), near)


@query(f"""WITH {_LINKS}, {_firsts("wanted", [("wt", 6), ("mc", 4)], 10)}, {_TEXTS},
    bm AS (SELECT t.qid, i.id, sum(impact) AS s FROM wanted t JOIN words q ON q.id = t.qid JOIN imp i ON i.term = t.term AND i.id <> t.qid AND i.subject <> q.subject GROUP BY ALL),
    c AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS seat FROM bm QUALIFY seat <= 20),
    tt AS (SELECT c.qid, c.id, sum(least(3, length(term) - 1)) AS tp FROM c JOIN wt t ON t.qid = c.qid AND t.place <= 10 JOIN words w ON w.id = c.id WHERE list_contains(ws, term) GROUP BY ALL),
    clusters AS (SELECT DISTINCT substr(concept, 1, 6) AS cluster, concept FROM concepts),
    expanded AS (SELECT DISTINCT qid, o.concept FROM mc JOIN clusters a ON a.concept = mc.term JOIN clusters o ON o.cluster = a.cluster AND o.concept <> a.concept),
    cc AS (SELECT c.qid, c.id, sum(least(15, 2 * length(term))) AS cp, list(term ORDER BY place) AS present, bool_or(e.concept IS NOT NULL) AS led
      FROM c JOIN mc t ON t.qid = c.qid JOIN words w ON w.id = c.id LEFT JOIN expanded e ON e.qid = c.qid AND e.concept = term WHERE list_contains(ws, term) GROUP BY ALL),
    j AS (SELECT c.*, w.n, least(35, coalesce(tp, 0)) + least(40, coalesce(cp, 0)) - CASE WHEN w.n < 50 THEN 20 ELSE 0 END AS p, coalesce(array_to_string(present[1:5], '|'), '') AS matched, coalesce(led, false) AS led
      FROM c JOIN words w ON w.id = c.id LEFT JOIN tt ON tt.qid = c.qid AND tt.id = c.id LEFT JOIN cc ON cc.qid = c.qid AND cc.id = c.id),
    u AS (SELECT qid, id, CASE WHEN led THEN 'implicit' ELSE 'explicit' END AS link_type, {_POINTS} AS score, matched, 0 AS channel, seat FROM j
      UNION ALL SELECT n.qid, n.id, 'implicit', 60, '', 1, place FROM near n JOIN words q ON q.id = n.qid JOIN words w ON w.id = n.id AND w.subject <> q.subject
      WHERE n.qid IN (SELECT qid FROM wanted) AND NOT EXISTS (SELECT 1 FROM c WHERE c.qid = n.qid AND c.id = n.id))
    SELECT qid, id, link_type, score, matched, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, channel, seat, id) AS INTEGER) AS rank FROM u QUALIFY rank <= 10""")
def page_cross_links(spark, sf):
    index = _index(spark, sf)
    pages, chosen, concepts, near = _sides(spark, sf, index)
    clusters = concepts.select(F.substring("concept", 1, 6).alias("cluster"), "concept")
    return question_links.link_pages(pages, chosen, index, concepts, clusters, near)


# Query analysis: words of texts, names and kinds of parts as queries; words of five rows or more as the
# catalogue; kinds of parts as terms whose names and brands are the synonyms.

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMPACT = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


@query(f"""WITH ws AS (SELECT regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents WHERE doc_id % 50 = 0),
    asked AS (SELECT DISTINCT query FROM (SELECT unnest([w[1], w[1] || ' ' || w[2], upper(w[1]), reverse(w[1]), substr(w[1], 2, 3)]) AS query FROM ws WHERE len(w) >= 2
      UNION ALL SELECT unnest([p_name, p_type, p_brand, split_part(p_name, ' ', 1), '??']) FROM part)),
    rows AS (SELECT query, {_COMPACT.format("query")} AS q FROM asked), qs AS (SELECT DISTINCT q FROM rows WHERE q <> ''),
    names AS (SELECT term AS concept FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM documents) WHERE length(term) >= 5 GROUP BY term HAVING count(*) >= 5),
    cm AS (SELECT q, concept AS term, CASE WHEN q = concept THEN 0 WHEN contains(q, concept) THEN 1 WHEN contains(concept, q) THEN 2
      WHEN contains(lower(q), concept) AND regexp_matches(lower(q), '(^|[^0-9a-z])' || concept || '($|[^0-9a-z])') THEN 3 END AS way FROM qs, names),
    cs AS (SELECT q, term, ['exact', 'contained', 'expanded', 'phrase'][way + 1] AS match_type, [300, 220, 200, 180][way + 1] + CASE way WHEN 2 THEN length(q) ELSE length(term) END AS score FROM cm WHERE way IS NOT NULL),
    ct AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, length(term) DESC, term) AS place FROM cs QUALIFY place <= 4),
    al AS (SELECT term, alias, row_number() OVER (PARTITION BY term ORDER BY kind, alias) AS place FROM (SELECT DISTINCT p_type AS term, 0 AS kind, p_name AS alias FROM part UNION SELECT DISTINCT p_type, 1, p_brand FROM part)),
    touched AS (SELECT DISTINCT q, term FROM qs, al WHERE contains({_FOLD.format("term")}, {_FOLD.format("q")}) OR contains({_FOLD.format("alias")}, {_FOLD.format("q")})),
    am AS (SELECT t.q, t.term, list(alias ORDER BY place) FILTER (place <= 8 AND (contains(t.q, {_COMPACT.format("alias")}) OR contains({_COMPACT.format("alias")}, t.q))) AS aliases FROM touched t JOIN al ON al.term = t.term GROUP BY ALL),
    asc_ AS (SELECT q, term, CASE WHEN coalesce(len(aliases), 0) > 0 THEN 'alias' ELSE 'term' END AS match_type, coalesce(aliases, [])[1:4] AS aliases, CASE WHEN term = q THEN 260 ELSE 210 + 10 * len(aliases) END AS score
      FROM am WHERE term = q OR coalesce(len(aliases), 0) > 0),
    at_ AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, length(term) DESC, term) AS place FROM asc_ QUALIFY place <= 4),
    missed AS (SELECT q FROM qs WHERE q NOT IN (SELECT q FROM ct) AND q NOT IN (SELECT q FROM at_)),
    parts AS (SELECT q, regexp_extract_all(q, '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS p FROM missed),
    wins AS (SELECT q, q AS term, -9 AS o, 0 AS i FROM missed UNION ALL SELECT q, array_to_string(p[i + 1:i + w], ''), -w, i FROM parts, range(1, 5) r(w), range(0, 60) s(i) WHERE len(p) >= 2 AND w <= len(p) AND i + w <= len(p)),
    cand AS (SELECT q, term FROM (SELECT q, term, min((o, i)) AS o FROM wins WHERE length(term) >= 2 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY q ORDER BY o) <= 18),
    hit AS (SELECT q, term, (SELECT count(*) FROM documents WHERE contains({_FOLD.format("coalesce(text, '')")}, {_FOLD.format("term")})) AS a, (SELECT count(*) FROM benchmark WHERE contains({_FOLD.format("coalesce(text, '')")}, {_FOLD.format("term")})) AS b FROM cand),
    fs AS (SELECT *, a + b AS h, CASE WHEN term = q THEN 240 ELSE 0 END
      + CASE WHEN contains(q, term) THEN length(term) * 24 + 40 + CASE WHEN starts_with(q, term) THEN 45 ELSE 0 END + CASE WHEN ends_with(q, term) THEN 65 ELSE 0 END + CASE WHEN length(term) >= 4 THEN 30 ELSE 0 END ELSE length(term) * 12 END
      + least(a + b, 6) * 10 + CASE WHEN b > 0 AND a <= 0 THEN 22 ELSE 0 END + CASE WHEN a + b <= 4 THEN (5 - a - b) * 8 ELSE 0 END - CASE WHEN a + b > 12 THEN least(60, (a + b - 12) * 2) ELSE 0 END AS score FROM hit WHERE a + b > 0),
    ft AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, h DESC, length(term) DESC, term) AS place FROM fs QUALIFY place <= 8),
    pl AS (SELECT q, 0 AS g, place, 0 AS s, term, match_type AS basis FROM ct UNION ALL SELECT q, 1, place, 0, {_COMPACT.format("term")}, match_type FROM at_
      UNION ALL SELECT q, 1, place, s, {_COMPACT.format("aliases[s]")}, 'alias' FROM at_, range(1, 4) r(s) WHERE s <= len(aliases) UNION ALL SELECT q, 2, place, 0, term, 'fallback' FROM ft UNION ALL SELECT q, 3, 0, 0, q, 'query' FROM qs),
    po AS (SELECT q, term, min((g, place, s)) AS o, arg_min(basis, (g, place, s)) AS basis FROM pl WHERE length(term) >= 2 GROUP BY q, term QUALIFY row_number() OVER (PARTITION BY q ORDER BY min((g, place, s))) <= 8),
    plans AS (SELECT q, string_agg(term || ':' || basis, '|' ORDER BY o) AS plan FROM po GROUP BY q),
    cl AS (SELECT q, string_agg(term || ':' || match_type || ':' || score, '|' ORDER BY place) AS line, arg_min(term, place) AS top FROM ct GROUP BY q),
    ll AS (SELECT q, string_agg(term || ':' || match_type || ':' || score, '|' ORDER BY place) AS line, arg_min(term, place) AS top FROM at_ GROUP BY q),
    fl AS (SELECT q, string_agg(term || ':' || score, '|' ORDER BY place) AS line, arg_min(term, place) AS top, bool_or(a > 0) AS own, bool_or(b > 0) AS more FROM ft GROUP BY q)
    SELECT query, CASE WHEN r.q = '' THEN 'invalid' WHEN cl.q IS NOT NULL THEN 'concept' WHEN ll.q IS NOT NULL THEN 'alias' WHEN fl.q IS NOT NULL THEN 'fallback' ELSE 'direct' END AS mode,
      coalesce(cl.top, ll.top, fl.top, r.q) AS display_term, concat_ws('|', cl.line, ll.line) AS concept_terms, coalesce(fl.line, '') AS fallback_terms, coalesce(plan, '') AS plan, coalesce(NOT own AND more, false) AS used_more_texts
    FROM rows r LEFT JOIN cl ON cl.q = r.q LEFT JOIN ll ON ll.q = r.q LEFT JOIN fl ON fl.q = r.q LEFT JOIN plans ON plans.q = r.q""")
def query_analysis_table(spark, sf):
    d, p = docs(spark, sf), table(spark, sf, "part")
    w = d.filter("id % 50 = 0").select(tx.words(F.col("text")).alias("w")).filter("size(w) >= 2")
    own = w.select(F.explode(F.expr("array(w[0], concat(w[0], ' ', w[1]), upper(w[0]), reverse(w[0]), substr(w[0], 2, 3))")).alias("query"))
    named = p.select(F.explode(F.array("p_name", "p_type", "p_brand", F.substring_index("p_name", " ", 1), F.lit("??"))).alias("query"))
    concepts = ranked.build_index(d).terms.filter("length(term) >= 5 and df >= 5").select(F.col("term").alias("concept"))
    sets = p.groupBy(F.col("p_type").alias("term")).agg(F.sort_array(F.collect_set("p_name")).alias("english"), F.sort_array(F.collect_set("p_brand")).alias("aliases"))
    synonyms = sets.select("term", F.to_json(F.struct("english", "aliases")).alias("synonyms"))
    more = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return query_analysis.analyse(own.unionByName(named), concepts, synonyms, d, more)


# Two rounds: the four weightiest words first; rows go on to twelve words if what they found is weak.

@query(f"""WITH {IMPACTS}, {WEIGHTED},
    a AS (SELECT qid, i.id, CAST(sum(impact) AS BIGINT) AS final_score FROM wt JOIN imp i ON i.term = wt.term AND i.id <> qid WHERE place <= 4 GROUP BY ALL),
    r1 AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, id) <= 10),
    t AS (SELECT qid, max(final_score) AS most, count(*) FILTER (final_score >= 9000000) AS good FROM (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, id) <= 3) GROUP BY qid),
    todo AS (SELECT DISTINCT qid FROM wt WHERE qid NOT IN (SELECT qid FROM t WHERE most >= 14000000 OR good >= 2)),
    b AS (SELECT qid, i.id, CAST(sum(impact) AS BIGINT) AS final_score FROM wt JOIN todo USING (qid) JOIN imp i ON i.term = wt.term AND i.id <> qid WHERE place <= 12 GROUP BY ALL),
    r2 AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, id) <= 10)
    SELECT qid, id, max(final_score) AS final_score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY qid, id""")
def two_round_retrieval(spark, sf):
    index = _index(spark, sf)
    terms = materialize(ranked.weighted_terms(index, docs(spark, sf).filter("id % 50 = 0"), 12), "weighted-terms")

    def found(asked):
        return ranked.top_k_in_blocks(index, asked, 10).select("qid", "id", F.col("score").alias("final_score"))

    queries = terms.select("qid").distinct()
    second = lambda left: found(terms.join(left, "qid", "left_semi"))
    return linking.two_rounds_of_many(queries, found(terms.filter("place <= 4")), second, 14_000_000, 9_000_000)
