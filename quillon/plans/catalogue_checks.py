"""Registered queries: verification across tables, page numbers of books, outlines and entries of texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import entries, occurrences, outline, page_map, verify
from quillon.operators.verify import Rule
from quillon.plans.catalogue import docs, query
from quillon.session import table

RULES = [
    Rule("document ids", "documents", "unique", ("doc_id",)),
    Rule("names of parts", "part", "unique", ("p_name",)),
    Rule("lines of orders", "lineitem", "unique", ("l_orderkey", "l_linenumber")),
    Rule("labels of documents", "labels", "refers", ("doc_id",), of="documents"),
    Rule("vectors of documents", "embeddings", "refers", ("vec_id",), of="documents", to=("doc_id",)),
    Rule("orders of customers", "orders", "refers", ("o_custkey",), of="customer", to=("c_custkey",)),
    Rule("documents with labels", "documents", "refers", ("doc_id",), of="labels"),
    Rule("lengths", "documents", "holds", ("doc_id",), "n_chars = length(text)"),
    Rule("long enough", "documents", "holds", ("doc_id",), "n_chars >= 40"),
    Rule("quantities", "lineitem", "holds", ("l_orderkey", "l_linenumber"), "l_quantity < 50"),
    Rule("enough benchmark items", "benchmark", "filled", least=1000),
    Rule("enough regions", "region", "filled", least=5),
]


def _rule_sql(r: Rule) -> str:
    key = lambda cs: " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cs)
    head = f"SELECT '{r.name}' AS rule, '{r.table}' AS table_name"
    if r.kind == "unique":
        return f"{head}, {key(r.key)} AS key, count(*) AS found FROM {r.table} GROUP BY {', '.join(r.key)} HAVING count(*) > 1"
    if r.kind == "refers":
        return f"{head}, {key(r.key)} AS key, count(*) AS found FROM {r.table} WHERE {r.key[0]} NOT IN (SELECT {(r.to or r.key)[0]} FROM {r.of}) GROUP BY {r.key[0]}"
    if r.kind == "holds":
        return f"{head}, {key(r.key)} AS key, CAST(1 AS BIGINT) AS found FROM {r.table} WHERE NOT coalesce({r.condition}, false)"
    return f"{head}, '' AS key, count(*) AS found FROM {r.table} HAVING count(*) < {r.least}"


@query(" UNION ALL ".join(map(_rule_sql, RULES)))
def rule_violations(spark, sf):
    return verify.violations({name: table(spark, sf, name) for r in RULES for name in (r.table, r.of) if name}, RULES)


# Page numbers: sources are books whose documents are scan pages in order; from every 40th page on the printed
# number falls back by one more, every eleventh document has none and every seventh a wrong one.

_BOOKS = """seen AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pdf_page, doc_id FROM documents),
    printed AS (SELECT book, pdf_page, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN pdf_page + 5 ELSE pdf_page - 2 - pdf_page // 40 END AS book_page FROM seen),
    votes AS (SELECT a.book, a.pdf_page, b.pdf_page - b.book_page AS shift, count(*) AS n FROM printed a JOIN printed b ON b.book = a.book AND b.pdf_page BETWEEN a.pdf_page - 3 AND a.pdf_page + 3 WHERE b.book_page IS NOT NULL GROUP BY ALL),
    voted AS (SELECT book, pdf_page, arg_min(shift, (-n, shift)) AS shift FROM votes GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN lag(shift) OVER (PARTITION BY book ORDER BY pdf_page) = shift THEN 0 ELSE 1 END AS begins FROM voted),
    runs AS (SELECT book, segment, shift, min(pdf_page) AS first, max(pdf_page) AS last FROM (SELECT *, sum(begins) OVER (PARTITION BY book ORDER BY pdf_page) AS segment FROM marked) GROUP BY book, segment, shift)"""


def _printed(spark, sf):
    order = Window.partitionBy("source").orderBy("doc_id")
    seen = table(spark, sf, "documents").select(F.col("source").alias("book"), F.row_number().over(order).cast("long").alias("pdf_page"), "doc_id")
    number = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 7 == 0, F.col("pdf_page") + 5).otherwise(F.col("pdf_page") - 2 - F.floor(F.col("pdf_page") / 40))
    return seen.select("book", "pdf_page", number.alias("book_page"))


@query(f"WITH {_BOOKS} SELECT book, CAST(segment AS BIGINT) AS segment, shift, first, last FROM runs")
def page_segments(spark, sf):
    return page_map.segments(_printed(spark, sf))


@query(f"""WITH {_BOOKS}, b AS (SELECT p.book, p.pdf_page, CASE WHEN p.pdf_page - shift > 0 THEN p.pdf_page - shift END AS mapped_book_page FROM printed p LEFT JOIN runs r ON r.book = p.book AND p.pdf_page BETWEEN first AND last),
    w AS (SELECT DISTINCT book, mapped_book_page AS n FROM b WHERE mapped_book_page IS NOT NULL), k AS (SELECT w.book, n, min(n + shift) AS pdf FROM w LEFT JOIN runs r ON r.book = w.book AND n + shift BETWEEN first AND last GROUP BY ALL)
    SELECT b.book, b.pdf_page, mapped_book_page, k.pdf AS first_pdf_page FROM b LEFT JOIN k ON k.book = b.book AND k.n = mapped_book_page""")
def page_numbers_both_ways(spark, sf):
    printed = _printed(spark, sf)
    runs = page_map.segments(printed)
    mapped = page_map.to_book(printed.select("book", "pdf_page"), runs)
    back = page_map.to_pdf(mapped.filter("mapped_book_page is not null").select("book", F.col("mapped_book_page").alias("book_page")), runs)
    return mapped.join(back.select("book", F.col("book_page").alias("mapped_book_page"), F.col("pdf_page").alias("first_pdf_page")), ["book", "mapped_book_page"], "left")


# Outlines: short lines, lines of middle length and lines that begin with a vowel as headings of three levels.

LEVELS = ["^.{1,24}$", "^.{25,60}$", "^[AEIOU]"]
_OUTLINE = f"""l AS (SELECT doc_id AS id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents),
    r AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM l),
    v AS (SELECT *, CASE WHEN regexp_matches(line, '{LEVELS[0]}') THEN 1 WHEN regexp_matches(line, '{LEVELS[1]}') THEN 2 WHEN regexp_matches(line, '{LEVELS[2]}') THEN 3 END AS level FROM r),
    h AS (SELECT * FROM v WHERE level IS NOT NULL),
    p AS (SELECT a.id, a.pos, max(b.pos) AS parent FROM h a JOIN h b ON b.id = a.id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL),
    b AS (SELECT v.id, coalesce((SELECT max(h.pos) FROM h WHERE h.id = v.id AND h.pos < v.pos), -1) AS pos, string_agg(line, chr(10) ORDER BY v.pos) AS body FROM v WHERE level IS NULL GROUP BY ALL)"""


@query(f"""WITH {_OUTLINE} SELECT coalesce(h.id, b.id) AS id, CAST(coalesce(h.pos, b.pos) AS INTEGER) AS pos, coalesce(h.level, 0) AS level, CAST(p.parent AS INTEGER) AS parent, coalesce(h.line, '') AS title, coalesce(b.body, '') AS body
    FROM h FULL JOIN b ON b.id = h.id AND b.pos = h.pos LEFT JOIN p ON p.id = h.id AND p.pos = h.pos""")
def outline_nodes(spark, sf):
    return outline.nodes(docs(spark, sf), LEVELS).drop("path")


# Entries: sources are books of documents as pages; the first word of every fifth document of a source heads an
# entry that is looked for on three pages.

LATIN_ENTRIES = entries.Layout(
    head_line="^{head}[ .,;].{0,40}$", any_head_line=r"^[A-ZÀ-Þ]\p{L}+[ .,;].{0,80}$", glued="^{head}\\p{L}", spoken=r"^\p{L}{2,}[ ,].*$", spoken_end=r"[.]$",
    origin=("the ", "les ", "der ", "los "), next_marks=("the ", "les ", "der ", "los ", "and "), phrases=("{head} ", "{head}."), headers=("License", "rights"),
    longest_line=120, least_entry=300,
)


@query()
def entry_texts(spark, sf):
    order = Window.partitionBy("source").orderBy("doc_id")
    pages = table(spark, sf, "documents").select(F.col("source").alias("book"), F.row_number().over(order).alias("page"), "text", "doc_id")
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"(\p{L}+)", 1)
    targets = pages.filter("page % 5 = 1").select(F.col("doc_id").alias("entry"), "book", head.alias("head"), F.col("page").alias("first"), (F.col("page") + 2).alias("last")).filter("head <> ''")
    return entries.extract(targets, pages.select("book", "page", "text"), LATIN_ENTRIES)


# Nested occurrences: lines, sentences and clauses of documents as questions, options and items; long words as terms.

CLAUSES = occurrences.Marks(question=r"(?m)^", option=r"\A|(?<=\.)", item=r"\A|(?<=,)", term=r"[^\W\d_]{10,}")


@query("""WITH q AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS question_no FROM documents),
    o AS (SELECT id, question_no, unnest(string_split(s, '.')) AS s, generate_subscripts(string_split(s, '.'), 1) AS option_no FROM q),
    i AS (SELECT id, question_no, option_no, unnest(string_split(s, ',')) AS s, generate_subscripts(string_split(s, ','), 1) AS item_no FROM o),
    t AS (SELECT id, question_no, option_no, item_no, regexp_extract_all(s, '\\p{L}{10,}') AS ts FROM i)
    SELECT id, CAST(question_no AS INTEGER) AS question_no, CAST(option_no AS INTEGER) AS option_no, CAST(item_no AS INTEGER) AS item_no, CAST(unnest(range(1, len(ts) + 1)) AS INTEGER) AS term_no, unnest(ts) AS term FROM t WHERE len(ts) > 0""")
def nested_occurrences(spark, sf):
    found = occurrences.occurrences(docs(spark, sf).select("id", "text"), CLAUSES)
    return found.select("id", "question_no", "option_no", "item_no", "term_no", "term")
