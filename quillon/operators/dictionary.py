"""Dictionary lookup, page ranges, registries and reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx


def tiered_lookup(entries: DataFrame, key: str, limit: int) -> DataFrame:
    """Exact, then prefix, then substring matches of a headword; shorter headwords first."""
    h = tx.ascii_fold(F.col("headword"))
    k = key.lower()
    tier = F.when(h == k, 0).when(h.startswith(k), 1).when(h.contains(k), 2)
    return entries.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.length("headword"), "id").limit(limit)


def prefix_lookup(entries: DataFrame, prefix: str, limit: int) -> DataFrame:
    return entries.filter(F.col("headword").startswith(prefix)).orderBy(F.length("headword"), "headword", "id").limit(limit)


def pages_in_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Interval join: pages (book_key, page) and the ranges (book_key, lo, hi) of their book that hold them."""
    return pages.join(ranges, (pages["book_key"] == ranges["book_key"]) & F.col("page").between(F.col("lo"), F.col("hi"))).drop(ranges["book_key"])


def unique_match(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows with the registry entry of their key if there is exactly one."""
    unique = registry.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry")).filter("n = 1").drop("n")
    return rows.join(unique, key, "left")


def reconcile(extra: DataFrame, primary: DataFrame) -> DataFrame:
    """Identity of extra books (id, subject, title, edition): bound if one primary book agrees in all,
    split if the title and subject alone agree with some, else new."""
    full = primary.groupBy("subject", "title", "edition").agg(F.count(F.lit(1)).alias("n_full"), F.min("id").alias("primary_id"))
    base = primary.groupBy("subject", "title").agg(F.count(F.lit(1)).alias("n_base"))
    rows = extra.join(full, ["subject", "title", "edition"], "left").join(base, ["subject", "title"], "left")
    status = F.when(F.col("n_full") == 1, "bound").when(F.col("n_base") > 0, "split").otherwise("new")
    return rows.select("id", status.alias("status"), F.when(F.col("n_full") == 1, F.col("primary_id")).alias("primary_id"))


def merge_review(candidates: DataFrame, review: DataFrame) -> DataFrame:
    """Candidates (key, pages, flag) with the flags of reviewed rows; pages of candidates win, orphans go."""
    r = review.select("key", F.col("flag").alias("reviewed"))
    return candidates.join(r, "key", "left").select("key", "pages", F.coalesce("reviewed", "flag").alias("flag"))


def resolve_reference(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Best page for each reference (ref, title, page) among pages (id, title, logical_page, section).

    logical_page counts before section; equal titles before those that begin alike or contain one another.
    """
    asked = refs.select("title", "page").distinct()
    p = pages.withColumnRenamed("title", "page_title")
    title: Column = (
        F.when(F.col("page_title") == F.col("title"), 100)
        .when(F.col("page_title").startswith(F.col("title")), 95)
        .when(F.col("title").startswith(F.col("page_title")), 90)
        .when(F.col("page_title").contains(F.col("title")), 80)
    )
    # Two equi-joins instead of one on a disjunction, which would compare every page.
    by_page = asked.join(p, F.col("page") == F.col("logical_page"))
    by_section = asked.join(p, (F.col("page") == F.col("section")) & ~F.col("page").eqNullSafe(F.col("logical_page")))
    rows = by_page.unionByName(by_section).withColumn("score", title).filter("score is not null")
    # The least of these is the best page: score, then whether the logical page is told (nulls last), then id (nulls last).
    place = F.struct((-F.col("score")).alias("less"), F.coalesce((F.col("page") != F.col("logical_page")).cast("int"), F.lit(2)).alias("other"), F.col("id").isNull().alias("unnamed"), "id")
    best = rows.groupBy("title", "page").agg(F.min(place).alias("best"))
    # References that ask for the same share one search; each takes the best of what it asks for.
    own = refs.select("ref", "title", "page").join(best, ["title", "page"])
    return own.groupBy("ref").agg(F.min("best").alias("best")).select("ref", "best.id", (-F.col("best.less")).alias("score"))


def books(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Primary books and those of the extra catalogue that are not among them."""
    return primary.unionByName(extra.join(primary.select("book_key"), "book_key", "left_anti"))


def status_rollup(entries: DataFrame) -> DataFrame:
    """Verified and candidate entries of each source."""
    return entries.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verified")).alias("verified"),
        F.count_if(~F.col("verified")).alias("candidates"),
    )


def ranked_lookup(entries: DataFrame, key: str, columns: list[str], limit: int) -> DataFrame:
    """Entries where a column equals the key, or else holds it; earlier columns first, then shorter headwords."""
    k = key.lower()
    folded = [tx.ascii_fold(F.col(c)) for c in columns]
    exact = [F.when(c == k, F.lit(i)) for i, c in enumerate(folded)]
    inside = [F.when(c.contains(k), F.lit(len(columns) + i)) for i, c in enumerate(folded)]
    tier = F.coalesce(*exact, *inside)
    return entries.withColumn("tier", tier).filter("tier is not null").orderBy("tier", F.length(columns[0]), "id").limit(limit)


def map_lookup(entries: DataFrame, key: str, limit: int) -> DataFrame:
    """Headwords (id, source, page, headwords) equal to the key; only where there are none, those that hold it."""
    rows = entries.select("id", "source", "page", F.explode("headwords").alias("headword"))
    h = tx.compact(F.lower("headword"))
    k = "".join(key.lower().split())
    found = rows.withColumn("exact", h == k).filter(h.contains(k))
    best = found.agg(F.max("exact").alias("any_exact"))
    kept = found.join(F.broadcast(best), found["exact"] == best["any_exact"]).drop("any_exact")  # one row
    return kept.orderBy("source", "page", "headword", "id").limit(limit)


def sections(records: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """id and the cleaned sections of JSON records (id, record): each is the first non-empty one of its fields."""
    fields = F.from_json("record", "map<string,string>")

    def cleaned(field: str) -> Column:
        out = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("fields")[field], F.lit("")), r"_x[0-9A-Fa-f]{4}_", ""), r"\*\d+\*|#", "")
        return F.nullif(F.trim(out), F.lit(""))

    return records.select("id", fields.alias("fields")).select("id", *[F.coalesce(*map(cleaned, fs)).alias(n) for n, fs in names.items()])


def unfolded_lines(text: Column) -> Column:
    """Single line breaks taken out, several made one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{2,}", "\u0001"), "\n", ""), "\u0001", "\n"))


def converted(text: Column, pairs: dict[str, str]) -> Column:
    """Characters replaced by a map of single characters, such as simplified to traditional ones; an empty map changes nothing."""
    return F.translate(text, "".join(pairs), "".join(pairs.values())) if pairs else text


def reference_cards(queries: DataFrame, sites: dict[str, str]) -> DataFrame:
    """query, site, item and url: a card for each distinct character of a query, and one for the whole query if it has several.

    {} in a site's address is the item, escaped with %20 for blanks.
    """
    chars = F.array_distinct(F.filter(F.split(F.regexp_replace("query", r"\s+", ""), ""), lambda c: c != ""))
    items = F.array_distinct(F.concat(F.when(F.size(chars) > 1, F.array(F.trim("query"))).otherwise(F.array().cast("array<string>")), chars))
    rows = queries.select("query", F.posexplode(items).alias("place", "item"))
    addresses = F.array(*[F.struct(F.lit(n).alias("site"), F.lit(u).alias("address")) for n, u in sites.items()])
    escaped = F.replace(F.url_encode("item"), F.lit("+"), F.lit("%20"))
    return rows.withColumn("s", F.explode(addresses)).select("query", "place", "item", "s.site", F.replace("s.address", F.lit("{}"), escaped).alias("url"))


def resolve_books(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (id, content_id, title, subject, edition) with the book_key that they name in a registry of the same columns.

    Levels in turn: content_id; title, subject and edition; title and subject; title. A level counts only
    if its entry is the only one.
    """
    levels = [["content_id"], ["title", "subject", "edition"], ["title", "subject"], ["title"]]
    out = rows
    for i, keys in enumerate(levels):
        one = registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("book_key").alias(f"found{i}")).filter("n = 1").drop("n")
        out = out.join(one.withColumnsRenamed({k: f"r_{k}" for k in keys}), [F.col(k) == F.col(f"r_{k}") for k in keys], "left").drop(*[f"r_{k}" for k in keys])
    found = [F.col(f"found{i}") for i in range(len(levels))]
    level = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(found)])
    return out.select(*rows.columns, F.coalesce(*found).alias("book_key"), level.alias("level"))


def overlaid(rows: DataFrame, key: str, layers: list[DataFrame], columns: list[str]) -> DataFrame:
    """Rows with columns taken from the first layer (key, columns) that has a value, else their own."""
    out = rows
    for i, layer in enumerate(layers):
        named = layer.select(F.col(key).alias(f"k{i}"), *[F.col(c).alias(f"{c}_{i}") for c in columns])
        out = out.join(named, F.col(key) == F.col(f"k{i}"), "left").drop(f"k{i}")
    chosen = {c: F.coalesce(*[F.col(f"{c}_{i}") for i in range(len(layers))], F.col(c)) for c in columns}
    return out.withColumns(chosen).select(*rows.columns)


def pages_by_bin(pages: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """pages_in_ranges for many ranges of a book: both sides meet by book and bin of pages, so that no book is compared whole."""
    binned = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    own = pages.withColumn("bin", F.floor(F.col("page") / width))
    r = binned.withColumnRenamed("book_key", "range_book")
    near = (own["bin"] == r["bin"]) & (F.col("book_key") == F.col("range_book")) & F.col("page").between(F.col("lo"), F.col("hi"))
    return own.join(r, near).drop("bin", "range_book")


def sample_check(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (headword, page) and whether it was found there, elsewhere or not at all."""
    own = found.groupBy("headword").agg(F.collect_set("page").alias("pages"))
    return expected.join(own, "headword", "left").select(
        "headword", "page",
        F.when(F.col("pages").isNull(), "missing").when(F.array_contains("pages", F.col("page")), "found").otherwise("elsewhere").alias("state"),
    )


def on_pages(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Rows whose logical page, or else section, lies in an interval."""
    return rows.filter(F.coalesce("logical_page", "section").between(low, high))


def headword_hits(docs: DataFrame, ranges: DataFrame, headword: str, score: Column, limit: int) -> DataFrame:
    """Rows (id, book_key, page, text) inside the ranges of their book that hold a headword, the best scored first."""
    inside = pages_by_bin(docs.filter(tx.has_term(F.col("text"), headword)), ranges).select("id", "book_key", "page", "text").distinct()
    return inside.withColumn("score", score).orderBy(F.desc("score"), "book_key", "page", "id").limit(limit)
