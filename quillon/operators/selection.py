"""Window-like selection: keep-best, caps, diversity, runs, spans and ordered folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (keep-best, keep-first, keep-longest)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def merge_groups(groups: list[DataFrame]) -> DataFrame:
    """Union of ranked row groups; an id that several groups have is kept from the first of them."""
    tagged = [g.withColumn("grp", F.lit(i)) for i, g in enumerate(groups)]
    rows = tagged[0]
    for g in tagged[1:]:
        rows = rows.unionByName(g)
    return first_by(rows, ["id"], [F.col("grp"), F.col("rank")])


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with the size of the whole group.

    Ranks are cut under a group limit and sizes are counted map-side, so no task holds a group.
    """
    sizes = rows.groupBy(F.col(group).alias("sized")).agg(F.count(F.lit(1)).alias("group_total"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= n)
    return first.join(sizes, F.col(group).eqNullSafe(F.col("sized"))).drop("sized")


def reorder_with_caps(rows: DataFrame, book: str, page: str, page_cap: int, book_cap: int) -> DataFrame:
    """Rows (scope, pos) with allowed: at most page_cap rows of a page and book_cap of a book stay in front.

    Rows over a cap move behind the others, in their order. A null page has no cap.
    """
    rp = F.row_number().over(Window.partitionBy("scope", book, page).orderBy("pos"))
    ok_page = F.col(page).isNull() | (F.col("rp") <= page_cap)
    rb = F.sum(ok_page.cast("int")).over(
        Window.partitionBy("scope", book).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    flagged = rows.withColumn("rp", rp).withColumn("rb", rb)
    allowed = ok_page & (F.col("rb") <= book_cap)
    final = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("allowed"), "pos"))
    return flagged.withColumn("allowed", allowed).withColumn("final_pos", final).drop("rp", "rb")


def diverse(rows: DataFrame, book: str, quota: int, limit: int) -> DataFrame:
    """Rows (scope, pos): one of each book first, then up to a quota for each book, then the rest."""
    own = Window.partitionBy("scope", book)
    ranked = rows.withColumns(
        {"rn": F.row_number().over(own.orderBy("pos")), "book_first": F.min("pos").over(own)}
    )
    step = F.when(F.col("rn") == 1, 1).when(F.col("rn") <= quota, 2).otherwise(3)
    by = [F.col("step"), F.when(F.col("step") < 3, F.col("book_first")).otherwise(F.col("pos")), F.col("rn")]
    placed = ranked.withColumn("step", step)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(*by))).filter(F.col("place") <= limit).drop("book_first")


def islands(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Runs of consecutive values: group, run_start, run_end, n."""
    distinct = rows.select(group, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(group).orderBy(value))
    return distinct.withColumn("island", island).groupBy(group, "island").agg(
        F.min(value).alias("run_start"), F.max(value).alias("run_end"), F.count(F.lit(1)).alias("n")
    ).drop("island")


def page_ranges(runs: DataFrame, group: str) -> DataFrame:
    """Runs as one text for each group: 1-3,7."""
    one = F.when(F.col("run_start") == F.col("run_end"), F.col("run_start").cast("string")).otherwise(
        F.concat_ws("-", F.col("run_start").cast("string"), F.col("run_end").cast("string"))
    )
    parts = F.array_sort(F.collect_list(F.struct("run_start", one.alias("part"))))
    return runs.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["part"]), ",").alias("pages"))


def expand_ranges(rows: DataFrame, pages: str) -> DataFrame:
    """The inverse: a row for each page of texts like 1-3,7; parts that are not numbers are skipped."""
    parts = rows.withColumn("part", F.explode(F.split(pages, ",")))
    bounds = parts.withColumn("part", F.trim("part")).withColumns(
        {
            "lo": F.expr("try_cast(substring_index(part, '-', 1) as bigint)"),
            "hi": F.expr("try_cast(substring_index(part, '-', -1) as bigint)"),
        }
    )
    return bounds.filter("lo is not null and hi is not null and lo <= hi").withColumn("page", F.explode(F.sequence("lo", "hi"))).drop("part", "lo", "hi")


def lead_spans(starts: DataFrame, group: str, start: str) -> DataFrame:
    """Each start's span: up to the one before the next start, but not before its own."""
    nxt = F.lead(start).over(Window.partitionBy(group).orderBy(start))
    return starts.withColumn("span_end", F.greatest(F.col(start), F.coalesce(nxt - 1, F.col(start))))


def context_pages(rows: DataFrame, page: str, low: str, high: str, k: int) -> DataFrame:
    """A row for each page within k of the given one, inside the book's bounds."""
    lo = F.greatest(F.col(low), F.col(page) - k)
    hi = F.least(F.col(high), F.col(page) + k)
    return rows.withColumn("context_page", F.explode(F.sequence(lo, hi)))


def drop_adjacent_repeats(rows: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Rows without those whose value is that of the row before."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__before", before).filter(~F.col(value).eqNullSafe(F.col("__before"))).drop("__before")


def sections(lines: DataFrame, group: str, position: str, is_header: Column, text: str) -> DataFrame:
    """Lines with the header that they stand under."""
    w = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("header", F.last(F.when(is_header, F.col(text)), ignorenulls=True).over(w))


def merge_blocks(blocks: DataFrame, shortest_repeat: int = 32, least_page: int = 0) -> DataFrame:
    """Pages (path, page, text) of at least so many characters from blocks (path, page, pos, text).

    Blanks are collapsed; a block goes if it has fewer than two characters, is part of the one kept
    before, or is shorter than shortest_repeat and has been kept already. The fold needs what was
    kept last, so it runs over the ordered blocks of one page, in one pass.
    """

    def fold(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            kept, seen = [], set()
            for block in page:
                text = " ".join((block or "").split())
                known = text.casefold() in seen and len(text) < shortest_repeat
                if len(text) >= 2 and not known and not (kept and text in kept[-1]):
                    kept.append(text)
                    seen.add(text.casefold())
            out.append("\n".join(kept))
        return pd.Series(out, dtype=object)

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"])
    pages = blocks.groupBy("path", "page").agg(ordered.alias("blocks"))
    merged = pages.select("path", "page", F.pandas_udf(fold, "string")("blocks").alias("text"))
    return merged.filter(F.length("text") >= least_page)
