"""Numbers printed in books and pages of their scans, mapped both ways through offsets that change along a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours on either side that vote on a page's offset.
NEIGHBOURS = 3


def _mode(values: Column) -> Column:
    """The most frequent element of an array without nulls, the smallest of several; null for an empty array."""
    kinds = F.array_distinct(values)
    counted = F.transform(kinds, lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("less"), v.alias("value")))
    return F.array_min(counted)["value"]


def segments(seen: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """book, segment, shift, first and last of runs of scan pages with one offset.

    seen has book, pdf_page and book_page, the number that was read on the page (null if none, wrong at
    times). The offset of a page is the most frequent one among its neighbours, so that single misreadings
    do not end a run. Books are split by pages only where the window needs it.
    """
    around = Window.partitionBy("book").orderBy("pdf_page").rowsBetween(-neighbours, neighbours)
    order = Window.partitionBy("book").orderBy("pdf_page")
    voted = seen.withColumn("shift", _mode(F.collect_list(F.col("pdf_page") - F.col("book_page")).over(around))).filter("shift is not null")
    begins = F.coalesce(F.lag("shift").over(order) != F.col("shift"), F.lit(True)).cast("int")
    runs = voted.withColumn("begins", begins).withColumn("segment", F.sum("begins").over(order))
    return runs.groupBy("book", "segment", "shift").agg(F.min("pdf_page").alias("first"), F.max("pdf_page").alias("last"))


def to_book(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """pages (book, pdf_page, ...) with mapped_book_page; null outside of all segments and before the first numbered page."""
    inside = (F.col("pdf_page") >= F.col("first")) & (F.col("pdf_page") <= F.col("last"))
    sides = runs.select(F.col("book").alias("run_book"), "first", "last", "shift")
    met = pages.join(sides, (F.col("book") == F.col("run_book")) & inside, "left")
    number = F.col("pdf_page") - F.col("shift")
    return met.withColumn("mapped_book_page", F.when(number > 0, number)).drop("run_book", "first", "last", "shift")


def to_pdf(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """pages (book, book_page) with pdf_page: the first scan page that bears the number; null if none does."""
    sides = runs.select(F.col("book").alias("run_book"), "first", "last", "shift")
    at = F.col("book_page") + F.col("shift")
    met = pages.distinct().join(sides, (F.col("book") == F.col("run_book")) & (at >= F.col("first")) & (at <= F.col("last")), "left")
    return met.groupBy("book", "book_page").agg(F.min(at).alias("pdf_page"))


def page_urls(prefix: Column, first: Column, last: Column, most: int = 12) -> Column:
    """Addresses of the images of pages first to last, most of them at the most; none without a first page above zero."""
    stop = F.least(F.greatest(F.coalesce(last, first), first), first + most - 1)
    made = F.transform(F.sequence(first, stop), lambda p: F.concat(prefix, F.lit("/p"), p.cast("string"), F.lit(".webp")))
    return F.when(F.coalesce(first > 0, F.lit(False)), made).otherwise(F.array().cast("array<string>"))
