"""Outlines of texts: headings of several levels, what stands under each, and the tree that they form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings of dictionary sections by level: kinds of use, numbered outlines, numbered senses.
SECTION_LEVELS = [
    r"^(?:代词|副词|介词|连词|助词|语气词|叹词|动词|名词|形容词|数词|量词|固定结构|固定格式)$",
    r"^(?:[一二三四五六七八九十]+[、.．]|（[一二三四五六七八九十]+）)",
    r"^(?:[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]|[0-9]{1,2}[.．、])",
]


def _level(line: Column, levels: list[str]) -> Column:
    """Place of the first pattern that a line matches, from 1; null for running text."""
    return F.coalesce(*[F.when(line.rlike(p), F.lit(i + 1)) for i, p in enumerate(levels)], F.lit(None).cast("int"))


def nodes(docs: DataFrame, levels: list[str]) -> DataFrame:
    """id, pos, level, parent, path, title and body of every heading of each text (id, text).

    Lines are cut and trimmed, and empty ones dropped; pos is the place among the others, from 0. A
    heading stands under the last one before it of a higher level (a smaller number), whatever levels are
    left out between; parent is null at the top. Running text belongs to the heading before it; what
    comes before the first heading is the body of a node of level 0 and pos -1. path lists the places from
    the top. Each text is ordered by itself; ids are taken to be unique.
    """
    trimmed = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = docs.select("id", F.posexplode(trimmed).alias("pos", "line")).withColumn("level", _level(F.col("line"), levels))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda i, w: F.last(F.when(F.col("level") == i, F.col("pos")), ignorenulls=True).over(w)
    n = len(levels)
    placed = lines.select(
        "id", "pos", "line", "level", F.last(F.when(F.col("level").isNotNull(), F.col("pos")), ignorenulls=True).over(upto).alias("owner"),
        *[last(i, before).alias(f"last_{i}") for i in range(1, n + 1)],
    )
    # An earlier heading is still open if none of its own level or a higher one has followed it.
    chain = [F.when(reduce(lambda a, b: a & b, [F.coalesce(F.col(f"last_{j}") < F.col(f"last_{i}"), F.lit(True)) for j in range(1, i)], F.col("level") > i), F.col(f"last_{i}")) for i in range(1, n + 1)]
    headings = placed.filter("level is not null").select("id", "pos", "level", F.array_compact(F.array(*chain)).alias("above"), F.col("line").alias("title"))
    text = placed.filter("level is null").groupBy("id", F.coalesce("owner", F.lit(-1)).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "line"))).alias("rows"))
    text = text.select("id", "pos", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))
    joined = headings.join(text, ["id", "pos"], "full")
    path = F.concat(F.coalesce("above", F.array().cast("array<int>")), F.array("pos"))
    return joined.select(
        "id", "pos", F.coalesce("level", F.lit(0)).alias("level"), F.try_element_at("above", F.lit(-1)).alias("parent"),
        F.array_join(F.transform(path, lambda p: p.cast("string")), "/").alias("path"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"),
    )


def trees(found: DataFrame) -> DataFrame:
    """id and tree: the nodes of a text in order, each with its parent; a text has a bounded number of headings."""
    each = F.struct("pos", "parent", "level", "title", "body")
    return found.groupBy("id").agg(F.array_sort(F.collect_list(each)).alias("tree"))


def mind_map(found: DataFrame, root: Column, deepest: int = 3) -> DataFrame:
    """id, source, target and depth: edges of a map of each text, from the root's name over its headings down to a level."""
    kept = found.filter(F.col("level").between(1, deepest))
    names = kept.select("id", F.col("pos").alias("parent"), F.col("title").alias("above"))
    return kept.join(names, ["id", "parent"], "left").select("id", F.coalesce("above", root).alias("source"), F.col("title").alias("target"), (F.size(F.split("path", "/"))).alias("depth"))
