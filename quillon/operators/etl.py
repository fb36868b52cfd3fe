"""Document processing: pages from blocks, records, identities, question blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.selection import first_by

# Publisher marks in paths and titles, in order of precedence.
EDITION_MARKS = [("人教版", "人教版"), ("北师大版", "北师大版"), ("苏教版", "苏教版"), ("沪教版", "沪教版"), ("外研版", "外研版"), ("鲁科版", "鲁科版")]


def keep_best_page(pages: DataFrame, key: list[str]) -> DataFrame:
    """The best page of each key: quality, then length, then the smaller id."""
    rows = pages.withColumn("quality", tx.page_quality(F.col("text")))
    return first_by(rows, key, [F.desc("quality"), F.desc(F.length("text")), F.col("id")])


def dedupe_by_fingerprint(rows: DataFrame) -> DataFrame:
    """The longest row of each text fingerprint (letters and digits only, lower case), then the smaller id."""
    mark = F.md5(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", ""))
    return first_by(rows.withColumn("mark", mark), ["mark"], [F.desc(F.length("text")), F.col("id")])


def edition(path: Column, title: Column) -> Column:
    """Edition by the first mark found in the path, then in the title."""
    marks = [F.when(c.contains(m), name) for c in (path, title) for m, name in EDITION_MARKS]
    return F.coalesce(*marks)


def record_hash(record: Column) -> Column:
    """SHA-1 of a map's entries in order of key, as JSON."""
    return F.sha1(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record)))))


def display_text(headers: list[str]) -> Column:
    """Non-empty fields as lines of 'header: value', in order of the headers."""
    return F.concat_ws("\n", *[F.when(F.trim(F.col(h)) != "", F.concat(F.lit(f"{h}: "), F.trim(F.col(h)))) for h in headers])


def question_blocks(rows: DataFrame, boundary: str = r"(?m)^(?=\d{1,2}[.．、])") -> DataFrame:
    """Blocks of a paper that begin with a question number at the start of a line."""
    parts = F.split("text", boundary)
    blocks = rows.select("id", F.posexplode(parts).alias("pos", "block"))
    number = F.regexp_extract("block", r"^(\d{1,2})[.．、]", 1)
    return blocks.filter(number != "").withColumn("number", number.cast("int"))


def options(block: Column) -> Column:
    """Option texts A to D of a question."""
    return F.regexp_extract_all(block, F.lit(r"[A-D][.．、]\s*([^A-D\n]+)"), F.lit(1))


def longest_section(rows: DataFrame) -> DataFrame:
    """The longest analysis section of each question number (id, number, text)."""
    return first_by(rows, ["id", "number"], [F.desc(F.length("text")), F.col("text")])


def clip(text: Column, start: str, end: str) -> Column:
    """The text between two markers; without them from the beginning or to the end."""
    at = F.instr(text, start)
    tail = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    stop = F.instr(tail, end)
    return F.when(stop > 1, F.substring(tail, F.lit(1), stop - 1)).otherwise(tail)


def build_stats(pages: DataFrame) -> DataFrame:
    """Books, pages and characters of each subject."""
    return pages.groupBy("subject").agg(
        F.count_distinct("book_key").alias("books"), F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars")
    )


def conflicts(rows: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Keys that several rows share while their flags differ."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(flag).alias("n_flags")).filter("n > 1 and n_flags > 1")


def flagged_lines(docs: DataFrame) -> DataFrame:
    """Lines with their neighbours: id, pos, line, before, after."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("id").orderBy("pos")
    return lines.withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)})


def conflict_kinds(rows: DataFrame, key: list[str], flag: str, phase: str, label: str) -> DataFrame:
    """Keys of several rows with what is wrong: shared, mixed flags, mixed phases, unlabelled copies."""
    facts = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(flag).alias("flags"), F.count_distinct(phase).alias("phases"),
        F.count_if(F.coalesce(F.col(label), F.lit("")) == "").alias("unlabelled"),
    ).filter("n > 1")
    kinds = F.concat_ws(
        ",", F.lit("shared"), F.when(F.col("flags") > 1, "flags"), F.when(F.col("phases") > 1, "phases"), F.when(F.col("unlabelled") > 1, "unlabelled")
    )
    return facts.select(*key, "n", kinds.alias("kinds"))
