"""Exam papers and dictionary examples: questions, occurrences, example sentences, classical style."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.selection import first_by

CJK = r"[\x{4e00}-\x{9fff}]"
# Particles of classical sentences, and of modern ones.
CLASSICAL, MODERN = ["曰", "矣", "焉", "乎", "哉", "兮", "也", "者"], r"[的了呢吗吧着]"


def first_kind(text: Column, kinds: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that a block matches, or null."""
    return F.coalesce(*[F.when(text.rlike(pattern), name) for name, pattern in kinds])


def occurrences(papers: DataFrame, block: str, token: str) -> DataFrame:
    """id, block_no, token_no and token of every token of every block of the papers (id, text).

    A block begins where its pattern matches; the tokens of a block are the first group of a pattern.
    """
    blocks = papers.select("id", F.posexplode(F.split("text", block)).alias("block_no", "block"))
    return blocks.select("id", "block_no", F.posexplode(F.regexp_extract_all("block", F.lit(token), F.lit(1))).alias("token_no", "token"))


def questions(rows: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Occurrences (question, label, number, gloss, excerpt) grouped by question.

    labels, numbers and glosses are sorted sets without nulls; n counts the occurrences. The text is
    that of the documents (question, text), or else the excerpts in order.
    """
    own = rows.groupBy("question").agg(
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.array_sort(F.collect_set("number")).alias("numbers"),
        F.array_sort(F.collect_set(F.nullif(F.trim("gloss"), F.lit("")))).alias("glosses"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("excerpt")), "\n").alias("excerpts"),
    )
    if documents is None:
        return own.withColumnRenamed("excerpts", "text").withColumn("source_mode", F.lit("excerpts"))
    told = documents.select("question", F.nullif(F.trim("text"), F.lit("")).alias("told"))
    both = own.join(told, "question", "left")
    return both.select(
        *[c for c in own.columns if c != "excerpts"], F.coalesce("told", "excerpts").alias("text"),
        F.when(F.col("told").isNotNull(), "document").otherwise("excerpts").alias("source_mode"),
    )


def top_examples(rows: DataFrame, n: int = 6) -> DataFrame:
    """The n best examples (title, id, score), one of each title."""
    one = first_by(rows, ["title"], [F.desc("score"), F.col("id")])
    return one.orderBy(F.desc("score"), "title").limit(n)


def marker_score(text: Column, strong: list[str], light: list[str]) -> Column:
    """2 for each occurrence of a strong marker and 1 for a light one, four of each marker at most, and 2 for a title in 《》."""
    points = [F.least(F.lit(4), tx.occurrences(text, m)) * w for w, ms in ((2, strong), (1, light)) for m in ms]
    return reduce(lambda a, b: a + b, points, F.lit(0)) + F.when(text.contains("《") & text.contains("》"), 2).otherwise(0)


def _lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def looks_like_poem(text: Column) -> Column:
    """At least four, and two in five, of the first sixteen lines have 2 to 18 characters and do not end a sentence."""

    def of(lines: Column) -> Column:
        bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"[（(].*?[)）]", ""), r"^[· ]+|[· ]+$", ""))
        short = F.size(F.filter(bare, lambda x: F.length(x).between(2, 18) & ~x.endswith("。")))
        return (F.size(lines) >= 4) & (short >= 4) & (short >= F.floor(F.size(lines) * 0.4))

    return tx.bound(F.slice(_lines(text), 1, 16), of)


def heading(text: Column) -> Column:
    """The first of six lines that is short, no number and no sentence; else an empty text."""
    first = F.slice(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), 1, 6)
    bare = F.transform(first, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^\*+|\*+$", ""))
    good = F.filter(
        bare, lambda x: F.length(x).between(1, 28) & ~x.rlike(r"^[0-9一二三四五六七八九十百千（）()·.、 ]+$") & ~x.rlike("[。？！；：:]")
    )
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def sentence_score(
    sentence: Column, headword: str, hints: list[str], letter: str = CJK, classical: list[str] = CLASSICAL, modern: str = MODERN
) -> Column:
    """How well a sentence shows a headword: letters, length, classical and modern wording, and the headword's place."""
    # All bounds and weights of this sum.
    n = F.regexp_count(sentence, F.lit(letter))
    flat = F.regexp_replace(sentence, r"\s+", "")
    points = lambda condition, w: F.when(condition, w).otherwise(0)
    score = (
        F.least(n, F.lit(48))
        + F.when(n.between(8, 44), 40).when(n < 6, -40).otherwise(-F.least(F.lit(30), n - 44))
        - 50 * tx.count_in(sentence, hints)
        - points(sentence.rlike(r"[〔〕【】\[\]]"), 35)
        - points(sentence.rlike(r"[0-9$\\]" if letter != CJK else r"[A-Za-z0-9$\\]"), 20)
        + points(tx.count_in(sentence, classical) > 0, 18)
        + points(sentence.rlike("[。！？；.!?;]$"), 8)
        + points(F.instr(flat, headword).between(1, 3), 6)
        + points(reduce(lambda a, b: a | b, [flat.endswith(headword + x) for x in ("", "也", "矣", "乎")]), 10)
        - points(F.length(flat) > 80, 20)
        - 8 * F.regexp_count(sentence, F.lit(modern))
    )
    return F.when(sentence.contains(headword), score).otherwise(-10_000).cast("long")


def best_sentence(rows: DataFrame, headword: str, score, least: int) -> DataFrame:
    """id, sentence and score of the best sentence of each row (id, text) that reaches a least score; the first of equal ones."""
    spans = rows.select("id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).filter(F.col("sentence").contains(headword))
    scored = spans.withColumn("score", score(F.col("sentence"))).filter(F.col("score") >= least)
    return first_by(scored, ["id"], [F.desc("score"), F.col("pos")]).select("id", "sentence", "score")


def headword_lines(lines: DataFrame, shape: Column) -> DataFrame:
    """Lines (id, pos, line) that look like entry heads: of the given shape, after no other head, before a longer line."""
    w = Window.partitionBy("id").orderBy("pos")
    near = lines.withColumns({"head": shape, "before": F.lag(shape).over(w), "after": F.lead("line").over(w)})
    return near.filter(F.col("head") & ~F.coalesce("before", F.lit(False)) & (F.length("after") > F.length("line"))).select("id", "pos", "line")


def entry_spans(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines under the head that they follow: id, head, first and last line number and characters of each entry."""
    marked = lines.join(heads.select("id", "pos", F.col("line").alias("own")), ["id", "pos"], "left")
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    under = marked.withColumns({"entry": F.sum(F.col("own").isNotNull().cast("int")).over(w), "head": F.last("own", ignorenulls=True).over(w)})
    return under.filter("entry > 0").groupBy("id", "entry", "head").agg(
        F.min("pos").alias("first_line"), F.max("pos").alias("last_line"), F.sum(F.length("line")).alias("chars")
    )


def best_candidate(rows: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """The candidate of the greatest weighted score of each key; the smaller candidate of equal ones."""
    score = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])
    return first_by(rows.withColumn("score", score), [key], [F.desc("score"), F.col("candidate")])
