"""Weighted fusion of channels, evidence extraction, bonuses and reranking."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.selection import first_by
from quillon.plans.query_plan import basis_bonus, channel_bonus
from quillon.session import materialize


def lexical_base(priority: Column, basis: Column, channel: Column) -> Column:
    """Base score of a lexical candidate."""
    return 168.0 - 10.0 * priority + basis_bonus(basis) + channel_bonus(channel)


def fuse(channels: list[DataFrame]) -> DataFrame:
    """Candidates (id, base_score, semantic_score, term, channel) of all channels, the best of each id."""
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c)
    return first_by(rows, ["id"], [F.desc("base_score"), F.desc("semantic_score"), F.col("channel"), F.col("term")])


def coverage_bonus(query: str, reference: Column) -> Column:
    """How much of a compact query a compact reference text covers; between -18 and 68."""
    if len(query) < 2:
        return F.lit(0.0)
    bigrams = list(dict.fromkeys(query[i : i + 2] for i in range(len(query) - 1)))
    chars = list(dict.fromkeys(query))
    share = tx.count_in(reference, chars) / float(len(chars))
    bonus = (
        F.when(reference.contains(query), 42.0).otherwise(0.0)
        + tx.count_in(reference, bigrams) / float(len(bigrams)) * 28.0
        + share * 18.0
        - F.when(share < 0.42, 18.0).otherwise(0.0)
    )
    return F.when(reference == "", 0.0).otherwise(tx.clamp(bonus, -18.0, 68.0))


# Wordings that define a term (T), with their weight, where they are looked for, and questions.
_STOP = r"(?:^|[。！？；：\n])"
DEFINING: list[tuple[str, float, str]] = [
    ("text", 22.0, _STOP + "(?:什么是)?T(?:通常)?是指"),
    ("text", 22.0, _STOP + "(?:什么是)?T(?:通常)?指"),
    ("text", 22.0, _STOP + "T(?:是|叫做|称为)"),
    ("text", 22.0, r"(?:把|将)[^。！？；：\n]{0,40}(?:称为|叫做)T"),
    ("text", 22.0, r"[^。！？；：\n]{0,40}物质(?:称为|叫做)T"),
    ("text", 22.0, "什么样的物质才能称为T"),
    ("text", 22.0, "才能称为T"),
    ("flat", 10.0, "T是指"),
    ("flat", 10.0, "T通常指"),
    ("flat", 10.0, "T称为"),
    ("flat", 10.0, "T叫做"),
    ("flat", 10.0, "什么是T"),
    ("flat", 10.0, "称为T"),
    ("flat", 10.0, "才能称为T"),
    ("flat", 10.0, "什么样的物质才能称为T"),
    ("flat", 10.0, "T概念"),
    ("text", -12.0, "什么样的|究竟什么|有什么不同|为什么"),
    ("text", -14.0, r"(?:称为|叫做)T[A-Za-z0-9\x{4e00}-\x{9fff}]"),
    ("title", 10.0, "定义|概念"),
    ("title", 6.0, "T"),
]
# Rules of evidence spans by intent, and the weight of a marker word.
EVIDENCE: dict[str, list[tuple[float, str]]] = {
    "definition": [
        (30.0, "(?:^|[。！？；：])(?:什么是)?T(?:通常)?是指"),
        (30.0, "(?:^|[。！？；：])(?:什么是)?T(?:通常)?指"),
        (30.0, "(?:^|[。！？；：])T(?:是|叫做|称为)"),
        (30.0, "(?:把|将)[^。！？；：]{0,40}(?:称为|叫做)T"),
        (30.0, "[^。！？；：]{0,40}物质(?:称为|叫做)T"),
        (30.0, "什么样的物质才能称为T"),
        *[(10.0, m) for m in ("是指", "通常指", "称为", "叫做", "是什么", "概念", "定义")],
        (-10.0, "什么样的|为什么|有什么不同"),
        (-16.0, r"(?:称为|叫做)T[A-Za-z0-9\x{4e00}-\x{9fff}]"),
    ],
    "comparison": [(8.0, m) for m in ("区别", "不同", "相同", "联系", "相比", "而", "但是")],
    "example": [(8.0, m) for m in ("例如", "比如", "如", "实例", "例子", "典型")],
    "reason": [(8.0, m) for m in ("原因", "因为", "由于", "所以", "导致")],
    "process": [(7.0, m) for m in ("过程", "步骤", "先", "然后", "接着", "最后")],
}

#: A class of characters that a pattern begins with and that may be empty.
_EMPTY_START = re.compile(r"^\[\^[^\]]*\]\{0,\d+\}")


def rule_points(rules: list[tuple[float, str]], text: Column, target: str) -> Column:
    """Sum of the weights of the patterns that a text matches; T stands for the target.

    A run at the start of a pattern that may be empty decides nothing, but would be tried at every place of
    a text; a pattern with the target is only tried on texts that have it.
    """

    def holds(pattern: str) -> Column:
        said = _EMPTY_START.sub("", pattern).replace("T", rf"\Q{target}\E")
        return text.contains(target) & text.rlike(said) if "T" in pattern else text.rlike(said)

    return sum((F.when(holds(p), w).otherwise(0.0) for w, p in rules), F.lit(0.0))


def definition_bonus(target: str, title: Column, text: Column, matched: Column | None = None) -> Column:
    """Bonus of texts that define the target; between -24 and 54.

    A row that was found by the bare target (matched) and defines nothing loses 24.
    """
    places = {"text": text, "flat": tx.compact(text), "title": tx.compact(title)}
    bonus = sum((rule_points([(w, p) for at, w, p in DEFINING if at == place], c, target) for place, c in places.items()), F.lit(0.0))
    if matched is not None:
        bonus = tx.bound(bonus, lambda b: b - F.when((tx.compact(matched) == target) & (b <= 0), 24.0).otherwise(0.0))
    return tx.clamp(bonus, -24.0, 54.0)


def span_score(
    span: Column, target: str, term: str, query: str, markers: list[str] | None = None, weight: float = 8.0, intent: str = "lookup"
) -> Column:
    """Score of an evidence span: what it holds of target, term and query, the rules of the intent, length.

    markers are more words that count, each with the same weight.
    """
    flat = tx.ascii_fold(span)
    holds = lambda t, w: F.when(flat.contains(t.lower()), w).otherwise(0.0) if t else F.lit(0.0)
    return (
        holds(target, 22.0) + holds(term, 12.0) + holds(query, 8.0)
        + tx.count_in(flat, markers or []) * weight
        + rule_points(EVIDENCE.get(intent, []), span, target)
        - F.greatest(F.lit(0.0), (F.length(span) - 120) * 0.08)
        - F.when(F.length(span) < 10, 8.0).otherwise(0.0)
    )


def best_evidence(
    rows: DataFrame, target: str, term: str, query: str, markers: list[str] | None = None, least: float = 18.0, intent: str = "lookup"
) -> DataFrame:
    """For each row (id, text) its best sentence of 4 to 260 characters, the first of equal ones.

    Where none reaches the least score, the context of the term.
    """
    spans = rows.select("id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "span")).filter(F.length("span").between(4, 260))
    spans = spans.withColumn("score", span_score(F.col("span"), target, term, query, markers, intent=intent))
    best = first_by(spans, ["id"], [F.desc("score"), F.col("pos")]).select("id", "span", "score")
    strong = F.coalesce(F.col("score") >= least, F.lit(False))
    context = tx.context_snippet(F.coalesce("text", F.lit("")), F.lit(term or target or query))
    return rows.select("id", "text").join(best, "id", "left").select(
        "id", F.when(strong, F.col("span")).otherwise(context).alias("evidence"),
        F.when(strong, F.col("score")).otherwise(F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0)))).alias("evidence_score"),
        F.when(strong, "sentence").otherwise("context").alias("source"),
    )


def relevance(words: Column, text: Column, terms: list[str], concepts: list[str], same_subject: Column) -> Column:
    """Relevance from 0 to 100: terms up to 35, concepts up to 40, 15 for the same subject, short texts lose 20."""
    term_points = sum((F.when(F.array_contains(words, t), min(3, len(t) - 1)).otherwise(0) for t in terms[:15]), F.lit(0))
    concept_points = sum((F.when(F.array_contains(words, c), min(15, 2 * len(c))).otherwise(0) for c in concepts), F.lit(0))
    score = F.least(F.lit(35), term_points) + F.least(F.lit(40), concept_points) + F.when(same_subject, 15).otherwise(0)
    score = F.when(F.length(text) < 50, F.greatest(F.lit(0), score - 20)).otherwise(score)
    return F.least(F.lit(100), score).cast("long")


def rerank(candidates: DataFrame, model: Callable[[Column], Column] | None = None, most: int = 36) -> DataFrame:
    """Candidates (id, base_score, semantic_score, evidence_score, coverage, intent_bonus, text) in final order.

    The model scores the first candidates by pre-score; without one every rerank score is 0.
    """
    pre = F.col("base_score") + F.col("evidence_score") + F.col("coverage") + 24.0 * F.col("semantic_score")
    rows = candidates.withColumn("pre_score", pre)
    if model is not None:
        rows = materialize(rows, "candidates")  # read by the model and again for the result
    if model is None:
        scored = rows.withColumn("rerank_score", F.lit(0.0))
    else:
        first = rows.orderBy(F.desc("pre_score"), F.col("id").cast("string")).limit(most)
        scores = first.select("id", tx.sigmoid(model(F.col("text"))).alias("rerank_score"))
        scored = rows.join(F.broadcast(scores), "id", "left").fillna(0.0, ["rerank_score"])
    final = (
        F.col("base_score") + 100.0 * F.col("rerank_score") + F.col("intent_bonus") + 35.0 * F.col("semantic_score")
        + F.col("evidence_score") + F.col("coverage")
    )
    return scored.withColumn("final_score", final)


def quota_per_term(rows: DataFrame, limit: int, n_terms: int, most_terms: int = 4) -> DataFrame:
    """Rows (term, id, rank) cut to an equal share of the limit for each term, then merged by id."""
    share = -(-limit // max(1, min(n_terms, most_terms)))
    w = Window.partitionBy("term").orderBy("rank", "id")
    kept = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= share).drop("rn")
    return first_by(kept, ["id"], [F.col("rank"), F.col("term")])
