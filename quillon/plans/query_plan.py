"""Understanding a query: intent, target, term plan and candidate scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Wordings of Chinese questions by intent, in order of precedence.
INTENT_PATTERNS = [
    ("definition", r"^(.+?)的定义$"),
    ("definition", r"^(.+?)的概念$"),
    ("definition", r"^(.+?)是什么$"),
    ("definition", r"^什么是(.+)$"),
    ("definition", r"^(.+?)指什么$"),
    ("comparison", r"^(.+?)(?:有什么)?区别$"),
    ("example", r"^(.+?)的例子$"),
    ("reason", r"^(.+?)为什么.+$"),
    ("process", r"^(.+?)的过程$"),
]
# Wordings that make a query one for the precise mode.
PRECISE_PATTERNS = [
    r"什么是.+", r".+是什么", r".+的(?:定义|概念|本质|特点|条件|作用|过程|原因)", r".+指什么",
    r".+(?:定律|定理|法则|原理|公式)$", r".+(?:有什么)?区别", r".+的(?:例子|实例)", r".+为什么.+",
]
# What is taken off a target, words that say nothing, and wordings by intent and round (T is the target).
TRIMMED = [
    r"^请(?:直接)?(?:根据教材)?(?:回答|解释|说明)?", r"^(?:帮我|请你)?(?:只)?(?:在课本中|在教材中)?(?:找|查|说明|解释)?",
    r"(?:的定义|的概念|的本质)$", r"(?:是什么|指什么|是什么意思)$", r"^(什么是)",
]
BARE_WORDS = ["定义", "概念", "本质", "特点", "条件", "作用", "过程", "原因", "什么是", "是什么"]
WORDINGS = {
    "definition": [
        ["T的定义", "T是什么", "什么是T", "T是", "T概念", "称为T", "才能称为T"],
        ["T是指", "T通常指", "T称为", "T叫做", "什么样的物质才能称为T"],
    ],
    "comparison": [["T区别", "T不同"], ["T联系"]],
    "example": [["T例子", "T实例"]],
    "reason": [["T原因", "T为什么"]],
    "process": [["T过程", "T步骤"]],
}
# Bonuses of the ways in which a term got into the plan, and of the channels of a hit.
BASIS_BONUS = {
    "exact": 54.0, "concept": 50.0, "contained": 46.0, "phrase": 44.0, "alias": 40.0, "expanded": 34.0,
    "precision_query": 58.0, "precision_followup": 42.0, "display_term": 30.0, "fallback": 24.0, "query": 18.0,
}
CHANNEL_BONUS = {"exact": 44.0, "fts": 24.0, "semantic": 18.0, "supplemental": 16.0}
#: Terms of a plan at most.
PLAN_LIMIT = 8


def trimmed(target: Column) -> Column:
    """A target without requests before it, question words around it and punctuation."""
    out = tx.clean(target)
    for p in TRIMMED:
        out = F.regexp_replace(out, p, "")
    out = F.regexp_replace(out, r"""[「」“”"'？?。！，,：:；;（）()\[\]{}]+""", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def classify(queries: DataFrame) -> DataFrame:
    """Queries (query) with their intent, target and whether they ask for the precise mode."""
    q = tx.compact(F.col("query"))
    rules = [(q.rlike(p), name, F.regexp_extract(q, p, 1)) for name, p in INTENT_PATTERNS]
    rules += [
        (q.contains("定义"), "definition", F.regexp_replace(q, "定义", "")),
        (q.contains("什么是") | q.endswith("是什么"), "definition", F.regexp_replace(q, "什么是|是什么", "")),
        (q.rlike(r"(?:定律|定理|法则|原理|公式)$"), "definition", F.col("query")),
        (q.contains("区别") | q.contains("不同"), "comparison", F.col("query")),
        (q.contains("例子") | q.contains("实例"), "example", F.col("query")),
    ]
    intent = F.coalesce(*[F.when(c, name) for c, name, _ in rules], F.lit("lookup"))
    target = trimmed(trimmed(F.coalesce(*[F.when(c, t) for c, _, t in rules], F.col("query"))))
    precise = reduce(lambda a, b: a | b, [q.rlike(p) for p in PRECISE_PATTERNS])
    return queries.select(
        "query", intent.alias("intent"), F.when(target == "", tx.clean(F.col("query"))).otherwise(target).alias("target"), precise.alias("precise")
    )


def low_signal(term: Column, target: Column) -> Column:
    """Terms that say nothing by themselves: one character, bare question words, the target with a particle."""
    t, g = tx.compact(term), tx.compact(target)
    particle = (t == F.concat(g, F.lit("的"))) | (t == F.concat(F.lit("的"), g)) | (t == F.concat(F.lit("是"), g))
    return (F.length(t) < 2) | t.isin(BARE_WORDS) | t.rlike("^的(?:定义|概念|本质|特点|条件|作用|过程|原因)$") | (g != "") & particle


def _distinct_terms(terms: Column, limit: int) -> Column:
    """Terms of two or more compact characters, each compact form once, in order, limit at most."""
    cleaned = F.filter(F.transform(terms, tx.clean), lambda t: F.length(F.regexp_replace(t, r"\s+", "")) >= 2)

    def first_of(ts: Column) -> Column:
        flat = F.transform(ts, lambda t: F.regexp_replace(t, r"\s+", ""))
        return F.filter(ts, lambda t, i: F.array_position(flat, F.regexp_replace(t, r"\s+", "")) == i + 1)

    return F.slice(tx.bound(cleaned, first_of), 1, limit)


def _filled(templates: list[str], target: Column) -> Column:
    return F.array(*[F.replace(F.lit(t), F.lit("T"), target) for t in templates])


def search_terms(profiles: DataFrame, round_index: int = 0, more: Column | None = None, limit: int = 12) -> DataFrame:
    """Profiles (query, target, intent) with terms: query, target, the intent's wordings, then more terms (an array) of some signal."""
    own = F.coalesce(
        *[F.when(F.col("intent") == name, _filled(rounds[min(round_index, len(rounds) - 1)], F.col("target"))) for name, rounds in WORDINGS.items()],
        F.array().cast("array<string>"),
    )
    extra = F.array().cast("array<string>") if more is None else F.filter(more, lambda t: ~low_signal(t, F.col("target")))
    return profiles.withColumn("terms", _distinct_terms(F.concat(F.array("query", "target"), own, extra), limit))


def semantic_queries(profiles: DataFrame, limit: int = 4) -> DataFrame:
    """Profiles (query, target, intent, precise, display) with the texts that a dense search is asked."""
    defines = F.col("precise") & (F.col("intent") == "definition")
    shown = F.col("precise") & (low_signal(F.col("display"), F.col("target")) | defines & (tx.compact(F.col("display")) == tx.compact(F.col("target"))))
    none = F.lit("")
    asked = F.concat(
        F.array("query", F.when(defines, none).otherwise(F.col("target")), F.when(shown, none).otherwise(F.col("display"))),
        F.when(defines, _filled(["T是什么", "什么是T", "T是"], F.col("target"))).otherwise(F.array().cast("array<string>")),
    )
    return profiles.withColumn("asked", _distinct_terms(asked, limit))


def matched_concepts(queries: DataFrame, concepts: DataFrame, longest: int = 6) -> DataFrame:
    """Queries with the concepts that they name: exact 300, contained 220 + characters; mode concept or direct.

    Queries meet concepts by their phrases, so that no query is compared with the whole catalogue.
    """
    words = tx.words(F.col("query"))
    phrases = queries.select("query", F.explode(tx.phrases(words, longest, " ")).alias("concept"))
    found = phrases.join(concepts.select("concept").distinct(), "concept")
    exact = F.col("concept") == F.lower(F.trim("query"))
    score = F.when(exact, 300).otherwise(220 + F.length("concept"))
    best = found.groupBy("query").agg(
        F.max_by("concept", F.struct(score.alias("score"), F.length("concept").alias("n"), "concept")).alias("display"), F.max(score).alias("score"),
        F.count(F.lit(1)).alias("n_concepts"),
    )
    return queries.select("query").join(best, "query", "left").select(
        "query", F.coalesce("display", F.lower(F.trim("query"))).alias("display"), F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("n_concepts", F.lit(0)).alias("n_concepts"), F.when(F.col("score").isNotNull(), "concept").otherwise("direct").alias("mode"),
    )


def term_plan(terms: list[tuple[str, str]], limit: int = PLAN_LIMIT) -> list[tuple[str, str]]:
    """Distinct (term, basis) of two or more characters, first come first; a plan is a handful of terms."""
    seen, out = set(), []
    for term, basis in terms:
        key = "".join(term.split())
        if len(key) >= 2 and key not in seen:
            seen.add(key)
            out.append((term.strip(), basis))
    return out[:limit]


def candidate_window(offset: int, limit: int, multiple: int = 4, least: int = 60, most: int = 600) -> int:
    """How many candidates to score for a page of results."""
    return min(most, max(least, (offset + limit) * multiple))


def fallback_scores(terms: DataFrame, query: str | Column) -> DataFrame:
    """Scores of candidate terms (term, primary_hits, extra_hits) of a query, or of the query in a column; terms without hits go."""
    q, t = (F.lit(query) if isinstance(query, str) else query), F.col("term")
    n = F.length(t).cast("long")
    hits = F.col("primary_hits") + F.col("extra_hits")
    inside = q.contains(t)
    score = (
        F.when(t == q, 240).otherwise(0)
        + F.when(
            inside,
            n * 24 + 40 + F.when(q.startswith(t), 45).otherwise(0) + F.when(q.endswith(t), 65).otherwise(0) + F.when(n >= 4, 30).otherwise(0),
        ).otherwise(n * 12)
        + F.least(hits, F.lit(6)) * 10
        + F.when((F.col("extra_hits") > 0) & (F.col("primary_hits") <= 0), 22).otherwise(0)
        + F.when(hits <= 4, (5 - hits) * 8).otherwise(0)
        - F.when(hits > 12, F.least(F.lit(60), (hits - 12) * 2)).otherwise(0)
    )
    return terms.filter(hits > 0).withColumn("score", score.cast("long"))


def basis_bonus(basis: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in BASIS_BONUS.items() for x in kv])[basis], F.lit(20.0))


def channel_bonus(channel: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CHANNEL_BONUS.items() for x in kv])[channel], F.lit(12.0))


def first_plan_term(docs: DataFrame, plan: list[tuple[str, str]]) -> DataFrame:
    """Rows that hold a term of the plan, scored by the first one that they hold.

    score = 420 - 24 x priority + min(90, 18 x hits) + min(24, 3 x length).
    """
    flat = tx.ascii_fold(F.col("text"))
    found = F.coalesce(*[F.when(flat.contains(t.lower()), F.lit(i)) for i, (t, _) in enumerate(plan)])
    rows = docs.withColumn("priority", found).filter("priority is not null")
    pick = lambda values: F.array(*[F.lit(v) for v in values])[F.col("priority")]
    hits = tx.occurrences(flat, pick([t.lower() for t, _ in plan]))
    return rows.withColumn("term", pick([t for t, _ in plan])).withColumn("basis", pick([b for _, b in plan])).withColumn("hits", hits).withColumn(
        "score",
        (420 - 24 * F.col("priority") + F.least(F.lit(90), 18 * F.col("hits")) + F.least(F.lit(24), 3 * F.length("term"))).cast("long"),
    )


def aliases(synonyms: DataFrame) -> DataFrame:
    """term and each alias out of JSON records, in the order of the record's lists, case-folded duplicates dropped."""
    keys = ["synonyms", "near_synonyms", "english", "abbreviations", "aliases"]
    schema = "struct<" + ",".join(f"{k}:array<string>" for k in keys) + ">"
    parsed = F.from_json("synonyms", schema)
    lists = F.concat(*[F.coalesce(parsed[k], F.array().cast("array<string>")) for k in keys])
    return synonyms.select("term", F.posexplode(lists).alias("pos", "alias")).filter("trim(alias) <> ''").groupBy(
        "term", F.lower(F.trim("alias")).alias("folded")
    ).agg(F.min("pos").alias("pos"), F.min_by(F.trim("alias"), F.col("pos")).alias("alias")).drop("folded")
