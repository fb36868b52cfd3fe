"""Findings of round 4: queries against their SQL on tables where they went wrong, and operators that were rebuilt against plain truths."""

import random
import re

import pytest
from oracle import connection, rows
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, graph, lexical, linking, ranked
from quillon.plans import catalogue, catalogue_corpus, catalogue_links  # noqa: F401  (register their queries)
from quillon.plans.catalogue import ORACLES, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def same_as_sql(spark, path, name, **tables):
    """Whether a query gives the rows of its SQL over some tables (rows and schema by name)."""
    for table, (some, schema) in tables.items():
        spark.createDataFrame(some, schema).toPandas().to_parquet(f"{path}/{table}.parquet", index=False)
    return rows(QUERIES[name](spark, str(path)).toPandas()) == rows(connection(str(path)).sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["table_digest", "ordered_sha"])
def test_digests_are_those_of_the_sql(spark, tmp_path, name):
    """Two levels however many rows there are; null texts and negative ids."""
    some = [(i, None if i % 7 == 0 or 100 <= i < 150 else f"t{i}", "en", "s", 1) for i in range(-120, 6000)]
    assert same_as_sql(spark, tmp_path, name, documents=(some, DOCUMENTS))


def joined_rows(spark, run):
    """run() and the most rows that a join made in it."""
    store, seen = spark._jsparkSession.sharedState().statusStore(), set()

    def executions():
        listed = store.executionsList()
        return [listed.apply(i).executionId() for i in range(listed.size())]

    seen = set(executions())
    out, most = run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for x in set(executions()) - seen:
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size() if "Join" in nodes.apply(i).name() else 0):
                value = values.get(metrics.apply(j).accumulatorId())
                if metrics.apply(j).name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return out, most


def test_references_that_ask_the_same_share_a_search(spark, tmp_path):
    suppliers = [(i, i % 3) for i in range(200)] + [(7, 2), (300, None)]
    customers = [(i, f"Customer#{i}" if i % 11 else "Customer#", None if i % 5 == 0 else i % 4) for i in range(100, 700)] + [(700, None, 1), (701, "C", 2)]
    tables = dict(supplier=(suppliers, "s_suppkey long, s_nationkey int"), customer=(customers, "c_custkey long, c_name string, c_nationkey int"))
    same, most = joined_rows(spark, lambda: same_as_sql(spark, tmp_path, "resolve_references", **tables))
    assert same and most < 5000


@pytest.mark.parametrize("subjects", [None, "same", "other"])
def test_blocks_give_the_same_best_rows(spark, subjects):
    """Small blocks, ties, words of nearly all rows (impacts of 0), null subjects, texts that are null, empty or without words."""
    dice = random.Random(5)
    vocabulary = [f"w{chr(97 + i)}" for i in range(20)]
    text = lambda: " ".join(dice.choices(vocabulary, [2 ** (-j / 3) for j in range(20)], k=dice.randint(1, 30)))
    docs = [(i, dice.choice("ab") if i % 9 else None, "wa " + text()) for i in range(300)] + [(300, "a", None), (301, "b", ""), (302, "a", " 1, 2")]
    index = ranked.build_index(spark.createDataFrame(docs, "id long, subject string, text string"))
    asked = [(q, docs[q][1], t) for q in range(0, 300, 7) for t in dice.sample(vocabulary, 6)] + [(500, "a", "none"), (500, "a", "wa")]
    frame = spark.createDataFrame(asked, "qid long, qsubject string, term string")
    keep = F.col("id") != F.col("qid")
    if subjects is not None:
        keep &= (F.col("subject") == F.col("qsubject")) if subjects == "same" else (F.col("subject") != F.col("qsubject"))
    want = ranked.top_k(index, frame, 9, keep).select("qid", "id", "score", "rank").collect()
    got = ranked.top_k_in_blocks(index, frame, 9, subjects, 37, 11).select("qid", "id", "score", "rank").collect()
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["bm25_many", "two_round_retrieval"])
def test_queries_do_not_meet_rows_one_by_one(spark, tmp_path, name):
    """No join makes more rows than the texts have words, however many queries share them."""
    dice = random.Random(6)
    some = [(i, " ".join(f"word{chr(97 + dice.randint(0, 11))}" for _ in range(12)) if i % 97 else None, "en", "s", 1) for i in range(1500)]
    same, most = joined_rows(spark, lambda: same_as_sql(spark, tmp_path, name, documents=(some, DOCUMENTS)))
    assert same and most <= 12 * 1500


def test_few_concepts_need_no_phrases_and_no_shuffle(spark, tmp_path, monkeypatch):
    """Concepts of rows by both ways against plain Python; the registered query shuffles nothing."""
    dice = random.Random(7)
    docs = [(i, " ".join(dice.choices(["of", "the", "that", "und", "der", "Of,"], k=dice.randint(0, 7)))) for i in range(120)] + [(500, None), (501, "1")]
    concepts = ["the", "of the", "that", "und der", "der", "of the that und", "", "The", "of  the", None]
    want = set()
    for i, text in docs:
        line = " " + " ".join(re.findall("[a-z]+", (text or "").lower())) + " "
        own = [c for c in concepts if c and len(c.split(" ")) <= 3 and f" {c} " in line]
        want |= {(i, c) for c in own if not any(c != o and c in o for o in own)}
    rows_, names = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame([(c,) for c in concepts], "concept string")
    for few in (64, 0):
        monkeypatch.setattr(linking, "FEW_CONCEPTS", few)
        got = [tuple(r) for r in linking.match_concepts(rows_, names).collect()]
        assert len(got) == len(want) and set(got) == want
    monkeypatch.undo()
    spark.createDataFrame([(1, "of the", "en", "s", 6)], DOCUMENTS).toPandas().to_parquet(f"{tmp_path}/documents.parquet", index=False)
    found = QUERIES["concept_matches"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


@pytest.mark.parametrize("name", ["graph_seed_hints", "scored_comentions"])
def test_comentions_shuffle_counts_of_words_only(spark, tmp_path, name):
    """Rows of the SQL with null subjects and texts, from a table of words and subjects: postings of rows are not written."""
    dice = random.Random(8)
    vocabulary = ["de", "en", *(f"w{chr(97 + i)}" for i in range(12))]
    some = [(i, " ".join(dice.choices(vocabulary, k=9)) if i % 13 else None, dice.choice(["a", "b", "c", None]), "s", 1) for i in range(600)]
    assert same_as_sql(spark, tmp_path, name, documents=(some, DOCUMENTS))
    counts = graph.comention_counts(catalogue.docs(spark, str(tmp_path)), ["de", "en"])
    assert counts.count() <= 4 * len(vocabulary)
    word = lambda t: set((t or "").split())
    want = {(w, s): (sum(w in word(t) for _, t, x, *_ in some if x == s), [sum({w, c} <= word(t) for _, t, x, *_ in some if x == s) for c in ("de", "en")]) for w in vocabulary for s in "abc"}
    assert {(r.term, r.subject): (r.n, r.together) for r in counts.collect() if r.subject} == want


def test_phrases_are_digested_in_order(spark):
    """Against all phrases sorted: repeated words, words that begin alike, letters beyond the first plane, rows without words."""
    dice = random.Random(9)
    texts = ["a b ab a b a ab", "x", "", None, " 1 ", "Z z É é 𝒜 𝒜x ﬀ 語", "the " * 40]
    texts += [" ".join(dice.choices(["a", "ab", "abc", "b", "é", "語", "𝒜"], k=dice.randint(1, 60))) for _ in range(80)]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = rows_.select("id", tx.phrases(tx.words(F.col("text")), 6, " ").alias("p")).filter(F.size("p") > 0)
    want = plain.select("id", F.size("p").cast("long"), F.md5(F.array_join(F.array_sort("p"), "|"))).collect()
    got = lexical.phrase_digests(rows_, 6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == len(texts) - 3


def test_rules_are_the_plain_patterns(spark):
    """Points of all rules against Python's patterns as they are written, and no pattern that begins with a run that may be empty."""
    target, dice = "熵", random.Random(10)
    pieces = ["熵", "是指", "通常", "指", "。", "\n", "物质", "称为", "叫做", "把", "将", "什么是", "什么样的物质才能称为", "概念", "x", "；", "为什么"]
    texts = ["".join(dice.choices(pieces, k=dice.randint(0, 14))) for _ in range(400)]
    said = lambda p: re.compile(p.replace("T", target).replace(r"\x{4e00}-\x{9fff}", "一-鿿"))
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for rules in ([(w, p) for _, w, p in fusion.DEFINING], *fusion.EVIDENCE.values()):
        points = fusion.rule_points(rules, F.col("text"), target)
        assert not re.search(r"RLIKE\(text, \[\^[^\]]*\]\{0", str(points._jc.toString())) and "]{0,40}物质" not in str(points._jc.toString())
        got = {r["id"]: r["p"] for r in frame.select("id", points.alias("p")).collect()}
        assert got == {i: sum(w for w, p in rules if said(p).search(t)) for i, t in enumerate(texts)}


def test_links_by_terms_do_not_meet_rows_one_by_one(spark, tmp_path):
    """Rows of the SQL with null subjects; no join makes more rows than the texts have words."""
    dice = random.Random(11)
    some = [(i, " ".join(f"word{chr(97 + dice.randint(0, 15))}" for _ in range(dice.randint(0, 12))) if i % 97 else None, dice.choice(["a", "b", None]), "s", 1) for i in range(1500)]
    some = [(i, t, s if i else None, *x) if i != 50 else (50, "worda wordb wordc wordd", None, *x) for i, t, s, *x in some]
    same, most = joined_rows(spark, lambda: same_as_sql(spark, tmp_path, "exam_textbook_links", documents=(some, DOCUMENTS)))
    assert same and most <= 12 * 1500
