"""Search plans, evidence, exams and text functions on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import dictionary, exams, fusion, lexical, search, selection
from quillon.plans import query_plan


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [tuple(r)[1:] for r in rows.select("id", *columns).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("query", "intent", "target"),
    [
        ("函数的定义", "definition", "函数"), ("什么是光合作用", "definition", "光合作用"), ("请解释牛顿第一定律", "definition", "牛顿第一定律"), ("氧化和还原有什么区别", "comparison", "氧化和还原"),
        ("隐喻的例子", "example", "隐喻"), ("天空为什么是蓝的", "reason", "天空"), ("细胞分裂的过程", "process", "细胞分裂"), ("三角函数", "lookup", "三角函数"),
    ],
)
def test_profiles(spark, query, intent, target):
    got = query_plan.classify(spark.createDataFrame([(query,)], "query string")).first()
    assert (got["intent"], got["target"]) == (intent, target)


def test_definition_rules(spark):
    texts = ["熵是指系统混乱的程度。", "人们把这个量称为熵", "为什么熵会增加", "才能称为熵增", "没有关系"]
    got = [x for (x,) in values(spark, texts, fusion.definition_bonus("熵", F.lit("熵的概念"), F.col("text")))]
    # 是指 + 指 + 是 anchored (66), told (10), title (16), at most 54; and so on.
    assert got == [54.0, 48.0, 4.0, 22.0 + 20.0 - 14.0 + 16.0, 16.0]
    bare = values(spark, ["没有关系"], fusion.definition_bonus("熵", F.lit("物理"), F.col("text"), F.lit("熵")))
    assert bare == [(-24.0,)]


def test_evidence_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "熵是指系统混乱的程度。其他句子。"), (2, "x"), (3, None), (4, "")], "id long, text string")
    got = {r["id"]: r for r in fusion.best_evidence(rows, "熵", "熵", "熵", intent="definition").collect()}
    assert got[1]["source"] == "sentence" and got[1]["evidence"] == "熵是指系统混乱的程度。" and got[1]["evidence_score"] >= 18
    assert {k: (r["source"], r["evidence_score"]) for k, r in got.items() if k > 1} == {k: ("context", 0.0) for k in (2, 3, 4)}


def test_contained_terms_of_any_kind(spark):
    needles = ["2024-12", "...!", "中", "ab", "the end of a long story told", "ending"]
    texts = ["on 2024-12-01 it rained", "what...!", "中文", "xabx", "at the end of a long story told twice", "spending", "nothing", ""]
    terms = spark.createDataFrame(list(enumerate(needles)), "term_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = sorted((i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n in t)
    assert sorted(map(tuple, lexical.contained_terms(terms, docs).collect())) == want
    lexical.NEEDLE_KEYS, kept = 0, lexical.NEEDLE_KEYS
    try:
        assert sorted(map(tuple, lexical.contained_terms(terms, docs).collect())) == want
    finally:
        lexical.NEEDLE_KEYS = kept
    assert lexical.contained_terms(terms.limit(0), docs).count() == 0


def test_blocks_are_folded_in_order(spark):
    blocks = ["第一行", " 第一行 ", "一行", "x", "第二行", "第一行", "a much longer line that may well repeat itself", "第二行 和", "a much longer line that may well repeat itself"]
    rows = spark.createDataFrame([("b", 1, i, t) for i, t in enumerate(blocks)], "path string, page int, pos int, text string")
    got = selection.merge_blocks(rows).first()["text"].split("\n")
    assert got == ["第一行", "第二行", "a much longer line that may well repeat itself", "第二行 和", "a much longer line that may well repeat itself"]
    assert selection.merge_blocks(rows, least_page=500).count() == 0


def test_images_and_excerpts(spark):
    texts = ["a ![x](y.png) b ![z](w)", "<p><img src=1></p>", "plain"]
    assert values(spark, texts, search.has_image(F.col("text")), search.image_count(F.col("text"))) == [(True, 2), (True, 1), (False, 0)]
    assert values(spark, texts[:1], search.excerpt(F.lit(" "), F.col("text")), search.excerpt(F.lit("sum"), F.col("text"))) == [("a   b", "sum")]


def test_text_functions(spark):
    assert values(spark, ["ＡＢ①ﬁ", None], tx.nfkc(F.col("text"))) == [("AB1fi",), (None,)]
    assert values(spark, ["Éàñ Ö"], tx.unaccented(F.col("text"))) == [("ean o",)]
    lines = "A line of prose.\nUNIT 1 UNIT 2\npp. 3 and pp. 4\nabandon /x/ v. 放弃\nALL WORDS HERE ARE BIG ONES\n![a](b) It's John's NATO day"
    assert values(spark, [lines], tx.english_lines(F.col("text"))) == [("A line of prose. It's John's NATO day",)]
    assert values(spark, [lines], tx.english_tokens(F.col("text"), ["day"], ["NATO"])) == [(["line", "prose", "john", "NATO"],)]
    told = values(spark, ["《史记》第12页", "Physics p. 7", "none"], tx.reference_page(F.col("text")))
    assert [tuple(x[0]) for x in told] == [("史记", 12), ("Physics", 7), (None, None)]


def test_idiom_sections_and_lines(spark):
    rows = spark.createDataFrame([(1, '{"a": " _x000D_one*1*# ", "b": "", "c": "x\\ny\\n\\nz"}')], "id long, record string")
    got = dictionary.sections(rows, {"first": ["b", "a"], "source": ["c"], "none": ["d"]}).first()
    assert (got["first"], got["none"]) == ("one", None)
    assert values(spark, [got["source"]], dictionary.unfolded_lines(F.col("text"))) == [("xy\nz",)]
    assert values(spark, ["书法"], dictionary.converted(F.col("text"), {"书": "書"}), dictionary.converted(F.col("text"), {})) == [("書法", "书法")]


def test_sentences_and_poems(spark):
    score = exams.sentence_score(F.col("text"), "之", ["同学"])
    got = [x for (x,) in values(spark, ["学而时习之，不亦说乎。", "同学们都知道之", "没有"], score)]
    assert got[0] == 9 + 40 + 18 + 8 and got[1] == 7 + 37 - 50 + 10 and got[2] == -10_000
    poem = "床前明月光\n疑是地上霜\n举头望明月\n低头思故乡"
    assert values(spark, [poem, "一句话。\n又一句。\n第三句。\n第四句。"], exams.looks_like_poem(F.col("text"))) == [(True,), (False,)]
    assert values(spark, ["12\n**静夜思**\n床前", "这是一句话。"], exams.heading(F.col("text"))) == [("静夜思",), ("",)]


def test_nearest_in_blocks_is_the_nested_loop(spark):
    from quillon.operators import vector

    points = [(i, [float((i * 7) % 5), float((i * 3) % 4), 1.0]) for i in range(40)]  # many equal scores
    rows = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    got = vector.nearest_in_blocks(rows.filter("vec_id % 10 = 0"), rows, 4, query_block=2, vector_block=7).collect()
    for key in (0, 10, 20, 30):
        scores = sorted((-sum(a * b for a, b in zip(points[key][1], e, strict=True)), i) for i, e in points if i != key)[:4]
        assert [(x["vec_id"], x["score"]) for x in sorted((x for x in got if x["query_id"] == key), key=lambda x: x["rank"])] == [(i, -v) for v, i in scores]
    assert vector.nearest_in_blocks(rows.limit(0), rows, 4).count() == 0
