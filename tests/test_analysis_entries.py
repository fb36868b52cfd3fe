"""Query analysis, batched full text, outlines, entries and verification against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.operators import entries, occurrences, outline, page_map, query_analysis, ranked, verify
from quillon.operators.verify import Rule


def test_top_k_is_the_full_scoring(spark):
    """Bounds never lose a row, whatever the number of terms that set them."""
    dice = random.Random(4)
    vocabulary = [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(i, "ab"[i % 2], " ".join(dice.choices(vocabulary, [2 ** (-j / 3) for j in range(20)], k=dice.randint(1, 30)))) for i in range(300)]
    index = ranked.build_index(spark.createDataFrame(docs, "id long, subject string, text string"))
    impact = {(r.term, r.id): r.impact for r in index.postings.collect()}
    asked = {q: dice.sample(vocabulary, 6) for q in range(25)}
    frame = spark.createDataFrame([(q, "a", t) for q, ts in asked.items() for t in ts], "qid long, qsubject string, term string")
    want = []
    for q, terms in asked.items():
        scores = {i: sum(impact.get((t, i), 0) for t in terms) for i, s, _ in docs if s == "a" and any((t, i) in impact for t in terms)}
        want += [(q, i, s, n + 1) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5])]
    for seeds in (1, 3, 6):
        got = ranked.top_k(index, frame, 5, F.col("subject") == F.col("qsubject"), seeds).select("qid", "id", "score", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_containment_is_the_substring_relation(spark):
    dice = random.Random(8)
    word = lambda n: "".join(dice.choice("abc") for _ in range(n))
    needles, hays = {word(dice.randint(1, 6)) for _ in range(80)}, {word(dice.randint(0, 12)) for _ in range(200)}
    got = query_analysis.containment(
        spark.createDataFrame([(x,) for x in [*needles, ""]], "needle string"), spark.createDataFrame([(x,) for x in hays], "hay string")
    )
    assert sorted(map(tuple, got.collect())) == sorted((n, h) for n in needles for h in hays if n in h)


def test_query_modes(spark):
    concepts = spark.createDataFrame([("牛顿第一定律",), ("定律",), ("晶体",), ("ATP",)], "concept string")
    synonyms = spark.createDataFrame([("脱氧核糖核酸", '{"abbreviations": ["DNA", "dna"], "aliases": ["遗传物质"]}')], "term string, synonyms string")
    texts = spark.createDataFrame([(1, "水的蒸发与潜热有关"), (2, "潜热")], "id long, text string")
    more = spark.createDataFrame([(1, "反射弧的组成")], "id long, text string")
    asked = ["晶体", "牛顿第一定律是什么", "牛顿", "atp", "DNA", "脱氧核糖核酸", "地表潜热", "反射弧呢", "zzz", "？！", None]
    rows = query_analysis.analyse(spark.createDataFrame([(x,) for x in asked], "query string"), concepts, synonyms, texts, more).collect()
    got = {r["query"]: r for r in rows}
    assert {k: (r["mode"], r["display_term"]) for k, r in got.items()} == {
        "晶体": ("concept", "晶体"), "牛顿第一定律是什么": ("concept", "牛顿第一定律"), "牛顿": ("concept", "牛顿第一定律"), "atp": ("concept", "ATP"),
        "DNA": ("alias", "脱氧核糖核酸"), "脱氧核糖核酸": ("alias", "脱氧核糖核酸"), "地表潜热": ("fallback", "潜热"), "反射弧呢": ("fallback", "反射弧"),
        "zzz": ("direct", "zzz"), "？！": ("invalid", ""), None: ("invalid", ""),
    }
    assert got["牛顿第一定律是什么"]["concept_terms"] == "牛顿第一定律:contained:226|定律:contained:222"
    assert got["牛顿"]["concept_terms"] == "牛顿第一定律:expanded:202" and got["atp"]["concept_terms"] == "ATP:phrase:183"
    assert got["晶体"]["plan"] == "晶体:exact" and got["DNA"]["concept_terms"] == "脱氧核糖核酸:alias:220"
    assert got["反射弧呢"]["used_more_texts"] and not got["地表潜热"]["used_more_texts"]


def plain_outline(text, levels):
    """A stack of open headings over the lines."""
    stack, nodes, lead = [], {}, []
    for pos, line in enumerate(x.strip(" ") for x in text.split("\n") if x.strip(" ")):
        level = next((i + 1 for i, p in enumerate(levels) if re.search(p, line)), None)
        if level is None:
            (nodes[stack[-1][1]][3] if stack else lead).append(line)
            continue
        while stack and stack[-1][0] >= level:
            stack.pop()
        nodes[pos] = (level, stack[-1][1] if stack else None, line, [], "/".join(str(p) for _, p in [*stack, (0, pos)]))
        stack.append((level, pos))
    out = [(pos, level, parent, path, title, "\n".join(body)) for pos, (level, parent, title, body, path) in nodes.items()]
    return sorted(out + ([(-1, 0, None, "-1", "", "\n".join(lead))] if lead else []))


def test_outline_is_the_stack_parser(spark):
    dice = random.Random(3)
    kinds = ["副词", "一、甲", "（二）乙", "①丙", "2. 丁", "正文一行", "  ", "又一行", "连词"]
    texts = [(i, "\n".join(dice.choices(kinds, k=dice.randint(0, 25)))) for i in range(40)]
    found = outline.nodes(spark.createDataFrame([*texts, (99, None)], "id long, text string"), outline.SECTION_LEVELS)
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append((r["pos"], r["level"], r["parent"], r["path"], r["title"], r["body"]))
    for i, text in texts:
        assert sorted(got.get(i, [])) == plain_outline(text, outline.SECTION_LEVELS)
    assert 99 not in got
    tree = {r["id"]: [n["pos"] for n in r["tree"]] for r in outline.trees(found).collect()}
    assert tree == {i: sorted(n[0] for n in ns) for i, ns in got.items()}
    edges = outline.mind_map(found, F.lit("root")).count()
    assert edges == sum(n[1] > 0 for ns in got.values() for n in ns)


def test_entries_over_page_borders(spark):
    filler = "\n".join(f"例句第{i}行，说明用法。" for i in range(60))
    pages = [
        ("b", 1, "前一页的文字\n12"), ("b", 2, "而\nér\n（说文）本义是胡须。\n连词\n①表示并列。"), ("b", 3, f"③\n.\n{filler}"), ("b", 4, "更多的话\n何\nhé\n（说文）本义是担。"), ("c", 1, "没有"),
    ]
    targets = [(1, "b", "而", 1, 4), (2, "b", "何", 3, 4), (3, "c", "乎", 1, 1)]
    got = entries.extract(
        spark.createDataFrame(targets, "entry long, book string, head string, first int, last int"), spark.createDataFrame(pages, "book string, page int, text string")
    ).collect()
    text = "\n".join(t for b, _, t in pages if b == "b")
    rows = {r["entry"]: r for r in got}
    assert set(rows) == {1, 2}
    assert (rows[1]["anchor"], rows[1]["stop"]) == (text.index("而\nér"), text.index("何\nhé"))
    assert (rows[1]["first_page"], rows[1]["last_page"]) == (2, 4)
    assert rows[1]["excerpt"].startswith("而\nér\n") and rows[1]["excerpt"].endswith("更多的话") and "\n.\n" not in rows[1]["excerpt"]
    assert rows[2]["excerpt"] == "何\nhé\n（说文）本义是担。" and rows[2]["first_page"] == 4


def test_gate(spark):
    left = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "a int, b int")
    rules = [
        Rule("key", "t", "unique", ("a",)), Rule("known", "t", "refers", ("b",), of="t", to=("a",)), Rule("positive", "t", "holds", ("a",), "b > 0"),
        Rule("null key", "t", "unique", ("b",)), Rule("rows", "t", "filled", least=4),
    ]
    broken = verify.violations({"t": left}, rules)
    want = {"key": 1, "known": 2, "positive": 2, "null key": 1, "rows": 1}
    assert verify.gate(broken, allow_partial=True) == want
    with pytest.raises(verify.VerificationError) as failed:
        verify.gate(broken)
    assert failed.value.counts == want
    assert verify.gate(verify.violations({"t": left}, [Rule("rows", "t", "filled", least=3)])) == {}
    with pytest.raises(ValueError, match="no kind"):
        verify.violations({"t": left}, [Rule("x", "t", "other")])


def test_page_urls(spark):
    rows = spark.createDataFrame([(1, 3), (5, None), (0, 4), (None, 2), (4, 2), (1, 99)], "a int, b int")
    got = [r[0] for r in rows.select(page_map.page_urls(F.lit("x"), F.col("a"), F.col("b"))).collect()]
    assert [len(x) for x in got] == [3, 1, 0, 0, 1, 12] and got[1] == ["x/p5.webp"]


def test_occurrences_have_their_whole_path(spark):
    paper = "卷首 **导言**\n1. 解释加点词\nA. **而**（连词）；<u>何</u>：什么；无\nB. 无\n2、又一题 **之**(代词)\nA．①**其**②**乎**：语气\n3.5 不是题 **若**\n"
    docs = spark.createDataFrame([(1, paper, "x"), (2, None, "y"), (3, "无", "z")], "id long, text string, term_source string")
    found = occurrences.occurrences(docs)
    got = sorted((r["question_no"], r["question"], r["option"], r["item_no"], r["term_no"], r["term"], r["gloss"]) for r in found.collect())
    assert got == [
        (0, "", "", 0, 1, "导言", None), (1, "1", "A", 0, 1, "而", "连词"), (1, "1", "A", 1, 1, "何", "什么"), (2, "2", "", 0, 1, "之", "代词"),
        (2, "2", "A", 0, 1, "其", None), (2, "2", "A", 0, 2, "乎", "语气"), (2, "2", "A", 0, 3, "若", None),
    ]
    assert all(r["term"] in paper[r["start"] : r["stop"]] for r in found.collect())
    assert [(r["term"], r["pair_index"], r["gloss"]) for r in occurrences.translations(found).orderBy("pair_index").collect()] == [
        ("而", 0, "连词"), ("何", 1, "什么"), ("之", 2, "代词"), ("乎", 3, "语气"),
    ]
