"""Core operators against small models, round trips, readers, sinks and the streaming form."""

import json
import random
import tempfile
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.functions import policy
from quillon.functions import text as tx
from quillon.operators import etl, fusion, integrity, lexical, linking, selection, vector
from quillon.plans import query_plan
from quillon.sources import readers, sinks
from quillon.streaming import trending


def test_entry_works_without_optional_folders(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as registry

    real = builtins.__import__

    def missing(name, *a, **k):
        if name.split(".")[0] == "corpus_pipeline" or name.startswith("quillon.llm"):
            raise ModuleNotFoundError(name, name="quillon.llm")
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quillon.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", missing)
    assert "bm25_search" in registry.queries() and "pipeline" not in registry.queries()
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_text_expressions(spark):
    df = spark.createDataFrame([("Ab，c！光_b-1 的 é",)], "t string")
    row = df.select(
        tx.clean(F.col("t")).alias("clean"), tx.compact(F.col("t")).alias("compact"), tx.has_term(F.col("t"), "AB").alias("has"),
        tx.single_hanzi(F.lit("光x")).alias("one"), tx.is_cjk_term(F.lit("光合作用")).alias("term"),
        tx.is_synthetic(F.lit("smoke_test 1")).alias("probe"), tx.sigmoid(F.lit(99.0)).alias("s"),
    ).first()
    assert row["clean"] == "Abc光_b1 的 é" and row["compact"] == "Abc光_b1的é" and row["has"] and row["one"] and row["term"] and row["probe"]
    assert abs(row["s"] - 1 / (1 + 2.718281828459045**-12)) < 1e-12


def test_snippets(spark):
    df = spark.createDataFrame([("x" * 200 + "needle" + "y" * 200,)], "t string")
    row = df.select(
        tx.context_snippet(F.col("t"), F.lit("needle")).alias("c"), tx.window_snippet(F.col("t"), "needle").alias("w"),
        tx.highlight_longest(F.lit("a needle nee"), ["nee", "needle"]).alias("h"),
    ).first()
    assert row["c"].startswith("…") and row["c"].endswith("…") and "needle" in row["c"]
    assert row["w"].startswith("x" * 30 + "<mark>needle</mark>") and row["h"] == "a <mark>needle</mark> nee"


def test_policy(spark):
    rows = [("高中", "英语", "北师大版", True), ("初中", "英语", "北师大版", False), ("高中", "语文", "人教版", True), (None, "语文", "人教版", False), ("高中", "语文", None, False)]
    df = spark.createDataFrame(rows, "p string, s string, e string, want boolean")
    assert df.filter(policy.edition_allowed(F.col("p"), F.col("s"), F.col("e")) != F.col("want")).count() == 0
    one = df.select(policy.canonical_subject(F.lit(" 生物 ")).alias("c"), policy.subject_family(F.lit("生物学")).alias("f"), policy.phase_of_series(F.lit("义务教育教科书 数学")).alias("ph")).first()
    assert tuple(one) == ("生物学", "生命科学", "初中")


def test_intents(spark):
    want = {"晶体的定义": ("definition", "晶体"), "什么是潜热": ("definition", "潜热"), "植物的过程": ("process", "植物"), "牛顿第一定律": ("definition", "牛顿第一定律"), "蛋白质": ("lookup", "蛋白质")}
    df = spark.createDataFrame([(k,) for k in want], "query string")
    got = {r["query"]: (r["intent"], r["target"]) for r in query_plan.classify(df).collect()}
    assert got == want


def test_term_plan_and_window():
    assert query_plan.term_plan([("a b", "x"), ("ab", "y"), ("c", "z"), ("de", "q")]) == [("a b", "x"), ("de", "q")]
    assert query_plan.candidate_window(0, 10) == 60 and query_plan.candidate_window(1000, 10) == 600


def test_aliases(spark):
    record = json.dumps({"synonyms": ["A", "b"], "english": ["a", "Cell"]})
    rows = query_plan.aliases(spark.createDataFrame([("t", record), ("u", "not json")], "term string, synonyms string")).orderBy("pos").collect()
    assert [(r["term"], r["alias"]) for r in rows] == [("t", "A"), ("t", "b"), ("t", "Cell")]


def test_islands_round_trip(spark):
    r = random.Random(1)
    pages = {(g, r.randint(1, 60)) for g in range(5) for _ in range(25)}
    df = spark.createDataFrame(list(pages), "grp long, v long")
    texts = selection.page_ranges(selection.islands(df, "grp", "v"), "grp")
    back = {(x["grp"], x["page"]) for x in selection.expand_ranges(texts, "pages").collect()}
    assert back == pages


def loop_caps(rows, page_cap, book_cap):
    books, seen, front, back = {}, {}, [], []
    for pos, book, page in rows:
        ok = books.get(book, 0) < book_cap and (page is None or seen.get((book, page), 0) < page_cap)
        (front if ok else back).append(pos)
        if ok:
            books[book] = books.get(book, 0) + 1
            if page is not None:
                seen[book, page] = seen.get((book, page), 0) + 1
    return front + back


def test_caps_are_the_greedy_loop(spark):
    r = random.Random(2)
    rows = [(s, i, r.choice("abc"), r.choice([1, 2, 3, None])) for s in range(20) for i in range(15)]
    df = spark.createDataFrame(rows, "scope long, pos long, book string, page long")
    out = selection.reorder_with_caps(df, "book", "page", 1, 2).orderBy("scope", "final_pos").collect()
    for s in range(20):
        own = [(p, b, g) for sc, p, b, g in rows if sc == s]
        # Rows without a page have no page cap; the window form counts them for the book alone.
        if all(g is not None for _, _, g in own):
            assert [x["pos"] for x in out if x["scope"] == s] == loop_caps(own, 1, 2)


def test_merge_blocks_folds(spark):
    rows = [("p", 1, 0, "Head"), ("p", 1, 1, "head"), ("p", 1, 2, "body text"), ("p", 1, 3, "Head"), ("p", 1, 4, "a long repeated line"), ("p", 1, 5, "x"), ("p", 1, 6, "a long repeated line")]
    got = selection.merge_blocks(spark.createDataFrame(rows, "path string, page int, pos int, text string")).first()["text"]
    # A block of one character goes, and so does one that is part of the block kept before it.
    assert got == "Head\nbody text\na long repeated line"


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(1, "Ab c"), (2, "abc!"), (3, "other"), (4, "a-b-c...")], "id long, text string")
    once = etl.dedupe_by_fingerprint(df)
    assert {r["id"] for r in once.collect()} == {4, 3}
    assert etl.dedupe_by_fingerprint(once.drop("mark")).count() == once.count()


def test_containment_join_is_the_nested_loop(spark):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice(["ab", "abc", "b", "cd", "a"]) for _ in range(30))) for i in range(15)]
    terms = [(i, " ".join(r.choice(["ab", "abc", "b", "cd", "a"]) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 6, 7, 8, 9] * 2)]
    terms = [(i, t) for i, t in terms if len(t) > 1]
    docs, t = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term_id long, text string")
    want = sorted((i, k) for i, needle in terms for k, text in texts if needle in text)
    assert sorted(tuple(x) for x in lexical.contained_terms(t, docs).collect()) == want


def test_top_k_is_a_prefix_of_the_sort(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    full = [x["vec_id"] for x in vector.top_k(df, rows[0][1], 60).collect()]
    assert [x["vec_id"] for x in vector.top_k(df, rows[0][1], 7).collect()] == full[:7]
    kept = [x["vec_id"] for x in vector.top_k(df, rows[0][1], 7, keep=F.col("label") == 1).collect()]
    assert kept == [i for i in full if i % 3 == 1][:7]


def test_bonuses(spark):
    df = spark.createDataFrame([("晶体是指有规则外形的固体。", "晶体的定义"), ("无关", "其他")], "text string, title string")
    a, b = [r[0] for r in df.select(fusion.definition_bonus("晶体", F.col("title"), F.col("text"))).collect()]
    assert a == 54.0 and b == 0.0
    c = df.select(fusion.coverage_bonus("晶体", tx.compact(F.col("text")))).collect()
    assert c[0][0] == 68.0 and c[1][0] == -18.0


def test_guardrails(spark):
    rows = [("supplemental", "alias", "含有极性键", "极性键", "键", "context", 0.0, True), ("supplemental", "alias", "无", "极性键", "键", "context", 20.0, False),
            ("supplemental", "character_fallback", "极性键", "极性键", "键", "sentence", 20.0, False), ("primary", "character_fallback", "", "", "", "", 0.0, True)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g double, want boolean")
    assert df.filter(linking.passes_guardrails(*[F.col(x) for x in "abcdefg"]) != F.col("want")).count() == 0


def test_two_rounds_stop_early(spark):
    strong = spark.createDataFrame([(1, 240.0)], "id long, final_score double")
    weak = spark.createDataFrame([(1, 100.0), (2, 50.0)], "id long, final_score double")
    assert linking.two_rounds(strong, lambda: 1 / 0).count() == 1
    both = {r["id"]: r["final_score"] for r in linking.two_rounds(weak, lambda: spark.createDataFrame([(2, 90.0), (3, 1.0)], "id long, final_score double")).collect()}
    assert both == {1: 100.0, 2: 90.0, 3: 1.0}


def test_manifests_differ_where_tables_do(spark):
    a, b = spark.range(10).toDF("x"), spark.range(11).toDF("x")
    one, two = (integrity.manifest({"t": t, "log": a, "u": a}, ("log",)) for t in (a, b))
    assert [r["name"] for r in integrity.verify(one, two).collect()] == ["t"]
    assert integrity.verify(one, one).count() == 0


def test_vector_gate_and_health(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert integrity.vector_gate(v, 2, 1) and not integrity.vector_gate(v, 3, 1)
    row = integrity.health(spark.createDataFrame([("a", True), ("b", False)], "name string, ok boolean")).first()
    assert tuple(row) == ("degraded", "b")


def test_question_blocks(spark):
    df = spark.createDataFrame([(1, "前言\n1. 题一 A. 甲 B. 乙\n2. 题二")], "id long, text string")
    assert [(r["number"], r["block"].strip()) for r in etl.question_blocks(df).orderBy("number").collect()] == [(1, "1. 题一 A. 甲 B. 乙"), (2, "2. 题二")]


def test_readers_and_sinks(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"subject":"s","title":"t","section":"3","text":"' + "x" * 30 + '"}\nbroken\n{"subject":"s","title":"t","section":"x","text":"' + "x" * 30 + '"}\n')
    rows = readers.json_lines(spark, str(good), "subject string, title string, section string, text string")
    assert readers.valid_pages(rows).count() == 1
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(good)]) == str(good)
    blocks = Path(tempfile.mkdtemp(prefix="blocks-"))  # tmp_path holds the test's name, which the reader leaves out
    (blocks / "x_content_list.json").write_text(json.dumps([{"type": "text", "text": "hello", "page_idx": 0}, {"type": "image", "text": "no", "page_idx": 0}, {"type": "text", "text": "world", "page_idx": 0}]))
    pages = selection.merge_blocks(readers.ocr_blocks(spark, str(blocks)))
    assert pages.first()["text"] == "hello\nworld"
    logs = spark.createDataFrame([("  Ab  c ", 1), ("loadtest x", 2)], "query string, n int")
    sinks.append_log(logs, str(tmp_path / "log"))
    sinks.append_log(logs, str(tmp_path / "log"))
    assert [r["query_normalized"] for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["ab c"] * 2
    sinks.sheet(logs, str(tmp_path / "tsv"))
    assert readers.delimited(spark, str(tmp_path / "tsv")).count() == 2
    sinks.gzip_json(logs, str(tmp_path / "gz"))
    assert readers.json_lines(spark, str(tmp_path / "gz"), "query string, n int").count() == 2
    sinks.snapshot(logs, str(tmp_path / "snap"), ["n"])
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    assert sinks.markdown(logs).startswith("| query | n |")
    texts = readers.paged_text(spark.createDataFrame([(1, "a\fb\fc")], "id long, text string"))
    assert texts.count() == 3
    meta = readers.key_values(spark.createDataFrame([("a", '"x"'), ("b", "plain"), ("c", "3")], "key string, value string"))
    assert {r["key"]: r["value"] for r in meta.collect()} == {"a": "x", "b": "plain", "c": "3"}


def test_spreadsheets_in_archives(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    inner = tmp_path / "w.xlsx"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Headword</t></si><si><t>Bopomofo</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   '<row><c r="A2" t="inlineStr"><is><t>word</t></is></c><c r="C2"><v>12</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.write(inner, "w.xlsx")
    rows = readers.spreadsheet_rows(spark, str(tmp_path / "all.zip"))
    out = readers.with_headers(rows, {"head": ["Headword"], "sound": ["Bopo"]}).first()
    assert (out["head"], out["sound"]) == ("word", "12")


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 10:00:00", f"q{d % 3}") for d in range(1, 28)]
    df = spark.createDataFrame(rows, "ts string, query_normalized string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    out = trending.run_available(spark, str(tmp_path / "in"), df.schema, trending.windowed_counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = {tuple(r) for r in trending.windowed_counts(spark.read.parquet(str(tmp_path / "in"))).collect()}
    stream = {tuple(r) for r in out.collect()}
    assert stream and stream <= batch
    newest = max(r[0] for r in batch)
    assert all((newest - r[0]).days <= 8 for r in batch - stream)


@pytest.mark.parametrize("filters, n", [({"book_key": "b", "scope_subject": "none"}, 1), ({"scope_subject": "s"}, 2), ({}, 2)])
def test_book_wins_over_scope(spark, filters, n):
    df = spark.createDataFrame([("b", "s"), ("c", "s")], "book_key string, subject string")
    assert lexical.equality_filters(df, **filters).count() == n
