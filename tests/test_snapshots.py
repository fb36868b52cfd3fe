"""Killed writes, replayed batches, failing logs, and readers that salvage what they can."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.sources import readers, snapshots


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_killed_write_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, path)
    first = snapshots.publish(spark.range(5), path, ["id"])
    broken = spark.range(100).select(F.when(F.col("id") == 57, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        snapshots.publish(broken, path)
    assert ids(snapshots.current(spark, path)) == list(range(5))
    # Data that were written but never committed are no snapshot either.
    spark.range(9).write.parquet(f"{path}/data/snapshot-orphan")
    assert ids(snapshots.current(spark, path)) == list(range(5))
    snapshots.publish(snapshots.current(spark, path).filter("id > 1"), path)  # reads what it replaces
    assert ids(snapshots.current(spark, path)) == [2, 3, 4] and ids(snapshots.current(spark, path, first)) == list(range(5))


def test_replayed_batches_add_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, rows in ((0, [1, 2]), (1, [3]), (1, [3]), (0, [1, 2])):
        snapshots.append_batch(spark.createDataFrame([(i,) for i in rows], "id long"), path, batch)
    assert ids(snapshots.batches(spark, path)) == [1, 2, 3]


def test_stream_appends_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "  Cell  Wall "), (2, "dna")], "id long, query string").write.parquet(source)
    for _ in range(2):  # started again, the stream goes on where it was
        stream = spark.readStream.schema("id long, query string").parquet(source)
        snapshots.stream_batches(stream, path, str(tmp_path / "state")).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
    assert sorted(map(tuple, snapshots.batches(spark, path).select("id", "query_normalized").collect())) == [(1, "cell wall"), (2, "dna")]


def test_failing_log_never_reaches_the_query(spark, tmp_path):
    path = str(tmp_path / "log")
    bad = spark.range(3).select(F.raise_error(F.lit("full disk")).cast("long").alias("id"))
    assert not snapshots.never_fails(snapshots.append_batch, bad, path, 0)
    assert snapshots.never_fails(snapshots.append_batch, spark.range(3), path, 1)
    assert ids(snapshots.batches(spark, path)) == [0, 1, 2]


def test_broken_lines_are_kept_apart(spark, tmp_path):
    lines = ['{"id": 1, "text": "a"}', "", '{"id": 2, "text": ', "not json", "not json", '{"id": 3}']
    (tmp_path / "plain.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "packed.jsonl.gz", "wt") as out:
        out.write("\n".join(lines))
    for name in ("plain.jsonl", "packed.jsonl.gz"):
        good, bad = readers.json_lines_with_rejects(spark, str(tmp_path / name), "id long, text string")
        assert sorted(map(tuple, good.collect())) == [(1, "a"), (3, None)]
        assert sorted((r["line"], r["n"]) for r in bad.collect()) == [("not json", 2), ('{"id": 2, "text":', 1)]


def test_first_readable_source(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "folder").mkdir()
    for i in (1, 2):
        (tmp_path / "folder" / f"{i}.json").write_text(json.dumps({"id": i}, indent=1))
    read_lines = lambda s, p: s.read.schema("id long").json(p)
    sources = [(str(tmp_path / "gone.jsonl.gz"), read_lines), (str(tmp_path / "empty.jsonl"), read_lines), (str(tmp_path / "folder"), lambda s, p: readers.json_document(s, p, "id long"))]
    assert ids(readers.first_readable(spark, sources)) == [1, 2]
    with pytest.raises(FileNotFoundError):
        readers.first_readable(spark, sources[:2])


def test_sheets_by_the_order_of_the_workbook(spark, tmp_path):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    doc = 'http://schemas.openxmlformats.org/officeDocument/2006/relationships'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{doc}"><sheets><sheet name="Words" r:id="b"/><sheet name="Notes" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet10.xml"/></Relationships>')
        for n in (1, 10):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet {space}><sheetData><row><c r="A1"><v>{n}</v></c></row></sheetData></worksheet>')
    first = readers.spreadsheet_rows(spark, str(tmp_path / "w.xlsx")).first()
    named = readers.spreadsheet_rows(spark, str(tmp_path / "w.xlsx"), "Notes").first()
    assert (first["cells"], named["cells"]) == (["10"], ["1"])


def test_blocks_keep_their_place(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("ocr")  # folders whose names begin with test are left out
    for book in ("a", "b"):
        (tmp_path / book).mkdir()
        blocks = [{"type": "text", "text": f"{book} block {i}", "page_idx": i // 2} for i in range(5)] + [{"type": "image", "page_idx": 0}, {"type": "text", "text": "x", "page_idx": 1}]
        (tmp_path / book / f"{book}_content_list.json").write_text(json.dumps(blocks, indent=2))
    got = sorted((r["path"].rsplit("/", 1)[1][0], r["pos"], r["page"], r["text"]) for r in readers.ocr_blocks(spark, str(tmp_path)).collect())
    assert got == [(b, i, i // 2, f"{b} block {i}") for b in "ab" for i in range(5)]
