"""Memory of Python workers: Arrow batches have bounded bytes, and rows are handed on in small parts."""

import pandas as pd
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.session import BATCH_BYTES, bounded_batches, given_back


def test_batches_of_long_rows_are_bounded_by_bytes(spark):
    bounded_batches(spark)
    rows = spark.range(40, numPartitions=1).select(F.expr("repeat('x', 1000000)").alias("text"))

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"bytes": [int(b["text"].str.len().sum())], "rows": [len(b)]})

    found = rows.mapInPandas(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in found) == 40
    assert max(r["bytes"] for r in found) <= BATCH_BYTES + 1_000_000


def test_a_lower_bound_of_the_caller_stays(spark):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)
    try:
        for own in ("1000", "2m"):
            spark.conf.set(name, own)
            bounded_batches(spark)
            assert spark.conf.get(name) == own
        for own in (str(BATCH_BYTES * 16), before):
            spark.conf.set(name, own)
            bounded_batches(spark)
            assert spark.conf.get(name) == before
    finally:
        spark.conf.set(name, before)


def test_documents_in_parts_meet_their_words(spark, monkeypatch):
    texts = ["one two three two", "", None, "x" * 300 + " two", "three  one\n"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2, "doc_id")
    want = sorted(tuple(r) for r in bpe.digests(docs).collect())
    monkeypatch.setattr(bpe, "PACKED_BYTES", 50)
    monkeypatch.setattr(bpe, "WORD_ROWS", 2)
    for chars in (1, 400, bpe.BATCH_CHARS):
        out = bpe.decode(bpe.encode(docs, batch_chars=chars)).collect()
        assert sorted((r["doc_id"], len(r["ids"]), r["ids_sha256"]) for r in out) == [w[:3] for w in want]
        assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out} == {i: x or "" for i, x in enumerate(texts)}


def test_rows_pass_where_memory_is_given_back():
    assert list(given_back(lambda batches: (b + 1 for b in batches))(iter([1, 2, 3]))) == [2, 3, 4]
    assert list(given_back(lambda batches: iter(()))(iter([1]))) == []
