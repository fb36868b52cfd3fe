"""The corpus pipeline against its stages and brute force."""

import corpus_pipeline
from test_near_copies import brute_kept
from test_operators import brute_groups, collected

from quillon.session import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows, kept = collected(before), {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert len(kept) > 0.98 * len(rows)
        elif name == "exact_dedup":
            groups, norm = brute_groups(rows)
            assert kept == {keep for keep, _ in groups.values()}
        elif name == "simhash_near_dedup":
            assert sorted(kept) == brute_kept(rows)
        else:
            assert 0.25 * len(rows) < len(kept) < 0.75 * len(rows)
    want = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) == docs.count()


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
