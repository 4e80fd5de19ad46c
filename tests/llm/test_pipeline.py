"""The corpus pipeline end to end on the smallest tables."""

import corpus_pipeline
from loomgraph.llm import rule_ledger
from tests.llm.test_operators import check_packing


def test_stages_keep_columns_and_pack_all(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, held, sizes = docs.columns, docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.spill(stage(spark, held, data), "t")
        assert held.columns == columns, name
        sizes.append(held.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3]
    assert sizes[1] == rule_ledger.quality_report(docs).filter("kept").count()
    got = corpus_pipeline.STAGES[-1][1](spark, held, data).collect()
    check_packing(got, [r["text"] for r in held.collect()])


def test_stages_take_an_empty_table(spark, data):
    held = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.spill(stage(spark, held, data), "t")
    assert held.count() == 0
