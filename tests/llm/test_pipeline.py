"""The pipeline's stages against plain decisions, and the registered queries' shape."""

import corpus_pipeline
from lociforge.llm import queries
from lociforge.llm.exact_dedup import exact_duplicates
from lociforge.llm.language_id import held_out, identify, train
from lociforge.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns
        kept = {r["doc_id"] for r in after.collect()}
        if name == "language":
            model = train(docs.where(~held_out(3, 1)))
            assert kept == {r["doc_id"] for r in identify(docs, model).where("not rejected").collect()}
        if name == "exact":
            assert kept == {r["doc_id"] for r in exact_duplicates(docs).where("kept").collect()}
            assert len({r["text"] for r in docs.where(docs.doc_id.isin(list(kept))).collect()}) == len(kept)
        if name == "near":
            assert kept == {r["doc_id"] for r in near_duplicates(docs).where("kept").collect()}
        assert kept <= before
        docs, before = after, kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == before and pieces.groupby("sequence_id").length.sum().max() <= 4096


def test_clean_documents_stay(spark):
    """Of labelled good documents, the two filters drop next to none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    kept = corpus_pipeline.good(spark, corpus_pipeline.languages(spark, docs, "/root/testdata/sf0.01"), "/root/testdata/sf0.01")
    assert len(good - {r["doc_id"] for r in kept.select("doc_id").collect()}) <= 0.01 * len(good)


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
