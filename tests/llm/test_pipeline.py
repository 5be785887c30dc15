import pytest

cp = pytest.importorskip("corpus_pipeline")

from tests.llm.test_corpus_operators import brute_components  # noqa: E402


def test_stages_keep_columns_and_take_effect(spark, awkward, tmp_path):
    docs = awkward
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        if name != cp.STAGES[-1][0]:
            assert out.columns == awkward.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "token_ids"]
    assert docs.filter("size(input_ids) != n_tokens").count() == 0


def test_near_duplicates_stage_keeps_one_of_each_group(spark, corpus):
    kept = {r["doc_id"] for r in cp.near_duplicates(spark, corpus, "").collect()}
    want = brute_components([(r["doc_id"], r["text"]) for r in corpus.collect()], 5, 80)
    assert kept == {i for i, c in want.items() if i == c}


def test_empty_table_passes_through(spark, nothing):
    docs = nothing
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
