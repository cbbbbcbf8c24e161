import math

import corpus_pipeline
from plexmat.llm import minhash
from plexmat.session import materialize


def test_each_stage_keeps_the_columns_and_acts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        assert 0.5 * n < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert len({r.sequence_id for r in packed}) <= 1.1 * math.ceil(sum(r.length for r in packed) / 2048)


def test_the_run_is_its_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "suffix_dedup", "decontaminate", "packing"]


def test_stages_on_tricky_rows(spark, sf, tricky, nothing):
    for docs in (tricky, nothing):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).count()


def test_near_copies_from_80_percent_go(spark, sf):
    """Of 100 words, the last k are others: similarity (96 - k) / (96 + k), which is 0.83, 0.81 and 0.79 for 9, 10 and 11."""
    rows, stay = [], set()
    for i in range(60):
        words, k = [f"w{i}x{j}" for j in range(100)], 9 + i % 3
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-k] + [f"v{i}x{j}" for j in range(k)]))]
        stay |= {2 * i, 2 * i + 1} if k == 11 else {2 * i}
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert {r.doc_id for r in out.collect()} == stay
    for percent in (80, 85):
        bands, width = minhash.banding(percent)
        assert (1 - (percent / 100) ** width) ** bands <= 1e-6
    assert minhash.banding(85) == (25, 5)
