"""The stages of the pipeline, each on what the one before it leaves."""

import cases
import corpus_pipeline

from tidegraph.llm import pii


def test_stages_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 1)
    rows = [(i, f"{t or ''} the and of with", "en", s, n) for i, t, _, s, n in cases.documents()]
    docs = spark.createDataFrame(rows + [(999, "12 !", "en", "a", 4)], cases.DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.where("doc_id = 999").count() == 0
    ids = [r[0] for r in docs.collect()]
    assert ids
    assert corpus_pipeline.run(spark, str(tmp_path)).where("sequence_id is null").count() == 0


def test_an_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 1)
    spark.createDataFrame([], cases.DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
