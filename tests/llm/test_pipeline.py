"""The pipeline: stages keep columns and whole rows, decisions take effect, and run() equals the stages one by one."""

from contextvars import ContextVar

from pyspark.sql import functions as F

import corpus_pipeline
from sedge.llm import common, decontaminate, language_id, mixing, simhash
from sedge.llm.common import cut
from sedge.session import table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = start = table(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == start.columns
            assert set(docs.collect()) <= set(before.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    deduped = spark.read.parquet(str(tmp_path / "simhash_near_dedup"))
    assert deduped.count() == simhash.report(spark.read.parquet(str(tmp_path / "language_id"))).select("component_id").distinct().count()
    clean = spark.read.parquet(str(tmp_path / "benchmark_decontamination"))
    assert decontaminate.report(clean, table(spark, SF, "benchmark")).where("contaminated").isEmpty()
    assert language_id.report(clean).where("lang_pred = 'und'").isEmpty()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, docs.collect())) == sorted(map(key, corpus_pipeline.run(spark, SF).collect()))
    assert docs.count() == clean.count() and docs.columns == mixing.report(clean).columns


def test_run_leaves_one_copy_of_the_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda spark, docs, sf_dir, n=n: cut(docs.withColumn("n_chars", docs["n_chars"] + 1))) for n in "abc"] + [("end", lambda spark, docs, sf_dir: docs)])
    monkeypatch.setattr(common, "_scratch", ContextVar("test", default=str(tmp_path)))
    docs = table(spark, SF, "documents")
    assert corpus_pipeline.run(spark, SF).agg(F.sum("n_chars")).first()[0] == docs.agg(F.sum(F.col("n_chars") + 3)).first()[0]
    (left,) = tmp_path.iterdir()
    assert [x.name for x in left.iterdir()] == ["c"]


def test_empty_and_odd_documents_pass_all_stages(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "hello there my friend", "en", "s", 5), (3, "hello there my friend", "en", "s", 5), (None, "another text altogether", "en", None, 5)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= len(data)
