import corpus_pipeline
import __spark_entry__ as entry
from scoreloom.llm.stages import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns, before = docs.columns, docs
        docs = written(stage(spark, docs, SF), "test")
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 100
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
