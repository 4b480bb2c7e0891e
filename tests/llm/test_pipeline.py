"""The pipeline's stages, one after another, on the small tables and on odd documents."""

import corpus_pipeline
from insertframe.llm.common import Stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stage, counts = docs.columns, Stage(spark, "t"), [docs.count()]
    for name, apply in corpus_pipeline.STAGES:
        docs = stage.put(apply(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0 and counts[-1] == counts[-2]
    assert counts[1] < counts[0]
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_odd_documents(spark, odd, empty):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, odd.select(own), SF).count() <= odd.count()
        assert apply(spark, empty.select(own), SF).count() == 0
