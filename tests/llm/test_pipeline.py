import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbispan.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        n.append(out.count())
        docs = out
    assert n[1] < n[0] and n[2] == n[1] and n[3] < n[2] and 0 < n[4] <= n[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.agg(F.max("n")).first()[0] <= 2048 and packed.select("doc_id").distinct().count() == n[4]
