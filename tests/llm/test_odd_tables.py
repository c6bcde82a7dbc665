"""Every registered corpus query on tables with nulls in any column, empty and very long texts, repeated rows and ids, and
further columns of clashing names, and on empty tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbispan.llm import queries

SF = "/root/testdata/sf0.001"
CLASHING = ["id", "score", "component", "fp", "h", "n", "part", "cell_a", "g", "size", "slot", "shard", "piece", "start", "length", "offset", "sequence_id", "kind", "spans", "file", "leaf", "y", "_gone", "_n", "bucket"]
ONE_ROW_EACH = {"op2_pii_surrogates": "documents", "op3_pu_quality": "documents", "op5_secret_scan": "documents", "op7_line_templates": "documents", "op8_pq_near_dedup": "embeddings", "op9_byte_shards": "documents", "op10_simhash_bktree": "documents", "op11_order_minhash": "documents", "op12_bit_sliced_resampling": "documents"}


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(spark, tmp_path_factory, request):
    folder = tmp_path_factory.mktemp(request.param)
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    doc, page, vec = read("documents").first(), read("pages").first(), read("embeddings").first()
    long_ones = ["word " * 50_000, " " * 100_000 + "x", "y" * 100_000]
    rows = {
        "documents": [(None,) * 5, (None, "a text without an id", None, "web", 3), (900_001, None, "en", "web", 0), (900_002, "", "en", "web", 0), (900_003, " \n \n", "en", None, 0), tuple(doc), tuple(doc), (None, doc.text, "en", "web", 1), (-5, "a negative id", "en", "web", 1), *[(900_010 + i, t, "en", "web", 1) for i, t in enumerate(long_ones)]],
        "labels": [(None, None, None), (900_001, None, 1), (900_002, 1, None), (None, 1, 0), (doc.doc_id, 0, 0), (doc.doc_id, 1, 0)],
        "benchmark": [(None, None), (None, "an item without an id that has some words"), (900_001, ""), (900_002, "word " * 2_000), (900_003, doc.text), (900_003, doc.text)],
        "embeddings": [(None, None, None), (900_001, None, 1), (900_002, [], 1), (900_003, [0.0] * len(vec.embedding), 1), (900_004, [None] * len(vec.embedding), 1), (900_005, [1.0, 2.0], 1), (900_006, [2.0, 4.0], 1), (900_007, [float("nan")] * len(vec.embedding), 1), tuple(vec), tuple(vec), (None, vec.embedding, 1)],
        "pages": [(None, None, None), (900_001, None, None), (900_002, "u", ""), (900_003, "u", "z" * 100_000), tuple(page), tuple(page)],
    }
    for name, more in rows.items():
        df = read(name)
        df = df.unionByName(spark.createDataFrame(more, df.schema)) if request.param == "odd" else df.limit(0)
        df.withColumns({c: F.when(F.rand(3) > 0.5, "v") for c in CLASHING if c not in df.columns}).write.parquet(f"{folder}/{name}.parquet")
    return request.param, f"{folder}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_queries_on_odd_and_empty_tables(spark, tables, name):
    kind, folder = tables
    n = (corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name])(spark, folder).toPandas().shape[0]
    if kind == "empty":
        assert n == 0
    elif name in ONE_ROW_EACH:
        assert n == spark.read.parquet(f"{folder}/{ONE_ROW_EACH[name]}.parquet").count()
    else:
        assert n > 0
