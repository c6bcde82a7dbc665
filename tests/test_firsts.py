"""The first truth of each detection against a minimum over all pairs."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbispan.functions.regions import overlap_of_shorter
from orbispan.operators import benchmark, firsts
from orbispan.operators.intervals import overlap_join
from orbispan.operators.sums import CELL
from orbispan.plans import catalog
from orbispan.scratch import checkpointed

SF = "/root/testdata/sf0.001"


def test_blocks_of_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    start = rng.integers(0, 3000, 500)
    table = pa.RecordBatch.from_pydict({"start": start, "end": start + rng.integers(1, 700, 500), "ord": rng.integers(0, 50, 500)})
    cell = firsts._Features()
    cell.batches.append(table)
    at = rng.integers(0, 3000, 200)
    whole = cell.first(at, at + 90, 0.8, ["ord"])
    monkeypatch.setattr(firsts, "PAIRS", 10)
    assert (cell.first(at, at + 90, 0.8, ["ord"]) == whole).all() and (whole >= 0).sum() > 100


def test_first_truth_lists_no_pairs(spark):
    r = random.Random(8)
    place = lambda: r.choice([0, CELL - 9, CELL, 2 * CELL - 300, 777]) + r.randrange(60)
    size = lambda: r.choice([0, 1, 9, 60, 300, 900, 3 * CELL])
    seg = lambda: (r.choice(["a", "a", "b", None]), s := place(), s + size())
    d = spark.createDataFrame([(f"d{i % 250}", i // 250, *seg()) for i in range(400)], "det_id string, region_ord int, chrom string, start long, end long")
    t = spark.createDataFrame([(r.choice([f"t{i}", f"t{i % 7}", None]), r.choice(["U", "M", None]), i, r.randrange(9), *seg()) for i in range(300)], "name string, type string, length long, ord long, chrom string, start long, end long")
    every = overlap_join(d, t, ("d_", "t_"), where=overlap_of_shorter("d_start", "d_end", "t_start", "t_end") >= 0.8)
    want = every.groupBy("d_det_id").agg(F.min(F.struct("d_region_ord", "t_ord", "t_name", "t_type", "t_length")).alias("m")).select("d_det_id", "m.t_name", "m.t_type", "m.t_length")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = benchmark.first_truth(d, t, 0.8)
        rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert rows(got) == rows(want) and got.count() > 100
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert "_spot_" not in got._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["benchmark_by_state", "benchmark_compare", "file_truth", "benchmark_by_length", "benchmark_confusion", "benchmark_metrics", "benchmark_missed", "benchmark_matches"])
def test_queries_find_first_truth_in_cells(spark, name):
    """No pairs are sorted or shuffled: features travel with their order and one row of each detection comes back."""
    assert "_f_ord" in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_unique_matches_without_a_table_of_pairs(spark, monkeypatch):
    r = random.Random(5)
    place = lambda: (r.choice(["a", "a", "b", None]), s := r.randrange(9000), s + r.choice([0, 1, 9, 60, 300, 900, 4000]))
    d = spark.createDataFrame([(f"d{i}", r.randrange(90), *place()) for i in range(500)], "det_id string, ord long, chrom string, start long, end long")
    t = spark.createDataFrame([(f"t{r.randrange(280)}", r.randrange(9), *place()) for i in range(300)], "name string, ord long, chrom string, start long, end long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    wrote = []
    monkeypatch.setattr(benchmark, "checkpointed", lambda df: wrote.append(df) or checkpointed(df))
    got = rows(benchmark.unique_matches(d, t, 0.5))
    assert not wrote
    monkeypatch.setattr(benchmark, "HELD", 10)
    want = rows(benchmark.unique_matches(d, t, 0.5))
    assert wrote and got == want and len(got) > 100
    whole = firsts._Free([pa.RecordBatch.from_pydict({"start": [0, 5], "end": [90, 95], "ord": [2, 1], "name": ["x", "y"]})], ["ord"], "name")
    assert whole.taken(np.array([0, 0, 0]), np.array([90, 90, 90]), 0.5)[1] == [1, 0]
