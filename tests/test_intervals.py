import random

import pytest
from pyspark.sql import functions as F

from orbispan.operators import intervals as iv

SCHEMA = "name string, chrom string, start bigint, end bigint"


def _random(n, seed, long_share=0.1):
    rng = random.Random(seed)
    out = [("touch1", "c1", 0, 100), ("touch2", "c1", 100, 200), ("empty", "c1", 50, 50), ("only", f"c{seed + 5}", 5, 10)]
    for i in range(n):
        s = rng.randrange(0, 60_000)
        size = rng.randrange(1, 40_000) if rng.random() < long_share else rng.randrange(1, 90)
        out.append((f"{seed}_{i}", f"c{rng.randrange(3)}", s, s + size))
    return out + out[-2:]


@pytest.mark.parametrize("bin_size,share", [(4096, 0.0), (64, 0.2), (16, 0.5)])
def test_overlap_join_equals_all_pairs(spark, bin_size, share):
    a, b = _random(120, 1, share), _random(150, 2, share)
    got = iv.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), bin_size=bin_size)
    rows = sorted((r.a_name, r.b_name, r.overlap_bp) for r in got.collect())
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]))
    assert rows == want


def test_semi_and_anti_split_the_left_side(spark):
    a, b = spark.createDataFrame(_random(60, 3), SCHEMA), spark.createDataFrame(_random(20, 4), SCHEMA)
    semi, anti = iv.overlap_join(a, b, how="left_semi"), iv.overlap_join(a, b, how="left_anti")
    assert semi.columns == a.columns and semi.count() + anti.count() == a.count() and semi.count() > 0


def test_merge_joins_touching_and_complement_fills_the_rest(spark):
    df = spark.createDataFrame([("c1", 10, 20), ("c1", 20, 30), ("c1", 25, 28), ("c1", 40, 50), ("c2", 0, 100)], "chrom string, start bigint, end bigint")
    assert sorted(map(tuple, iv.merged(df).collect())) == [("c1", 10, 30), ("c1", 40, 50), ("c2", 0, 100)]
    genome = spark.createDataFrame([("c1", 60), ("c2", 100), ("c3", 7)], "chrom string, size bigint")
    assert sorted(map(tuple, iv.complement(df, genome).collect())) == [("c1", 0, 10), ("c1", 30, 40), ("c1", 50, 60), ("c2", 0, 100), ("c3", 0, 7)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(9)
    points = [(f"p{i}", f"c{rng.randrange(3)}", rng.randrange(5_000_000)) for i in range(300)]
    targets = [(f"c{rng.randrange(2)}", rng.randrange(5_000_000)) for _ in range(9)]
    got = iv.nearest(spark.createDataFrame(points, "name string, chrom string, pos bigint"), spark.createDataFrame(targets, "chrom string, pos bigint"))
    want = {n: min(abs(p - t) for c2, t in targets if c2 == c) for n, c, p in points if any(c2 == c for c2, _ in targets)}
    assert {r.name: r.distance for r in got.collect()} == want


def test_windows_cover_edges_and_last_partial_tile(spark):
    genome = spark.createDataFrame([("c1", 250)], "chrom string, size bigint")
    pos = spark.createDataFrame([("c1", 0), ("c1", 99), ("c1", 100), ("c1", 249), ("cx", 3)], "chrom string, pos bigint")
    rows = sorted((r.start, r.end, r["count"]) for r in iv.window_counts(pos, genome, 100).collect())
    assert rows == [(0, 100, 2), (100, 200, 1), (200, 250, 1)]


def test_coverage_adds_up_unless_merged(spark):
    genome = spark.createDataFrame([("c1", 100)], "chrom string, size bigint")
    f = spark.createDataFrame([("c1", 0, 100), ("c1", 50, 100)], "chrom string, start bigint, end bigint")
    assert iv.tile_coverage(f, genome, 100).first()["coverage"] == 1.5
    assert iv.tile_coverage(f, genome, 100, union=True).first()["coverage"] == 1.0


def test_empty_inputs(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert iv.overlap_join(e, e).count() == 0 and iv.merged(e).count() == 0
    assert iv.overlap_join(spark.createDataFrame(_random(5, 1), SCHEMA), e, how="left_anti").count() == 11


def test_join_plan_is_an_equi_join_on_bins(spark):
    a = spark.createDataFrame(_random(5, 1), SCHEMA)
    plan = iv.overlap_join(a, a)._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell_a_" in plan and "Cartesian" not in plan
    assert F.col("x") is not None


def test_islands_that_cross_stretches_equal_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        s = rng.randrange(0, 40_000_000)
        rows.append((rng.choice(["c1", "c2", None]), s, s + (rng.randrange(1, 9_000_000) if i % 40 == 0 else rng.randrange(1, 60_000))))
    rows += [("c1", 1 << 22, (1 << 22) + 5), ("c1", (1 << 22) + 5, (1 << 22) + 9), ("c3", None, 4)] + rows[:3]
    want = []
    for c in ("c1", "c2", None):
        own = sorted(r[1:] for r in rows if r[0] == c)
        for s, e in own:
            if want and want[-1][0] == c and s <= want[-1][2]:
                want[-1] = (c, want[-1][1], max(want[-1][2], e))
            else:
                want.append((c, s, e))
    got = iv.merged(spark.createDataFrame(rows, "chrom string, start bigint, end bigint"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
