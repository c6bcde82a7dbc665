"""Overlaps summed by category against sums over pairs."""

import random

from pyspark.sql import functions as F

from orbispan.operators import sums, te


def tables(spark, seed=3):
    """Regions that share names, are long, empty or without a name or place; features without a category, empty or long."""
    r = random.Random(seed)
    cell = sums.CELL
    edges = [0, 1, cell - 1, cell, cell + 1, 2 * cell - 5, 3 * cell]
    at = lambda: r.choice(edges) + r.randrange(0, 40) if r.random() < 0.5 else r.randrange(0, 4 * cell)
    regions = []
    for i in range(300):
        s = at()
        length = r.choice([0, 1, 10, 500, 3000, sums.SHORT, sums.SHORT + 1, 2 * cell + 7, 3])
        regions.append((r.choice([f"r{i}", f"r{i}", f"r{i}", f"d{length}"]), r.choice(["a", "b"]), s, s + length, length, "U"))
    regions += [(None, "a", 5, 900, 895, "U"), ("nowhere", None, 5, 900, 895, "U"), ("unplaced", "a", None, None, 0, "M"), ("alone", "z", 5, 900, 895, "M")]
    features = []
    for i in range(400):
        s = at()
        features.append((f"t{i}", r.choice(["a", "b", None, "a"]), s, s + r.choice([0, 1, 20, 700, 4000, 3 * cell]), r.choice(["SINE", "LINE", None]), r.choice(["x1", "x2", "y", None]), 1.0))
    e = spark.createDataFrame(regions, "name string, chrom string, start long, end long, length long, type string")
    return e, spark.createDataFrame(features, "te_name string, chrom string, start long, end long, te_class string, te_family string, pct_div double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sums_equal_sums_over_pairs(spark):
    e, t = tables(spark)
    pairs = te.te_overlaps(e, t)
    got = sums.by_name(sums.overlap_sums(e, t, ["te_class", "te_family"]), ["te_class", "te_family"])
    for c in ("te_class", "te_family"):
        want = pairs.groupBy("name", c).agg(F.sum("overlap_bp"))
        assert rows(got.select("name", F.inline(f"{c}_bp"))) == rows(want) and want.count() > 100
    assert rows(got.where("hits > 0").select("name", "bp", "hits")) == rows(pairs.groupBy("name").agg(F.sum("overlap_bp"), F.count("*")))
    whole = sums.by_region(sums.overlap_sums(e, t, ["te_class"]), ["te_class"])
    assert rows(whole.select(e.columns)) == rows(e)


def test_features_and_regions_of_a_cell_meet_in_many_partitions(spark):
    e, t = tables(spark, 4)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sums.by_name(sums.overlap_sums(e, t, ["te_class"]), ["te_class"])
        assert rows(got.where("hits > 0").select("name", "bp", "hits")) == rows(te.te_overlaps(e, t).groupBy("name").agg(F.sum("overlap_bp"), F.count("*")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_cells_fold_and_share_hashes(spark, monkeypatch):
    """Many features of a cell are put together, categories go in blocks, and cells whose hashes are equal are told apart."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    s = rng.integers(0, 50, 4000)
    batch = pa.RecordBatch.from_pydict({"start": s, "end": s + rng.integers(1, 9, 4000), "k": pa.array([str(x) for x in rng.integers(0, 30, 4000)])})
    one, folded = sums._Cell(0, ["k"]), sums._Cell(0, ["k"])
    one.add(batch)
    monkeypatch.setattr(sums, "KEPT", 500)
    monkeypatch.setattr(sums, "BLOCK", 200)
    for i in range(0, 4000, 100):
        folded.add(batch.slice(i, 100))
    lo = np.array([0, 3, 20]), np.array([7, 40, 21]), np.array([True, True, True])
    (h1, [a]), (h2, [b]) = one.sums(*lo), folded.sums(*lo)
    assert sum(len(p[0]) for p in folded.parts) < 4000 and h1.tolist() == h2.tolist()
    named = lambda cell, f: sorted(zip(f[0].tolist(), [list(cell.values[0])[c] for c in f[1]], f[2].tolist()))
    assert named(one, a) == named(folded, b) and len(a[0]) > 60
    mixed = pa.RecordBatch.from_pydict({"chrom": ["a", "b", "a", None], "_idx": [1, 1, 2, 1]})
    assert [(k, len(p)) for k, p in sums._by_cell(mixed.slice(0, 3))] == [(("a", 1), 1), (("a", 2), 1), (("b", 1), 1)]


def test_combinations_do_not_list_pairs(spark):
    e, t = tables(spark)
    got = te.region_combinations_of(e, t)
    assert rows(got) == rows(te.region_combinations(te.te_overlaps(e, t))) and got.count() > 20
    assert "overlap_bp" not in got._jdf.queryExecution().toString()


def listed(got):
    return "overlap_bp" in got._jdf.queryExecution().toString()


def test_region_combinations_of_many_categories(spark):
    e, t = tables(spark, 5)
    got = te.region_combinations_of(e, t.withColumn("te_family", F.col("te_name")), 0.01)
    assert rows(got) == rows(te.region_combinations(te.te_overlaps(e, t.withColumn("te_family", F.col("te_name"))), 0.01)) and not listed(got)


def test_family_share_does_not_list_pairs(spark):
    e, t = tables(spark)
    got = te.family_share_of(e, t)
    assert rows(got) == rows(te.family_share(te.te_overlaps(e, t)).select(got.columns)) and not listed(got)


def test_classify_does_not_list_pairs(spark):
    e, t = tables(spark)
    pairs = te.te_overlaps(e, t)
    got = te.classify_of(e, t)
    assert rows(got) == rows(te.classify(e, pairs)) and not listed(got)
    assert {r.classification for r in got.collect()} >= {"no_TE", "single_TE", "composite_TE"}


def test_counts_of_classes_do_not_list_pairs(spark):
    e, t = tables(spark)
    got = te.counts_of(te.classify_of(e, t), "classification")
    assert rows(got) == rows(te.counts_of(te.classify(e, te.te_overlaps(e, t)), "classification")) and not listed(got)


def test_per_region_does_not_list_pairs(spark):
    e, t = tables(spark)
    got = te.per_region_of(e, t)
    assert rows(got) == rows(te.per_region(e, te.te_overlaps(e, t))) and not listed(got)


def test_classes_from_summary_do_not_list_pairs(spark):
    e, t = tables(spark)
    got = te.classify_from_summary(te.per_region_of(e, t))
    assert rows(got) == rows(te.classify_from_summary(te.per_region(e, te.te_overlaps(e, t)))) and not listed(got)


def test_summary_tallies_regions(spark):
    e, t = tables(spark)
    pairs = te.te_overlaps(e, t)
    got, want = te.summary_of(e, t), te.summary(te.per_region(e, pairs), pairs)
    assert rows(got) == rows(want) and want.count() > 10 and not listed(got)
    plain = te.per_region(e, pairs).agg(F.count("*"), F.sum("te_bp"), F.bround(F.avg("te_pct"), 4), F.bround(F.percentile("te_pct", 0.5), 4)).first()
    value = {r.metric: r.value for r in got.collect()}
    assert (value["total_regions"], value["total_te_bp"], value["mean_te_pct"], value["median_te_pct"]) == tuple(plain)
