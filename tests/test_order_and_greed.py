"""Numbering, exact quantiles, greedy sweeps, file order and the repeat sink."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbispan.operators import greedy, intervals, process, stats
from orbispan.sources import detectors, repeats, tables


def one_by_one(pairs):
    """Absorption by a scan in order."""
    nodes, by = sorted({x for p in pairs for x in p}), {}
    for a, b in pairs:
        by.setdefault(a, []).append(b)
    owner = {}
    for x in nodes:
        if x not in owner:
            for y in by.get(x, ()):
                owner.setdefault(y, x)
    return owner


@pytest.mark.parametrize("swept", [1_000_000, 50])
def test_absorption_equals_a_scan(spark, monkeypatch, swept):
    monkeypatch.setattr(greedy, "SWEPT", swept)
    rng = random.Random(1)
    pairs = {(g, *sorted(rng.sample(range(60), 2))) for g in range(4) for _ in range(150)}
    df = spark.createDataFrame(sorted(pairs), "g int, a long, b long").repartition(5)
    df = df.select("g", *[F.struct("g", c).alias(c) for c in "ab"])
    want = one_by_one({((g, a), (g, b)) for g, a, b in pairs})
    for group in (F.col("g"), None):
        assert {tuple(r.b): tuple(r.a) for r in greedy.absorbed_by(df, "a", "b", group).collect()} == want
    assert greedy.absorbed_by(df.limit(0), "a", "b").count() == 0


def test_a_chain_of_100000_takes_few_rounds(spark, monkeypatch):
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for swept, rounds in ((1_000_000, 1), (10_000, 10)):
        monkeypatch.setattr(greedy, "SWEPT", swept)
        count = []
        monkeypatch.setattr(greedy, "_swept", lambda *a, real=greedy._swept, n=count: n.append(1) or real(*a))
        got = greedy.absorbed_by(chain, "a", "b")
        assert got.agg(F.count("*"), F.sum("a"), F.sum("b")).first()[:] == (50_000, sum(range(0, 100_000, 2)), sum(range(1, 100_001, 2))) and len(count) == rounds
        monkeypatch.undo()


@pytest.mark.parametrize("swept", [1_000_000, 40])
def test_choices_equal_one_by_one(spark, monkeypatch, swept):
    monkeypatch.setattr(greedy, "SWEPT", swept)
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(60), rng.randrange(50)) for _ in range(600)})
    rows = [(a, b, rng.randrange(5)) for a, b in pairs]
    df = spark.createDataFrame(rows + rows[:30], "a long, b long, w int").repartition(4)
    taken, want = set(), set()
    for a in sorted({r[0] for r in rows}, key=lambda a: (-a % 7, a)):
        if free := [(w, b) for x, b, w in rows if x == a and b not in taken]:
            taken.add(min(free)[1])
            want.add((a, min(free)[1]))
    assert sorted((r.a, r.b) for r in greedy.first_choices(df, "a", "b", F.pmod(-F.col("a"), F.lit(7)), F.col("w")).collect()) == sorted(want)


def test_dedupe_of_a_hot_locus_by_islands(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("chr1", 40 * i, 40 * i + 1000, "t", "s") for i in range(2000)] + [("chr2", s, s + rng.randrange(800, 1200), "t", "s") for s in (rng.randrange(20_000) for _ in range(400))]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, tool string, sample string").repartition(4)
    places = sorted({r[:3] for r in rows})
    owner = {}
    for i, (c, s, e) in enumerate(places):
        if (c, s, e) in owner:
            continue
        for x in places[i + 1 :]:
            ov = min(e, x[2]) - max(s, x[1])
            if x[0] != c or x[1] >= e:
                break
            if ov > 0 and ov >= 0.8 * (e - s) and ov >= 0.8 * (x[2] - x[1]):
                owner.setdefault(x, (c, s, e))
    want = sorted(set(places) - set(owner))
    for swept in (1_000_000, 900):
        monkeypatch.setattr(greedy, "SWEPT", swept)
        assert sorted((r.chrom, r.start, r.end) for r in process.deduplicated(df).collect()) == want


def test_islands_of_pairs(spark):
    rng = random.Random(4)
    spans = [(c, *sorted(rng.choices(range(3000), k=2))) for c in ("a", "b") for _ in range(60)]
    spans = [(c, s, min(e, s + rng.randrange(40))) for c, s, e in spans]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "i int, c string, s long, e long")
    got = {r.i: r.island for r in intervals.with_islands(df, "c", F.col("s"), F.col("e")).collect()}
    up = list(range(len(spans)))
    for i, (c, s, e) in enumerate(spans):
        for j, (d, t, f) in enumerate(spans):
            if c == d and s <= f and t <= e:
                up = [up[i] if x == up[j] else x for x in up]
    assert len(got) == len(spans) and all((got[i] == got[j]) == (up[i] == up[j]) for i in got for j in got)


def test_numbers_without_gaps(spark):
    rows = [(k, rng) for k in ("a", "b", None) for rng in range(200)] + [("hot", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = stats.numbered(df, "n", ["v"], ["k"]).collect()
    assert len(got) == len(rows) and all(r.n == r.v + 1 for r in got)
    assert sorted(r.n for r in stats.numbered(df, "n", ["k", "v"]).collect()) == list(range(1, len(rows) + 1))
    assert stats.numbered(df.limit(0), "n", ["v"]).count() == 0


def test_quantiles_equal_percentile(spark):
    rng = random.Random(5)
    rows = [(k, None if rng.random() < 0.1 else rng.choice([rng.randrange(9), rng.random() * 1e6])) for k in ("a", "b", None) for _ in range(157)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = stats.exact_quantiles(df, "v", probs, ["k"])
    assert "percentile" not in got._jdf.queryExecution().toString()
    want = df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    assert {r.k: r.q for r in got.collect()} == {r.k: r.q for r in want.collect()}
    values = [v for _, v in rows if v is not None]
    assert np.allclose(stats.exact_quantiles(df, "v", probs).first().q, np.quantile(values, probs))
    agg = stats.with_quantile(df.groupBy("k").count(), df, "v", "median", keys=["k"])
    assert {r.k: r.median for r in agg.collect()}["none"] is None and agg.count() == 5
    assert stats.exact_quantiles(df.limit(0), "v", probs).count() == 0


def test_inputs_of_ranks_are_computed_once(spark):
    for run in (lambda df: stats.benjamini_hochberg(df), lambda df: stats.average_ranks(df, "p_value")):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        df = spark.range(1000).select((F.col("id") % 97 / 100).alias("p_value")).mapInArrow(counted, "p_value double")
        assert run(df).count() == 1000 and seen.value == 1000


def test_truth_and_names_follow_the_files(spark, tmp_path):
    (tmp_path / "u.bed").write_text("#chrom\tstart\nchr9\t5\t9\tz\t4\t+\tU\t.\nchr1\t1\t9\ta\t8\t+\tU\t.\nchr5\t0\t4\tm\t4\t+\tU\t.\n")
    (tmp_path / "m.bed").write_text("chr2\t1\t9\tb\t8\t+\tM\t.\n")
    t = detectors.read_truth(spark, str(tmp_path / "u.bed"), str(tmp_path / "m.bed")).orderBy("ord").collect()
    assert [r.name for r in t] == ["z", "a", "m", "b"]
    (tmp_path / "n.bed").write_text("chr9\t5\t9\ntrack x\nchr1\tbad\t9\nchr1\t1\t9\nchr5\t0\t4\n")
    got = {r.name: r.chrom for r in tables.read_regions(spark, str(tmp_path / "n.bed"), str(tmp_path / "m.bed")).collect()}
    assert got == {"eccDNA_0": "chr9", "eccDNA_1": "chr1", "eccDNA_2": "chr5", "b": "chr2"}
    (tmp_path / "c.csv").write_text("eChr,eStart,eEnd\nchr3,7,9\nchr2,1,4\n")
    assert {r.name: r.chrom for r in tables.read_regions(spark, str(tmp_path / "c.csv")).collect()} == {"eccDNA_0": "chr3", "eccDNA_1": "chr2"}


def test_repeat_sink_ids_and_counters(spark, tmp_path):
    head = "   SW   perc perc perc  query\nscore   div. del. ins.  sequence\n\n"
    row = " {0} 1.25 0.4 1.35 {1} {2} 10468 (99) {3} (CCC)n {4} 1 463 (0) 1{5}\n"
    lines = [("1504", "chr1", "10001", "C", "Simple_repeat", " *"), ("12", "chr2", "5", "+", "LINE/L1/x", ""), ("bad", "chr1", "5", "+", "LINE/L1", ""), ("7", "chrX", "5", "+", "SINE", ""), ("9", "chr1", "7", "+", "SINE", "*")]
    (tmp_path / "r.out").write_text(head + "".join(row.format(*x) for x in lines) + "too few fields\n")
    alias = spark.createDataFrame([("chr1", "NC_1"), ("chr2", "NC_2"), ("chr2", "NC_2")], "name string, alias string")
    assert repeats.convert_repeats(spark, str(tmp_path / "r.out"), str(tmp_path / "o"), alias) == {"converted": 3, "skipped": 2}
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))).splitlines()
    assert text == [
        "0\t1504\t12\t4\t14\tNC_1\t10000\t10468\t(99)\t-\t(CCC)n\tSimple_repeat\tSimple_repeat\t0\t0\t(0)\t0",
        "0\t12\t12\t4\t14\tNC_2\t4\t10468\t(99)\t+\t(CCC)n\tLINE\tL1/x\t0\t0\t(0)\t1",
        "0\t9\t12\t4\t14\tNC_1\t6\t10468\t(99)\t+\t(CCC)n\tSINE\tSINE\t0\t0\t(0)\t2",
    ]
    assert repeats.convert_repeats(spark, str(tmp_path / "r.out"), str(tmp_path / "b"), bed=True) == {"converted": 4, "skipped": 1}
    bed = "".join(p.read_text() for p in sorted((tmp_path / "b").glob("part-*"))).splitlines()
    assert bed[0] == "chr1\t10000\t10468\t(CCC)n\t1504\t-\tSimple_repeat\tSimple_repeat" and len(bed) == 4


def test_all_nearest_targets_equal_brute_force(spark):
    rng = random.Random(7)
    targets = [(c, rng.randrange(0, 3_000_000, 500), i) for i, c in enumerate("aab" * 60)] + [("a", 1000, 900), ("a", 1000, 901), ("a", None, 902)]
    points = [(i, rng.choice("abc"), rng.randrange(3_000_000)) for i in range(150)] + [(200, "a", 1250), (201, "a", 1000), (202, "a", None)]
    t = spark.createDataFrame(targets, "chrom string, pos long, id int")
    p = spark.createDataFrame(points, "name int, chrom string, pos long").repartition(4)
    want = set()
    for i, c, x in points:
        all_d = [(abs(x - y), k) for d, y, k in targets if d == c and x is not None and y is not None]
        want |= {(i, d, k) for d, k in all_d if d == min(all_d)[0]}
    got = intervals.nearest_targets(p, t).collect()
    assert {(r.name, r.distance, r.target_id) for r in got} == want and len(got) == len(want) and sum(r.name == 201 for r in got) >= 2


def test_leading_units_equal_brute_force(spark):
    from orbispan.functions import sequence

    rng = random.Random(8)
    texts = ["".join(rng.choices("AC", k=rng.randrange(1, 5))) * rng.randrange(1, 12) + "".join(rng.choices("AC", k=rng.randrange(4))) for _ in range(200)] + ["A" * 3000, "", None]
    for s in texts[:-1]:
        want = []
        for u in range(2, min(50, len(s) // 2) + 1):
            n = 0
            for i in range(0, len(s) - u, u):
                if s[i : i + u] != s[:u]:
                    break
                n += 1
            if n >= 2:
                want.append((u, n, n * u))
        assert sequence.leading_units(s, 2, 50) == want
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", sequence.tandem_units("s", 2, 50).alias("u"))
    assert all([tuple(x) for x in r.u] == sequence.leading_units(r.s or "", 2, 50) for r in df.collect())
