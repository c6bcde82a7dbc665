import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbispan.functions import regions, sequence
from orbispan.operators import benchmark, cecc, hotspots, process, sequences, stats, te
from orbispan.sources import repeats, tables


def test_merge_keeps_sample_names(spark):
    a = spark.createDataFrame([("chr1", 1, 5), ("chr2", 3, 9)], "eChr string, eStart bigint, eEnd bigint")
    b = spark.createDataFrame([("chr1", 7, 8)], "eChr string, eStart bigint, eEnd bigint")
    out = process.union_samples({"sample1": a, "sample2": b}).collect()
    assert len(out) == 3 and {r["sample"] for r in out} == {"sample1", "sample2"}


def test_parse_names(spark):
    df = spark.createDataFrame([("chr1:100-500", "x"), ("nonsense", "y")], "seqname string, other_col string")
    rows = [tuple(r)[2:] for r in process.parse_names(df).collect()]
    assert rows == [("chr1", 100, 500, 400), (None, None, None, None)]


def test_filter_keeps_the_bound(spark):
    df = spark.createDataFrame([(90.0,), (50.0,), (85.0,), (70.0,), (80.0,), (None,)], "anno_Percent double")
    assert process.filter_annotation(df, 80).count() == 3


def test_region_texts(spark):
    df = spark.createDataFrame([("chr1:10-20(+);chr2:5-9(-)",), ("chr1:1-5|chr1:7-9",), ("bad",)], "t string")
    rows = df.select(regions.regions_array("t").alias("r"), regions.fusion_class(regions.regions_array("t")).alias("f"), regions.intra_distance(regions.regions_array("t")).alias("d")).collect()
    assert [len(r.r) for r in rows] == [2, 2, 0]
    assert [r.f for r in rows] == ["inter-chromosomal", "intra-chromosomal", "unknown"] and [r.d for r in rows][:2] == [None, 8]


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTN",), ("nnn",)], "s string")
    rows = df.select(sequence.gc_content("s").alias("g"), sequence.reverse_complement("s").alias("r")).collect()
    assert rows[0].g == 0.5 and rows[1].g is None and rows[0].r == "NACGT"
    assert spark.range(1).select(sequence.cs_stats(sequence.F.lit(":5*ag:3+tt-c:2")).alias("c")).first()["c"] == (1, 2, 3)


def test_bh_matches_a_loop(spark):
    p = [0.01, 0.04, 0.04, 0.03, 0.5, None, 1.0]
    got = {i: q for i, q in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p_value double")).select("i", "q_value").collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    best, want = 1.0, {5: None}
    for rank in range(len(known), 0, -1):
        best = min(best, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = best
    assert all(got[i] == pytest.approx(want[i]) if want[i] is not None else got[i] is None for i in got)


def test_exact_kernels():
    assert stats.fisher_p(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert stats.fisher_p(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)
    # U = 0 of 3 against 4: two of the 35 orders are as extreme
    assert stats.mwu_p(3, 4, 0.0, 0.0) == pytest.approx(2 / 35)
    assert stats.mwu_p(0, 4, 0.0, 0.0) is None


def test_rank_test_equals_pair_counting(spark):
    rng = np.random.default_rng(1)
    x, g = rng.integers(0, 9, 80), rng.integers(0, 2, 80).astype(bool)
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, g)], "v double, g boolean")
    u = stats.mann_whitney(df, "v", "g").first()["u"]
    assert u == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in x[g] for b in x[~g]))


def test_saturation_fit_recovers_its_curve():
    x = np.linspace(0.1, 1, 10)
    f = stats.saturation_fit(x, 1000 * (1 - np.exp(-2.5 * x)))
    assert f["n_max"] == pytest.approx(1000, rel=1e-4) and f["rate"] == pytest.approx(2.5, rel=1e-4) and f["r2"] > 0.9999


def test_permutation_null_is_binomial(spark):
    genome = spark.createDataFrame([("c1", 1000)], "chrom string, size bigint")
    ecc = spark.createDataFrame([("c1", i * 10, i * 10 + 2) for i in range(50)], "chrom string, start bigint, end bigint")
    rows = {r.idx: r for r in hotspots.permutation_test(ecc, genome, 100, n_perm=2000, seed=3).collect()}
    tail = sum(math.comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(10, 51))
    assert rows[0]["count"] == 10 and rows[0].p_value == pytest.approx(tail, abs=0.02) and rows[9].p_value == 1.0


def test_greedy_dedupe_absorbs_in_order(spark):
    rows = [("c1", 0, 100, "A", "s1"), ("c1", 5, 100, "B", "s2"), ("c1", 90, 300, "A", "s1"), ("c2", 0, 50, "A", "s1"), ("c1", 101, 110, "B", "s3")]
    out = process.deduplicated(spark.createDataFrame(rows, "chrom string, start bigint, end bigint, tool string, sample string"), 0.8, "A+B")
    assert sorted(map(tuple, out.collect())) == [("c1", 0, 100, "A+B", "s1;s2"), ("c1", 90, 300, "A", "s1"), ("c1", 101, 110, "B", "s3"), ("c2", 0, 50, "A", "s1")]


def test_truth_as_its_own_detection_is_perfect(spark):
    segs = "array<struct<chrom: string, start: bigint, end: bigint>>"
    rows = [("U1", "U", 100, 1, [("c1", 0, 100)]), ("M1", "M", 50, 2, [("c2", 500, 550)]), ("C1", "C", 60, 3, [("c1", 900, 930), ("c3", 10, 40)])]
    truth = spark.createDataFrame(rows, f"name string, type string, length bigint, ord bigint, segs {segs}")
    det = truth.selectExpr("concat('d', name) AS det_id", "type", "'Confirmed' AS state", "segs")
    res = benchmark.outcomes(det, truth)
    assert all(r.precision == r.recall == r.f1 == 1.0 for r in benchmark.metrics_by(res, truth).collect())
    assert benchmark.missed(res, truth).count() == 0


def test_partial_chimera_is_a_false_positive(spark):
    assert benchmark.most_paired([("a", 0, 10), ("b", 0, 10)], [("b", 0, 10), ("a", 0, 10)], 0.8) == 2
    assert benchmark.most_paired([("a", 0, 10), ("b", 0, 10)], [("a", 0, 10), ("z", 0, 10)], 0.8) == 1
    assert benchmark.most_paired([("a", 0, 10)], [("a", 0, 10)] * 3, 0.8) == 0


def test_false_discovery_birthday_form(spark):
    spike = spark.createDataFrame([(90, 90, 20)], "A long, B long, AB long")
    s = spark.createDataFrame([("x", 1000, 10)], "sample string, total_reads long, ceccdna_count long")
    r = cecc.false_discovery(s, spike).first()
    assert r.expected_false_reads == pytest.approx(100) and r.fdr_no_filter == pytest.approx(10) and 0 < r.fdr_filtered < 1e-9


def test_te_class_rules(spark):
    reg = spark.createDataFrame([("a", "U", 100), ("b", "U", 100), ("c", "U", 100), ("d", "U", 100)], "name string, type string, length bigint")
    ov = spark.createDataFrame([("a", "x", 90), ("b", "x", 40), ("b", "y", 40), ("c", "x", 5)], "name string, te_family string, overlap_bp bigint")
    assert {r.name: r.classification for r in te.classify(reg, ov).collect()} == {"a": "single_TE", "b": "composite_TE", "c": "no_TE", "d": "no_TE"}


def test_circular_depth_wraps(spark):
    parts = spark.createDataFrame([("m", 80, 120, 100)], "name string, start bigint, end bigint, length bigint")
    r = sequences.circular_depth(parts).first()
    assert (r.min_depth, r.max_depth, r.zero_bp) == (0, 1, 60) and r.mean_depth == pytest.approx(0.4)


def test_readers(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\n#c\nchr1\t5\t9\tn1\n585\tchr2\t1\t4\nchr3\tx\t4\n")
    assert [tuple(r)[:3] for r in tables.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 5, 9), ("chr2", 1, 4)]
    (tmp_path / "b.csv").write_text("eName,Chr,eStart,eEnd,extra\nq,chr1,1,4,z\nr,chr1,bad,4,z\n")
    rows = tables.read_csv(spark, str(tmp_path / "b.csv")).collect()
    assert len(rows) == 1 and rows[0]["length"] == 3 and rows[0]["extra"] == "z"
    (tmp_path / "c.gff").write_text("##gff\nchr1\tsrc\tgene\t11\t20\t.\t+\t.\tID=g1;Name=\"abc\";biotype=x\n")
    g = tables.read_gff(spark, str(tmp_path / "c.gff")).first()
    assert (g.start, g.ID, g.biotype, g.source_file) == (11, "g1", "x", "c")
    (tmp_path / "d.out").write_text("  SW perc\n\n 1504 1.3 0.4 1.3 chr1 10001 10468 (99) C (CCC)n Simple_repeat/Low* 1 463 (0) 1\n")
    t = repeats.read_repeats(spark, str(tmp_path / "d.out")).first()
    assert (t.chrom, t.start, t.strand, t.te_class, t.te_family, t.pct_div) == ("chr1", 10000, "-", "Simple_repeat", "Low", 1.3)
    assert tables.genome_sizes(spark).count() == 24


def test_fasta_round_trip(spark, tmp_path):
    from orbispan.sources import sequences as fa

    df = spark.createDataFrame([("chr1", "ACGT" * 50), ("chr2", "GGC")], "name string, seq string")
    fa.write_fasta(df, str(tmp_path / "f"))
    chunks = fa.read_fasta(spark, str(tmp_path / "f"), 64)
    reg = spark.createDataFrame([("r1", "chr1", 60, 70), ("r2", "chr2", 0, 3), ("r3", "chrX", 0, 3)], "name string, chrom string, start bigint, end bigint")
    assert {r.name: r.seq for r in sequences.fetched(reg, chunks, 64).collect()} == {"r1": ("ACGT" * 50)[60:70], "r2": "GGC", "r3": ""}


def test_streaming_counts(spark, tmp_path):
    from orbispan.streaming.counts import sample_counts

    spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:01:01", "a"), ("2024-01-01 01:00:00", "b")], "ts string, sample string").selectExpr("to_timestamp(ts) ts", "sample").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, sample string").parquet(str(tmp_path / "in"))
    q = sample_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["sample"], r["count"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_pairing_equals_all_permutations():
    from itertools import permutations

    rng = random.Random(4)
    draw = lambda n: [(rng.choice("ab"), s, s + rng.randrange(5, 12)) for s in (rng.randrange(0, 12) for _ in range(n))]
    for _ in range(300):
        t, d = draw(rng.randrange(0, 6)), draw(rng.randrange(0, 6))
        fits = lambda x, y: x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= 0.6 * min(x[2] - x[1], y[2] - y[1])
        few, many = sorted((t, d), key=len)
        want = max(sum(fits(many[i], few[k]) for i, k in enumerate(p)) for p in permutations(range(len(few)))) if abs(len(t) - len(d)) <= 1 else 0
        assert benchmark.most_paired(t, d, 0.6) == want
    many = [("a", i * 10, i * 10 + 10) for i in range(200)]
    assert benchmark.most_paired(many, many[::-1], 0.8) == 200


def test_deduplicated_equals_a_scan(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(250):
        s = rng.randrange(0, 300)
        rows.append((rng.choice(["c1", "c2"]), s, s + rng.randrange(0, 60), rng.choice("xy"), rng.choice("pqr")))
    rows += rows[:20] + [("c3", 5, 5, "x", "p")] * 2
    for fraction in (0.5, 0.8):
        survivors = []
        for c, s, e, tool, sample in sorted(rows):
            near = next((m for m in survivors if m[0] == c and e > s and (o := min(e, m[2]) - max(s, m[1])) > 0 and o >= fraction * (e - s) and o >= fraction * (m[2] - m[1])), None)
            if near is None:
                survivors.append([c, s, e, tool, sample])
            else:
                near[3] = tool if near[3] == tool else "merged"
                near[4] += "" if near[4] == sample else f";{sample}"
        df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, tool string, sample string").repartition(3)
        assert sorted(map(tuple, process.deduplicated(df, fraction).collect())) == sorted(map(tuple, survivors))


def test_greedy_choices_equal_one_by_one(spark):
    from orbispan.operators.greedy import first_choices

    rng = random.Random(6)
    rows = list({(rng.randrange(40), rng.randrange(30)): rng.random() for _ in range(250)}.items())
    rows = [(a, b, w) for (a, b), w in rows]
    used, want = set(), set()
    for a in sorted({r[0] for r in rows}):
        free = sorted((w, b) for x, b, w in rows if x == a and b not in used)
        if free:
            used.add(free[0][1])
            want.add((a, free[0][1]))
    df = spark.createDataFrame(rows, "a long, b long, w double").repartition(3)
    assert {(r.a, r.b) for r in first_choices(df, "a", "b", F.col("a"), F.col("w")).collect()} == want
    assert first_choices(df.limit(0), "a", "b", F.col("a"), F.col("w")).count() == 0


def test_poisson_tail_and_fisher_on_large_values():
    exact = lambda k, m: 1 - math.fsum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k))
    for k, m in ((1, 0.1), (3, 2.5), (10, 4.0), (30, 40.0), (7, 7.0), (90, 100.0)):
        assert stats.poisson_tail(k, m) == pytest.approx(exact(k, m), rel=1e-9, abs=1e-12)
    assert stats.poisson_tail(800, 800.0) == pytest.approx(0.5047, abs=1e-3) and stats.poisson_tail(2000, 800.0) < 1e-200
    assert stats.poisson_tail(10**9, 1e9) == pytest.approx(0.5, abs=1e-3) and stats.poisson_tail(0, 5.0) == 1.0 and stats.poisson_tail(3, 0.0) == 0.0

    def brute(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        ways = lambda k: math.comb(col, k) * math.comb(n - col, row - k)
        return sum(ways(k) for k in range(max(0, row + col - n), min(row, col) + 1) if ways(k) <= ways(a)) / math.comb(n, row)

    rng = random.Random(7)
    for _ in range(200):
        x = [rng.randrange(0, 25) for _ in range(4)]
        if sum(x):
            assert stats.fisher_p(*x) == pytest.approx(brute(*x), rel=1e-6)
    assert 0 < stats.fisher_p(10**8, 10**8 + 30_000, 10**8, 10**8) < 1
    assert stats.mwu_p(8, 800_000_000, 3.2e9, 0) > 0.9


def test_hit_chances_and_overlap_test(spark):
    from orbispan.operators import enrich

    genome = spark.createDataFrame([("c1", 300), ("c2", 100)], "chrom string, size bigint")
    rng = random.Random(8)
    regions = [(c, s, s + rng.randrange(1, 12), rng.choice("uv")) for c, top in (("c1", 290), ("c2", 90)) for s in (rng.randrange(0, top) for _ in range(6))]
    r = spark.createDataFrame(regions, "chrom string, start bigint, end bigint, kind string")
    got = {(x.kind, x.length): x.chance for x in enrich.hit_chances(spark.createDataFrame([(5,), (40,)], "length bigint"), r, genome, ["kind"]).collect()}
    for kind in "uv":
        for n in (5, 40):
            want = 0.0
            for c, size in (("c1", 300), ("c2", 100)):
                starts = range(size - n + 1)
                want += size / 400 * sum(any(x[0] == c and x[3] == kind and s < x[2] and x[1] < s + n for x in regions) for s in starts) / len(starts)
            assert got[kind, n] == pytest.approx(want)
    ecc = spark.createDataFrame([(f"e{i}", *rng.choice([x[:2] for x in regions])) for i in range(60)], "name string, chrom string, start bigint").selectExpr("name", "chrom", "start", "start + 5 AS end")
    out = enrich.overlap_test(ecc, r.select("chrom", "start", "end"), genome, n_perm=400).first()
    every = enrich.hit_chances(spark.createDataFrame([(5,)], "length bigint"), r.select("chrom", "start", "end"), genome).first().chance
    assert out.observed == 60 and out.n_perm == 400 and out["mean"] == pytest.approx(60 * every, rel=0.05) and out.p_value == pytest.approx(1 / 401)


def test_boundary_test_draws_the_distances_of_random_places(spark):
    from orbispan.operators import enrich

    rng = np.random.default_rng(9)
    genome = spark.createDataFrame([("c1", 1_000_000), ("c2", 400_000)], "chrom string, size bigint")
    domains = [("c1", 200_000, 450_000), ("c1", 700_000, 900_000), ("c2", 150_000, 300_000)]
    dom = spark.createDataFrame(domains, "chrom string, start bigint, end bigint")
    at = rng.integers(0, 1_400_000, size=4000)
    rows = [("c1", int(x)) if x < 1_000_000 else ("c2", int(x) - 1_000_000) for x in at]
    ecc = spark.createDataFrame([(f"e{i}", c, x, x + 1) for i, (c, x) in enumerate(rows)], "name string, chrom string, start bigint, end bigint")
    out = {r.statistic: r for r in enrich.boundary_test(ecc, dom, genome, n_perm=200).collect()}
    for s in ("mean", "median"):
        assert out[s]["mean"] == pytest.approx(out[s].observed, rel=0.05) and 0.005 < out[s].p_value < 1


def test_reports(spark, tmp_path):
    from orbispan.sources import sinks

    rows = [("all", "U", "f1", 0.5), ("all", "U", "n", 2.0), ("tool", "M", "n", 1.0)]
    m = spark.createDataFrame(rows, "scope string, key string, metric string, value double")
    assert sinks.write_report(m, f"file://{tmp_path}/r")["all"]["U"] == {"f1": 0.5, "n": 2.0}
    sinks.write_report_text(m, f"file://{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/t").collect()) == ["all / U: f1=0.5000, n=2.0000", "tool / M: n=1.0000"]
    sinks.write_report_csv(m, f"file://{tmp_path}/c")
    assert spark.read.csv(f"file://{tmp_path}/c", header=True).count() == 3
    sinks.REPORT_ROWS, old = 2, sinks.REPORT_ROWS
    try:
        with pytest.raises(ValueError):
            sinks.write_report(m, f"file://{tmp_path}/r2")
    finally:
        sinks.REPORT_ROWS = old


def test_ranks_and_adjusted_values_in_range_partitions(spark):
    import random

    from orbispan.operators import stats

    rng = random.Random(4)
    rows = [(i, rng.choice("ab") if i % 9 else None, rng.choice([rng.random(), 0.25, 0.5]) if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, p double")
    known = [r for r in rows if r[2] is not None]
    order = sorted(r[2] for r in known)
    raw = {p: p * len(known) / sum(x <= p for x in order) for p in order}
    q = {r.id: r.q_value for r in stats.benjamini_hochberg(df, "p").collect()}
    assert all(q[i] is None if p is None else abs(q[i] - min([1.0, *[raw[x] for x in order if x >= p]])) < 1e-12 for i, _, p in rows)
    ranks = {r.id: r["rank"] for r in stats.average_ranks(df.where("p is not null"), "p", keys=["g"]).collect()}
    assert len(ranks) == len(known)
    for i, g, p in known:
        own = [x for _, k, x in known if k == g]
        assert ranks[i] == sum(x < p for x in own) + (own.count(p) + 1) / 2


def test_binomial_quantiles_invert_the_distribution():
    from math import comb

    import numpy as np

    from orbispan.operators.stats import binomial_quantiles

    for n, p in ((1, 0.5), (7, 0.3), (40, 0.97), (300, 1e-4)):
        pmf = [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        below = np.concatenate([[0.0], np.cumsum(pmf)])
        units = np.linspace(0.0005, 0.9995, 500)
        want = [int(np.flatnonzero(below[:-1] <= u)[-1]) for u in units]
        assert binomial_quantiles(np.full(500, n), p, units).tolist() == binomial_quantiles(np.full(500, n), p, units, 9).tolist() == want
    mixed, unit = np.array([300, 0, 40, 300]), np.array([0.4, 0.9, 0.99, 0.7])
    assert binomial_quantiles(mixed, 0.3, unit).tolist() == [int(binomial_quantiles(mixed[i : i + 1], 0.3, unit[i : i + 1])[0]) for i in range(4)]
    assert binomial_quantiles(mixed, 0.0, unit).tolist() == [0] * 4 and binomial_quantiles(mixed, 1.0, unit).tolist() == mixed.tolist()
    assert abs(binomial_quantiles(np.array([10**9]), 0.25, np.array([0.5]))[0] - 250_000_000) <= 1


def test_multinomial_draws_depend_on_labels_alone_and_have_the_right_moments():
    import numpy as np

    from orbispan.operators.stats import digest_unit, multinomial_draws

    weights = np.array([5, 0, 1, 3, 0, 0, 11, 20, 7])
    labels = [f"7:chr1:{k}" for k in range(4000)]
    got = multinomial_draws(120, weights, labels)
    assert (got.sum(axis=1) == 120).all() and (got[:, weights == 0] == 0).all()
    share = weights / weights.sum()
    assert np.abs(got.mean(axis=0) - 120 * share).max() < 0.35
    assert np.abs(np.cov(got.T, bias=True) - 120 * (np.diag(share) - np.outer(share, share))).max() < 2.0
    assert (multinomial_draws(120, weights, labels[100:103]) == got[100:103]).all()
    assert (multinomial_draws(0, weights, labels[:2]) == 0).all()
    assert 0 <= digest_unit("a") < 1


def test_permutation_test_is_the_same_for_any_blocks(spark):
    from orbispan.operators import enrich

    ecc = spark.createDataFrame([(f"e{i}", "chr1", i * 7 % 950, i * 7 % 950 + 10) for i in range(200)], "name string, chrom string, start bigint, end bigint")
    genome = spark.createDataFrame([("chr1", 1000)], "chrom string, size bigint")
    rows = [sorted(tuple(r) for r in hotspots.permutation_test(ecc, genome, 100, n_perm=300, block=b).collect()) for b in (7, 300)]
    assert rows[0] == rows[1]
    tests = [enrich.overlap_test(ecc, spark.createDataFrame([("chr1", 100, 300)], "chrom string, start bigint, end bigint"), genome, n_perm=100, block=b).collect() for b in (9, 100)]
    a, b = (t[0].asDict() for t in tests)
    assert math.isclose(a.pop("sd"), b.pop("sd"), rel_tol=1e-12) and a == b  # sums of squares depend on the order of rows

