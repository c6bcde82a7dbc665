"""FASTA and FASTQ files cut into small blocks, and row order in files."""

import random

import pytest
from pyspark.sql import functions as F

from orbispan.operators import sequences
from orbispan.sources import order, sinks, tables
from orbispan.sources import sequences as sq


@pytest.fixture()
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def reads(n, seed=1):
    rng = random.Random(seed)
    text = lambda letters, k: "".join(rng.choices(letters, k=k))
    out = []
    for i in range(n):
        k = rng.choice([1, 30, 90, 2500 if i % 40 == 7 else 60])
        out.append((f"r{i} part={i % 3}", text("ACGTN", k), text("@III+#", k)))
    return out


def fastq(rows):
    return "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in rows)


def test_fastq_by_place_in_the_file(spark, tmp_path, small_blocks):
    a, b = reads(150), reads(40, 2)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.fq").write_text(fastq(a))
    (tmp_path / "x" / "b.fq").write_text(fastq(b) + "\n")
    df = sq.read_fastq(spark, str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).rdd.getNumPartitions() > 10
    got = sorted((r.file[-4:], r.record, r.read_id, r.seq, r.quality) for r in df.collect())
    assert got == sorted([("a.fq", i, *r) for i, r in enumerate(a)] + [("b.fq", i, *r) for i, r in enumerate(b)])
    assert {r.name for r in df.collect()} == {r[0].split()[0] for r in a + b}
    (tmp_path / "cut.fq").write_text("@one\nAC\n+\n@@\n@two\nGG\n")
    assert sorted((r.read_id, r.seq, r.quality) for r in sq.read_fastq(spark, str(tmp_path / "cut.fq")).collect()) == [("one", "AC", "@@"), ("two", "GG", None)]
    (tmp_path / "none.fq").write_text("")
    assert sq.read_fastq(spark, str(tmp_path / "none.fq")).count() == 0 and sq.read_fastq_ids(spark, str(tmp_path / "cut.fq")).count() == 2


def test_fastq_written_by_name(spark, tmp_path, small_blocks):
    rows = reads(200) + [("same", "A" * i, "I" * i) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "read_id string, seq string, quality string").repartition(5)
    sq.write_fastq(df, str(tmp_path / "s"), by_name=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert text == fastq(sorted(rows))
    again = sq.read_fastq(spark, str(tmp_path / "s"))
    assert sorted((r.read_id, r.seq, r.quality) for r in again.collect()) == sorted(rows)


def contigs():
    rng = random.Random(3)
    base = lambda n: "".join(rng.choices("acgtN", k=n))
    return [("chrA 5'->3' strand > x", base(5000)), ("chrB", ""), ("chrC", base(59)), ("chrD", base(60)), ("chrE\ttab", base(3001)), ("chrM", base(10)), ("chr1_random", base(100))]


def as_text(rows, width=60):
    return "".join(f">{h}\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for h, s in rows)


def test_fasta_of_any_headers_in_any_blocks(spark, tmp_path, small_blocks):
    rows = contigs()
    (tmp_path / "g.fa").write_text("; a remark\n" + as_text(rows))
    want = {h.split()[0]: s.upper() for h, s in rows[:5]}
    for chunk in (64, 1000, 1 << 16):
        got = {}
        for r in sq.read_fasta(spark, str(tmp_path / "g.fa"), chunk).orderBy("chunk").collect():
            assert len(r.seq) == min(chunk, len(want[r.chrom]) - r.chunk * chunk)
            got[r.chrom] = got.get(r.chrom, "") + r.seq
        assert got == want
    assert sq.read_fasta(spark, str(tmp_path / "g.fa"), 64, excluded=()).select("chrom").distinct().count() == 7
    import gzip

    (tmp_path / "g.fa.gz").write_bytes(gzip.compress((tmp_path / "g.fa").read_bytes()))
    assert sorted(map(tuple, sq.read_fasta(spark, str(tmp_path / "g.fa.gz"), 64).collect())) == sorted(map(tuple, sq.read_fasta(spark, str(tmp_path / "g.fa"), 64).collect()))


def test_index_and_byte_ranges(spark, tmp_path, small_blocks, monkeypatch):
    monkeypatch.setattr(sq, "RANGE_BASES", 500)
    rows = contigs()
    path = tmp_path / "g.fa"
    path.write_text(as_text(rows))
    index = {r.chrom: r for r in sq.fasta_index(spark, str(path)).collect()}
    data = path.read_bytes()
    for h, s in rows:
        r = index[h.split()[0]]
        assert (r.length, r.offset) == (len(s), data.index(f">{h}\n".encode()) + len(h) + 2) and r.line_bases == min(60, len(s)) and r.line_width == r.line_bases + 1
        for b in range(0, len(s), 7):
            at = r.offset + b // r.line_bases * r.line_width + b % r.line_bases
            assert data[at : at + 1].decode() == s[b]
    sq.write_index(sq.fasta_index(spark, str(path)), str(tmp_path / "index"))
    sq.write_index(sq.fasta_index(spark, str(path)), str(tmp_path / "index6"), files=True)
    assert sq.read_indexed_fasta(spark, "none", str(tmp_path / "index6"), 64).count() == sq.read_fasta(spark, str(path), 64).count()
    (fai,) = (tmp_path / "index").glob("part-*")
    assert [line.split("\t")[0] for line in fai.read_text().splitlines()] == [h.split()[0] for h, _ in rows]
    assert {r.chrom: r.size for r in tables.read_sizes(spark, str(fai)).collect()} == {h.split()[0]: len(s) for h, s in rows}
    for chunk in (64, 1000):
        ranges = sq.read_indexed_fasta(spark, str(path), str(fai), chunk)
        assert sorted(map(tuple, ranges.collect())) == sorted(map(tuple, sq.read_fasta(spark, str(path), chunk).collect()))
        of_e = sorted(r for r in map(tuple, ranges.collect()) if r[0] == "chrE")
        assert sorted(map(tuple, sq.read_indexed_fasta(spark, str(path), str(fai), chunk, contigs=["chrE", "none"]).collect())) == of_e
        # filters of one use of a table do not change what others read
        assert sorted(map(tuple, ranges.where("chrom = 'chrE'").collect())) == of_e
        assert ranges.where("chrom = 'chrE'").unionByName(ranges.where("chrom <> 'chrE'")).count() == ranges.count() > len(of_e)
    regions = spark.createDataFrame([(f"{c}:{s}", c, s, e) for c, s, e in [("chrA", 0, 60), ("chrA", 59, 2600), ("chrE", 2990, 3001), ("chrX", 1, 2)]], "name string, chrom string, start long, end long")
    got = {r.name: r.seq for r in sequences.fetched(regions, sq.read_indexed_fasta(spark, str(path), str(fai), 64), 64).collect()}
    a, e = (next(s for h, s in rows if h.startswith(c)).upper() for c in ("chrA", "chrE"))
    assert got == {"chrA:0": a[:60], "chrA:59": a[59:2600], "chrE:2990": e[2990:], "chrX:1": ""}


def test_ordinals_follow_files_and_lines(spark, tmp_path, small_blocks):
    (tmp_path / "o").mkdir()
    rng = random.Random(5)
    rows = [[f"{rng.random()}" for _ in range(n)] for n in (120, 0, 1, 77)]
    for k, lines in enumerate(rows):
        (tmp_path / "o" / f"{k}.txt").write_text("".join(f"{x}\n" for x in lines))
    got = order.with_ordinals(spark.read.text(str(tmp_path / "o")), in_file="line", file="file").orderBy("ordinal").collect()
    assert [r.value for r in got] == [x for lines in rows for x in lines] and [r.ordinal for r in got] == list(range(198))
    assert [r.line for r in got] == [i for lines in rows for i in range(len(lines))] and {r.file[-5:] for r in got} == {"0.txt", "2.txt", "3.txt"}
    table = spark.range(0, 500, 1, 6).withColumn("v", F.col("id") * 3)
    table.write.parquet(str(tmp_path / "p"))
    got = order.with_ordinals(spark.read.parquet(str(tmp_path / "p"))).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(500)) and [r.id for r in got] == list(range(500))
