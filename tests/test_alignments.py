"""Binary alignment files: round trips over any cuts, the index, odd fields and damaged files."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from orbispan.operators.sequences import junction_support
from orbispan.sources import alignments as al
from orbispan.sources.alignments import read_bam, read_bam_references, write_bam

CONTIGS = [("b", 5_000_000), ("a", 40_000_000), ("none", 10)]
COLUMNS = [x.strip().split(" ")[0] for x in al.SCHEMA.split(",")]


def some(n: int, seed: int = 1, longest: int = 300) -> list[dict]:
    r, out = random.Random(seed), []
    for i in range(n):
        bases = r.randrange(1, longest)
        placed = r.random() < 0.95
        contig, size = CONTIGS[r.randrange(2)]
        row = dict.fromkeys(COLUMNS)
        row |= {"name": f"r{i // 2}", "flag": 64 if i % 2 else 128, "mapq": r.randrange(255), "template_length": r.randrange(-900, 900)}
        row |= {"seq": "".join(r.choices("ACGTN", k=bases)), "quality": "".join(r.choices("!5I~", k=bases)) if r.random() < 0.8 else None, "tags": r.choice([[], ["NM:i:3", "MD:Z:5A7"], ["XA:A:q", "XB:B:C,1,255", "XI:i:4000000000"]])}
        if placed:
            start = r.randrange(size - 400_000)
            row |= {"contig": contig, "start": start, "cigar": f"{bases}M", "end": start + bases}
        out.append(row)
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], al.SCHEMA).repartition(3)


def seen(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def expected(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=repr)


def test_round_trip_over_any_cuts_and_by_index(spark, tmp_path):
    rows = some(4000) + some(6, 2, 200_000)  # some records take several blocks
    write_bam(frame(spark, rows), f"{tmp_path}/x", CONTIGS)
    for step in (1_000, 50_000, 1 << 26):
        df = read_bam(spark, f"{tmp_path}/x", range_bytes=step)
        assert seen(df) == expected(rows)
    assert df.rdd.getNumPartitions() < read_bam(spark, f"{tmp_path}/x", range_bytes=1_000).rdd.getNumPartitions()
    for step in (1_000, 1 << 26):
        assert seen(read_bam(spark, f"{tmp_path}/x", index=True, range_bytes=step)) == expected(rows)
    assert [tuple(r) for r in read_bam_references(spark, f"{tmp_path}/x").orderBy("ordinal").collect()] == [(i, *c) for i, c in enumerate(CONTIGS)]
    whole = b"".join(gzip.decompress((p).read_bytes()) for p in sorted((tmp_path / "x").glob("*.bam"))[:1])
    assert whole[:4] == b"BAM\x01"


def test_regions_take_fewer_ranges(spark, tmp_path):
    rows = some(3000, 3)
    write_bam(frame(spark, rows), f"{tmp_path}/x", CONTIGS)
    ranges = {}
    for contigs, least in ((["a"], 0), (["b", "zz"], 0), (["a"], 30_000_000), (["a", "b"], 4_000_000), (["a"], 39_999_999), (["none"], 0), ([], 0)):
        for index in (False, True):
            df = read_bam(spark, f"{tmp_path}/x", index, 20_000, contigs, least)
            assert seen(df) == expected(r for r in rows if r["contig"] in contigs and r["start"] >= least), (contigs, least, index)
        ranges[(*contigs, least)] = df.rdd.getNumPartitions()
    whole = read_bam(spark, f"{tmp_path}/x", True, 20_000)
    assert ranges["a", 30_000_000] < ranges["a", 0] < whole.rdd.getNumPartitions()
    # filters of one use of a table do not change what others read
    parts = [whole.where(w) for w in ("contig = 'a'", "contig = 'b'", "contig IS NULL")]
    assert seen(parts[0].unionByName(parts[1]).unionByName(parts[2])) == seen(whole) == expected(rows)


def test_bytes_that_look_like_records_are_an_error_or_right(spark, tmp_path):
    """A tag holds whole records: a cut within it finds them, and the task before says that they are none."""
    fake = b"".join(al._record({**dict.fromkeys(COLUMNS), "name": f"fake{i}", "contig": "b", "start": i, "cigar": "4M", "seq": "ACGT"}, {"b": 0})[0] for i in range(4000))
    rows = some(20, 4)
    noise = random.Random(5).randbytes(400_000)  # keeps blocks from shrinking to nothing
    rows[3]["tags"] = ["XX:B:C," + ",".join(map(str, noise[:200_000] + fake + noise[200_000:]))]
    write_bam(frame(spark, rows).coalesce(1), f"{tmp_path}/x", CONTIGS)
    assert seen(read_bam(spark, f"{tmp_path}/x", index=True)) == expected(rows)
    assert seen(read_bam(spark, f"{tmp_path}/x")) == expected(rows)
    with pytest.raises(Exception, match="read it with an index or another range_bytes"):
        read_bam(spark, f"{tmp_path}/x", range_bytes=3_000).count()


def test_odd_fields(spark, tmp_path):
    many = "".join("1M1I" for _ in range(40_000))
    rows = [dict.fromkeys(COLUMNS) | {"name": n, "flag": 0, "mapq": 0, "template_length": 0, "tags": []} for n in ("long", "bare", "same", "same")]
    rows[0] |= {"contig": "a", "start": 7, "end": 40_007, "cigar": many, "seq": "AC" * 40_000, "tags": ["NM:i:40000"]}
    rows[1] |= {"contig": "b", "start": 0}
    write_bam(frame(spark, rows), f"{tmp_path}/x", CONTIGS)
    assert seen(read_bam(spark, f"{tmp_path}/x")) == expected(rows)
    got = read_bam(spark, f"{tmp_path}/x", index=True, contigs=["a"]).collect()
    assert [r["end"] for r in got] == [40_007]
    with pytest.raises(Exception, match="KeyError"):
        write_bam(frame(spark, [rows[0] | {"contig": "absent"}]), f"{tmp_path}/y", CONTIGS)


def test_empty_tables_and_overwriting(spark, tmp_path):
    write_bam(frame(spark, some(50)), f"{tmp_path}/x", CONTIGS)
    write_bam(frame(spark, []), f"{tmp_path}/x", CONTIGS)
    for index in (False, True):
        assert read_bam(spark, f"{tmp_path}/x", index=index).count() == 0
        assert read_bam(spark, f"{tmp_path}/x", index=index, contigs=["a"]).count() == 0
    (tmp_path / "nothing").mkdir()
    assert read_bam(spark, f"{tmp_path}/nothing").count() == 0


def test_damaged_files_are_errors(spark, tmp_path):
    write_bam(frame(spark, some(3000, 6)).coalesce(1), f"{tmp_path}/x", CONTIGS)
    raw = max((tmp_path / "x").glob("*.bam"), key=lambda p: p.stat().st_size).read_bytes()
    (tmp_path / "cut.bam").write_bytes(raw[: len(raw) // 2])
    flipped = bytearray(raw)
    flipped[len(raw) // 2] ^= 255
    (tmp_path / "flipped.bam").write_bytes(flipped)
    (tmp_path / "text.bam").write_bytes(b"no alignments, but more than eighteen bytes of text")
    for name, message in (("cut", "no whole block|ends within"), ("flipped", "damaged block|no whole block"), ("text", "no whole block")):
        with pytest.raises(Exception, match=message):
            read_bam(spark, f"{tmp_path}/{name}.bam").count()


def test_bins_hold_their_stretch():
    r = random.Random(9)
    for _ in range(2000):
        start = r.randrange(1 << 29)
        end = min(start + r.choice([1, 50, 20_000, 3_000_000, 1 << 28]), 1 << 29)
        number = al._bin(start, end)
        level = next(k for k in range(5, -1, -1) if number >= ((1 << 3 * k) - 1) // 7)
        shift, at = 29 - 3 * level, number - ((1 << 3 * level) - 1) // 7
        assert at << shift <= start and end <= at + 1 << shift
    assert struct.unpack("<H", al.END_BLOCK[16:18])[0] + 1 == len(al.END_BLOCK)


def test_junction_support_of_few_reads(spark):
    schema = "name string, flag int, contig string, start long, end long, cigar string, tags array<string>"
    rows = [("r1", 0, "c", 400, 600, "200M", None), ("r1", 0, "c", 10, 20, "5S10M", []), ("r2", 0, "c", 10, 100, "90M", ["SA:Z:c,701,+,9M,60,0;bad;c,x,+"]), ("r3", 1024, "c", 400, 600, "200M", None), ("r4", 4, "c", None, None, None, None), ("r5", 0, "c", 480, 600, "120M3S", None), ("r6", 0, "c", 5, None, None, None), (None, 0, "c", 300, 700, "400M", ["SA:Z:"])]
    refs = spark.createDataFrame([("c", 1000), ("d", 10)], "contig string, size long")
    got = {r["contig"]: tuple(r)[1:] for r in junction_support(spark.createDataFrame(rows, schema), refs, min_unique=5, min_split=4).collect()}
    assert got == {"c": (5, 4, 3, 1000, "Detected", "High"), "d": (0, 0, 0, 10, "Not_detected", "Low")}
    assert junction_support(spark.createDataFrame([], schema), refs).agg(F.sum("unique_reads")).first()[0] == 0
