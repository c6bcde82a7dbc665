"""Readers of tools' files beside the registered round trips."""

from pyspark.sql import functions as F

from orbispan.sources import detectors, repeats, tables


def test_longest_consensus(spark):
    rows = [("a", "ACG"), ("a", "TTTT"), ("a", "CCCC"), ("b", ""), ("c", None), (None, "A"), (None, "AC")]
    got = detectors.longest_consensus(spark.createDataFrame(rows, "name string, consensus string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "CCCC"), (None, "AC")], key=str)
    assert detectors.longest_consensus(spark.createDataFrame([], "name string, consensus string")).count() == 0


def test_consensus_lines_with_comments(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# readName\trepN\tseq\nr1\trep0\t5\tACGT\nr1\n\nr2\trep1\tAA\n")
    assert sorted(map(tuple, detectors.read_consensus(spark, str(tmp_path / "c.txt")).collect())) == [("r1", "ACGT"), ("r2", "AA")]


def test_directory_of_samples(spark, tmp_path):
    for name, rows in (("s1.x", ["chr1,5,9"]), ("s2", ["chr2,1,4", "chr2,7,8"])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["eChr,eStart,eEnd", *rows]) + "\n")
    got = tables.read_directory(spark, f"{tmp_path}/*.csv")
    assert sorted(map(tuple, got.groupBy("sample").agg(F.count(F.lit(1)), F.min("eStart")).collect())) == [("s1.x", 1, "5"), ("s2", 2, "1")]


def test_exclusions_are_centromeres_of_bands_only(spark, tmp_path):
    (tmp_path / "bands").write_text("chr1\t0\t5\tp1\tgneg\nchr1\t5\t9\tcen\tacen\n#x\n")
    (tmp_path / "gaps.bed").write_text("track x\nchr1\t3\t4\nchr2\t0\t9\tgap\n")
    assert [tuple(r) for r in tables.read_excluded(spark, str(tmp_path / "bands")).collect()] == [("chr1", 5, 9)]
    assert sorted(map(tuple, tables.read_excluded(spark, str(tmp_path / "gaps.bed")).collect())) == [("chr1", 3, 4), ("chr2", 0, 9)]


def test_formats_are_told_apart(spark, tmp_path):
    lines = {"ucsc": "\t".join(["1"] * 17), "gff": "chr1\tx\trepeat\t5\t9\t.\t+\t.\tID=a", "repeatmasker": "  SW  perc\nscore div\n\n" + "  ".join(["463"] * 15), "bed": "chr1\t5\t9\tAlu"}
    for name, text in lines.items():
        (tmp_path / name).write_text("# comment\n" + text + "\n")
        assert repeats.sniff(spark, str(tmp_path / name)) == name
    (tmp_path / "calls").write_text("chr1\t5\t9\n")
    (tmp_path / "calls2").write_text("chrom,start,end\nchr1,5,9\n")
    assert (tables.sniff(spark, str(tmp_path / "calls")), tables.sniff(spark, str(tmp_path / "calls2")), tables.sniff(spark, "x.CSV")) == ("bed", "csv", "csv")
