"""Column functions over intervals and region texts. Coordinates are 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default length bins, half-open, the last one open-ended.
LENGTH_BINS = ((0, 500, "<500bp"), (500, 1000, "500-1kb"), (1000, 5000, "1-5kb"), (5000, 10000, "5-10kb"), (10000, None, ">10kb"))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def region_struct(text: str | Column) -> Column:
    """struct<chrom, start, end> of 'chr:a-b' at the start of a text; null where it does not match."""
    m = lambda i: F.regexp_extract(_c(text), r"^([^:]+):(\d+)-(\d+)", i)
    return F.when(m(1) != "", F.struct(m(1).alias("chrom"), m(2).cast("bigint").alias("start"), m(3).cast("bigint").alias("end")))


def regions_array(text: str | Column) -> Column:
    """array<struct<chrom, start, end>> of 'chr1:1-5(+);chr2:7-9'; ';' separates if the text has one, else '|'."""
    t = _c(text)
    parts = F.when(t.contains(";"), F.split(t, ";")).otherwise(F.split(t, r"\|"))
    parsed = F.transform(parts, lambda x: region_struct(F.trim(x)))
    return F.filter(parsed, lambda x: x.isNotNull())


def stranded_segments(text: str | Column) -> Column:
    """array<struct<chrom, start, end, strand, seg_length>>; parts without (+) or (-) are left out."""
    pattern = r"^([^:]+):(\d+)-(\d+)\(([+-])\)"
    g = lambda x, i: F.regexp_extract(F.trim(x), pattern, i)

    def part(x: Column) -> Column:
        s, e = g(x, 2).cast("bigint"), g(x, 3).cast("bigint")
        return F.when(g(x, 1) != "", F.struct(g(x, 1).alias("chrom"), s.alias("start"), e.alias("end"), g(x, 4).alias("strand"), (e - s).alias("seg_length")))

    return F.filter(F.transform(F.split(_c(text), r"[;|]"), part), lambda x: x.isNotNull())


def fusion_class(segments: str | Column) -> Column:
    s = _c(segments)
    chroms = F.array_distinct(F.transform(s, lambda x: x["chrom"]))
    return F.when(F.size(s) < 2, "unknown").when(F.size(chroms) > 1, "inter-chromosomal").otherwise("intra-chromosomal")


def intra_distance(segments: str | Column) -> Column:
    """Span from the first to the last position if all segments share a chromosome, else null."""
    s = _c(segments)
    one = F.size(F.array_distinct(F.transform(s, lambda x: x["chrom"]))) == 1
    ends = F.flatten(F.transform(s, lambda x: F.array(x["start"], x["end"])))
    return F.when(one, F.array_max(ends) - F.array_min(ends))


def chromosome_set(segments: str | Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(_c(segments), lambda x: x["chrom"]))), ",")


def midpoint(start: str | Column = "start", end: str | Column = "end") -> Column:
    return F.floor((_c(start) + _c(end)) / 2).cast("bigint")


def window_of(position: str | Column, size: int) -> Column:
    return F.floor(_c(position) / size).cast("bigint")


def overlap_bp(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)))


def overlap_of_shorter(s1, e1, s2, e2) -> Column:
    """Overlap over the shorter length; 0 if either is empty."""
    short = F.least(_c(e1) - _c(s1), _c(e2) - _c(s2))
    return F.when(short > 0, overlap_bp(s1, e1, s2, e2) / short).otherwise(0.0)


def reciprocal(s1, e1, s2, e2, fraction: float) -> Column:
    ov = overlap_bp(s1, e1, s2, e2)
    return (ov > 0) & (ov >= (_c(e1) - _c(s1)) * F.lit(fraction)) & (ov >= (_c(e2) - _c(s2)) * F.lit(fraction))


def one_sided_fraction(s1, e1, s2, e2) -> Column:
    return overlap_bp(s1, e1, s2, e2) / F.greatest(F.lit(1), _c(e1) - _c(s1))


def clamp(start: str | Column, end: str | Column, size: str | Column) -> Column:
    """struct<start, end, valid> inside [0, size]."""
    s = F.greatest(F.lit(0), F.least(_c(start), _c(size)))
    e = F.greatest(F.lit(0), F.least(_c(end), _c(size)))
    return F.struct(s.alias("start"), e.alias("end"), (e > s).alias("valid"))


def length_bin(length: str | Column, bins=LENGTH_BINS) -> Column:
    """Label of the first bin that holds the length; the last one takes the rest."""
    out = F.lit(bins[-1][2])
    for lo, hi, label in reversed(bins[:-1]):
        out = F.when((_c(length) >= lo) & (_c(length) < hi), label).otherwise(out)
    return out


def percent_bin(pct: str | Column, n_bins: int) -> Column:
    """Index of equal-width bins over 0..100, the last one closed; null outside."""
    p = _c(pct)
    return F.when((p >= 0) & (p <= 100), F.least(F.floor(p / F.lit(100.0 / n_bins)), F.lit(n_bins - 1)).cast("int"))


def window_label(size: int) -> str:
    return f"{size // 1000}kb" if size < 1_000_000 else f"{size // 1_000_000}Mb"


def cnv_category(value: str | Column) -> Column:
    return F.when(_c(value) > 1.2, "gain").when(_c(value) < 0.8, "loss").otherwise("neutral")


def ratio_or_zero(part: str | Column, whole: str | Column) -> Column:
    return F.when(_c(whole) > 0, _c(part) / _c(whole)).otherwise(0.0)


def f1_score(precision: str | Column, recall: str | Column) -> Column:
    p, r = _c(precision), _c(recall)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def type_of_name(name: str | Column) -> Column:
    """U, M, C or X by the beginning of a simulated region's name."""
    n = _c(name)
    return F.when(n.startswith("Uecc"), "U").when(n.startswith("Mecc"), "M").when(n.startswith("Cecc"), "C").otherwise("X")
