"""Column functions over nucleotide sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orbispan.functions.regions import _c


def _without(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_content(seq: str | Column) -> Column:
    """G and C over A, C, G and T in either case; null without any."""
    s = F.upper(_c(seq))
    bases = _without(s, "ACGT")
    return F.when(bases > 0, _without(s, "GC") / bases)


def gc_indicator(base: str | Column) -> Column:
    """1 for G and C, 0 for A and T, null for anything else."""
    b = F.upper(_c(base))
    return F.when(b.isin("G", "C"), 1).when(b.isin("A", "T"), 0)


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGTNacgtn", "TGCANtgcan"))


def circular_slice(seq: str | Column, offset: str | Column, length: str | Column) -> Column:
    """`length` bases from `offset` around a circle, as often around as it takes."""
    s, n = _c(seq), F.length(_c(seq))
    start = F.pmod(_c(offset), n)
    return F.when(n > 0, F.substring(F.repeat(s, F.ceil((start + _c(length)) / n).cast("int")), start + 1, _c(length)))


def rotated_and_doubled(seq: str | Column, cut: str | Column) -> Column:
    s, c = _c(seq), _c(cut)
    turned = F.concat(F.substring(s, c + 1, F.length(s)), F.substring(s, F.lit(1), c))
    return F.concat(turned, turned)


def junction_template(seq: str | Column, flank: int) -> Column:
    """struct<template, junction>: tail before head; a sequence of up to two flanks is doubled."""
    s = _c(seq)
    short = F.length(s) <= 2 * flank
    template = F.when(short, F.concat(s, s)).otherwise(F.concat(F.substring(s, F.length(s) - flank + 1, F.lit(flank)), F.substring(s, F.lit(1), F.lit(flank))))
    return F.struct(template.alias("template"), F.when(short, F.length(s)).otherwise(F.lit(flank)).alias("junction"))


def amplicon_reference(inside: str | Column, outside_tail: str | Column, outside_head: str | Column, head: str | Column) -> Column:
    """Tail inside and outside, then head outside and inside: the sequence that a junction amplicon is aligned to."""
    return F.concat(_c(inside), _c(outside_tail), _c(outside_head), _c(head))


def homopolymers(seq: str | Column, least: int = 4) -> Column:
    """array<string> of single-base runs of at least `least`."""
    runs = "|".join(f"{b}{{{least},}}" for b in "ACGT")
    return F.regexp_extract_all(F.upper(_c(seq)), F.lit(f"({runs})"), F.lit(1))


def leading_units(text: str, least: int = 10, most: int = 5000) -> list[tuple[int, int, int]]:
    """(unit length, copies, bases) of the units of `least` to `most` bases that a sequence begins with at least twice. A copy
    counts if bases follow it. Lengths of common beginnings with the sequence itself, each base looked at twice at most."""
    n = len(text)
    common, left, right, out = [0] * n, 0, 0, []
    for i in range(1, n):
        k = min(right - i, common[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        common[i] = k
        if i + k > right:
            left, right = i, i + k
        if least <= i <= min(most, n // 2):
            copies = min(1 + k // i, -(-(n - i) // i))
            if copies >= 2:
                out.append((i, copies, copies * i))
    return out


def tandem_units(seq: str | Column, least: int = 10, most: int = 5000) -> Column:
    """array<struct<unit_length, repeat_count, total_length>> of leading_units; null sequences have none."""

    @F.pandas_udf("array<struct<unit_length: int, repeat_count: int, total_length: int>>")
    def found(s: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("unit_length", "repeat_count", "total_length"), u)) for u in leading_units(x or "", least, most)] for x in s])

    return found(_c(seq))


def cs_stats(cs: str | Column) -> Column:
    """struct<mismatches, gap_opens, gap_bases> of a cs difference string."""
    c = _c(cs)
    gaps = F.regexp_extract_all(c, F.lit(r"[+-]([A-Za-z]+)"), F.lit(1))
    bases = F.aggregate(gaps, F.lit(0), lambda a, x: a + F.length(x))
    return F.struct(F.size(F.regexp_extract_all(c, F.lit(r"(\*[A-Za-z]{2})"), F.lit(1))).alias("mismatches"), F.size(gaps).alias("gap_opens"), bases.alias("gap_bases"))
