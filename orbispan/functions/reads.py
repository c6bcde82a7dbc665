"""Column functions over read identifiers and alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbispan.functions.regions import _c


def molecule_of_read(read_id: str | Column, platform: str | Column) -> Column:
    """The molecule that a simulated read comes from; null if the identifier has another form.

    Short reads are 'molecule-index/1', long reads 'molecule.sequence_number' and accurate long reads 'molecule_hifi_number'.
    """
    r, p = F.regexp_replace(_c(read_id), "^@", ""), _c(platform)
    pick = lambda pattern: F.nullif(F.regexp_extract(r, pattern, 1), F.lit(""))
    return F.when(p == "NGS", pick(r"^(.+)-\d+(?:/[12])?$")).when(p == "ONT", pick(r"^(.+)\.\w+_\d+$")).when(p == "HiFi", pick(r"^(.+)_hifi_\d+$"))


def molecule_seed(seed: int, molecule: str | Column, platform: str | Column) -> Column:
    """First four bytes of an MD5, little-endian, below 2**31: the same seed wherever a molecule is simulated."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), _c(molecule), _c(platform)).cast("binary"))
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint") % F.lit(1 << 31)


def repeat_count(length: str | Column, unit: str | Column) -> Column:
    return F.when(_c(unit) > 0, F.floor(_c(length) / _c(unit)).cast("int"))


def template_coverage(real: str | Column, unit: str | Column, length: str | Column) -> Column:
    return F.when(_c(length) > 0, _c(real) * _c(unit) / _c(length))


def paf_identity(divergence: str | Column, matches: str | Column, aligned: str | Column) -> Column:
    """One minus the divergence tag if there is one, else matches over the alignment's length."""
    return F.coalesce(1 - _c(divergence), F.when(_c(aligned) > 0, _c(matches) / _c(aligned)).otherwise(0.0))


def paf_coverage(target_span: str | Column, original: str | Column) -> Column:
    """Percent of the original sequence, 100 at most."""
    return F.when(_c(original) > 0, F.least(F.lit(100.0), 100.0 * _c(target_span) / _c(original))).otherwise(0.0)


def tag_value(tags: str | Column, name: str) -> Column:
    """Value of a typed tag such as 'de:f:' in an array of tags."""
    hit = F.filter(_c(tags), lambda t: t.startswith(name))
    return F.when(F.size(hit) > 0, F.substring(hit[0], len(name) + 1, 1 << 20))
