"""Overlaps of regions with features summed by category, without a row for each pair.

The bases that a region shares with the features of a category are C(end) - C(start), where C(x) adds up what lies before x of
each feature: the sum of x - p over their starts p before x, less that over their ends. So a region costs two searches however
many features it meets. The genome is cut into cells; a cell's features go to one task as starts and ends with counts, and its
regions pass by them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbispan.scratch import checkpointed

CELL = 1 << 16
#: Regions up to this length are handled whole in the cell of their start, where all features that they can meet are listed.
SHORT = CELL // 4
#: Starts and ends of a cell that are kept before equal ones are put together; figures of a block of regions and categories.
KEPT, BLOCK = 2_000_000, 4_000_000
#: Names sent to all tasks.
BROADCAST_ROWS = 1_000_000


class Sums(NamedTuple):
    """single: regions whose name no other has, whole, with bp, hits and <category>_bp. rest: the other regions, without them.
    pieces: what each cell of the rest adds to bp, hits and <category>_bp of its name. rest and pieces are None if there are none."""

    single: DataFrame
    rest: DataFrame | None
    pieces: DataFrame | None


class _Cell:
    """Features of one cell as positions with counts, from one base before the cell on."""

    def __init__(self, idx: int, by: Sequence[str]):
        self.low, self.high, self.by = idx * CELL - 1, (idx + 1) * CELL + SHORT, by
        self.values: list[dict] = [{} for _ in by]
        self.parts: list[tuple] = []  # position - low, +1 or -1 (times the features there), codes of each category
        self.kept, self.ready = 0, None

    def add(self, b: pa.RecordBatch) -> None:
        codes = []
        for seen, c in zip(self.values, self.by):
            d = b.column(c).dictionary_encode(null_encoding="encode")
            to = np.array([seen.setdefault(v, len(seen)) for v in d.dictionary.to_pylist()], dtype=np.int64)
            codes.append(to[d.indices.to_numpy()])
        at = [np.clip(b.column(c).to_numpy(), self.low, self.high) - self.low for c in ("start", "end")]
        one = np.ones(len(b), dtype=np.int64)
        self.parts.append((np.concatenate(at), np.concatenate([one, -one]), *[np.concatenate([c, c]) for c in codes]))
        self.kept, self.ready = self.kept + 2 * len(b), None
        if self.kept > KEPT:
            self._fold()

    def _fold(self) -> None:
        """Equal places, kinds and categories put together, so that a cell holds no more of them than it has bases for each."""
        if len(self.parts) < 2:
            self.kept = 0
            return
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort((cols[0], cols[1] > 0, *cols[2:]))
        cols = [c[order] for c in cols]
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in (cols[0], cols[1] > 0, *cols[2:])])
        firsts = np.flatnonzero(new)
        self.parts = [(cols[0][firsts], np.add.reduceat(cols[1], firsts), *[c[firsts] for c in cols[2:]])]
        self.kept = 0

    def _made(self):
        if self.ready is None:
            cols = [np.concatenate(c) for c in zip(*self.parts)]
            places, where = np.unique(cols[0], return_inverse=True)
            opened = cols[1] > 0
            counts = []
            for side in (opened, ~opened):  # starts and ends before each place
                n = np.zeros(len(places) + 1, dtype=np.int64)
                np.add.at(n, where[side] + 1, np.abs(cols[1][side]))
                counts.append(np.cumsum(n))
            self.ready = places, where, cols, counts
        return self.ready

    def sums(self, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        """hits of each region and, for each category, the region's row, code and bases of those it shares any with. first: the
        piece has the region's start, so features that begin before it count."""
        none = np.empty(0, dtype=np.int64)
        if not self.parts or not len(start):
            return np.zeros(len(start), dtype=np.int64), [(none, none, none) for _ in self.by]
        places, where, cols, (opened, closed) = self._made()
        s, e = start - self.low, end - self.low
        i, j = np.searchsorted(places, s), np.searchsorted(places, e)
        before = np.where(first, closed[np.searchsorted(places, s, side="right")], opened[np.searchsorted(places, 1)])
        hits = opened[j] - before
        out = []
        for k, seen in enumerate(self.values):
            code, found = cols[2 + k], []
            width = max(1, BLOCK // max(len(places) + 1, len(start)))
            for lo in range(0, len(seen), width):
                n = min(width, len(seen) - lo)
                here = slice(None) if n == len(seen) else (code >= lo) & (code < lo + n)
                spot, size = (where[here] + 1) * n + code[here] - lo, (len(places) + 1) * n
                # whole numbers far below 2**53, so sums of doubles are exact
                number, total = (np.cumsum(np.bincount(spot, weights=w, minlength=size).astype(np.int64).reshape(-1, n), axis=0) for w in (cols[1][here], cols[1][here] * cols[0][here]))
                bp = (number[j] * e[:, None] - total[j]) - (number[i] * s[:, None] - total[i])
                row, c = np.nonzero(bp)
                found.append((row, c + lo, bp[row, c]))
            if len(found) > 1:
                row, c, bp = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(row, kind="stable")
                found = [(row[order], c[order], bp[order])]
            out.append(found[0] if found else (none, none, none))
        return hits, out


def _passed(features: DataFrame, regions: DataFrame, by: Sequence[str], pieces: bool) -> DataFrame:
    """regions' columns, bp, hits and <category>_bp (value, bp of the categories with any base) of each region, or of each cell of
    each region. Empty regions and those without a place have none."""
    at = lambda p: F.floor(p / F.lit(CELL)).cast("bigint")
    start, end = F.col("start").cast("bigint"), F.col("end").cast("bigint")
    own = F.coalesce(at(start), F.lit(0))
    cells = F.sequence(own, F.greatest(own, F.coalesce(at(end - 1), F.lit(0)))) if pieces else F.array(own)
    far = F.explode(F.sequence(at(start - (0 if pieces else SHORT)), at(end - 1)))
    kinds = dict(features.select(*by).dtypes)
    tagged = lambda df, side: df.withColumn("_g", F.xxhash64("chrom", "_idx").bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side)))
    kept = [c for c in regions.columns if c not in ("chrom", "start", "end")]
    marks = tagged(features.where("end > start and chrom is not null").select("chrom", start.alias("start"), end.alias("end"), *[F.col(c).alias(f"_by_{c}") for c in by], far.alias("_idx")), 0)
    rows = tagged(regions.select("chrom", start.alias("start"), end.alias("end"), *kept, F.explode(cells).alias("_idx")), 1)
    both = marks.select("_g", "_idx", "chrom", "start", "end", *[f"_by_{c}" for c in by], *[F.lit(None).cast(regions.schema[c].dataType).alias(c) for c in kept])
    both = both.unionByName(rows.select("_g", "_idx", "chrom", "start", "end", *[F.lit(None).cast(kinds[c]).alias(f"_by_{c}") for c in by], *kept))
    names = [f"_by_{c}" for c in by]
    lists = [T.StructField(f"{c}_bp", T.ArrayType(T.StructType([T.StructField("value", features.schema[c].dataType), T.StructField("bp", T.LongType())]))) for c in by]
    schema = T.StructType([both.schema[c] for c in ("chrom", "start", "end", *kept)] + [T.StructField("bp", T.LongType()), T.StructField("hits", T.LongType()), *lists])

    def summed(b: pa.RecordBatch, cell: _Cell, idx: int) -> pa.RecordBatch:
        s, e = (pc.fill_null(b.column(c), 0).to_numpy() for c in ("start", "end"))
        real = (e > s) & pc.is_valid(b.column("start")).to_numpy(False) & pc.is_valid(b.column("end")).to_numpy(False)
        first = s >= idx * CELL
        if pieces:
            s, e = np.maximum(s, idx * CELL), np.minimum(e, (idx + 1) * CELL)
        s, e = np.where(real, s, 0 if idx >= 0 else cell.low + 1), np.where(real, e, 0 if idx >= 0 else cell.low + 1)
        hits, found = cell.sums(s, e, first)
        columns, bp = [], None
        for (row, code, shared), seen in zip(found, cell.values):
            counts = np.bincount(row, minlength=len(b))
            if bp is None:
                upto = np.concatenate([[0], np.cumsum(shared)])
                bp = upto[np.cumsum(counts)] - upto[np.cumsum(counts) - counts]
            field = lists[len(columns)].dataType.elementType.fields[0]
            known = pa.array(list(seen), type=pa_types[field.name, len(columns)])
            items = pa.StructArray.from_arrays([known.take(pa.array(code)), pa.array(shared)], names=["value", "bp"])
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items))
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in ("chrom", "start", "end", *kept)], pa.array(bp), pa.array(np.where(real, hits, 0)), *columns], names=schema.names)

    pa_types: dict = {}

    def run(batches: Iterator[pa.RecordBatch]):
        group, cells = None, {}
        for b in batches:
            for k, c in enumerate(names):
                pa_types["value", k] = b.schema.field(c).type
            g = b.column("_g").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if group != g[lo] >> 1:
                    group, cells = g[lo] >> 1, {}
                for key, part in _by_cell(b.slice(lo, hi - lo)):
                    cell = cells.setdefault(key, _Cell(key[1], names))
                    if g[lo] & 1:
                        yield summed(part, cell, key[1])
                    else:
                        cell.add(part)

    # features come before regions: their last bit is 0
    return both.repartition(F.shiftright("_g", 1)).sortWithinPartitions("_g").mapInArrow(run, schema)


def _by_cell(b: pa.RecordBatch):
    """(chromosome, index) and rows of each cell among rows whose cells have the same hash, so of one cell nearly always."""
    chroms, idx = b.column("chrom").dictionary_encode(null_encoding="encode"), b.column("_idx").to_numpy()
    if len(chroms.dictionary) == 1 and (idx == idx[0]).all():
        yield (chroms.dictionary[0].as_py(), int(idx[0])), b
        return
    codes = chroms.indices.to_numpy()
    for code, i in sorted({*zip(codes.tolist(), idx.tolist())}):
        yield (chroms.dictionary[code].as_py(), int(i)), b.filter(pa.array((codes == code) & (idx == i)))


def overlap_sums(regions: DataFrame, features: DataFrame, by: Sequence[str], key: str = "name") -> Sums:
    """Sums of the overlaps of regions (chrom, start, end, key and others) with features (chrom, start, end, by), for each value of
    each column of `by`. Names that occur twice, long regions and those without a name are the rest."""
    h = F.xxhash64(key)
    odd = F.bool_or(F.col(key).isNull() | F.coalesce(F.col("end") - F.col("start") > SHORT, F.lit(False)))
    rest = checkpointed(regions.groupBy(h.alias("_h")).agg((F.count(F.lit(1)) > 1).alias("_twice"), odd.alias("_odd")).where("_twice or _odd").select("_h"))
    n = rest.count()
    if not n:
        return Sums(_passed(features, regions, by, False), None, None)
    marked = F.broadcast(rest) if n <= BROADCAST_ROWS else rest
    part = lambda how: regions.join(marked, h == F.col("_h"), how)
    return Sums(_passed(features, part("left_anti"), by, False), part("left_semi"), _passed(features, part("left_semi"), by, True))


def _of_names(pieces: DataFrame, by: Sequence[str], key: str, others: Sequence[str]) -> DataFrame:
    """key, others (of any of its rows), bp, hits and <category>_bp of each name."""
    kinds = [F.array(F.struct(F.lit(-1).alias("kind"), F.lit(None).cast("string").alias("value"), "bp", "hits"))]
    tagged = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["value"].cast("string").alias("value"), x["bp"].alias("bp"), F.lit(0).cast("bigint").alias("hits"))
    kinds += [F.transform(f"{c}_bp", tagged(k)) for k, c in enumerate(by)]
    flat = pieces.select(key, *others, F.inline(F.concat(*kinds)))
    each = flat.groupBy(key, "kind", "value").agg(F.sum("bp").alias("bp"), F.sum("hits").alias("hits"), *[F.first(c).alias(c) for c in others])
    kind_of = lambda c: pieces.schema[f"{c}_bp"].dataType.elementType["value"].dataType
    mine = lambda k, c: F.when(F.col("kind") == k, F.struct(F.col("value").cast(kind_of(c)).alias("value"), F.col("bp")))
    total = [F.sum(F.when(F.col("kind") == -1, F.col(c))).alias(c) for c in ("bp", "hits")]
    return each.groupBy(key).agg(*[F.first(c).alias(c) for c in others], *total, *[F.collect_list(mine(k, c)).alias(f"{c}_bp") for k, c in enumerate(by)])


def _figures(by: Sequence[str]) -> list[str]:
    return ["bp", "hits", *[f"{c}_bp" for c in by]]


def by_name(sums: Sums, by: Sequence[str], key: str = "name", others: Sequence[str] = ()) -> DataFrame:
    """key, others, bp, hits and <category>_bp: one row for each name, others from any of its rows."""
    single = sums.single.select(key, *others, *_figures(by))
    return single if sums.pieces is None else single.unionByName(_of_names(sums.pieces, by, key, others))


def by_region(sums: Sums, by: Sequence[str], key: str = "name", single: bool = True) -> DataFrame:
    """The regions, or those of the rest, with bp, hits and <category>_bp of their names; none for regions without a name."""
    if sums.rest is None:
        return sums.single
    found = sums.rest.join(_of_names(sums.pieces, by, key, ()), key, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(sums.single.schema[c].dataType))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    found = found.select(*sums.rest.columns, zero("bp"), zero("hits"), *[empty(f"{c}_bp").alias(f"{c}_bp") for c in by])
    return sums.single.unionByName(found) if single else found
