"""Interval joins, merging, tiling and coverage on (chrom, start, end), 0-based and half-open.

Spark plans a join on chrom with a range test as all pairs of a chromosome. Here each interval is listed in the bins that
it touches, the bins join by equality, and a pair is kept in the one bin where the later of its starts lies. Intervals
longer than a few bins use coarser levels (each eight times wider), so no interval is listed in more than about nine bins a
level, however long it is; only levels that occur on the other side are listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbispan.functions.regions import reciprocal

BIN = 4096
STEP = 8
LEVELS = 7


def _level(bin_size: int) -> Column:
    """Lowest level at which an interval spans eight bins at most."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(F.col("end") - F.col("start") <= bin_size * STEP**k * STEP, k).otherwise(out)
    return out


def _spots(k: int, bin_size: int) -> Column:
    """The bins of level k that an interval touches, each as bin * LEVELS + k. A plain sequence stays in generated code."""
    at = lambda p: (F.floor(p / F.lit(bin_size * STEP**k)) * LEVELS + k).cast("bigint")
    return F.sequence(at(F.col("start")), at(F.col("end") - 1), F.lit(LEVELS).cast("bigint"))


def _levels_of(a: DataFrame, b: DataFrame, bin_size: int) -> tuple[list[int], list[int]]:
    """Levels that occur in a and in b, by one aggregate over their starts and ends."""
    held = lambda df, side: df.where("end > start").agg(F.lit(side).alias("side"), F.bit_or(F.pow(F.lit(2), _level(bin_size)).cast("bigint")).alias("held"))
    found = dict(held(a, 0).unionByName(held(b, 1)).collect())  # one row a side
    return tuple([k for k in range(LEVELS) if (found[side] or 1) >> k & 1] for side in (0, 1))


def _in_bins(df: DataFrame, tag: str, other_levels: Sequence[int], own_levels: Sequence[int], bin_size: int) -> DataFrame:
    """df's columns prefixed by tag, with its own level and each spot (a bin of a level) to meet the other side in."""
    own = F.lit(own_levels[0]) if len(own_levels) == 1 else _level(bin_size)
    spots, many = [], len(own_levels) > 1
    for k in sorted(set(own_levels) | set(other_levels)):
        # a pair meets at the coarser of its two levels: the own level, and coarser ones that the other side has
        meets = k in other_levels
        if not many and k != own_levels[0] and not (meets and k > own_levels[0]):
            continue
        here = _spots(k, bin_size)
        if many:
            here = F.when(own <= k if meets else own == k, here).otherwise(F.array().cast("array<bigint>"))
        spots.append(here)
    listed = df.where("end > start").withColumn(f"_spot_{tag}", F.explode(F.concat(*spots) if len(spots) > 1 else spots[0]))
    return listed.select(F.xxhash64("chrom", f"_spot_{tag}").alias(f"_cell_{tag}"), f"_spot_{tag}", own.alias(f"_own_{tag}"), *[F.col(c).alias(f"{tag}{c}") for c in df.columns])


def overlap_join(a: DataFrame, b: DataFrame, tags: tuple[str, str] = ("a_", "b_"), how: str = "inner", where: Column | None = None, bin_size: int = BIN) -> DataFrame:
    """Pairs of intervals that share at least one base, with overlap_bp; columns carry the sides' tags.

    how: 'inner', 'left_semi' or 'left_anti' (the latter two give a's own columns). where: a further condition on the
    tagged columns. Empty intervals never match. Touching intervals do not overlap.
    """
    if how != "inner":
        return _semi(a, b, how, tags, where, bin_size)
    left, right = tags
    la, lb = _levels_of(a, b, bin_size)
    x, y = _in_bins(a, left, lb, la, bin_size), _in_bins(b, right, la, lb, bin_size)
    s1, e1, s2, e2 = (F.col(f"{t}{c}") for t in tags for c in ("start", "end"))
    later = F.greatest(s1, s2)
    spot = F.col(f"_spot_{left}")
    level, at = F.pmod(spot, F.lit(LEVELS)), F.floor(spot / LEVELS)
    width = F.lit(bin_size) if max(la + lb) == 0 else F.lit(bin_size) * F.pow(F.lit(STEP), level).cast("bigint")
    on = (later < F.least(e1, e2)) & (F.floor(later / width) == at)
    if len(set(la + lb)) > 1:
        on &= level == F.greatest(f"_own_{left}", f"_own_{right}")
    # the hash of chromosome and spot comes first, so that a sort compares one long; the others tell apart cells that share it
    same = [F.col(f"{c}{left}") == F.col(f"{c}{right}") for c in ("_cell_", "_spot_")]
    joined = x.join(y, same[0] & same[1] & (F.col(f"{left}chrom") == F.col(f"{right}chrom"))).where(on if where is None else on & where)
    return joined.withColumn("overlap_bp", F.least(e1, e2) - later).drop(*[f"_{c}_{t}" for t in tags for c in ("cell", "spot", "own")])


def _semi(a: DataFrame, b: DataFrame, how: str, tags, where, bin_size: int) -> DataFrame:
    """Rows of a with (or without) a partner. Rows are told apart by all their columns, so equal rows share their fate."""
    hit = overlap_join(a, b, tags, "inner", where, bin_size).select(*[F.col(f"{tags[0]}{c}").alias(c) for c in a.columns]).distinct()
    on = [a[c].eqNullSafe(hit[c]) for c in a.columns]
    cond = on[0]
    for o in on[1:]:
        cond &= o
    return a.join(hit, cond, how)


def overlapping_names(a: DataFrame, b: DataFrame, name: str = "name", where: Column | None = None, bin_size: int = BIN) -> DataFrame:
    """Distinct names of a's intervals with a partner in b: one column, `name`."""
    return overlap_join(a, b, ("a_", "b_"), "inner", where, bin_size).select(F.col(f"a_{name}").alias(name)).distinct()


def reciprocal_join(a: DataFrame, b: DataFrame, fraction: float, tags: tuple[str, str] = ("a_", "b_"), where: Column | None = None) -> DataFrame:
    """Pairs whose overlap is at least `fraction` of both intervals. Lengths bound each other, which prunes early."""
    s1, e1, s2, e2 = (F.col(f"{t}{c}") for t in tags for c in ("start", "end"))
    test = reciprocal(s1, e1, s2, e2, fraction)
    return overlap_join(a, b, tags, "inner", test if where is None else test & where)


def nearest(points: DataFrame, targets: DataFrame, pos: str = "pos", target: str = "pos") -> DataFrame:
    """points' columns and distance to the nearest target on the chromosome; null positions and chromosomes without targets are dropped.

    A point's neighbours are the last target at or before it and the first after it, found by a running window in each
    direction over both kinds of rows. Windows run within stretches of a chromosome, and each stretch starts from the last
    target before and ends with the first after it, so a large chromosome is many tasks. Both frames only grow: a frame that
    ends with the partition would be summed anew for each row.
    """
    stretch = 1 << 20
    cell = F.floor(F.col("_p") / stretch)
    t = targets.select("chrom", F.col(target).cast("bigint").alias("_t")).where("_t is not null").distinct()
    rows = points.where(F.col(pos).isNotNull()).withColumns({"_p": F.col(pos).cast("bigint"), "_q": F.lit(True), "_t": F.lit(None).cast("bigint")})
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name != "chrom"]
    marks = t.select("chrom", *blank, F.col("_t").alias("_p"), F.lit(False).alias("_q"), "_t")
    both = rows.unionByName(marks).withColumn("_cell", cell)
    edges = marks.withColumn("_cell", cell).groupBy("chrom", "_cell").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    cells = both.select("chrom", "_cell").distinct().join(edges, ["chrom", "_cell"], "left")
    ahead = (Window.unboundedPreceding, -1)
    up, down = (Window.partitionBy("chrom").orderBy(o).rowsBetween(*ahead) for o in (F.asc("_cell"), F.desc("_cell")))
    cells = cells.select("chrom", "_cell", F.max("_hi").over(up).alias("_left"), F.min("_lo").over(down).alias("_right"))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up, down = (Window.partitionBy("chrom", "_cell").orderBy(*o).rowsBetween(*so_far) for o in ((F.asc("_p"), F.asc("_q")), (F.desc("_p"), F.asc("_q"))))
    near = both.withColumn("_before", F.max("_t").over(up)).withColumn("_after", F.min("_t").over(down))
    near = near.where("_q").join(cells, ["chrom", "_cell"])
    gap = F.least(F.col("_p") - F.coalesce("_before", "_left"), F.coalesce("_after", "_right") - F.col("_p"))
    return near.withColumn("distance", gap).where("distance is not null").select(*points.columns, "distance")


def nearest_targets(points: DataFrame, targets: DataFrame, pos: str = "pos", target: str = "pos", tag: str = "target_") -> DataFrame:
    """points' columns, distance, and the columns of each nearest target with a tag: one row for every target at that distance,
    on either side. A target at that distance can only stand at one of two places, so an equality join finds them all."""
    near = nearest(points, targets, pos, target)
    at = F.col(pos).cast("bigint")
    spots = near.withColumn("_at", F.explode(F.array_distinct(F.array(at - F.col("distance"), at + F.col("distance")))))
    named = targets.where(F.col(target).isNotNull()).select(F.col("chrom").alias("_on"), F.col(target).cast("bigint").alias("_at"), *[F.col(c).alias(f"{tag}{c}") for c in targets.columns if c != "chrom"])
    return spots.join(named, (spots["chrom"] == named["_on"]) & (spots["_at"] == named["_at"])).drop("_at", "_on")


def _with_earlier(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Adds name: the largest value of column in the earlier stretches (_cell) of the key; only stretches go through a window."""
    w = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*keys, "_cell").agg(F.max(column).alias("_top"))
    cells = cells.select(*[F.col(c).alias(f"_key_{c}") for c in (*keys, "_cell")], F.max("_top").over(w).alias(name))
    on = F.lit(True)
    for c in (*keys, "_cell"):
        on &= F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return df.join(cells, on).drop(*[f"_key_{c}" for c in (*keys, "_cell")])


def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end and _before, the end of the island before (null for a key's first).

    Windows run within stretches of a key, so that a chromosome is many tasks. A stretch is told the furthest end before it,
    and the island that is open where it begins.
    """
    cell = F.floor(F.col("start") / (1 << 22))
    rows = df.select(*keys, "start", "end").where("start is not null and end is not null").withColumn("_cell", cell)
    w = Window.partitionBy(*keys, "_cell").orderBy("start", "end")
    reach = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    marked = _with_earlier(rows, keys, "end", "_far").withColumn("_before", reach)
    marked = marked.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), F.col("start")))
    marked = marked.withColumn("_first", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = [F.min("start").alias("start"), F.max("end").alias("end")]
    pieces = marked.groupBy(*keys, "_cell", "_first").agg(*ends, F.max(F.when(F.col("_new").isNotNull(), F.col("_before"))).alias("_before"))
    whole = _with_earlier(pieces, keys, "_first", "_open").withColumn("_island", F.coalesce("_first", "_open"))
    return whole.groupBy(*keys, "_island").agg(*ends, F.max("_before").alias("_before")).drop("_island")


def merged(df: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Gaps and islands: keys, start, end of the unions of overlapping or touching intervals; null ends do not count."""
    return _islands(df, keys).drop("_before")


def with_islands(pairs: DataFrame, chrom: str, low: Column, high: Column, out: str = "island") -> DataFrame:
    """pairs with the island of their spans (low to high, both included) as a number; pairs whose spans meet, directly or over
    others, have the same one. Pairs with a common member meet at its start if low and high are starts."""
    spots = pairs.withColumns({"_low": low, "_high": high})
    spans = merged(spots.select(F.col(chrom).alias("chrom"), F.col("_low").alias("start"), F.col("_high").alias("end"))).withColumn("end", F.col("end") + 1)
    points = spots.withColumns({"chrom": F.col(chrom), "start": F.col("_low"), "end": F.col("_low") + 1})
    found = overlap_join(points, spans, ("p_", "s_"))
    return found.select(*[F.col(f"p_{c}").alias(c) for c in pairs.columns], F.xxhash64("s_chrom", "s_start").alias(out))


def complement(excluded: DataFrame, genome: DataFrame) -> DataFrame:
    """chrom, start, end of what the intervals leave of each chromosome; one that they fill is given whole."""
    clipped = excluded.join(F.broadcast(genome), "chrom").select("chrom", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "size").alias("end")).where("end > start")
    m = _islands(clipped, ["chrom"])
    gaps = m.select("chrom", F.coalesce("_before", F.lit(0)).alias("start"), F.col("start").alias("end"))
    tails = m.groupBy("chrom").agg(F.max("end").alias("start")).join(F.broadcast(genome), "chrom").select("chrom", "start", F.col("size").alias("end"))
    free = gaps.unionByName(tails).where("end > start")
    whole = genome.join(free.select("chrom").distinct(), "chrom", "left_anti").select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    return free.unionByName(whole)


def tiles(genome: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """chrom, idx, start, end, keys of windows of `size` for each row of genome; the last one is clipped."""
    idx = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / size)))
    return genome.where("size > 0").select("chrom", "size", *keys, idx.alias("idx")).select("chrom", "idx", (F.col("idx") * size).alias("start"), F.least((F.col("idx") + 1) * size, F.col("size")).alias("end"), *keys)


def window_counts(points: DataFrame, genome: DataFrame, size: int, pos: str = "pos", keys: Sequence[str] = ()) -> DataFrame:
    """Zero-filled counts of positions for each tile (and each value of keys): chrom, idx, start, end, keys, count."""
    counted = points.groupBy("chrom", F.floor(F.col(pos) / size).alias("idx"), *keys).agg(F.count(F.lit(1)).alias("count"))
    each = points.select(*keys).distinct().crossJoin(F.broadcast(genome.select("chrom", "size"))) if keys else genome  # a row a chromosome
    grid = tiles(each, size, keys)
    return grid.join(counted, ["chrom", "idx", *keys], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def per_tile(df: DataFrame, size: int) -> DataFrame:
    """df's rows listed at each tile that they touch, with idx and the bases shared with it as ov."""
    idx = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)))
    out = df.where("end > start").withColumn("idx", idx)
    return out.withColumn("ov", F.least("end", (F.col("idx") + 1) * size) - F.greatest("start", F.col("idx") * size))


def tile_coverage(features: DataFrame, genome: DataFrame, size: int, union: bool = False) -> DataFrame:
    """Covered share of each tile; overlapping features add up, so it may exceed 1, unless union is set."""
    src = merged(features) if union else features.select("chrom", "start", "end")
    cov = per_tile(src, size).groupBy("chrom", "idx").agg(F.sum("ov").alias("bp"))
    grid = tiles(genome, size)
    return grid.join(cov, ["chrom", "idx"], "left").withColumn("coverage", F.coalesce("bp", F.lit(0)) / (F.col("end") - F.col("start"))).drop("bp")


def tile_weighted_mean(df: DataFrame, genome: DataFrame, size: int, value: str, default: float = 1.0) -> DataFrame:
    """Mean of value over each tile, weighted by shared bases; `default` where nothing lies."""
    agg = per_tile(df, size).groupBy("chrom", "idx").agg((F.sum(F.col(value) * F.col("ov")) / F.sum("ov")).alias("mean"))
    return tiles(genome, size).join(agg, ["chrom", "idx"], "left").withColumn("mean", F.coalesce("mean", F.lit(default)))
