"""Windowed hotspots: thresholds, permutation tests, refinement and replicate classes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbispan.functions.regions import midpoint, window_label
from orbispan.operators.intervals import complement, merged, per_tile, window_counts
from orbispan.operators.stats import benjamini_hochberg, multinomial_draws


def with_midpoints(ecc: DataFrame) -> DataFrame:
    return ecc.withColumn("pos", midpoint())


def multiscale_counts(ecc: DataFrame, genome: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Zero-filled counts of midpoints in tiles of each size, one scan: each row is listed at every resolution."""
    spark, mids = ecc.sparkSession, with_midpoints(ecc).select("chrom", "pos")
    labels = spark.createDataFrame([(s, window_label(s)) for s in sizes], "size bigint, window_size string")
    scale = F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes]))
    counted = mids.withColumn("size", scale).groupBy("size", "chrom", F.floor(F.col("pos") / F.col("size")).alias("idx")).agg(F.count(F.lit(1)).alias("count"))
    g = genome.withColumnRenamed("size", "chrom_size").crossJoin(F.broadcast(labels))
    g = g.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("chrom_size") - 1) / F.col("size")))))
    out = g.join(counted, ["size", "chrom", "idx"], "left")
    return out.select("window_size", "chrom", (F.col("idx") * F.col("size")).alias("start"), F.least((F.col("idx") + 1) * F.col("size"), F.col("chrom_size")).alias("end"), F.coalesce("count", F.lit(0)).alias("count"))


def fold_hotspots(counts: DataFrame, fold: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Adds median (of the counts above zero), fold and is_hotspot: count >= fold * median. A group of N points has at most about
    the square root of 2 N different counts, so the median's buffer is small."""
    med = counts.where("count > 0").groupBy(*keys).agg(F.percentile("count", F.lit(0.5)).alias("median"))
    out = counts.join(med, list(keys), "left") if keys else counts.crossJoin(F.broadcast(med))
    return out.withColumns({"fold": F.when(F.col("median") > 0, F.col("count") / F.col("median")).otherwise(0.0), "is_hotspot": F.coalesce((F.col("count") > 0) & (F.col("count") >= F.col("median") * fold), F.lit(False))})


def refine(hotspots: DataFrame, ecc: DataFrame, fine: int, density: float = 0.2) -> DataFrame:
    """hotspots (chrom, start, end) with refined_start, refined_end and refined.

    A hotspot is cut into fine windows; those below `density` of its peak count are trimmed from both ends. Without
    midpoints it stays. Hotspots are few tiles wide, so they meet midpoints through the overlap join.
    """
    from orbispan.operators.intervals import overlap_join

    mids = with_midpoints(ecc).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    hit = overlap_join(hotspots.select("chrom", "start", "end").distinct(), mids, ("h_", "m_"))
    n_sub = F.greatest(F.lit(1), F.ceil((F.col("h_end") - F.col("h_start")) / fine))
    sub = hit.select("h_chrom", "h_start", "h_end", F.least(F.floor((F.col("m_start") - F.col("h_start")) / fine), n_sub - 1).alias("sub"))
    counts = sub.groupBy("h_chrom", "h_start", "h_end", "sub").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("peak", F.max("n").over(Window.partitionBy("h_chrom", "h_start", "h_end")))
    kept = counts.where(F.col("n") >= F.col("peak") * density).groupBy("h_chrom", "h_start", "h_end").agg(F.min("sub").alias("lo"), F.max("sub").alias("hi"))
    kept = kept.select(F.col("h_chrom").alias("chrom"), F.col("h_start").alias("start"), F.col("h_end").alias("end"), (F.col("h_start") + F.col("lo") * fine).alias("refined_start"), F.least(F.col("h_start") + (F.col("hi") + 1) * fine, F.col("h_end")).alias("refined_end"))
    out = hotspots.join(kept, ["chrom", "start", "end"], "left")
    out = out.withColumns({"refined_start": F.coalesce("refined_start", "start"), "refined_end": F.coalesce("refined_end", "end")})
    return out.withColumn("refined", (F.col("refined_start") != F.col("start")) | (F.col("refined_end") != F.col("end")))


def replicate_classes(windows: DataFrame, totals: DataFrame) -> DataFrame:
    """Classes of hotspot windows by group.

    windows: grp, rep, chrom, start, end of each replicate's hotspots; totals: grp, n_replicates_total. core windows are in
    all replicates, recurrent ones in two or more, others sporadic. A window is shared if it is core in another group.
    """
    per = windows.select("grp", "rep", "chrom", "start", "end").distinct().groupBy("grp", "chrom", "start", "end").agg(F.count(F.lit(1)).alias("n_replicates_hit"))
    per = per.join(totals, "grp")
    kind = F.when(F.col("n_replicates_hit") == F.col("n_replicates_total"), "core").when(F.col("n_replicates_hit") >= 2, "recurrent").otherwise("sporadic")
    per = per.withColumn("replicate_category", kind)
    core = per.where("replicate_category = 'core'").groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_set("grp")).alias("cores"))
    out = per.join(core, ["chrom", "start", "end"], "left")
    others = F.coalesce(F.array_join(F.array_remove("cores", F.col("grp")), ";"), F.lit(""))
    return out.select("grp", "chrom", "start", "end", "replicate_category", "n_replicates_hit", "n_replicates_total", F.when(others == "", "group_specific").otherwise("shared").alias("specificity"), others.alias("shared_with"))


def replicate_counts(classes: DataFrame, counts: DataFrame, reps: Sequence[str]) -> DataFrame:
    """Adds each replicate's observed count. counts: rep, chrom, start, count; reps: the replicates' names."""
    wide = counts.groupBy("chrom", "start").pivot("rep", list(reps)).agg(F.first("count")).na.fill(0)
    return classes.join(wide.withColumnsRenamed({r: f"{r}_count" for r in reps}), ["chrom", "start"], "left")


def hotspot_summary(classes: DataFrame) -> DataFrame:
    c = lambda k: F.count_if(F.col("replicate_category") == k).alias(k)
    return classes.groupBy("grp").agg(F.count(F.lit(1)).alias("total_hotspots"), c("core"), c("recurrent"), c("sporadic"))


def permutation_test(ecc: DataFrame, genome: DataFrame, size: int, n_perm: int = 1000, seed: int = 42, excluded: DataFrame | None = None, fdr: float = 0.05, fold: float = 3.0, block: int = 250) -> DataFrame:
    """Windows with exceedance p-values, q-values and hotspot flags.

    Each permutation redraws a chromosome's midpoints uniformly over what the exclusions leave of it and counts, for every
    window, whether it reached the observed count. Counts of independent uniform points in disjoint windows are one
    multinomial draw with the windows' free bases as weights, so no point is placed and the work does not grow with
    them. The job runs over (chromosome, block of permutations), one row for each window, summed by a partial aggregate.
    Draws are digests of (seed, chromosome, permutation, stretch of windows), taken through the inverse of the binomial
    distribution, so results do not depend on partitions, blocks or retries and SQL can restate them. Windows without
    midpoints have p = 1.
    """
    counts = window_counts(with_midpoints(ecc), genome, size)
    if excluded is None:
        grid = counts.withColumn("free", F.col("end") - F.col("start"))
    else:
        free = per_tile(merged(complement(excluded, genome)), size).groupBy("chrom", "idx").agg(F.sum("ov").alias("free"))
        grid = counts.join(free, ["chrom", "idx"], "left").withColumn("free", F.coalesce("free", F.lit(0)))
    windows = grid.groupBy("chrom").agg(F.sum("count").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "count", "free"))).alias("w"))
    blocks = ecc.sparkSession.range(-(-n_perm // block)).select(F.col("id").alias("block"))
    # few rows of much work: a stated number of partitions, as small ones dealt by key would be joined into one task
    parts = int(ecc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    jobs = windows.where("n > 0").crossJoin(F.broadcast(blocks)).repartition(parts)

    def draw(batches):
        for b in batches:
            for r in b.to_pylist():
                idx, obs, bases = (np.array([x[c] for x in r["w"]], dtype=np.int64) for c in ("idx", "count", "free"))
                if not bases.sum():
                    continue
                labels = [f"{seed}:{r['chrom']}:{k}" for k in range(r["block"] * block, min(n_perm, (r["block"] + 1) * block))]
                over = (multinomial_draws(int(obs.sum()), bases, labels) >= obs).sum(axis=0)
                hit = np.flatnonzero(obs > 0)
                yield pa.RecordBatch.from_pydict({"chrom": pa.array([r["chrom"]] * len(hit)), "idx": pa.array(idx[hit]), "over": pa.array(over[hit])})

    over = jobs.mapInArrow(draw, "chrom string, idx bigint, over bigint").groupBy("chrom", "idx").agg(F.sum("over").alias("over"))
    out = counts.withColumn("count", F.col("count").cast("int")).join(over, ["chrom", "idx"], "left").withColumn("p_value", (F.coalesce("over", F.lit(n_perm)) + 1) / F.lit(n_perm + 1)).drop("over")
    flagged = fold_hotspots(benjamini_hochberg(out), fold)
    return flagged.withColumn("is_hotspot", F.col("is_hotspot") & (F.col("q_value") < fdr))
