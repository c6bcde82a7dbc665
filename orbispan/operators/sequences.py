"""Sequences by chunk, base composition profiles, terminal repeats, alignments and coverage of circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbispan.functions.reads import paf_coverage, paf_identity, tag_value
from orbispan.functions.regions import one_sided_fraction
from orbispan.functions.sequence import gc_content, gc_indicator, reverse_complement


def fetched(regions: DataFrame, chunks: DataFrame, chunk: int, key: str = "name") -> DataFrame:
    """key and seq of each region (chrom, start, end). chunks: chrom, chunk (index), seq of `chunk` bases each.

    A region is listed at each chunk that it touches and joined by equality; parts are put together in order. A contig that
    is missing gives an empty sequence.
    """
    spots = regions.select(key, "chrom", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / chunk))).alias("chunk"))
    lo, hi = F.greatest("start", F.col("chunk") * chunk), F.least("end", (F.col("chunk") + 1) * chunk)
    part = F.substring(F.col("seq"), (lo - F.col("chunk") * chunk + 1).cast("int"), (hi - lo).cast("int"))
    joined = spots.join(chunks, ["chrom", "chunk"], "left").withColumn("part", F.coalesce(part, F.lit("")))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("seq"))


def stranded(df: DataFrame, seq: str = "seq", strand: str = "strand") -> DataFrame:
    return df.withColumn(seq, F.when(F.col(strand) == "-", reverse_complement(seq)).otherwise(F.col(seq)))


def joined_fragments(parts: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """name and seq of records that may have several fragments, in order."""
    return parts.groupBy(name).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "seq"))), lambda x: x["seq"]), "").alias("seq"))


def gc_of(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn("gc", gc_content(seq))


def gc_profile(windows: DataFrame, width: int, seq: str = "seq") -> DataFrame:
    """pos, mean_gc, n of windows of full width; bases other than A, C, G and T do not count."""
    at = windows.where(F.length(seq) == width).select(F.posexplode(F.split(F.col(seq), "")).alias("pos", "base")).where(F.col("pos") < width)
    return at.groupBy("pos").agg(F.avg(gc_indicator("base")).alias("mean_gc"), F.count(gc_indicator("base")).alias("n"))


def gc_metagene(df: DataFrame, bins: int = 100, seq: str = "seq") -> DataFrame:
    """bin, gc, acgt, mean_gc over whole sequences of any length, each cut into `bins` stretches of equal share.

    A stretch i of n bases is [i * n / bins, (i + 1) * n / bins), rounded down; bases other than A, C, G and T do not count.
    """
    n = F.length(seq)
    lo = lambda i: F.floor(i.cast("bigint") * n / bins)
    part = lambda i: F.substring(F.col(seq), (lo(i) + 1).cast("int"), (lo(i + 1) - lo(i)).cast("int"))
    count = lambda x, of: F.length(x) - F.length(F.translate(x, of, ""))
    cells = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(i.alias("bin"), count(part(i), "GC").alias("gc"), count(part(i), "ACGT").alias("acgt")))
    rows = df.where(n > 0).select(F.explode(cells).alias("c")).groupBy("c.bin").agg(F.sum("c.gc").alias("gc"), F.sum("c.acgt").alias("acgt"))
    return rows.withColumn("mean_gc", F.when(F.col("acgt") > 0, F.col("gc") / F.col("acgt")))


def terminal_repeats(direct: DataFrame, inverted: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """name, repeat_type and the best direct and inverted hit by bit score (then length, identity).

    Hits: name, pident, length, bitscore.
    """
    best = lambda df, tag: df.groupBy(key).agg(F.max(F.struct("bitscore", "length", "pident")).alias(tag))
    out = names.select(key).join(best(direct, "d"), key, "left").join(best(inverted, "i"), key, "left")
    kind = F.when(F.col("d").isNotNull() & F.col("i").isNotNull(), "Both").when(F.col("d").isNotNull(), "Direct").when(F.col("i").isNotNull(), "Inverted").otherwise("No_Repeat")
    return out.select(key, kind.alias("repeat_type"), F.col("d.length").alias("direct_length"), F.col("d.pident").alias("direct_identity"), F.col("i.length").alias("inverted_length"), F.col("i.pident").alias("inverted_identity"))


def paf_hits(paf: DataFrame, min_identity: float, min_coverage: float) -> DataFrame:
    """paf rows with identity and coverage that reach both limits. Needs divergence, matches, aligned, target_start,
    target_end and original."""
    out = paf.withColumns({"identity": paf_identity("divergence", "matches", "aligned"), "coverage": paf_coverage(F.col("target_end") - F.col("target_start"), "original")})
    return out.where((F.col("identity") >= min_identity) & (F.col("coverage") >= min_coverage))


def distinct_hits(hits: DataFrame, key: str, order: list[Column], grain: int = 100) -> DataFrame:
    """The first hit of each key in each cell of start and end."""
    cells = ["chrom", F.floor(F.col("start") / grain), F.floor(F.col("end") / grain)]
    w = Window.partitionBy(key, *cells).orderBy(*order)
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def copy_class(regions: DataFrame, hits: DataFrame, key: str = "name", same: float = 0.9) -> DataFrame:
    """key, n_other, copy_class: M if a hit lies elsewhere than on the region itself, else U."""
    j = regions.select(key, F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end")).join(hits.select(key, "chrom", "start", "end"), key, "left")
    own = (F.col("chrom") == F.col("r_chrom")) & (one_sided_fraction("r_start", "r_end", "start", "end") >= same)
    n = F.count_if(F.col("chrom").isNotNull() & ~own)
    return j.groupBy(key).agg(n.alias("n_other"), F.when(n > 0, "M").otherwise("U").alias("copy_class"))


def internal_repeats(regions: DataFrame, consensus: DataFrame, share: float = 0.8, key: str = "name") -> DataFrame:
    """regions whose longest internal repeat consensus covers less than `share` of them."""
    longest = consensus.groupBy(key).agg(F.max(F.length("consensus")).alias("_longest"))
    return regions.join(longest, key, "left").where(F.coalesce("_longest", F.lit(0)) < F.col("length") * share).drop("_longest")


def validation(alignments: DataFrame, min_reads: int = 3) -> DataFrame:
    """name, reads, split_reads, crossing_reads, status, confidence of an alignment table (name, read_id, start, end,
    is_split, junction): a read crosses if it covers the junction with ten bases on both sides."""
    cross = (F.col("start") <= F.col("junction") - 10) & (F.col("end") >= F.col("junction") + 10)
    d = lambda cond: F.count_distinct(F.when(cond, F.col("read_id")))
    agg = alignments.groupBy("name").agg(F.count_distinct("read_id").alias("reads"), d(F.col("is_split")).alias("split_reads"), d(cross).alias("crossing_reads"))
    status = F.when((F.col("split_reads") > 0) | (F.col("crossing_reads") > 0), "validated").otherwise("not_validated")
    conf = F.when(F.col("crossing_reads") >= min_reads, "high").when(status == "validated", "low").otherwise("none")
    return agg.withColumns({"status": status, "confidence": conf})


def junction_support(alignments: DataFrame, references: DataFrame, window: int = 20, min_unique: int = 20, min_split: int = 3, min_crossing: int = 3) -> DataFrame:
    """contig, unique_reads, split_reads, crossing_reads, ref_length, status, confidence of every reference, whose junction is
    its middle.

    alignments: name, flag, contig, start, end, cigar, tags; unmapped ones and duplicates are left out. An alignment is split
    if another part of its read is listed (tag SA) or its ends are clipped. A read crosses if an alignment reaches beyond
    `window` on both sides of the junction, or lies beyond it on one side and a listed part on the other. References without
    alignments have zeros. Reads of one reference are counted after a partial aggregate by name, so one may hold any share.
    """
    used = alignments.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("flag").bitwiseAND(1024) == 0))
    sa = tag_value("tags", "SA:Z:")
    parts = F.transform(F.filter(F.split(sa, ";"), lambda b: b != ""), lambda b: F.try_element_at(F.split(b, ","), F.lit(2)).try_cast("bigint") - 1)
    j = used.join(references.select("contig", F.expr("size div 2").alias("_mid")), "contig")
    lo, hi = F.col("_mid") - window, F.col("_mid") + window
    far = F.exists(parts, lambda p: ((F.col("end") < lo) & (p > hi)) | ((F.col("start") > hi) & (p < lo)))
    cross = F.coalesce((F.col("start") < lo) & (F.col("end") > hi), F.lit(False)) | F.coalesce(far, F.lit(False))
    split = sa.isNotNull() | F.coalesce(F.col("cigar").rlike(r"^\d+S|S$"), F.lit(False))
    reads = j.groupBy("contig", "name").agg(F.count_if(split).alias("split"), F.max(cross).alias("cross"))
    agg = reads.groupBy("contig").agg(F.count(F.lit(1)).alias("unique_reads"), F.sum("split").alias("split_reads"), F.count_if("cross").alias("crossing_reads"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = references.select("contig", F.col("size").alias("ref_length")).join(agg, "contig", "left").select("contig", *map(zero, ("unique_reads", "split_reads", "crossing_reads")), "ref_length")
    basic, crossing = (F.col("unique_reads") >= min_unique) & (F.col("split_reads") >= min_split), F.col("crossing_reads") >= min_crossing
    status = F.when(basic | crossing, "Detected").otherwise("Not_detected")
    return out.withColumns({"status": status, "confidence": F.when(basic & crossing, "High").when(basic | crossing, "Medium").otherwise("Low")})


def circular_depth(parts: DataFrame, key: str = "name") -> DataFrame:
    """key, min_depth, max_depth, mean_depth, zero_bp over circles from aligned parts (key, start, end, length), where an
    end beyond the length wraps around. Depth changes at starts and ends only, so runs stand for bases."""
    wrap = F.when(F.col("end") > F.col("length"), F.array(F.struct("start", F.col("length").alias("end")), F.struct(F.lit(0).cast("bigint").alias("start"), F.least(F.col("end") - F.col("length"), F.col("length")).alias("end")))).otherwise(F.array(F.struct("start", "end")))
    flat = parts.select(key, "length", F.explode(wrap).alias("s")).select(key, "length", "s.*").where("end > start")
    events = flat.select(key, "length", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e")).select(key, "length", "e.*")
    edges = parts.select(key, "length").distinct().select(key, "length", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("d")), F.struct(F.col("length").alias("pos"), F.lit(0).alias("d")))).alias("e")).select(key, "length", "e.*")
    steps = events.unionByName(edges).groupBy(key, "length", "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("pos")
    runs = steps.withColumns({"depth": F.sum("d").over(w), "span": F.lead("pos").over(w) - F.col("pos")}).where("span > 0")
    return runs.groupBy(key).agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), (F.sum(F.col("depth") * F.col("span")) / F.sum("span")).alias("mean_depth"), F.coalesce(F.sum(F.when(F.col("depth") == 0, F.col("span"))), F.lit(0)).alias("zero_bp"))
