"""Rank statistics, multiple testing and small exact kernels. SQL where it can be; standard-library maths in tasks else."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orbispan.scratch import checkpointed


def matched(df: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with the further columns of table where the columns are equal, nulls too."""
    on = F.lit(True)
    for c in columns:
        on &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return df.join(table.select(*[F.col(c).alias(f"_of_{c}") if c in columns else F.col(c) for c in table.columns]), on).drop(*[f"_of_{c}" for c in columns])


def running_total(df: DataFrame, order: str, amount: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds _upto, the sum of amount over the key's rows up to this one and its equals in order, and _part.

    Rows are dealt to range partitions of keys and order, which are written once, so that their bounds hold; windows run
    within a partition (_part, ascending with order) and only the partitions' totals go through a window of the key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_part").agg(F.sum(amount).alias("_total"))
    totals = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_below"))
    here = F.sum(amount).over(Window.partitionBy(*keys, "_part").orderBy(order))
    return matched(dealt, totals, [*keys, "_part"]).withColumn("_upto", here + F.col("_below")).drop("_below")


def numbered(df: DataFrame, out: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds row numbers from 1 by order within keys, without gaps. Rows are numbered within range partitions of keys and order,
    written once; only the partitions' counts go through a window of the key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_below"))
    here = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return matched(dealt, counts, [*keys, "_part"]).withColumn(out, F.col("_below") + here).drop("_below", "_part")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), out: str = "q", weight: str | None = None) -> DataFrame:
    """keys, out: array of the quantiles of value, linear between neighbours; nulls do not count. weight: how many times a row counts.

    Distinct values are counted and numbered in range partitions, and the two values at each rank are picked by their
    running counts, so no task holds the values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    table = running_total(counts, value, "_n", keys)
    total = table.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    table = matched(table, total, keys) if keys else table.crossJoin(F.broadcast(total))  # one row
    place = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value).cast("double")))
    picked = table.groupBy(*keys, "_all").agg(*[at(f(place(p))).alias(f"_{n}{i}") for i, p in enumerate(probs) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    lo, hi = (lambda i: F.col(f"_lo{i}")), (lambda i: F.col(f"_hi{i}"))
    between = lambda i, p: F.when((F.ceil(place(p)) == F.floor(place(p))) | (lo(i) == hi(i)), lo(i)).otherwise((F.ceil(place(p)) - place(p)) * lo(i) + (place(p) - F.floor(place(p))) * hi(i))
    return picked.select(*keys, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias(out))


def with_quantile(agg: DataFrame, df: DataFrame, value: str, out: str, prob: float = 0.5, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """agg, a row for each value of keys, with the exact quantile of df's values as out; null where there are none."""
    found = exact_quantiles(df, value, [prob], keys, weight=weight).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("q")[0].alias(out))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return agg.join(found, on, "left").drop(*[f"_of_{k}" for k in keys])


def benjamini_hochberg(df: DataFrame, p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Adds q = the least p * n / rank among equal or larger p, 1 at most. Null p have null q and do not count.

    Ranks depend on the distinct p alone; those are numbered in range partitions and joined back. No window holds all rows.
    The input is written once, as it is read for the ranks and for the join.
    """
    df = checkpointed(df)
    known = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(known, p, "_n")
    n = ranked.agg(F.max("_upto").alias("_all"))
    ranked = ranked.crossJoin(F.broadcast(n)).withColumn("_q", F.least(F.lit(1.0), F.col(p) * F.col("_all") / F.col("_upto")))  # one row
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    least = ranked.groupBy("_part").agg(F.min("_q").alias("_low")).select("_part", F.min("_low").over(later).alias("_later"))  # a row a partition
    table = matched(ranked, least, ["_part"]).select(F.col(p).alias("_p"), F.least(F.min("_q").over(Window.partitionBy("_part").orderBy(F.desc(p))), "_later").alias(q))
    return df.join(table, F.col(p) == F.col("_p"), "left").drop("_p")


def average_ranks(df: DataFrame, value: str, rank: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Adds ranks from 1, ties sharing their mean; over distinct values, numbered in range partitions and joined back. The
    input is written once, as it is read for the ranks and for the join."""
    df = checkpointed(df)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    table = running_total(counts, value, "_ties", keys)
    table = table.select(*keys, value, (F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2).alias(rank), "_ties")
    return matched(df, table, [*keys, value])


def mann_whitney(df: DataFrame, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n1, n2, u, p_value: two-sided test of the rows with group true against the others.

    Ties share ranks. Without ties and with 8 rows or fewer on a side the p-value is exact, else normal with tie and
    continuity corrections. Null if a side is empty.
    """
    ranked = average_ranks(df.where(F.col(value).isNotNull()), value, "_r", keys)
    agg = ranked.groupBy(*keys).agg(F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n2"), F.coalesce(F.sum(F.when(F.col(group), F.col("_r"))), F.lit(0.0)).alias("_s"), F.sum(F.col("_ties").cast("double") * F.col("_ties") - 1).alias("_t"))
    agg = agg.withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2)

    @F.pandas_udf(DoubleType())
    def p_value(n1: pd.Series, n2: pd.Series, u: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([mwu_p(int(a), int(b), x, y) for a, b, x, y in zip(n1, n2, u, t)])

    return agg.withColumn("p_value", p_value("n1", "n2", "u", "_t")).select(*keys, "n1", "n2", "u", "p_value")


#: Most products of group sizes for which the rank test counts arrangements one by one; beyond, the normal form serves.
EXACT_RANKS = 2_000_000


def mwu_p(n1: int, n2: int, u: float, ties: float) -> float | None:
    """ties: sum of t**3 - t over groups of t equal values."""
    if not n1 or not n2:
        return None
    big, n = max(u, n1 * n2 - u), n1 + n2
    if ties == 0 and min(n1, n2) <= 8 and n1 * n2 <= EXACT_RANKS:
        ways = np.zeros(n1 * n2 + 1)
        ways[0] = 1.0
        # number of ways to each U by the generating function of Gaussian binomials
        for i in range(1, min(n1, n2) + 1):
            j = max(n1, n2) + i
            if j < len(ways):
                ways[j:] -= ways[:-j].copy()
            for r in range(min(i, len(ways))):
                ways[r::i] = np.cumsum(ways[r::i])
        return min(1.0, 2 * float(ways[int(math.ceil(big)) :].sum() / ways.sum()))
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (big - n1 * n2 / 2 - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2 x 2 table: all tables as likely as this one or less.

    Likelihoods rise to one mode and fall: each tail is summed outwards from its largest term until terms no longer count,
    so the work grows with the spread of the distribution, not with the margins.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lg = math.lgamma
    ways = lambda m, k: lg(m + 1) - lg(k + 1) - lg(m - k + 1)
    log_p = lambda k: ways(col, k) + ways(n - col, row - k) - ways(n, row)
    lo, hi, own = max(0, row + col - n), min(row, col), log_p(a) + 1e-7
    mode = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))
    if log_p(mode) <= own:
        return 1.0

    def edge(far: int) -> int | None:
        """The table next to the mode, on the side of `far`, that is as likely as this one or less."""
        if log_p(far) > own:
            return None
        near = mode
        while abs(far - near) > 1:
            mid = (far + near) // 2
            near, far = (mid, far) if log_p(mid) > own else (near, mid)
        return far

    def tail(k: int | None, step: int) -> float:
        total = 0.0
        while k is not None and lo <= k <= hi:
            term = math.exp(log_p(k))
            total += term
            if term <= total * 1e-17:
                break
            k += step
        return total

    return min(1.0, tail(edge(lo), -1) + tail(edge(hi), 1))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d)])


def poisson_tail(k: int, mean: float) -> float:
    """P(X >= k) as the regularised lower incomplete gamma function of (k, mean), in log space: a series left of the mode,
    a continued fraction right of it; both end after some square roots of k terms."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    scale = k * math.log(mean) - mean - math.lgamma(k)
    if mean < k + 1:
        term = total = 1.0 / k
        i = k
        while term > total * 1e-17:
            i += 1
            term *= mean / i
            total += term
        return min(1.0, math.exp(scale + math.log(total)))
    tiny = 1e-300
    b = mean + 1.0 - k
    c, d = 1.0 / tiny, 1.0 / b
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - k)
        b += 2.0
        d = an * d + b
        c = b + an / c
        d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            return max(0.0, 1.0 - math.exp(scale) * h)


def binomial_quantiles(n: np.ndarray, p: float, units: np.ndarray, cells: int = 1_000_000) -> np.ndarray:
    """For each n and unit u in [0, 1) the k with P(X < k) <= u < P(X <= k): a binomial draw that anything with the same u repeats.

    A distribution is listed for each distinct n, within 9 standard deviations and 40 of the mean: what lies beyond is less
    likely than a unit of 48 bits can tell. Terms follow from their ratios and are scaled to sum to one. No more than about
    `cells` terms (one n's at least) are listed at once.
    """
    if p <= 0.0 or p >= 1.0:
        return n * int(p > 0.0)
    values, which = np.unique(n, return_inverse=True)
    mean, sd = values * p, np.sqrt(values * p * (1.0 - p))
    lo = np.maximum(0, np.floor(mean - 9 * sd - 40)).astype(np.int64)
    hi = np.minimum(values, np.ceil(mean + 9 * sd + 40)).astype(np.int64)
    order, out = np.argsort(which, kind="stable"), np.empty(len(n), dtype=np.int64)
    width = int((hi - lo).max(initial=0))
    step = max(1, cells // (width + 1))
    for at in range(0, len(n), step):
        rows = order[at : at + step]
        here, inner = np.unique(which[rows], return_inverse=True)
        most, k = values[here, None], lo[here, None] + np.arange(width)
        steps = np.where(k < hi[here, None], np.log(np.maximum(most - k, 1) / (k + 1.0)) + (math.log(p) - math.log1p(-p)), -np.inf)
        logs = np.concatenate([np.zeros((len(here), 1)), np.cumsum(steps, axis=1)], axis=1)
        cdf = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        cdf /= cdf[:, -1:]
        passed = (cdf[inner] <= units[rows, None]).sum(axis=1)
        out[rows] = np.minimum(lo[which[rows]] + passed, hi[which[rows]])
    return out


def digest_unit(text: str) -> float:
    """A number in [0, 1): the first 48 bits of the text's digest; what `enrich.unit_draw` gives in a column."""
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / float(1 << 48)


def multinomial_draws(n: int, weights: np.ndarray, labels: Sequence[str]) -> np.ndarray:
    """A row of counts for each label: n points dealt to classes by weight (whole numbers, not all zero).

    Classes are halved again and again, and the points of a stretch [lo, hi) fall to its first half by a binomial draw with
    the digest of `label:lo:hi` as its unit. So the draws depend on the labels alone, and each costs the number of classes,
    not of points.
    """
    upto = np.concatenate([[0], np.cumsum(weights)])
    out = np.zeros((len(labels), len(weights)), dtype=np.int64)
    todo = [(0, len(weights), np.full(len(labels), n, dtype=np.int64))]
    while todo:
        lo, hi, points = todo.pop()
        if hi - lo == 1:
            out[:, lo] = points
            continue
        mid = (lo + hi) // 2
        left, whole = int(upto[mid] - upto[lo]), int(upto[hi] - upto[lo])
        share, first = left / whole if whole else 0.0, np.zeros_like(points)
        some = np.flatnonzero(points)
        if 0.0 < share < 1.0:
            units = np.array([digest_unit(f"{labels[i]}:{lo}:{hi}") for i in some])
            first[some] = binomial_quantiles(points[some], share, units)
        elif share >= 1.0:
            first = points
        todo += [(lo, mid, first), (mid, hi, points - first)]
    return out


@F.pandas_udf(DoubleType())
def poisson_at_least(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= k) of a Poisson variable."""
    return pd.Series([poisson_tail(int(x), float(m)) for x, m in zip(k, mean)])


def pearson(x: str, y: str) -> Column:
    """Coefficient of two columns as an aggregate; null when a side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, pearson, spearman; null when a side is constant."""
    rx = average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx", keys).drop("_ties")
    ry = average_ranks(rx, y, "_ry", keys).drop("_ties")
    return ry.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("pearson"), pearson("_rx", "_ry").alias("spearman"))


def moving_average(df: DataFrame, value: str, order: str, width: int, keys: Sequence[str] = (), out: str = "smooth") -> DataFrame:
    """Centred sum over `width` rows divided by width, as a convolution with zero padding."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width - 1 - width // 2)
    return df.withColumn(out, F.sum(value).over(w) / width)


def saturation_fit(x: Sequence[float], y: Sequence[float]) -> dict[str, float | None]:
    """Least squares of y = n (1 - exp(-c x)) by Levenberg-Marquardt: n, c, their standard errors and R squared."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    none = {"n_max": None, "rate": None, "n_max_se": None, "rate_se": None, "r2": None}
    if len(x) < 3 or not np.isfinite(y).all():
        return none
    p, damp = np.array([max(y.max() * 1.5, 1e-9), 2.0 / max(x.max(), 1e-9)]), 1e-3
    model = lambda p: p[0] * (1 - np.exp(-np.clip(p[1] * x, -50, 50)))
    cost = float(((y - model(p)) ** 2).sum())
    for _ in range(500):
        decay = np.exp(-np.clip(p[1] * x, -50, 50))
        jac = np.stack([1 - decay, p[0] * x * decay], axis=1)
        h, g = jac.T @ jac, jac.T @ (y - model(p))
        try:
            step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), g)
        except np.linalg.LinAlgError:
            return none
        new = p + step
        trial = float(((y - model(new)) ** 2).sum())
        if trial < cost:
            done = cost - trial < 1e-14 * max(cost, 1e-300)
            p, cost, damp = new, trial, damp / 5
            if done:
                break
        else:
            damp *= 4
            if damp > 1e15:
                break
    decay = np.exp(-np.clip(p[1] * x, -50, 50))
    jac = np.stack([1 - decay, p[0] * x * decay], axis=1)
    spread = float(((y - y.mean()) ** 2).sum())
    try:
        se = np.sqrt(np.diag(np.linalg.inv(jac.T @ jac)) * cost / max(1, len(x) - 2))
    except np.linalg.LinAlgError:
        se = [None, None]
    return {"n_max": float(p[0]), "rate": float(p[1]), "n_max_se": None if se[0] is None else float(se[0]), "rate_se": None if se[1] is None else float(se[1]), "r2": 1 - cost / spread if spread > 0 else None}


def saturation_curves(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key and the fit of each sample's curve; a curve has a handful of points, so a group is one small frame."""
    kind = df.schema[key].dataType.simpleString()
    names = ["n_max", "rate", "n_max_se", "rate_se", "r2"]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        f = saturation_fit(group[x].to_numpy(), group[y].to_numpy())
        return pd.DataFrame([[group[key].iloc[0], *[f[n] for n in names]]], columns=[key, *names])

    return df.select(key, x, y).groupBy(key).applyInPandas(fit, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def geometric_extrapolation(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, last_value, mean_ratio of the last three increments, expected total: a series of shrinking gains summed up."""
    w = Window.partitionBy(key).orderBy(order)
    inc = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_r", F.col("_d") / F.greatest(F.lag("_d").over(w), F.lit(1)))
    last = inc.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    agg = last.groupBy(key).agg(F.max_by(value, order).alias("last_value"), F.max_by("_d", order).alias("_last"), F.avg(F.when(F.col("_k") <= 3, F.col("_r"))).alias("mean_ratio"))
    more = F.when((F.col("mean_ratio") > 0) & (F.col("mean_ratio") < 1), F.col("_last") * F.col("mean_ratio") / (1 - F.col("mean_ratio"))).otherwise(0.0)
    return agg.select(key, "last_value", "mean_ratio", (F.col("last_value") + more).alias("expected_total"))


def lincoln_petersen(df: DataFrame) -> DataFrame:
    """Adds the capture-recapture estimate n_a * n_b / n_shared, infinite without shared ones."""
    return df.withColumn("lp_estimate", F.when(F.col("n_shared") > 0, F.col("n_a").cast("double") * F.col("n_b") / F.col("n_shared")).otherwise(F.lit(float("inf"))))


def expected_overlap(df: DataFrame, population: float | None = None) -> DataFrame:
    """Adds the share of b expected by chance for a mean population, and observed over expected."""
    if population is None:
        mean = lincoln_petersen(df).where(F.col("lp_estimate") < float("inf")).agg(F.avg("lp_estimate").alias("_mean"))
        df = df.crossJoin(F.broadcast(mean))  # one row
    else:
        df = df.withColumn("_mean", F.lit(float(population)))
    want = F.when(F.col("_mean") > 0, F.col("n_b") / F.col("_mean"))
    return df.withColumns({"expected_fraction": want, "overlap_ratio": F.when(want > 0, F.col("overlap_fraction") / want)}).drop("_mean")


def empirical_p(df: DataFrame, observed: str, permuted: str, keys: Sequence[str] = (), lower: bool = False) -> DataFrame:
    """keys, n_perm, mean, sd (population), p_value = (as extreme + 1) / (n + 1), fold against the mean."""
    extreme = F.col(permuted) <= F.col(observed) if lower else F.col(permuted) >= F.col(observed)
    agg = df.groupBy(*keys).agg(F.first(observed).alias("observed"), F.count(F.lit(1)).alias("n_perm"), F.avg(permuted).alias("mean"), F.stddev_pop(permuted).alias("sd"), ((F.count_if(extreme) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    fold = F.when(F.col("mean") > 0, F.col("observed") / F.col("mean")).when(F.col("observed") > 0, F.lit(float("inf"))).otherwise(1.0)
    return agg.withColumn("fold", fold)
