"""Whitening of embeddings by shifted Cholesky QR (operator 13).

The centred rows are never stored. A pass reads them, solves with the triangular factors found so far, and adds up the Gram
matrix of what is left; its Cholesky factor is the next one. The first is shifted by a bound on the rounding of the Gram
matrix, so it exists for ill-conditioned rows too; the further passes restore orthogonality. The product of the factors is R of
the centred rows, and its singular values and right vectors are those of the rows. Sums and deviations are exact integers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbispan.llm.common import map_arrow, map_runs

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
#: Tasks whose Gram matrices are added up, each of the square of the dimension.
TASKS = 4096
#: Passes at most; three serve for full rank.
PASSES = 8
#: Entries off the identity at which rows count as orthonormal.
CLOSE = 1e-11
#: Singular values below this part of the largest are those of dependent dimensions.
RANK = 1e-12
#: Scaled entries beyond this size are set to it, so that they fit in a long.
LARGEST = 1 << 52
#: Doubles of all factors that travel to the tasks, one square for each pass and length.
MOST_DOUBLES = 1 << 27


def usable(vector: Column) -> Column:
    """Not null, and all entries finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as longs."""
    return np.clip(np.floor(SCALE * vectors), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def by_length(batch: pa.RecordBatch):
    """(length, row numbers, x) of a batch of (id, vector)."""
    column = batch.column(1)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, whole(flat[starts[rows][:, None] + np.arange(d)])


def exact_sums(x: np.ndarray) -> list[int]:
    if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def less_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as longs where they fit and as Python integers else."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def deviations(gap: np.ndarray) -> list[int]:
    """Exact sums of squares over the dimensions."""
    most = int(np.abs(gap).max(initial=0))
    if gap.dtype == np.int64 and most * most * gap.shape[1] < 1 << 62:
        return (gap * gap).sum(axis=1).tolist()
    return (gap.astype(object) ** 2).sum(axis=1).tolist()


def solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Z with Z r = y for an upper triangular r, column by column for all rows at once."""
    z = np.empty_like(y)
    for j in range(r.shape[0]):
        z[:, j] = (y[:, j] - z[:, :j] @ r[:j, j]) / r[j, j]
    return z


@dataclass
class Fit:
    """What the passes found out about the vectors of one length."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    values: np.ndarray | None = None  # eigenvalues of the covariance that are wanted, falling
    axes: np.ndarray | None = None  # their unit vectors, as columns
    explained: np.ndarray | None = None
    error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (less_mean(x, self.n, self.sums) / self.n).astype(np.float64)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Columns of components of no spread are nan."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, y @ self.axes / np.sqrt(self.values), np.nan)


def gram(vectors: DataFrame, fits: dict[int, Fit], rows_of) -> dict[int, np.ndarray]:
    """Z'Z by length, with Z = rows_of(fit, centred rows). Tasks send their sums a row at a time; rows meet by number, are
    added up in the order of the tasks, and the driver gets one matrix a length."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(fits)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b):
                z = rows_of(shared.value[d], shared.value[d].centred(x))
                total[d] = total.get(d, 0.0) + z.T @ z
        for d, g in total.items():
            rows = [pa.array([d] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()), pa.array([r.tobytes() for r in g], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["length", "i", "row"])

    def added(key, rows):
        table = rows.sort_by([("part", "ascending")])
        total = np.sum([np.frombuffer(r, dtype=np.float64) for r in table.column("row").to_pylist()], axis=0)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["length", "i", "row"])

    partial = map_arrow(vectors.coalesce(TASKS), run, "length int, i int, row binary").withColumn("part", F.spark_partition_id())
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in map_runs(partial, ["length", "i"], added, "length int, i int, row binary").collect():
        out.setdefault(r.length, {})[r.i] = np.frombuffer(bytes(r.row), dtype=np.float64)
    shared.unpersist()
    return {d: np.stack([rows[i] for i in sorted(rows)]) for d, rows in out.items()}


def cholesky(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = g, or g plus a bound on its rounding if g has no such factor or `shifted` asks for it."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(float(np.trace(g)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d) if shifted else g).T
        except np.linalg.LinAlgError:
            shift *= 10 if shifted else 1
            shifted = True


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A Fit for each length of the vectors of (id, vector array<double>), all usable."""

    def sums(batches):
        total: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for d, rows, x in by_length(b):
                n, old = total.get(d, (0, [0] * d))
                total[d] = n + len(rows), [p + q for p, q in zip(old, exact_sums(x))]
        for d, (n, s) in total.items():
            cols = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, ["length", "j", "n", "s"])

    found: dict[int, dict[int, tuple]] = {}
    per_task = map_arrow(vectors, sums, "length int, j int, n long, s decimal(38,0)")
    for r in per_task.groupBy("length", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        found.setdefault(r.length, {})[r.j] = (r.n, int(r.s))
    fits = {d: Fit(cols[0][0], [cols[j][1] for j in range(d)]) for d, cols in found.items()}
    if PASSES * sum(d * d for d in fits) > MOST_DOUBLES:
        raise ValueError(f"the lengths' squares, {sum(d * d for d in fits)} doubles a pass, are too many for the tasks")

    def left(fit, y):
        for r in fit.factors:
            y = solved(y, r)
        return y

    moving = dict(fits)
    for k in range(PASSES):
        for d, g in gram(vectors.where(F.size("vector").isin(list(moving))), moving, left).items() if moving else ():
            if not np.trace(g) > 0 or k >= 2 and np.abs(g - np.eye(d)).max() < CLOSE:
                del moving[d]
            else:
                fits[d].factors.append(cholesky(g, fits[d].n, shifted=k == 0))
    for d, fit in fits.items():
        r = np.zeros((d, d)) if not fit.factors else np.eye(d)
        for f in fit.factors:
            r = f @ r
        _, singular, right = np.linalg.svd(r)
        values = np.where(singular > RANK * singular[0], singular, 0.0) ** 2 / fit.n
        sign = np.sign(right[np.arange(d), np.abs(right).argmax(axis=1)])
        fit.values, fit.axes = values[:components], (right * sign[:, None])[:components].T
        fit.explained = fit.values / values.sum() if values.sum() > 0 else np.full(len(fit.values), np.nan)
        fit.factors = []
    # covariance of what comes out, over all rows
    ones = lambda fit, y: np.concatenate([np.nan_to_num(fit.whitened(y)), np.ones((len(y), 1))], axis=1)
    for d, g in gram(vectors, fits, ones).items() if fits else ():
        spread = fits[d].values > 0
        mean = g[-1, :-1] / fits[d].n
        cov = g[:-1, :-1] / fits[d].n - np.outer(mean, mean) - np.eye(len(mean))
        fits[d].error = float(np.abs(cov[spread][:, spread]).max(initial=0.0))
    return fits


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation decimal(38,0), whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or hold null or non-finite entries are left out, of the fit too. Entries become longs
    floor(1024 c) + 100000 first. Components are numbered from 1 by falling variance, at most `components` and the length of
    the vectors; a component's vector has its largest entry positive. Vectors of different lengths are fitted apart, empty
    ones give no row. Components without spread (a single row, equal rows, dependent dimensions) have null whitened
    values, and count neither in explained, null without any spread, nor in identity_error. Ids are carried, null and repeated
    ones too; every repeated row counts; other columns are ignored; an empty table gives no rows. Deviations of more than 38
    digits are null. A task holds a batch of vectors and the square of their length.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector")).where(usable(F.col("vector")) & (F.size("vector") > 0))
    fits = fitted(rows, components)
    shared = df.sparkSession.sparkContext.broadcast(fits)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for b in batches:
            for d, at, x in by_length(b):
                fit = shared.value[d]
                k = len(fit.values)
                white = fit.whitened(fit.centred(x)).reshape(-1)
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                dev = pa.array([Decimal(v) if v < 10**38 else None for v in deviations(less_mean(x, fit.n, fit.sums)) for _ in range(k)], pa.decimal128(38, 0))
                some = lambda v: pa.array(np.tile(v, len(at)), pa.float64(), mask=np.isnan(np.tile(v, len(at))))
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array([fit.n] * len(ids), pa.int64()), dev, pa.array(white, mask=np.isnan(white)), some(fit.explained), pa.array([fit.error] * len(ids), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(rows, run, f"id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
