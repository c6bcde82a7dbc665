"""Embedding near-duplicates by product quantisation (operator 8).

Coarse inverted lists hold residual subspace codes. The lists are the cells of a two-level tree of centroids, about as many
as the square root of the vectors, so both the lists and what a list holds grow with the data and neither without bound
for the other. A query probes every list whose border with its own cell is near enough, scans their codes with an
asymmetric distance table, and reranks candidates by exact cosine in double precision. Codes keep their own error, so the
scan never loses a pair (triangle inequality); only the choice of lists can, and `reach` bounds that. A list's members and
its queries are cut into bounded parts and each pair of parts is a cell, so a list with most of the vectors is many tasks.
A cell emits counts and a spanning forest, never all its pairs. Equal vectors are one class, which is searched once.
Vectors of each length have an index of their own, in the same pass.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from orbispan.llm.common import components, map_arrow, map_runs, stored

#: Bound of the fit: vectors drawn by hash for all lengths together, but for SMALL_SAMPLE of each length at least.
MAX_SAMPLE = 262_144
SMALL_SAMPLE = 256
#: Vectors drawn for each list.
SAMPLE_PER_LIST = 32
SUBSPACES = 8
CODES = 64


@dataclass
class PQIndex:
    """Centroids of a tree of two levels, and the codebooks of the residuals, for vectors of one length."""

    top: np.ndarray  # cells x dim
    sub: list[np.ndarray]  # for each cell: lists x dim
    base: np.ndarray  # number of the first list of each cell
    codebooks: np.ndarray  # subspaces x codes x width
    dim: int

    @property
    def lists(self) -> int:
        return int(self.base[-1]) + len(self.sub[-1])

    def centroid(self, at: int) -> np.ndarray:
        t = int(np.searchsorted(self.base, at, "right")) - 1
        return self.sub[t][at - self.base[t]]

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Vectors filled with zeros to whole subspaces."""
        return np.pad(x, ((0, 0), (0, self.codebooks.shape[2] * len(self.codebooks) - x.shape[1])))


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, so that a vector has the same figures in any batch."""
    return np.maximum(0.0, np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c)[None] - 2 * np.einsum("ij,kj->ik", x, c))


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 8192) -> np.ndarray:
    norm = (c * c).sum(1)[None]
    return np.concatenate([np.argmin(norm - 2 * (x[lo : lo + step] @ c.T), axis=1) for lo in range(0, len(x), step)]) if len(x) else np.empty(0, dtype=np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit_index(sample: np.ndarray, lists: int, seed: int = 7) -> PQIndex:
    """Cells and lists on the sample, then codebooks for each subspace of the residuals."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    lists = max(1, min(lists, len(sample)))
    top = _kmeans(sample, max(1, round(lists**0.5)), 8, rng)
    own = _nearest(sample, top)
    sub = []
    for t in range(len(top)):
        part = sample[own == t]
        want = max(1, round(lists * len(part) / len(sample)))
        sub.append(_kmeans(part, min(want, len(part)), 8, rng) if len(part) else top[t : t + 1].copy())
    residual = np.concatenate([p - sub[t][_nearest(p, sub[t])] for t in range(len(top)) if len(p := sample[own == t])])
    subspaces = min(SUBSPACES, dim)
    width = -(-dim // subspaces)
    residual = np.pad(residual, ((0, 0), (0, width * subspaces - dim)))
    k = min(CODES, len(residual))
    books = np.stack([_kmeans(residual[:, i * width : (i + 1) * width], k, 8, rng) for i in range(subspaces)])
    return PQIndex(top, sub, np.cumsum([0, *[len(s) for s in sub[:-1]]]), books, dim)


def _near(c: np.ndarray, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, and a boolean matrix of the centroids whose cells begin within the limit.

    A partner lies in another cell only if the plane between the two centroids is nearer than the partner.
    """
    d2 = _square_distances(x, c)
    own = np.argmin(d2, axis=1)
    between = np.sqrt(_square_distances(c, c))[own]
    near = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * between * limit
    near[np.arange(len(x)), own] = True
    return own, near


def _limit(index: PQIndex, radius: float, reach: float) -> float:
    """A partner's step towards one given plane is radius / sqrt(dim) in the mean, so planes beyond reach times that are left
    out; reach >= sqrt(dim) leaves out none that can matter."""
    return radius * min(1.0, reach / np.sqrt(index.dim))


def probed(index: PQIndex, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, list and whether it is the row's own, for every list that each vector probes."""
    own, near = _near(index.top, x, limit)
    rows, lists, home = [], [], []
    for t in range(len(index.top)):
        at = np.flatnonzero(near[:, t])
        if len(at):
            mine, close = _near(index.sub[t], x[at], limit)
            r, s = np.nonzero(close)
            rows.append(at[r])
            lists.append(s + index.base[t])
            home.append((own[at[r]] == t) & (mine[r] == s))
    return np.concatenate(rows), np.concatenate(lists), np.concatenate(home)


def probes(index: PQIndex, x: np.ndarray, lists: np.ndarray, limit: float) -> np.ndarray:
    """Whether each vector probes the list beside it."""
    out = np.zeros(len(x), dtype=bool)
    cell = np.searchsorted(index.base, lists, "right") - 1
    for t in np.unique(cell):
        at = np.flatnonzero(cell == t)
        at = at[_near(index.top, x[at], limit)[1][:, t]]
        if len(at):
            out[at] = _near(index.sub[t], x[at], limit)[1][np.arange(len(at)), lists[at] - index.base[t]]
    return out


def encode(index: PQIndex, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals and the distance of each vector to its decoded form."""
    centre = np.concatenate(index.sub)[own]
    residual, width = index.padded(x - centre), index.codebooks.shape[2]
    codes = np.empty((len(x), len(index.codebooks)), dtype=np.uint8)
    left = np.zeros(len(x))
    for i, book in enumerate(index.codebooks):
        d2 = _square_distances(residual[:, i * width : (i + 1) * width], book)
        codes[:, i] = np.argmin(d2, axis=1)
        left += d2[np.arange(len(x)), codes[:, i]]
    return codes, np.sqrt(left)


def _asymmetric(index: PQIndex, q: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
    """Squared distances of whole queries to decoded list members, by one table lookup for each subspace."""
    shifted, width = index.padded(q - index.centroid(at)), index.codebooks.shape[2]
    out = np.zeros((len(q), len(code)))
    for i, book in enumerate(index.codebooks):
        out += _square_distances(shifted[:, i * width : (i + 1) * width], book)[:, code[:, i]]
    return out


def is_usable(column: pa.Array) -> np.ndarray:
    """Vectors that have a direction: not null, all components finite and not null, not all zero."""
    out = np.zeros(len(column), dtype=bool)
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            top = np.abs(np.array(v, dtype=np.float64)).max()
            out[i] = np.isfinite(top) and top > 0
    return out


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    """Usable vectors of one length as unit vectors in double precision."""
    x = flat.astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _fitted(classes: DataFrame, max_sample: int) -> dict[int, PQIndex]:
    """An index for each length of the vectors of classes (cid, v, d), on a bounded sample drawn by hash."""
    sizes = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    total = sum(sizes.values())
    lists = {d: max(1, round(n**0.5)) for d, n in sizes.items()}
    share = {d: min(1.0, max(SMALL_SAMPLE / n, min(SAMPLE_PER_LIST * max(lists[d], 128), max_sample * n / total) / n)) for d, n in sizes.items()}
    parts = classes.sparkSession.createDataFrame([(d, int(s * (1 << 40))) for d, s in share.items()], "d int, part long")
    drawn = classes.join(F.broadcast(parts), "d").where(F.pmod(F.xxhash64("cid", F.lit(11)), F.lit(1 << 40)) < F.col("part"))
    got = drawn.select("cid", "d", "v").toArrow().sort_by("cid")
    length, out = got.column("d").to_numpy(), {}
    for d in sorted(sizes):
        part = got.column("v").take(pa.array(np.flatnonzero(length == d))).combine_chunks().flatten().to_numpy()
        out[d] = fit_index(unit_rows(part, d) if len(part) else np.zeros((1, d)), lists[d])
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, reach: float = 2.5, cap: int = 8192, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """id, n_links, component: links are pairs of vectors of one length with at least the given cosine.

    Null, empty, zero and non-finite vectors and those with null components link with nothing: n_links 0, component their own
    id. Equal vectors link with each other (a cosine of 1); repeated rows of one id are rows of their own. A null id is no
    smallest id: the component is null only where all its ids are. Ids may be of any type that has an order. An empty table
    gives none; further columns are ignored.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    held = vectors.schema[vec_col].dataType
    cell = "float" if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{cell}>").alias("v"))

    def clean(batches):
        for b in batches:
            v = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), v.take(pa.array(np.where(ok := is_usable(v), np.arange(len(v)), 0), pa.int64(), mask=~ok))], ["id", "v"])

    units = stored(map_arrow(rows, clean, f"id {kind}, v array<{cell}>"), "vectors")
    grouped = units.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("cid"), "v", F.size("v").alias("d"), "low", "n"), "vector-classes")
    indexes, radius = _fitted(classes, max_sample), float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    if not indexes:
        return units.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    lengths = sorted(indexes)
    first = np.cumsum([0, *[indexes[d].lists for d in lengths]]).tolist()

    def deal(batches):
        for b in batches:
            length = b.column(3).to_numpy()
            for d in np.unique(length).tolist():
                part = pa.array(np.flatnonzero(length == d))
                cid, n, v = (b.column(i).take(part) for i in range(3))
                index, x = indexes[d], unit_rows(v.flatten().to_numpy(), d)
                at, where, home = probed(index, x, _limit(index, radius, reach))
                own = np.empty(len(x), dtype=np.int64)
                own[at[home]] = where[home]
                codes, left = encode(index, x, own)
                code = [codes[i].tobytes() if h else None for i, h in zip(at.tolist(), home.tolist())]
                take, start = pa.array(at), first[lengths.index(d)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where + start), pa.array(own[at] + start), cid.take(take), n.take(take), pa.array(code, pa.binary()), pa.array(left[at]), v.take(take)],
                    ["list", "own", "cid", "n", "code", "err", "v"],
                )

    listed = stored(map_arrow(classes.select("cid", "n", "v", "d"), deal, f"list long, own long, cid long, n long, code binary, err double, v array<{cell}>"), "inverted-lists")
    dealt = _cells(listed, cap).select("list", "m_part", "q_part", "ask", "own", "cid", "n", "code", "err", "v")

    def scan(key, rows):
        which = bisect_right(first, key[0]) - 1
        start, index = first[which], indexes[lengths[which]]
        at, limit = key[0] - start, _limit(index, radius, reach)
        ask, own, cid, n = (rows.column(c).to_numpy() for c in ("ask", "own", "cid", "n"))
        q, m = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(q) or not len(m):
            return None
        x = unit_rows(rows.column("v").combine_chunks().flatten().to_numpy(), index.dim)
        code = np.frombuffer(b"".join(rows.column("code").take(pa.array(m)).to_pylist()), dtype=np.uint8).reshape(len(m), -1)
        bound = (radius + rows.column("err").to_numpy()[m][None] + 1e-9) ** 2
        pairs = []
        for lo in range(0, len(q), 128):
            part = q[lo : lo + 128]
            i, k = np.nonzero(_asymmetric(index, x[part], at, code) <= bound)
            i, j = part[i], m[k]
            differ = cid[i] != cid[j]
            i, j = i[differ], j[differ]
            good = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[good], j[good]
            # a pair that meets in two lists, or twice in this one, counts where the smaller id asks
            twice = np.flatnonzero((cid[i] > cid[j]) & (own[i] != key[0]))
            once = cid[i] < cid[j]
            once[twice] = ~probes(index, x[j[twice]], own[i[twice]] - start, limit)
            pairs.append((i[once], j[once]))
        i, j = (np.concatenate(p) for p in zip(*pairs))
        ids, spot = np.unique(np.concatenate([cid[i], cid[j]]), return_inverse=True)
        i_at, j_at = spot[: len(i)], spot[len(i) :]
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, i_at, n[j])
        np.add.at(links, j_at, n[i])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(_heads(i_at, j_at, ids))], ["cid", "links", "other"])

    found = stored(map_runs(dealt, ["list", "m_part", "q_part"], scan, "cid long, links long, other long"), "vector-links")
    comp = components(found.select(F.col("cid").alias("src"), F.col("other").alias("dst")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lows = named.groupBy("component").agg(F.min("low").alias("lowest"))
    named = stored(named.join(lows, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "lowest"), "vector-groups")
    alone = F.col("v").isNull()
    return units.join(named, "v", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("lowest")).alias("component"))


def _cells(listed: DataFrame, cap: int) -> DataFrame:
    """Every query of a list with every member of it, in cells of at most about `cap` queries and `cap` members."""
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / cap).alias("kq"), F.ceil(F.greatest(F.lit(1), F.count_if(F.col("own") == F.col("list"))) / cap).alias("km"))
    both = listed.join(F.broadcast(sizes), "list")  # one row a list: the square root of the vectors
    part = lambda k, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1))
    queries = both.withColumns({"ask": F.lit(True), "q_part": part("kq", 98), "m_part": every("km")})
    members = both.where("own = list").withColumns({"ask": F.lit(False), "m_part": part("km", 97), "q_part": every("kq")})
    return queries.unionByName(members)


def _heads(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that the pairs (i, j) of one cell connect each row with."""
    head = ids.copy()
    while True:
        low = np.minimum(head[i], head[j])
        new = head.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == head).all():
            return head
        head = new
