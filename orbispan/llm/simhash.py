"""SimHash near-duplicates with BK-trees (operator 10).

Fingerprints are computed in one pass over the texts. Equal fingerprints collapse first, so copies never form pairs.
Distinct fingerprints are dealt to shards by pigeonhole: with the 64 bits cut into radius + intact blocks, two
fingerprints within the radius agree in at least `intact` whole blocks, so each choice of that many blocks is a route and
its bits are the shard. Every pair within the radius meets in some shard; no pair is tried outside one. In a shard a
BK-tree (children keyed by integer Hamming distance) is followed only along edges within the radius. A hot shard is cut
into bounded parts and the tree of each part is sent to the tasks that query it (common.with_grid): trees travel through
the shuffle, never whole through the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbispan.llm.common import BROADCAST_ROWS, Forest, components, fresh, join_small, map_arrow, map_runs, stored, texts_of, with_grid
from orbispan.operators.stats import numbered

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at [\\x20\\x09-\\x0D]+; null is an empty text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_digests(words: list[bytes], k: int, seed: int = 42) -> bytes:
    """Concatenated big-endian XXH64 digests of all k-word shingles, repeats included."""
    digest = xxhash.xxh64_digest
    if len(words) <= k:
        return digest(b" ".join(words), seed) if words else b""
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    return b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :])])


def majority_bits(digests: bytes) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the digests. No digests: zero."""
    n = len(digests) // 8
    if not n:
        return 0
    total = np.zeros(64, dtype=np.int64)
    raw = np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)
    for lo in range(0, n, 65536):
        total += np.unpackbits(raw[lo : lo + 65536], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, k: int) -> int:
    return majority_bits(shingle_digests(words_of(text), k))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, fp (signed 64-bit)."""

    def run(batches):
        for b in batches:
            out = np.empty(b.num_rows, dtype=np.int64)
            for lo, texts in texts_of(b.column(1)):
                for i, t in enumerate(texts, lo):
                    out[i] = _signed(fingerprint(t, shingle))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, fp long")


class BKTree:
    """A node is [fingerprint, {distance to a child: child}]."""

    def __init__(self) -> None:
        self.top: list | None = None

    def add(self, fp: int) -> None:
        if self.top is None:
            self.top = [fp, {}]
            return
        node = self.top
        while d := (node[0] ^ fp).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [fp, {}]
                return
            node = child

    def within(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [self.top] if self.top else []
        while todo:
            node = todo.pop()
            d = (node[0] ^ fp).bit_count()
            if d <= radius:
                found.append(node[0])
            if node[1]:
                lo, hi = d - radius, d + radius
                todo += [c for e, c in node[1].items() if lo <= e <= hi]
        return found


def routes(radius: int, intact: int = 2) -> list[int]:
    """Bit masks, one for each choice of `intact` blocks out of radius + intact."""
    n = radius + intact
    bounds = [64 * i // n for i in range(n + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:])]
    return [sum(block[i] for i in c) for c in combinations(range(n), intact)]


def fingerprint_links(fps: DataFrame, radius: int, intact: int, cap: int) -> DataFrame:
    """Links (src, dst) that connect the distinct fingerprints of `fps` (fp) exactly as all pairs within the radius do."""
    masks = [_signed(m) for m in routes(radius, intact)]
    route = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("r", "mask")
    dealt = fps.select("fp", route).select("r", "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    dealt = dealt.select(F.xxhash64("r", "bits").alias("shard"), "fp")
    dealt = with_grid(dealt, "shard", "fp", cap).select("shard", "cell_a", "cell_b", "part", "fp")

    def search(key, rows):
        if rows.num_rows < 2:
            return None
        (_, a, b), forest, tree = key, Forest(), BKTree()
        part, fp = rows.column("part").to_numpy(), rows.column("fp").to_pylist()
        ask = [(x, x & (2**64 - 1)) for x, p in zip(fp, part) if p == b]
        if a == b:
            for x, u in ask:
                for v in tree.within(u, radius):
                    forest.join(x, _signed(v))
                tree.add(u)
        else:
            for x, p in zip(fp, part):
                if p == a:
                    tree.add(x & (2**64 - 1))
            for x, u in ask:
                for v in tree.within(u, radius):
                    forest.join(x, _signed(v))
        src, dst = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return map_runs(dealt, ["shard", "cell_a", "cell_b"], search, "src long, dst long").distinct()


def fingerprint_groups(prints: DataFrame, radius: int, intact: int = 1, cap: int = 1500) -> DataFrame:
    """prints: id, fp (stored). Adds component: the smallest id reachable over links between fingerprints."""
    classes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    links = fingerprint_links(classes.select("fp"), radius, intact, cap)
    comp = components(links)
    named = classes.join(comp.select(F.col("node").alias("fp"), F.col("component").alias("head")), "fp", "left").withColumn("head", F.coalesce("head", "fp"))
    lows = named.groupBy("head").agg(F.min("low").alias("component"))
    named = stored(named.join(lows, "head").select("fp", "component"), "fingerprint-groups")
    return prints.join(named, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, cap: int = 1500) -> DataFrame:
    """One row per document: id, fp, component (the smallest id reachable over fingerprints `radius` bits apart or less).

    Null and empty texts have fingerprint zero and link like any other; repeated rows and ties give equal rows; an empty
    table gives none; further columns of docs are ignored. 3 blocks of 21 or 22 bits, any one of them intact, are the shards
    for radius 2: three rows a fingerprint, and shards of some hundreds at a billion of them, which the trees prune.
    """
    prints = stored(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return fingerprint_groups(prints, radius, cap=cap)


# --- near-duplicates: fingerprints, verified by five-word shingles ------------------------------------------------------


def _shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_digests(words_of(text), k), dtype=">u8").astype(np.uint64))


#: Shingles that a task sorts at once, and those of a bucket, about.
FLUSH_SHINGLES = 1 << 19
_BUCKET_ROWS = "bucket int, kind int, ids binary, counts binary, hashes binary"


def _shingle_buckets(texts: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """texts (id, text) as packed shingle sets, cut by ranges of hashes. Kind 0: the shingles of one document alone among
    those sorted together, by document. Kind 1: one of each of the others. Kind 2: the documents, how many shingles each
    has and how many of them are of the others, so a common shingle costs a bucket a row for each batch, not each document.
    The upper half of a hash gives the bucket and the lower half goes along: a bucket holds a fixed number of shingles, so
    halves are as good as unique there, and two that clash only let a document pass that the exact test then drops."""

    def packed(ids, sets):
        ids, sizes = np.array(ids, dtype=np.int64), np.array([len(x) for x in sets], dtype=np.int64)
        owner, h = np.repeat(np.arange(len(ids)), sizes), np.concatenate(sets)
        order = np.argsort(h)
        owner, h = owner[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(first, len(h)))
        alone = np.repeat(count == 1, count)
        many = np.bincount(owner[~alone], minlength=len(ids))
        yield int(ids[0] % buckets), 2, ids.tobytes(), np.stack([sizes, many]).tobytes(), b""
        slot = lambda x: ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        for kind, who, x in ((0, owner[alone], h[alone]), (1, None, h[first[count > 1]])):
            at = slot(x)
            for lo in np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))).tolist() if len(x) else ():
                hi = int(np.searchsorted(at, at[lo], "right"))
                half = x[lo:hi].astype(np.uint32)
                if kind:
                    yield int(at[lo]), kind, b"", b"", half.tobytes()
                else:
                    by = np.argsort(who[lo:hi], kind="stable")
                    doc, n = np.unique(who[lo:hi][by], return_counts=True)
                    yield int(at[lo]), kind, ids[doc].tobytes(), n.astype(np.int32).tobytes(), half[by].tobytes()

    def batch_of(rows):
        b, k, i, c, h = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), *(pa.array(x, pa.binary()) for x in (i, c, h))], ["bucket", "kind", "ids", "counts", "hashes"])

    def run(batches):
        ids, sets, n = [], [], 0
        for b in batches:
            for lo, ts in texts_of(b.column(1)):
                for i, t in zip(b.column(0).slice(lo, len(ts)).to_pylist(), ts):
                    if len(x := _shingle_set(t, shingle)):
                        ids.append(i)
                        sets.append(x)
                        n += len(x)
                    if n >= FLUSH_SHINGLES:
                        yield batch_of(packed(ids, sets))
                        ids, sets, n = [], [], 0
        if n:
            yield batch_of(packed(ids, sets))

    return map_arrow(texts, run, _BUCKET_ROWS)


def _sharing(texts: DataFrame, shingle: int, similarity: float, buckets: int) -> DataFrame:
    """id of the texts of whose shingles at least the share `similarity` occurs in other texts; others have no partner."""

    def count(key, rows):
        kinds = rows.column("kind").to_pylist()
        read = lambda name, kind, dtype: [np.frombuffer(x, dtype=dtype) for x, k in zip(rows.column(name).to_pylist(), kinds) if k == kind]
        none = np.empty(0, dtype=np.int64)
        hashes = np.concatenate([np.empty(0, np.uint32), *read("hashes", 0, np.uint32)])
        ids = np.concatenate([none, *[np.repeat(i, n) for i, n in zip(read("ids", 0, np.int64), read("counts", 0, np.int32))]])
        pool = np.concatenate([hashes, *read("hashes", 1, np.uint32)])
        order = np.argsort(pool)
        edge = np.concatenate(([True], pool[order][1:] != pool[order][:-1])) if len(pool) else np.empty(0, bool)
        at = np.flatnonzero(edge)
        n = np.diff(np.append(at, len(pool)))
        shared = order[np.repeat(n > 1, n)]
        doc, hits = np.unique(ids[shared[shared < len(hashes)]], return_counts=True)
        told = [none, *read("ids", 2, np.int64)]
        sizes = [x.reshape(2, -1) for x in read("counts", 2, np.int64)]
        n_col = np.concatenate([np.full(len(doc), -1), *[x[0] for x in sizes]])
        c_col = np.concatenate([hits, *[x[1] for x in sizes]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([doc, *told])), pa.array(n_col), pa.array(c_col)], ["id", "n", "c"])

    rows = map_runs(_shingle_buckets(texts, shingle, buckets), ["bucket"], count, "id long, n long, c long")
    tally = rows.groupBy("id").agg(F.min(F.when(F.col("n") >= 0, F.col("n"))).alias("n"), F.sum("c").alias("c"))
    return tally.where(F.col("c") >= similarity * F.col("n") - 1e-9).select("id")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """id, s: the shingles of each set's prefix. Every two of the sets (id, s) that can have the similarity share one.

    Shingles are ordered by the sets that hold them, rarest first. Two sets of that similarity share one of the first
    n - ceil(similarity * n) + 1 shingles of each; those of a single set are counted, not listed.
    """
    tokens = sets.select("id", F.xxhash64("id", "s").alias("u"), F.size("s").alias("n"), F.explode("s").alias("s"))
    often = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = tokens.join(often, "s").groupBy("u", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    take = F.size("x") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int") + 1
    return stored(lists.withColumn("k", take).where("k > 0").select("id", F.explode(F.slice("x", F.lit(1), F.col("k"))["s"]).alias("s")), "prefixes")


def _open_prefixes(prefix: DataFrame, settled: DataFrame) -> DataFrame:
    """The rows of `prefix` (id, s) of shingles whose sets are not all in one group of `settled` (node, component)."""
    known = prefix.join(settled.withColumnRenamed("node", "id"), "id", "left").select("s", F.coalesce("component", "id").alias("c"))
    still = known.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    return stored(prefix.join(still, "s", "left_semi").select("id", "s"), "open-prefixes")


def _prefix_links(prefix: DataFrame) -> DataFrame:
    """src, dst: links that connect all sets that share a shingle of their prefixes."""
    low = prefix.groupBy("s").agg(F.min("id").alias("dst"), F.max("id").alias("high")).where("dst < high").select("s", "dst")
    return prefix.join(low, "s").where("id <> dst").select(F.col("id").alias("src"), "dst").distinct()


def _candidate_groups(sets: DataFrame, prefix: DataFrame, cap: int) -> DataFrame:
    """g, id, s: shingle sets in groups in which every two that can have the similarity meet.

    Sets that prefixes link, over any number of others, are one group while they fit into one cell. Larger ones are either
    one group, of which cells hold every two parts of `cap` sets (many copies of one text), or fall apart into one group for
    each list of sets that share a shingle (texts that passages link in chains), whichever copies the sets fewer times.
    """
    cand = stored(components(_prefix_links(prefix)).select(F.col("node").alias("id"), F.col("component").alias("g")), "candidates")
    n_cand = cand.count()
    times = lambda n: F.ceil(F.col(n) / cap)
    large = stored(cand.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).withColumn("as_one", F.col("n") * times("n")), "large-groups")
    n_large = large.count()
    if not n_large:
        return join_small(sets, cand, ["id"], "inner", n_cand).select("g", "id", "s")
    listed = stored(join_small(join_small(prefix, cand, ["id"], "inner", n_cand), large.select("g"), ["g"], "left_semi", n_large), "listed")
    # shingles of one passage are in the same sets: one of them stands for all
    lists = listed.groupBy("g", "s").agg(F.count(F.lit(1)).alias("df"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who")).where("df > 1")
    lists = stored(lists.groupBy("g", "df", "who").agg(F.min("s").alias("s")), "lists")
    apart = lists.groupBy("g").agg(F.sum(F.col("df") * times("df")).alias("as_lists")).join(large, "g").where("as_lists < as_one").select("g")
    apart = stored(apart, "groups-apart")
    n_apart = apart.count()
    whole = join_small(cand, apart, ["g"], "left_anti", n_apart).select("g", "id")
    named = join_small(listed, apart, ["g"], "left_semi", n_apart).join(lists.select("g", "s"), ["g", "s"]).select(F.xxhash64("g", "s").alias("g"), "id")
    return sets.join(whole.unionByName(named), "id").select("g", "id", "s")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (id, text) as id, s: the hashes of each one's different shingles (stored)."""

    def run(batches):
        for b in batches:
            sets = [_shingle_set(t, shingle).view(np.int64) for _, ts in texts_of(b.column(1)) for t in ts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return stored(map_arrow(texts, run, "id long, s array<long>"), "shingle-sets")


def _verified_links(cells: DataFrame, similarity: float) -> DataFrame:
    """src, dst: links that connect the sets of each cell (g, cell_a, cell_b, part, id, s) as all pairs of the similarity do."""

    def verify(key, rows):
        if rows.num_rows < 2:
            return None
        _, a, b = key
        part, ids = rows.column("part").to_numpy(), rows.column("id").to_numpy()
        col = rows.column("s").combine_chunks()
        starts, vals = col.offsets.to_numpy() - col.offsets[0].as_py(), col.flatten().to_numpy()
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(vals, kind="stable")
        _, code, count = np.unique(vals, return_inverse=True, return_counts=True)
        at = np.concatenate(([0], np.cumsum(count)))
        postings, forest = owner[order], Forest()
        for q in np.flatnonzero(part == b):
            mine = code[starts[q] : starts[q + 1]]
            hit = np.concatenate([postings[at[c] : at[c + 1]] for c in mine]) if len(mine) else postings[:0]
            share = np.bincount(hit, minlength=len(ids))
            ok = share >= similarity * (sizes + sizes[q] - share)
            ok &= (part == a) & (sizes > 0) if sizes[q] else (part == a) & (sizes == 0)
            for m in np.flatnonzero(ok):
                forest.join(int(ids[q]), int(ids[m]))
        src, dst = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return map_runs(cells, ["g", "cell_a", "cell_b"], verify, "src long, dst long")


def _simhash_links(texts: DataFrame, shingle: int, similarity: float, cap: int, feature: int, radius: int) -> DataFrame:
    """src, dst: links of the similarity between texts (id, text) whose fingerprints of `feature`-word shingles are linked,
    over any number of others, at `radius` bits or less; each is verified on whole shingle sets.

    A linked group is one cell up to `cap` texts. A larger one is cut into parts, all of which hold the group's first text, so
    that work grows with the texts; the exact way after this one links what two parts have in common beside it.
    """
    prints = stored(with_fingerprints(texts, "id", "text", feature), "fingerprints")
    groups = fingerprint_groups(prints, radius, intact=2).select("id", F.col("component").alias("g")).distinct()
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / cap).cast("int").alias("k"))
    own = F.array(F.pmod(F.xxhash64("id", F.lit(97)), F.col("k")).cast("int"))
    places = F.when(F.col("id") == F.col("g"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(own)
    cells = stored(groups.join(sizes, "g").select("g", "id", F.explode(places).alias("part")), "fingerprint-cells")
    ids = stored(cells.select("id").distinct(), "fingerprint-candidates")
    sets = _shingle_sets(join_small(texts, ids, ["id"], "left_semi", ids.count()), shingle)
    cells = cells.join(sets, "id").select("g", F.col("part").alias("cell_a"), F.col("part").alias("cell_b"), "part", "id", "s")
    return stored(_verified_links(cells, similarity), "fingerprint-links")


def _with_numbers(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with ids that are no integers replaced by their places in order, and the table (id, number) of them."""
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs, None
    names = stored(numbered(docs.select(F.col(id_col).alias("id")).distinct(), "number", ["id"]), "ids")
    return docs.join(names, docs[id_col] == names["id"]).drop("id").drop(id_col).withColumnRenamed("number", id_col), names


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, cap: int = 1200, feature: int = 2, radius: int = 4) -> DataFrame:
    """id, component (the smallest id of the group) of documents whose shingle sets have a Jaccard similarity of at least
    `similarity`, linked directly or over others.

    Exact copies collapse first. SimHash fingerprints of all texts (`feature`-word shingles) are then linked at `radius` bits or
    less by BK-trees in shards, and the linked texts are verified on whole shingle sets. A similarity sets no bound to the
    bits, so the rest is found in an exact way: texts that share too few shingles with all others leave, then those that
    share a shingle of their prefixes are linked, but for shingles whose texts fingerprints have put into one group. These
    groups are verified like the others, in bounded cells, and only verified links make components. So the result depends
    on neither `feature` nor `radius`; they tell how much is left for the exact way.

    Null texts and texts without words form one group. Ids may be of any type that has an order; rows that repeat an id are
    one document, with the links of all its texts, and each gets a row; rows with a null id get a null component and link
    nothing; an empty table gives none; very long texts are read whole; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lost = rows.where("id is null").select("id", F.col("id").alias("component"))
    rows, names = _with_numbers(rows.where("id is not null"), "id")
    base = rows.select(F.col("id").cast("long").alias("id"), "text")

    def run(batches):
        for b in batches:
            h, l, n = (np.empty(b.num_rows, dtype=np.int64) for _ in range(3))
            for lo, texts in texts_of(b.column(1)):
                for i, t in enumerate(texts, lo):
                    words = words_of(t)
                    h[i], l[i] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype=">i8")
                    n[i] = len(words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h), pa.array(l), pa.array(n)], ["id", "h", "l", "n"])

    prints = stored(map_arrow(base, run, "id long, h long, l long, n long"), "document-prints")
    texts = stored(prints.groupBy("h", "l").agg(F.min("id").alias("id"), F.max("n").alias("n")), "distinct-texts")
    copies = stored(prints.join(texts.select("id"), "id", "left_anti").select("id").distinct(), "copies")
    buckets = 1 + (texts.agg(F.sum("n")).first()[0] or 0) // FLUSH_SHINGLES
    single = join_small(base, copies, ["id"], "left_anti", copies.count())
    near = _simhash_links(single, shingle, similarity, cap, feature, radius)
    some = stored(_sharing(single, shingle, similarity, buckets), "sharing-texts")
    sets = _shingle_sets(join_small(single, some, ["id"], "left_semi", some.count()), shingle)
    groups = _candidate_groups(sets, _open_prefixes(_prefixes(sets, similarity), components(near)), cap)
    cells = with_grid(stored(groups, "candidate-sets"), "g", "id", cap).select("g", "cell_a", "cell_b", "part", "id", "s")
    verified = near.unionByName(_verified_links(cells, similarity))
    final = components(verified).select(F.col("node").alias("low"), "component")
    named = texts.select("h", "l", F.col("id").alias("low")).join(final, "low", "left").select("h", "l", F.coalesce("component", "low").alias("component"))
    out = prints.select("id", "h", "l").join(named, ["h", "l"]).select("id", "component")
    if names is not None:
        one, two = (names.select(F.col("number").alias(n), F.col("id").alias(f"{n}_name")) for n in ("id", "component"))
        out = out.join(one, "id").join(two, "component").select(F.col("id_name").alias("id"), F.col("component_name").alias("component"))
    return out.unionByName(lost)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but the document of smallest id of each near-duplicate group; every column stays.

    Documents with a null id are kept, as nothing can be said of them; rows that repeat an id are repeats of one
    document, so the first document's rows stay together.
    """
    gone, = fresh(docs, "_gone")
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **options)
    dropped = stored(groups.where("id <> component").select(F.col("id").alias(gone)), "dropped-copies")
    n = dropped.count()
    return docs.join(F.broadcast(dropped) if n <= BROADCAST_ROWS else dropped, docs[id_col] == F.col(gone), "left_anti")


def hex_digits(fp: str | Column) -> Column:
    """A signed 64-bit fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
