"""Benchmark decontamination by SimHash windows (operator 1).

A window of a document has the size of a benchmark item. A window that reaches the wanted similarity holds that share of
the item's weight, so every start is tried at which the document's shingles that lie in the item weigh as much, in whatever
order they stand, and those aligned with a shared shingle.
Each window's weighted SimHash is looked up in a multi-index: eight blocks of eight bits, each probed within two bits, hold
every item fingerprint within 23 bits (were all blocks off by three, the distance would be 24). Candidates are verified by
the exact weighted Jaccard similarity of their shingles, repeats counted. One pass over whole texts; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orbispan.llm.common import map_arrow, stored, texts_of

#: Items, and bytes of their texts, that one pass holds; a larger benchmark takes more passes.
MAX_ITEMS = 20_000
MAX_BYTES = 32 << 20
RADIUS = 23
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words; case, punctuation and layout do not matter."""
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles, mixed so that each bit is fair; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ (words[i : i + n] >> np.uint64(29)) ^ words[i : i + n]) * _STEP + np.uint64(2 * i + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def weighted_simhash(hashes: np.ndarray, weights: np.ndarray) -> np.uint64:
    """A bit is 1 if the shingles that have it weigh over half."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(weights @ bits > weights.sum() / 2).view(">u8")[0].astype(np.uint64)


class ItemIndex:
    """Items' shingles, weights, fingerprints and the multi-index over the fingerprints.

    For a part of a benchmark: total counts the items of the whole and repeated the items of shingles in several of them.
    """

    def __init__(self, ids: list, texts: list[str | None], shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, total: int | None = None, repeated: dict[int, int] | None = None) -> None:
        self.similarity, self.radius = similarity, radius
        self.ids, self.hashes, self.k = [], [], []
        for ident, text in zip(ids, texts):
            words = word_hashes(text)
            if len(words):
                k = min(shingle, len(words))
                self.ids.append(ident)
                self.k.append(k)
                self.hashes.append(shingle_hashes(words, k))
        if total is None:
            total, repeated = len(self.ids), Counter(h for x in self.hashes for h in set(x.tolist()))
        self.rare = 1 + np.log(max(1, total))
        self.weight = {h: 1 + np.log(total / n) for h, n in repeated.items() if n > 1}
        self.counts = [Counter(x.tolist()) for x in self.hashes]
        self.prints = np.array([weighted_simhash(x, self.weights(x)) for x in self.hashes], dtype=np.uint64)
        self.whole = [float(self.weights(x).sum()) for x in self.hashes]
        self.holders: dict[int, dict[int, list[int]]] = {k: {} for k in set(self.k)}
        for i, (x, k) in enumerate(zip(self.counts, self.k)):
            for h in x:
                self.holders[k].setdefault(h, []).append(i)
        self.filters = {}
        for k, at in self.holders.items():
            seen = np.zeros(1 << 20, dtype=bool)
            seen[np.fromiter(at, dtype=np.uint64, count=len(at)) & np.uint64((1 << 20) - 1)] = True
            self.filters[k] = seen
        value = np.arange(256, dtype=np.uint8)
        blocks = self.prints.astype(">u8").view(np.uint8).reshape(-1, 8)
        close = np.bitwise_count(value[:, None] ^ value[None]) <= radius // 8
        self.near = [[np.flatnonzero(close[v][blocks[:, b]]).astype(np.int32) for v in range(256)] for b in range(8)]

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(h, self.rare) for h in hashes.tolist()])

    def candidates(self, fp: np.uint64) -> np.ndarray:
        """Items whose fingerprint is within the radius: the buckets of each block's value hold them all, by the block
        argument, and their distance picks them out."""
        at = np.concatenate([self.near[b][v] for b, v in enumerate(np.array([fp]).astype(">u8").view(np.uint8).tolist())])
        return np.unique(at[np.bitwise_count(self.prints[at] ^ fp) <= self.radius])

    def jaccard(self, window: np.ndarray, item: int) -> float:
        a, b = Counter(window.tolist()), self.counts[item]
        w = lambda h: self.weight.get(h, self.rare)
        both = sum(w(h) * min(n, b[h]) for h, n in a.items() if h in b)
        return both / (sum(w(h) * n for h, n in a.items()) + sum(w(h) * n for h, n in b.items()) - both)

    def starts(self, x: np.ndarray, item: int, places: np.ndarray) -> np.ndarray:
        """Starts of the item-sized windows of x whose shingles at `places`, those that the item holds, weigh enough for the
        similarity. No other window of that size can reach it."""
        weights, m, need = self.weights(x[places]), len(self.hashes[item]), self.similarity * self.whole[item] - 1e-9
        if weights.sum() < need:
            return places[:0]
        at = np.arange(max(0, int(places[0]) - m + 1), min(int(places[-1]), max(0, len(x) - m)) + 1)
        upto = np.concatenate(([0.0], np.cumsum(weights)))
        weight = upto[np.searchsorted(places, at + m)] - upto[np.searchsorted(places, at)]
        return at[weight >= need]

    def matches(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """(item id, best similarity, first word, words) of each item that a window of its size reaches.

        Windows that hold the same shingles as often are one, tried at its first start (told by the sum of their hashes), so
        a text that repeats itself costs no more than what is new in it.
        """
        found: dict[object, tuple[float, int, int]] = {}
        words = word_hashes(text) if text else ()
        for k, holders in self.holders.items():
            x = shingle_hashes(words, k) if len(words) >= k else ()
            if not len(x):
                continue
            hits = np.flatnonzero(self.filters[k][x & np.uint64((1 << 20) - 1)])
            held: dict[int, list[int]] = {}
            for p in hits.tolist():
                for i in holders.get(int(x[p]), ()):
                    held.setdefault(i, []).append(p)
            windows: dict[int, list[np.ndarray]] = {}
            for i, places in held.items():
                windows.setdefault(len(self.hashes[i]), []).append(self.starts(x, i, np.array(places, dtype=np.int64)))
            upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(x, dtype=np.uint64)))
            for m, several in windows.items():
                at = np.unique(np.concatenate(several))
                _, first = np.unique(upto[np.minimum(at + m, len(x))] - upto[at], return_index=True)
                for start in at[first].tolist():
                    window = x[start : start + m]
                    for i in self.candidates(weighted_simhash(window, self.weights(window))).tolist():
                        if self.k[i] == k and len(self.hashes[i]) == m and (s := self.jaccard(window, i)) >= self.similarity:
                            best = (s, -start, len(window) + k - 1)
                            if best > found.get(self.ids[i], (0.0,)):
                                found[self.ids[i]] = best
        return [(i, s, -start, n) for i, (s, start, n) in sorted(found.items(), key=lambda r: str(r[0]))]


def _slices(items: DataFrame, item_id: str, item_text: str, max_items: int, shingle: int):
    """The benchmark in parts that a task may hold: one if it is small, as its counted rows and bytes decide. Texts of one
    id travel together. With several parts, counts over the whole benchmark go with each, so that weights do not depend
    on the parts."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()
    n = max(-(-count // max_items), -(-size // MAX_BYTES)) if count else 0
    total = repeated = None

    def run(batches):
        for b in batches:
            for _, ts in texts_of(b.column(0)):
                sets = [np.unique(shingle_hashes(w, min(shingle, len(w)))).view(np.int64) for w in map(word_hashes, ts) if len(w)]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], ["s"])

    if n > 1:
        sets = stored(map_arrow(rows.select("t"), run, "s array<long>"), "item-shingles")
        total = sets.count()
        got = sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
        repeated = dict(zip(got.column(0).to_numpy().view(np.uint64).tolist(), got.column(1).to_pylist()))
    for s in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == s)
        got = part.toArrow()
        yield got.column(0).to_pylist(), got.column(1).to_pylist(), total, repeated


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8, max_items: int = MAX_ITEMS) -> DataFrame:
    """id, item_id, similarity, first_word, n_words: the best window of each document for each item that it holds.

    Null, empty and wordless texts and items match nothing. An item of fewer words than a shingle is one shingle. Items
    of one id count as one; repeated documents give repeated rows; empty tables give none; further columns are ignored.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, similarity double, first_word int, n_words int"
    item_type, out = to_arrow_type(items.schema[item_id].dataType), None
    for ids, texts, total, repeated in _slices(items, item_id, item_text, max_items, shingle):

        def run(batches, ids=ids, texts=texts, total=total, repeated=repeated):
            index = ItemIndex(ids, texts, shingle, similarity, total=total, repeated=repeated)
            for b in batches:
                row, item, score, first, size = [], [], [], [], []
                for lo, ts in texts_of(b.column(1)):
                    for r, t in enumerate(ts, lo):
                        for i, s, start, n in index.matches(t):
                            row.append(r)
                            item.append(i)
                            score.append(s)
                            first.append(start)
                            size.append(n)
                yield pa.RecordBatch.from_pydict({"id": b.column(0).take(pa.array(row, pa.int64())), "item_id": pa.array(item, item_type), "similarity": pa.array(score, pa.float64()), "first_word": pa.array(first, pa.int32()), "n_words": pa.array(size, pa.int32())})

        part = map_arrow(docs.select(id_col, text_col), run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, similarity: float = 0.8, max_items: int = MAX_ITEMS) -> DataFrame:
    """docs without the rows that hold an item; every column stays and no text is shuffled.

    Null and empty texts hold nothing and stay, as do texts too short for any item; rows that repeat share their fate, null
    ids have no part in it; null and empty items are none, items that repeat count once; an empty table gives none; very
    long texts are read whole.
    """
    for ids, texts, total, repeated in _slices(items, item_id, item_text, max_items, shingle):

        def run(batches, ids=ids, texts=texts, total=total, repeated=repeated):
            index = ItemIndex(ids, texts, shingle, similarity, total=total, repeated=repeated)
            for b in batches:
                yield b.filter(pa.array([not index.matches(t) for _, ts in texts_of(b.column(text_col)) for t in ts], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
