"""Importance resampling towards a target distribution by bit-sliced bucket counts (operator 12).

A feature's bucket gains floor(1000 ln ratio) of its smoothed shares in the target and in the corpus, a signed integer. The
gains lie once as planes of one bit a bucket in two's complement. A document's bucket counts become planes too; the
population count of a count plane AND a gain plane, times the powers of two of both, adds up to the exact sum of the gains
of all its features. Only bucket totals and fixed-width rows are shuffled, never texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbispan.llm.common import map_arrow, stored, texts_of

BUCKETS = 10_000
#: Texts are cut into words in pieces of about so many bytes; a piece ends between words.
PIECE = 1 << 20
#: Words whose buckets a task remembers.
KNOWN_WORDS = 1 << 18
#: UTF-8 bytes of words after A-Z became a-z: digits, letters and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PART_ROWS = 50_000
MAX_PARTS = 16_384


class Buckets(dict):
    """Bucket of each feature; forgets all when it holds KNOWN_WORDS."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def pieces_of_words(text: str | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size, but for a single longer word."""
    data = (text or "").encode().lower()
    at = 0
    while at < len(data):
        end = min(len(data), at + piece)
        if end < len(data) and (last := WORD.match(data, end)):
            end = last.end()
        yield WORD.findall(data, at, end)
        at = end


def feature_counts(text: str | None, known: Buckets, max_words: int = 1) -> tuple[np.ndarray, int, int]:
    """Occurrences of each bucket among all runs of 1 to max_words words, how many runs there are, and how many words."""
    counts, n_words, tail = np.zeros(known.buckets, dtype=np.int64), 0, []
    for words in pieces_of_words(text):
        n_words += len(words)
        counts += np.bincount(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)), minlength=known.buckets)
        line, old = tail + words, len(tail)
        for k in range(2, max_words + 1):
            runs = [b" ".join(line[i - k : i]) for i in range(max(k, old + 1), len(line) + 1)]
            counts += np.bincount(np.fromiter(map(known.__getitem__, runs), dtype=np.int64, count=len(runs)), minlength=known.buckets)
        tail = line[len(line) - max_words + 1 :] if max_words > 1 else []
    return counts, int(counts.sum()), n_words


# --- bit planes -------------------------------------------------------------------------------------------------------


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Plane p holds bit p of every value, 64 values a word; negative values as two's complement."""
    wide = np.zeros(-(-len(values) // 64) * 64, dtype=np.int64)
    wide[: len(values)] = values
    return np.packbits(((wide[None, :] >> np.arange(bits)[:, None]) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


class Gains:
    """Signed gains of all buckets as bit planes."""

    def __init__(self, gains: np.ndarray) -> None:
        bits = int(np.abs(gains).max(initial=0)).bit_length() + 1
        self.planes = planes_of(gains, bits)
        self.power = np.array([1 << q for q in range(bits - 1)] + [-(1 << (bits - 1))], dtype=object)

    def total(self, counts: np.ndarray) -> int:
        """Sum of count times gain over all buckets."""
        bits = int(counts.max(initial=0)).bit_length()
        if not bits:
            return 0
        ones = np.bitwise_count(planes_of(counts, bits)[:, None, :] & self.planes[None, :, :]).sum(axis=2, dtype=np.int64)
        return int(sum((1 << p) * int(row @ self.power) for p, row in enumerate(ones)))


# --- corpus passes ------------------------------------------------------------------------------------------------------


def bucket_totals(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_words: int = 1) -> DataFrame:
    """bucket, n: occurrences over all rows; a task sends a row a bucket at most."""

    def run(batches):
        known, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, some in texts_of(b.column(0)):
                for text in some:
                    total += feature_counts(text, known, max_words)[0]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    return map_arrow(texts.select(text_col), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the add-one shares in the target over those in the corpus, in doubles."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, max_words: int = 1) -> DataFrame:
    """id, n_features, n_words, weight: the floored mean of the gains of each text's features.

    Features are runs of 1 to max_words consecutive words, repeats counted. Null and empty texts and those without words
    have no features and a weight of 0; repeated rows weigh alike and all count in the corpus; ids are carried, null too;
    very long texts are read whole, piece by piece; an empty table gives no rows, an empty target gains that speak for
    rare buckets. Other columns are ignored. The driver gets `buckets` totals of either table, whatever their size.
    """
    totals = []
    for df, col in ((docs, text_col), (target, target_col)):
        x = np.zeros(buckets, dtype=np.int64)
        for r in bucket_totals(df, col, buckets, max_words).collect():
            x[r.bucket] = r.n
        totals.append(x)
    gains = Gains(bucket_gains(*totals))

    def run(batches):
        known = Buckets(buckets)
        for b in batches:
            out = []
            for _, some in texts_of(b.column(1)):
                for text in some:
                    counts, n, n_words = feature_counts(text, known, max_words)
                    out.append((n, n_words, gains.total(counts) // n if n else 0))
            cols = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", "n_features", "n_words", "weight"])

    return map_arrow(docs.select(id_col, text_col), run, f"id {docs.schema[id_col].dataType.simpleString()}, n_features long, n_words long, weight long")


def gumbel_score(weight: str, ident: str, seed: int) -> Column:
    """weight plus floor(-1000 ln(-ln u)), u from the first 32 bits of sha256('<seed>:<id>'); a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.col(weight) + F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(weighted: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """weighted with score and rank: the floor(percent N / 100) highest scores of the N rows with at least min_words words are
    numbered from 1, ties to the smaller id, nulls first; other ranks are null.

    The rows are dealt to range partitions by score and id, written once, and numbered within each; only the partitions'
    counts go through one window. Rows equal in both are spread by their place in the written table.
    """
    scored = stored(weighted.withColumn("score", gumbel_score("weight", "id", seed)), "scored").withColumn("_at", F.monotonically_increasing_id())
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    order = [F.desc("score"), F.col("id").asc_nulls_first(), F.col("_at").asc()]
    dealt = stored(scored.where(able).repartitionByRange(min(MAX_PARTS, 1 + n // PART_ROWS), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_start")  # at most MAX_PARTS starts
    ranked = dealt.join(F.broadcast(starts), "_part").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n * percent // 100, F.col("rank"))).drop("_part", "_start", "_at")
    return ranked.unionByName(scored.where(~able).drop("_at").withColumn("rank", F.lit(None).cast("long")))
