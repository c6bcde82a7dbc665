"""Order MinHash fingerprints (operator 11): DataFrame functions only.

A text is cut into short tokens: up to eight letters or digits with the few signs after them, and single characters of scripts
without blanks. Its k-mers are the runs of k tokens, numbered by how often they have occurred so far, so that repeats count.
Each numbered k-mer has a place on a circle of hashes. Sketch j of m takes the l numbered k-mers that follow the j-th of m equal
marks on the circle, puts them in the order in which they stand in the text, and hashes the tuple. Two texts agree in a sketch if
the same k-mers come first after the mark and stand in the same order, so edits that only move text count too. One hash of each
k-mer serves all sketches; texts of few k-mers share them between marks.

A k-mer travels as one long: 36 bits of its hash and 28 bits of its position. Two sorts of plain longs do the work: the first
brings equal k-mers together for numbering, the second lays the numbered ones on the circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbispan.llm.common import fresh, stored

K = 2
TUPLE = 2
SKETCHES = 64
#: Bits of a position; texts of more tokens have no array in Spark either way.
AT_BITS = 28
AT = (1 << AT_BITS) - 1
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_ALONE}]]"
TOKEN = rf"{_WORD}{{1,8}}[^\p{{L}}\p{{M}}\p{{N}}]{{0,4}}|[{_ALONE}]|[^\p{{L}}\p{{M}}\p{{N}}]{{1,4}}"
PART_ROWS = 50_000
MAX_PARTS = 16_384


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _packed(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~AT)).bitwiseOR(at)


def _kmers(tokens: Column, k: int) -> Column:
    """Hash and position of every k-mer; fewer tokens are one k-mer, none have none."""
    n = F.size(tokens)
    spots = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))).otherwise(F.array_repeat(F.lit(0), 0))
    return F.transform(spots, lambda i: _packed(F.xxhash64(*[F.get(tokens, i + d) for d in range(k)]), i.cast("long")))


def _numbered(s: Column) -> Column:
    """Each first occurrence as it is, the others at places that depend on k-mer and number. s: sorted hashes and positions."""

    def place(v: Column, i: Column) -> Column:
        same = lambda d: F.shiftrightunsigned(F.get(s, i - d).bitwiseXOR(v), AT_BITS) == 0
        steps = F.array(*[F.lit(1 << p) for p in range(AT_BITS - 1, -1, -1)])
        many = F.aggregate(steps, F.lit(0), lambda d, p: F.when(same(d + p), d + p).otherwise(d))
        earlier = F.when(~F.coalesce(same(2), F.lit(False)), 1).when(~F.coalesce(same(3), F.lit(False)), 2).otherwise(many)
        return F.when(same(1), _packed(F.xxhash64(F.shiftright(v, AT_BITS), earlier), v.bitwiseAND(F.lit(AT)))).otherwise(v)

    return F.transform(s, place)


def _sketches(tokens: Column, circle: Column, k: int, size: int, sketches: int) -> Column:
    """The tuples' hashes. circle: numbered k-mers sorted by place."""
    n = F.size(circle)
    steps = F.filter(F.array(*[F.lit(1 << p) for p in range(AT_BITS - 1, -1, -1)]), lambda p: p <= n)
    marks = F.array(*[F.lit((j << 64) // sketches - (1 << 63)) for j in range(sketches)])
    ahead = F.slice(F.array(*[F.lit(d) for d in range(size)]), F.lit(1), F.least(n, F.lit(size)))

    def sketch(mark: Column, powers: Column) -> Column:
        before = F.aggregate(powers, F.lit(0), lambda c, p: F.when(F.get(circle, c + p - 1) < mark, c + p).otherwise(c))
        taken = _let(before, lambda c: F.transform(ahead, lambda d: F.get(circle, F.pmod(c + d, n)).bitwiseAND(F.lit(AT))))
        return F.shiftright(F.xxhash64(F.transform(F.sort_array(taken), lambda at: F.slice(tokens, at.cast("int") + 1, k))), 32).cast("int")

    return _let(steps, lambda powers: F.transform(marks, lambda mark: sketch(mark, powers)))


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """df with `out`, array<int> of `sketches` values.

    A null text counts as an empty one; all empty ones have the same fingerprint, which is like no other. A text under k
    tokens is one k-mer; one of fewer than `size` k-mers has shorter tuples. Equal texts have equal fingerprints, wherever
    they stand. No row meets another. A task needs some 20 bytes for each byte of the longest text.
    """
    tokens, s, circle = fresh(df.withColumn(out, F.lit(None)), "tokens", "kmers", "circle")
    step = df.withColumn(tokens, F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0)))
    step = step.withColumn(s, F.sort_array(_kmers(F.col(tokens), k)))
    step = step.withColumn(circle, F.sort_array(_numbered(F.col(s))))
    return step.withColumn(out, _sketches(F.col(tokens), F.col(circle), k, size, sketches)).drop(tokens, s, circle)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of the sketches in which two fingerprints agree, 0 to 1."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def hex_text(fingerprint: str | Column) -> Column:
    """8 lowercase hex digits for each sketch."""
    c = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.lower(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


# --- each document, its edited text and the next document ----------------------------------------------------------------


def _following(keys: DataFrame) -> DataFrame:
    """id, h, n, next struct<id, h, n>: of each row of keys the one after it by id and h, nulls first; the first one after the
    last. Range partitions are written once; only their first rows go through one window."""
    order = [F.col("id").asc_nulls_first(), F.col("h").asc()]
    dealt = stored(keys.repartitionByRange(min(MAX_PARTS, 1 + keys.count() // PART_ROWS), *order).withColumn("part", F.spark_partition_id()), "ranges")
    me = F.struct("id", "h", "n")
    heads = dealt.groupBy("part").agg(F.min_by(me, F.struct(F.col("id").isNotNull(), "id", "h")).alias("head"))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(parts)).alias("after"))  # at most MAX_PARTS rows
    inside = Window.partitionBy("part").orderBy(*order)
    return dealt.join(F.broadcast(heads), "part").select("id", "h", "n", F.coalesce(F.lead(me).over(inside), "after").alias("next"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 4, k: int = K, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint for every row.

    The edited text is the text with its last floor(n_chars / part) code points replaced by the first as many, or all, of the
    next document's. Documents follow each other by id, nulls first, and rows of one id by a hash of their texts; rows equal
    in id and text are one document here, and all get its result; the first document follows the last, a single one
    itself. Null texts are empty ones; an empty table gives no rows; other columns are ignored.

    Texts are shuffled once, for both sides of the join; what goes to the document before is the beginning that it needs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    known = stored(with_fingerprint(rows, "text", "fp", k, size, sketches).select("id", "h", F.char_length("text").cast("long").alias("n"), "fp"), "fingerprints")
    distinct = known.groupBy("id", "h").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"))
    repeated = known.count() > distinct.count()
    if repeated:
        known = stored(distinct, "fingerprints")
    after = stored(_following(known.select("id", "h", "n")), "following")
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    here, there = F.struct("id", "h").alias("here"), F.col("next").alias("there")
    wanted = after.select(here, there, "n").select(F.col("there.id").alias("id"), F.col("there.h").alias("h"), "here", F.floor(F.col("n") / part).alias("need"))
    heads = rows.alias("d").join(wanted.alias("w"), same("d", "w")).select("w.here", F.left(F.col("d.text"), F.col("w.need").cast("int")).alias("head"))
    if repeated:
        heads = heads.groupBy("here").agg(F.any_value("head").alias("head"))
    heads = heads.select("here.*", "head")
    prints = known.alias("k").join(wanted.alias("w"), same("k", "w")).select("w.here", F.col("k.fp").alias("next_fp")).select("here.*", "next_fp")
    prints = known.alias("a").join(prints.alias("b"), same("a", "b")).select("a.id", "a.h", "a.n", "a.fp", "b.next_fp")
    whole = rows.alias("d").join(heads.alias("e"), same("d", "e")).select("d.id", "d.h", "d.text", "e.head").alias("d").join(prints.alias("p"), same("d", "p"))
    kept = (F.col("p.n") - F.floor(F.col("p.n") / part)).cast("int")
    out = whole.select("d.id", F.col("p.n").alias("n_chars"), F.concat(F.left(F.col("d.text"), kept), F.col("d.head")).alias("edited"), F.col("p.fp").alias("fingerprint"), F.col("p.next_fp").alias("next_fingerprint"))
    return with_fingerprint(out, "edited", "edited_fingerprint", k, size, sketches)
