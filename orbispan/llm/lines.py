"""Line deduplication with a log-template tree (operator 7).

A line's leaf in the tree is its token count and its leading tokens, with tokens that hold digits masked. In a leaf, lines go in
the order of their hashes: a line joins the first template whose line it agrees with in at least `agree` of the positions, and
the positions in which it differs are variable fields of that template; else it begins a template of its own. Which template
a line joins thus depends on the lines of its leaf alone, not on how they are dealt to tasks. Identical lines and templates of
long lines that recur, and short templates that recur in several documents, are dropped everywhere but in the document of
smallest id. Lines travel as 64-bit hashes; the texts of leaves with a single line never leave their task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orbispan.llm.common import fresh, join_small, map_arrow, map_runs, stored, texts_of

DEPTH = 3
AGREE = 0.8
#: Documents that an identical line, or a template of LONG_TOKENS or more, must occur in to be dropped from all but one,
#: and those that a shorter template must occur in.
LINE_DOCS = 2
TEMPLATE_DOCS = 5
LONG_TOKENS = 8
#: Shorter lines stay: one-word sentences and short headings recur by chance.
MIN_CHARS = 16
#: Lines of fewer tokens, as in scripts without blanks, are only compared as wholes: one field leaves too little constant.
MIN_TOKENS = 3
#: Slots of the filter for leaves of a single line. Where leaves are many more, it lets more lines pass, none too few.
LEAF_BITS = 1 << 24
#: Line hashes and ids, of eight bytes each, that may be broadcast.
BROADCAST_HASHES = 1 << 20
_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(r"\S*\d\S*")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(frozen=True)
class Form:
    """How lines are read: depth of the tree, and what is too short to be a line or a template."""

    depth: int = DEPTH
    min_chars: int = MIN_CHARS
    min_tokens: int = MIN_TOKENS
    long_tokens: int = LONG_TOKENS

    def tokens(self, line: str) -> list[str] | None:
        """Tokens of a line, or None if it has none or too few characters."""
        tokens = line.split()
        if not tokens or len(line) < self.min_chars or sum(map(len, tokens)) + len(tokens) - 1 < self.min_chars:
            return None
        return tokens

    def leaf(self, tokens: list[str]) -> str:
        lead = " ".join(tokens[: self.depth])
        if len(tokens) < self.min_tokens:
            return f"{len(tokens)} {lead}"
        return f"{len(tokens)} {_DIGITS.sub('<*>', lead) if _DIGIT.search(lead) else lead}"

    def masked(self, plain: str) -> str:
        """The line with tokens that hold digits masked; as it is if no token were left or it has few."""
        size = plain.count(" ") + 1
        if size < self.min_tokens or not _DIGIT.search(plain):
            return plain
        masked, n = _DIGITS.subn("<*>", plain)
        return masked if n < size else plain


def _line_rows(docs: DataFrame, id_col: str, text_col: str, form: Form) -> DataFrame:
    """id, h, m, leaf, long: hashes of the normal form, masked form and leaf of each different line of a document, and
    whether it is a long one."""

    def run(batches):
        for b in batches:
            row, hs, ms, leaves, long = [], [], [], [], []
            for lo, texts in texts_of(b.column(1)):
                for r, t in enumerate(texts, lo):
                    for line in set((t or "").split("\n")):
                        if tokens := form.tokens(line):
                            plain = " ".join(tokens)
                            h = _hash(plain)
                            row.append(r)
                            hs.append(h)
                            ms.append(_hash(form.masked(plain)) if _DIGIT.search(plain) else h)
                            leaves.append(_hash(form.leaf(tokens)))
                            long.append(len(tokens) >= form.long_tokens)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (hs, ms, leaves)), pa.array(long, pa.bool_())], ["id", "h", "m", "leaf", "long"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, h long, m long, leaf long, long boolean")


def _crowded(rows: DataFrame) -> np.ndarray:
    """One bit for each slot of leaf hashes that holds several masked lines: a table of fixed size, whatever the input."""
    slot = F.pmod("leaf", F.lit(LEAF_BITS))
    many = rows.select("leaf", "m").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = many.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(LEAF_BITS + 65536, dtype=bool)
    for p in parts:
        bits = np.unpackbits(np.frombuffer(bytes(p["bits"]), dtype=np.uint8), bitorder="little")
        lo = (p["b"] - 1) * 32768 + 1 if p["b"] > 0 else 0
        out[lo : lo + len(bits)] |= bits.astype(bool)
    return np.packbits(out)


def _crowded_lines(docs: DataFrame, rows: DataFrame, text_col: str, form: Form) -> DataFrame:
    """leaf, t, line: each different masked line, with its hash t, of the leaves that hold several."""
    bits = _crowded(rows).tobytes()

    def pick(batches):
        for b in batches:
            found = {}
            for _, texts in texts_of(b.column(0)):
                for t in texts:
                    for line in set((t or "").split("\n")):
                        if tokens := form.tokens(line):
                            leaf = _hash(form.leaf(tokens))
                            s = leaf % LEAF_BITS
                            if bits[s >> 3] >> (7 - (s & 7)) & 1:
                                masked = form.masked(" ".join(tokens))
                                found[_hash(masked)] = (leaf, masked)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found.values()], pa.int64()), pa.array(list(found), pa.int64()), pa.array([x[1] for x in found.values()], pa.string())], ["leaf", "t", "line"])

    return stored(map_arrow(docs.select(text_col), pick, "leaf long, t long, line string").distinct(), "crowded-lines")


class Templates:
    """The templates of a leaf so far, found by the blocks of positions that they share with a line.

    Lines of w tokens that agree in `agree` of them differ in at most so many positions that, of one more blocks of
    positions than that, they share a whole one. So only templates with a block in common are compared.
    """

    def __init__(self, agree: float) -> None:
        self.agree = agree
        self.ids: list[int] = []
        self.lines: list[list[str]] = []
        self.by_block: dict[tuple, list[int]] = {}

    def _blocks(self, words: list[str]) -> Iterator[tuple]:
        n = int((1 - self.agree) * len(words) + 1e-9) + 1
        return ((len(words), r, *words[r::n]) for r in range(n))

    def first(self, words: list[str]) -> int | None:
        """Id of the first template that agrees with the line."""
        need = self.agree * len(words) - 1e-9
        best = None
        for block in self._blocks(words):
            for k in self.by_block.get(block, ()):  # ascending
                if best is not None and k >= best:
                    break
                if sum(map(eq, self.lines[k], words)) >= need:
                    best = k
                    break
        return None if best is None else self.ids[best]

    def add(self, ident: int, words: list[str]) -> None:
        for block in self._blocks(words):
            self.by_block.setdefault(block, []).append(len(self.ids))
        self.ids.append(ident)
        self.lines.append(words)


def templates_of(ids: list[int], lines: list[str], agree: float) -> list[int]:
    """For each line, by ascending ids, the id of the line whose template it joins; its own if it begins one."""
    known, owner = Templates(agree), {}
    for ident, line in sorted(zip(ids, lines)):
        words = line.split(" ")
        found = known.first(words)
        if found is None:
            known.add(ident, words)
        owner[ident] = ident if found is None else found
    return [owner[i] for i in ids]


def template_text(lines: list[str]) -> str:
    """A template's line with its variable fields; the first line is the one that began it."""
    return " ".join("<*>" if len(set(column)) > 1 else column[0] for column in zip(*(x.split(" ") for x in lines)))


def _begun(lines: DataFrame, agree: float) -> DataFrame:
    """leaf, t, into of all lines (leaf, t, line), a leaf being one run."""

    def run(key, rows):
        ids = rows.column("t").to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(ids)), pa.array(ids), pa.array(templates_of(ids, rows.column("line").to_pylist(), agree))], ["leaf", "t", "into"])

    return stored(map_runs(lines.select("leaf", "t", "line"), ["leaf"], run, "leaf long, t long, into long"), "templates")


def _joined(dealt: DataFrame, agree: float) -> DataFrame:
    """dealt: leaf, deal, head, t, line. leaf, t, line, into of the lines that are no heads: the first head of their deal that
    agrees with them, null if none does."""

    def run(key, rows):
        known, out = Templates(agree), []
        columns = (rows.column(c).to_pylist() for c in ("head", "t", "line"))
        for head, t, line in sorted(zip(*columns), key=lambda r: (not r[0], r[1])):
            if head:
                known.add(t, line.split(" "))
            else:
                out.append((key[0], t, line, known.first(line.split(" "))))
        if out:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["leaf", "t", "line", "into"])

    return stored(map_runs(dealt.select("leaf", "deal", "head", "t", "line"), ["leaf", "deal"], run, "leaf long, t long, line string, into long"), "joined-lines")


def _templates(lines: DataFrame, agree: float, cap: int) -> DataFrame:
    """m, t of the masked lines that are not the first of their template.

    A leaf of at most `cap` lines is one run. Of a larger one, the first lines by hash, about half of `cap`, are one run;
    its templates then go to all later lines of the leaf, in runs of about `cap` lines, and take those that agree. What is
    left begins anew: no template so far agrees with it, so the result is that of a single run. A leaf takes rounds for
    the templates in it, not for its lines.
    """
    sizes = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    hot = stored(sizes.select("leaf", F.col("n"), F.lit(0.0).alias("done")), "hot-leaves")
    n_hot = hot.count()
    left = join_small(lines, hot.select("leaf"), ["leaf"], "left_anti", n_hot) if n_hot else lines
    named = _begun(left, agree).where("t <> into").select(F.col("t").alias("m"), F.col("into").alias("t"))
    if not n_hot:
        return named
    place = (F.col("t").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)  # hashes are spread evenly
    rest = stored(join_small(lines, hot.select("leaf"), ["leaf"], "left_semi", n_hot), "hot-lines")
    while n_hot:
        upto = F.when(F.col("n") <= cap, F.lit(2.0)).otherwise(F.col("done") + (1 - F.col("done")) * (cap / 2) / F.col("n"))
        hot = stored(hot.select("leaf", "n", upto.alias("done")), "hot-leaves")
        all_open = join_small(rest, hot, ["leaf"], "inner", n_hot)
        now = all_open.where(place < F.col("done")).select("leaf", "t", "line")
        begun = _begun(now, agree)
        heads = now.join(begun.where("t = into").select("leaf", "t"), ["leaf", "t"]).select("leaf", F.lit(True).alias("head"), "t", "line")
        parts = hot.select("leaf", F.ceil(F.col("n") / cap).cast("long").alias("k"))
        heads = join_small(heads, parts, ["leaf"], "inner", n_hot).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        later = join_small(all_open.where(place >= F.col("done")).select("leaf", F.lit(False).alias("head"), "t", "line"), parts, ["leaf"], "inner", n_hot)
        later = later.withColumn("deal", F.pmod(F.xxhash64("t", F.lit(1)), F.col("k")))
        found = _joined(later.unionByName(heads), agree)
        named = named.unionByName(begun.where("t <> into").unionByName(found.where("into is not null").select("leaf", "t", "into")).select(F.col("t").alias("m"), F.col("into").alias("t")))
        rest = found.where("into is null").select("leaf", "t", "line")
        hot = stored(join_small(rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), hot.select("leaf", "done"), ["leaf"], "inner", n_hot), "hot-leaves")
        n_hot = hot.count()
    return named


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, agree: float = AGREE, line_docs: int = LINE_DOCS, template_docs: int = TEMPLATE_DOCS, cap: int = 8192, min_chars: int = MIN_CHARS, min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """id, drop array<long>: hashes of the lines to drop from each document that has any. Rows without an id count for nothing.

    cap bounds the lines of a run and has no part in the result. min_chars and min_tokens of 1 hold every line against others.
    """
    form = Form(depth, min_chars, min_tokens, long_tokens)
    rows = stored(_line_rows(docs, id_col, text_col, form).where("id is not null"), "line-hashes")
    same = rows.groupBy("h").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first")).where(F.col("n") >= line_docs)
    same = stored(same.select("h", "first"), "recurring-lines")
    groups = stored(_templates(_crowded_lines(docs, rows, text_col, form), agree, cap).withColumnRenamed("t", "first_line"), "template-groups")
    named = join_small(rows.select("id", "h", "m", "long"), groups, ["m"], "left", groups.count()).select("id", "h", "long", F.coalesce("first_line", "m").alias("t"))
    named = stored(named, "template-lines")
    templates = named.select("id", "t", "long").distinct().groupBy("t", "long").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") >= F.when(F.col("long"), line_docs).otherwise(template_docs))
    templates = stored(templates.select("t", "first"), "recurring-templates")
    by_line = join_small(rows.select("id", "h"), same, ["h"], "inner", same.count()).where("id <> first").select("id", "h")
    by_template = join_small(named.select("id", "h", "t"), templates, ["t"], "inner", templates.count()).where("id <> first").select("id", "h")
    return by_line.union(by_template).groupBy("id").agg(F.collect_set("h").alias("drop"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, **options) -> DataFrame:
    """docs with recurring lines cut from their texts, whole columns and rows; count_col adds how many were cut.

    Blank and short lines stay, as do line ends of what is left. A text that loses all its lines becomes empty; null
    stays null; rows that repeat an id are one document and are cut alike; rows with a null id stay whole, as it cannot be
    said which document of a group comes first; an empty table gives none.
    """
    ident, drop = fresh(docs, "_id", "_drop")
    lists = stored(recurring_lines(docs, id_col, text_col, **options).withColumnsRenamed({"id": ident, "drop": drop}), "lines-to-drop")
    rows, hashes = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(drop)), F.lit(0))).first()
    joined = docs.join(F.broadcast(lists) if rows + hashes <= BROADCAST_HASHES else lists, docs[id_col] == F.col(ident), "left").drop(ident)
    names, at = list(docs.columns), docs.columns.index(text_col)
    form = Form(min_chars=options.get("min_chars", MIN_CHARS))

    def run(batches):
        for b in batches:
            texts, cut = [], []
            for (_, ts), (_, lost) in zip(texts_of(b.column(at)), texts_of(b.column(len(names)))):
                for t, gone in zip(ts, lost):
                    n = 0
                    if t and gone:
                        gone, kept = set(gone), []
                        for line in t.split("\n"):
                            tokens = form.tokens(line)
                            if tokens and _hash(" ".join(tokens)) in gone:
                                n += 1
                            else:
                                kept.append(line)
                        t = "\n".join(kept)
                    texts.append(t)
                    cut.append(n)
            columns = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(cut, pa.int64())] if count_col else [])], [*names, *([count_col] if count_col else [])])

    schema = StructType(docs.schema.fields + ([StructField(count_col, LongType())] if count_col else []))
    return map_arrow(joined, run, schema)
