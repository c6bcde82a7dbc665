"""Best-fit packing with a swap-based local search (operator 6).

One pass over the texts yields pieces of at most `size` tokens; only their lengths and checksums are shuffled. Pieces are
dealt by hash to groups of about `group_rows`; each group is packed alone, best fit decreasing first and then by local
search, so a task holds one bounded group and all groups together lose about one sequence each.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbispan.llm.common import map_arrow, map_runs, stored, texts_of
from orbispan.llm.tokens import text_encoder

GROUP_ROWS = 16_384


def cut_pieces(docs: DataFrame, size: int, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32, spot. A document is its ids and a final id 0; a longer one is cut into pieces of
    `size` tokens, of which the first may be shorter. spot is the document's place in its batch of rows."""

    def run(batches):
        encode = text_encoder(vocabulary)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for lo, texts in texts_of(b.column(1)):
                for i, text in enumerate(texts, lo):
                    ids = encode(text) + b"\0\0\0\0"
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(row, pa.int32())],
                ["id", "piece", "start", "length", "ids_crc32", "spot"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, piece int, start long, length long, ids_crc32 long, spot int")


class Index:
    """Which bins hold an item of a length, or two items of a summed length; a bit mask of the sums finds the next one.

    A bin of `size` tokens has few different lengths (their sum is bounded: 63 for 2048), so all pairs of them are few.
    """

    def __init__(self) -> None:
        self.where: dict[int, set[int]] = {}
        self.held: dict[int, dict[int, tuple]] = {}
        self.mask = 0

    def put(self, b: int, sums: dict[int, tuple]) -> None:
        """Bin b now holds these sums, each with the items that make it, and no others."""
        old = self.held.get(b, {})
        for n in old.keys() - sums.keys():
            at = self.where[n]
            at.discard(b)
            if not at:
                self.mask ^= 1 << n
        for n in sums.keys() - old.keys():
            at = self.where.setdefault(n, set())
            if not at:
                self.mask |= 1 << n
            at.add(b)
        self.held[b] = sums


def _singles(items: list[tuple[int, int]]) -> dict[int, tuple]:
    return {x[0]: (x,) for x in items}


def _pairs(items: list[tuple[int, int]]) -> dict[int, tuple]:
    first: dict[int, list] = {}
    for x in items:
        at = first.setdefault(x[0], [])
        if len(at) < 2:  # equal lengths are interchangeable
            at.append(x)
    flat = [x for at in first.values() for x in at]
    return {x[0] + y[0]: (x, y) for i, x in enumerate(flat) for y in flat[i + 1 :]}


class Bins:
    """Sequences being filled; fill is kept for each, and a sorted list of the items of each."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.items: list[list[tuple[int, int]]] = []  # (length, row), ascending
        self.fill: list[int] = []

    def best_fit(self, lengths: list[int]) -> None:
        """Longest first, each into the fullest bin with room for it: a bit mask of the rooms finds that bin."""
        rooms: list[list[int]] = [[] for _ in range(self.size + 1)]
        mask = 0
        for row in sorted(range(len(lengths)), key=lambda r: (-lengths[r], r)):
            n = lengths[row]
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    mask ^= 1 << room
            else:
                room, b = self.size, len(self.fill)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append((n, row))
            self.fill[b] += n
            if room > n:
                rooms[room - n].append(b)
                mask |= 1 << (room - n)
        for x in self.items:
            x.sort()

    def improve(self) -> None:
        """Moves, one-for-one and two-for-one exchanges between underfull bins while the sum of squared fills grows.

        Each step fills one bin at the cost of an emptier one, so the fill gathers in few bins and the others empty. The
        sum is a bounded integer that grows with each step, so the search ends, and it ends only where no single exchange
        of these kinds between any two underfull bins grows it.
        """
        self.one, self.two = Index(), Index()
        open_bins = [b for b in range(len(self.fill)) if 0 < self.fill[b] < self.size]
        for b in open_bins:
            self._enter(b)
        moved = True
        while moved:
            moved = False
            open_bins = sorted((b for b in open_bins if 0 < self.fill[b] < self.size), key=lambda b: (-self.fill[b], b))
            for b in open_bins:
                while 0 < self.fill[b] < self.size and (step := self._step(b)) is not None:
                    give, other, take = step
                    for src, dst, part in ((b, other, give), (other, b, take)):
                        for item in part:
                            self.items[src].remove(item)
                            insort(self.items[dst], item)
                            self.fill[src] -= item[0]
                            self.fill[dst] += item[0]
                    self._enter(b)
                    self._enter(other)
                    moved = True

    def _enter(self, b: int) -> None:
        """Keep the indexes: a full or empty bin takes part no more."""
        some = 0 < self.fill[b] < self.size
        self.one.put(b, _singles(self.items[b]) if some else {})
        self.two.put(b, _pairs(self.items[b]) if some else {})

    def _step(self, b: int):
        """The exchange with an emptier bin that fills bin b most: (given items, other bin, taken items)."""
        gap, fill, best, gain = self.size - self.fill[b], self.fill[b], None, 0
        # nothing, one or two given for one taken; nothing or one given for two taken
        offers = [(0, (), self.one), (0, (), self.two)]
        offers += [(n, part, index) for n, part in self.one.held[b].items() for index in (self.one, self.two)]
        offers += [(n, part, self.one) for n, part in self.two.held[b].items()]
        for n, give, index in offers:
            window = (index.mask >> (n + 1)) & ((1 << gap) - 1)
            while window and (d := window.bit_length()) > gain:
                window ^= 1 << (d - 1)
                others = [(self.fill[o], o) for o in index.where[n + d] if o != b and self.fill[o] - d < fill]
                if others:
                    o = min(others)[1]
                    best, gain = (give, o, index.held[o][n + d]), d
                    break
            if gain == gap:
                break
        return best


def pack_group(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    bins = Bins(size)
    bins.best_fit(lengths)
    bins.improve()
    place, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for b, items in enumerate(bins.items):
        at = 0
        for n, row in reversed(items):
            place[row], offset[row] = b, at
            at += n
    return place, offset


def pack(docs: DataFrame, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, vocabulary: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece, offsets gapless from 0.

    A null text counts as empty and is the single id 0. Ids may be null and of any atomic type. Repeated rows are packed as
    often as they occur, and their place in a batch deals them to different groups; ties go by the order of id and piece;
    an empty table gives none; texts of any length, long runs of one character included, are cut and packed whole;
    further columns are ignored.
    """
    pieces = stored(cut_pieces(docs, size, id_col, text_col, vocabulary), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "spot"), F.lit(groups))).drop("spot")

    def pack_rows(key, rows):
        rows = rows.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        place, offset = pack_group(rows.column("length").to_pylist(), size)
        rows = rows.append_column("sequence_id", pa.array(place + (key[0] << 32))).append_column("offset", pa.array(offset))
        return rows.to_batches()[0]

    return map_runs(dealt, ["grp"], pack_rows, "grp long, " + _kinds(pieces.drop("spot")) + ", sequence_id long, offset long").drop("grp")


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
