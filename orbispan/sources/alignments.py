"""Alignments in block-compressed binary files: a data source, a sink and the table of references."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from orbispan.sources.sequences import _located, _opened

SCHEMA = "name string, flag int, contig string, start long, end long, mapq int, cigar string, next_contig string, next_start long, template_length long, seq string, quality string, tags array<string>"
_ARROW = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("next_contig", pa.string()), ("next_start", pa.int64()), ("template_length", pa.int64()), ("seq", pa.string()), ("quality", pa.string()), ("tags", pa.list_(pa.string()))])

# Fixed values of the public format: letters of bases and operations by code, blocks, tag types, the bin of counts.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
BLOCK_HEAD = b"\x1f\x8b\x08\x04"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 0xFF00
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
COUNTS_BIN = 37450
MOST_OPERATIONS = 65535

_LETTERS = str.maketrans("0123456789abcdef", BASES)
_NIBBLES = {c: i for i, c in enumerate(BASES)}
_OPS = re.compile(f"(\\d+)([{OPERATIONS}])")
_ON_REFERENCE = frozenset("MDN=X")

#: Compressed bytes that a task reads, and rows of a batch.
RANGE_BYTES, ROWS = 64 << 20, 4096
#: Records in a row that must fit for a place to be taken as the start of one.
CHAIN = 8


class _Blocks:
    """The inflated bytes from a block on, kept from the record that is read to as far as was asked for."""

    def __init__(self, f, size: int, at: int) -> None:
        self.f, self.size, self.next = f, size, at
        self.data, self.base = bytearray(), 0
        self.marks: list[tuple[int, int]] = []  # (place in the inflated bytes, offset of the block), empty blocks left out

    def more(self) -> bool:
        while self.next < self.size:
            self.f.seek(self.next)
            raw = self.f.read(min(1 << 16, self.size - self.next))
            length = _block_length(raw)
            if length is None or length > len(raw):
                raise ValueError(f"no whole block at byte {self.next}")
            body = _inflated(raw[:length])
            if body is None:
                raise ValueError(f"damaged block at byte {self.next}")
            at, self.next = self.next, self.next + length
            if body:
                self.marks.append((self.base + len(self.data), at))
                self.data += body
                return True
        return False

    def take(self, at: int, n: int) -> bytes | None:
        """n bytes at a place; None if the file ends at the place, an error if it ends within them."""
        while self.base + len(self.data) < at + n:
            if not self.more():
                if self.base + len(self.data) <= at:
                    return None
                raise ValueError("the file ends within a record")
        return bytes(memoryview(self.data)[at - self.base : at - self.base + n])

    def place(self, at: int) -> tuple[int, int] | None:
        """(offset of the block, place in it) of a place; None at the end of the file."""
        while self.base + len(self.data) <= at:
            if not self.more():
                return None
        i = bisect_left(self.marks, (at + 1, -1)) - 1
        return self.marks[i][1], at - self.marks[i][0]

    def forget(self, at: int) -> None:
        if at - self.base > 1 << 22:
            del self.data[: at - self.base]
            self.base = at
            keep = bisect_left(self.marks, (at + 1, -1)) - 1
            self.marks = self.marks[max(keep, 0) :]


def _block_length(raw: bytes) -> int | None:
    """The length that a block's head states; None if it is no head."""
    if len(raw) < 18 or raw[:4] != BLOCK_HEAD:
        return None
    (extra,) = struct.unpack_from("<H", raw, 10)
    at = 12
    while at + 4 <= min(12 + extra, len(raw)):
        (n,) = struct.unpack_from("<H", raw, at + 2)
        if raw[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(raw):
            return struct.unpack_from("<H", raw, at + 4)[0] + 1
        at += 4 + n
    return None


def _inflated(block: bytes) -> bytes | None:
    (extra,) = struct.unpack_from("<H", block, 10)
    crc, size = struct.unpack_from("<II", block, len(block) - 8)
    try:
        body = zlib.decompress(block[12 + extra : -8], -15)
    except zlib.error:
        return None
    return body if len(body) == size and zlib.crc32(body) == crc else None


def _deflated(body: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(body) + z.flush()
    return BLOCK_HEAD + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(body), len(body))


def _first_block(f, size: int, lo: int) -> int:
    """Offset of the first block at or after a byte; the file's size if there is none. What looks like a head within a block's
    bytes falls away, as it does not inflate to the length and check sum that follow it."""
    at = lo
    while at < size:
        f.seek(at)
        raw = f.read(min(1 << 17, size - at))
        found = raw.find(BLOCK_HEAD)
        while found >= 0 and found < 1 << 16:
            length = _block_length(raw[found : found + 1024])
            if length is not None and found + length <= len(raw) and _inflated(raw[found : found + length]) is not None:
                return at + found
            found = raw.find(BLOCK_HEAD, found + 1)
        at += 1 << 16
    return size


@dataclass
class _Header:
    text: str
    names: list[str]
    sizes: np.ndarray
    end: tuple[int, int] | None  # where the first record begins


def _header(path: str) -> _Header:
    with _opened(path) as f:
        blocks = _Blocks(f, f.size(), 0)
        if blocks.take(0, 4) != b"BAM\x01":
            raise ValueError(f"{path} holds no alignments of the binary format")
        number = lambda at: struct.unpack("<i", blocks.take(at, 4))[0]
        n = number(4)
        text, at = blocks.take(8, n) or b"", 8 + n
        count, at = number(at), at + 4
        names, sizes = [], np.zeros(count, dtype=np.int64)
        for i in range(count):
            n = number(at)
            names.append(blocks.take(at + 4, n)[:-1].decode())
            sizes[i] = number(at + 4 + n)
            at += 8 + n
        return _Header(text.rstrip(b"\0").decode(), names, sizes, blocks.place(at))


def _fits(fields: tuple, n: int, sizes: np.ndarray) -> bool:
    """Whether a record's fixed fields can be those of one of n bytes."""
    ref, pos, name, _, _, ops, _, bases, next_ref, next_pos, _ = fields
    if not (-1 <= ref < len(sizes) and -1 <= next_ref < len(sizes) and name and bases >= 0 and pos >= -1 and next_pos >= -1):
        return False
    if (ref >= 0 and pos > sizes[ref]) or (next_ref >= 0 and next_pos > sizes[next_ref]):
        return False
    return 32 + name + 4 * ops + (bases + 1) // 2 + bases <= n


_FIXED = struct.Struct("<iiBBHHHiiii")


def _chained(blocks: _Blocks, at: int, sizes: np.ndarray) -> bool:
    """Whether CHAIN records, or all up to the end of the file, can follow each other from a place on."""
    for i in range(CHAIN):
        try:
            head = blocks.take(at, 36)
            if head is None:
                return i > 0
            (n,), fields = struct.unpack_from("<i", head), _FIXED.unpack_from(head, 4)
            if n < 32 or not _fits(fields, n, sizes):
                return False
            name = blocks.take(at + 36, fields[2])
        except ValueError:
            return False
        if not name or name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
            return False
        at += 4 + n
    return True


def _first_record(path: str, f, lo: int, sizes: np.ndarray) -> tuple[int, int] | None:
    """Where the first record begins that begins in a block at or after a byte: the first place from which records follow each
    other. None if there is none."""
    size = f.size()
    blocks = _Blocks(f, size, _first_block(f, size, lo))
    at = 0
    while blocks.take(at, 1) is not None:
        upto = blocks.base + len(blocks.data)
        raw = np.frombuffer(bytes(blocks.data[at:]), dtype=np.uint8)
        if len(raw) < 36 and blocks.more():
            continue
        # places at which the references and the lengths can be meant, all at once
        places = len(raw) - 35
        if places > 0:
            ints = lambda k: np.ndarray(places, "<i4", raw[k:].tobytes(), 0, (1,))  # noqa: B023, E731
            n, ref, next_ref, bases = ints(0), ints(4), ints(24), ints(20)
            good = (n >= 32) & (ref >= -1) & (ref < len(sizes)) & (next_ref >= -1) & (next_ref < len(sizes)) & (bases >= 0) & (bases <= n)
            for i in np.flatnonzero(good):
                if _chained(blocks, at + int(i), sizes):
                    return blocks.place(at + int(i))
            at += places
        if blocks.base + len(blocks.data) == upto and not blocks.more():
            return None
    return None


def _tags(raw: bytes) -> list[str]:
    out, at = [], 0
    while at < len(raw):
        tag, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in "ZH":
            stop = raw.index(0, at)
            out.append(f"{tag}:{kind}:{raw[at:stop].decode()}")
            at = stop + 1
        elif kind == "A":
            out.append(f"{tag}:A:{chr(raw[at])}")
            at += 1
        elif kind == "B":
            inner, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[inner]}", raw, at + 5)
            out.append(f"{tag}:B:{','.join([inner, *map(_number, values)])}")
            at += 5 + n * struct.calcsize(NUMBERS[inner])
        else:
            (value,) = struct.unpack_from("<" + NUMBERS[kind], raw, at)
            out.append(f"{tag}:{'f' if kind == 'f' else 'i'}:{_number(value)}")
            at += struct.calcsize(NUMBERS[kind])
    return out


def _number(value) -> str:
    return str(np.float32(value)) if isinstance(value, float) else str(value)


def _cigar(raw: bytes) -> tuple[str | None, int]:
    """Operations as text and how many bases of the reference they take."""
    codes = np.frombuffer(raw, dtype="<u4")
    parts = [(int(c) >> 4, OPERATIONS[c & 15]) for c in codes]
    return "".join(f"{n}{o}" for n, o in parts) or None, sum(n for n, o in parts if o in _ON_REFERENCE)


def _row(raw: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, ops, flag, bases, next_ref, next_pos, template = _FIXED.unpack_from(raw)
    at = 32 + n_name
    name = raw[32 : at - 1].decode()
    cigar, span = _cigar(raw[at : at + 4 * ops])
    at += 4 * ops
    seq = raw[at : at + (bases + 1) // 2].hex().translate(_LETTERS)[:bases] or None
    at += (bases + 1) // 2
    quality = raw[at : at + bases]
    quality = None if not bases or quality[0] == 255 else bytes(min(q, 93) + 33 for q in quality).decode()
    tags = _tags(raw[at + bases :])
    if ops == 2 and cigar == f"{bases}S{span}N":  # more operations than their field can count stand in a tag
        for i, t in enumerate(tags):
            if t.startswith("CG:B:I,"):
                cigar, span = _cigar(np.array(t[7:].split(","), dtype="<u4").tobytes())
                del tags[i]
                break
    contig, mate = names[ref] if ref >= 0 else None, names[next_ref] if next_ref >= 0 else None
    start, end = (pos if pos >= 0 else None), (pos + span if pos >= 0 and span else None)
    return name or None, flag, contig, start, end, mapq, cigar, mate, next_pos if next_pos >= 0 else None, template, seq, quality, tags


def _index(path: str) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """Chunks and first places by windows of 16,384 bases of each reference, places as block offset << 16 | place in it."""
    with _opened(path) as f:
        raw = f.read()
    if raw[:4] != b"BAI\x01":
        raise ValueError(f"{path} is no index of alignments")
    (refs,), at = struct.unpack_from("<i", raw, 4), 8
    chunks, windows = [], []
    for _ in range(refs):
        (bins,), at = struct.unpack_from("<i", raw, at), at + 4
        mine = []
        for _ in range(bins):
            number, n = struct.unpack_from("<Ii", raw, at)
            flat = struct.unpack_from(f"<{2 * n}Q", raw, at + 8)
            at += 8 + 16 * n
            if number != COUNTS_BIN:
                mine += zip(flat[::2], flat[1::2])
        (n,), at = struct.unpack_from("<i", raw, at), at + 4
        chunks.append(sorted(mine))
        windows.append(list(struct.unpack_from(f"<{n}Q", raw, at)))
        at += 8 * n
    return chunks, windows


class Alignments(DataSource):
    """Alignments of a binary file, or of a folder's *.bam files: options path, index (true: '.bai' beside each file), range_bytes,
    contigs (tab-separated: rows of others and without a contig are left out), least_start (with contigs: rows before it are, too).

    Rows have `start` from 0 and `end` beyond the last base; what the format marks as absent is null. Tasks read ranges of
    compressed bytes. A range's first record is the first place from which records can follow each other; each task holds the
    place where its own records end against the one that the next range would find, so that a wrong guess is an error, never
    a wrong table. With an index, ranges begin where it says, and those of other contigs or before the least start are not read.
    Filters are not pushed down: Spark keeps one set of ranges for a table that is used under several filters. A truncated
    or damaged file is an error. The header goes to every task that reads the file.
    """

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), [f.name for f in schema.fields], overwrite)


def _files(uri: str) -> list[str]:
    fs, path = _located(uri)
    if fs.get_file_info(path).type != pa.fs.FileType.Directory:
        return [uri]
    head = uri.rstrip("/")
    return [f"{head}/{n}" for n in sorted(x.base_name for x in fs.get_file_info(pa.fs.FileSelector(path))) if n.endswith(".bam") and n[0] not in "._"]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.indexed = options.get("index", "false").lower() == "true"
        self.step = int(options.get("range_bytes") or RANGE_BYTES)
        only = options.get("contigs")
        self.only: set[str] | None = None if only is None else set(only.split("\t"))
        self.least = int(options.get("least_start") or 0)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            if self.indexed:
                out += self._by_index(path)
                continue
            with _opened(path) as f:
                size = f.size()
            out += [InputPartition((path, lo, min(lo + self.step, size))) for lo in range(0, size, self.step)]
        return out or [InputPartition(None)]

    def _by_index(self, path: str) -> list[InputPartition]:
        """Ranges of places (from, before); the last one is open where all contigs are wanted, for reads without a place."""
        head = _header(path)
        if head.end is None:
            return []
        chunks, windows = _index(f"{path}.bai")
        first = head.end[0] << 16 | head.end[1]
        cuts = sorted({first, *(c[0] for mine in chunks for c in mine), *(w for mine in windows for w in mine if w)})
        spans = [(first, None)]
        if self.only is not None:
            spans = []
            for name, mine, places in zip(head.names, chunks, windows):
                if name in self.only and mine:
                    lo, w = mine[0][0], self.least >> 14
                    if w >= len(places) and self.least:
                        continue  # nothing of the contig reaches so far
                    spans.append((max(lo, places[w]) if self.least else lo, max(c[1] for c in mine)))
        out = []
        for lo, hi in spans:
            at = lo
            for c in cuts[bisect_left(cuts, lo + 1) :]:
                if hi is not None and c >= hi:
                    break
                if (c >> 16) - (at >> 16) >= self.step:
                    out.append(InputPartition((path, at, c, True)))
                    at = c
            out.append(InputPartition((path, at, hi, True)))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, lo, hi, *known = partition.value
        head = _header(path)
        wanted = None if self.only is None else {i for i, n in enumerate(head.names) if n in self.only}
        if self.only is not None and not wanted:
            return
        with _opened(path) as f:
            if known:
                begin, stop = (lo >> 16, lo & 0xFFFF), None if hi is None else (hi >> 16, hi & 0xFFFF)
            else:
                begin, stop = head.end if lo == 0 else _first_record(path, f, lo, head.sizes), (hi, 0)
                if begin is not None and head.end is not None and lo:
                    begin = max(begin, head.end)
                if head.end is None or begin is None or begin[0] >= hi and lo:
                    return
            blocks = _Blocks(f, f.size(), begin[0])
            at, rows = begin[1], []
            while (here := blocks.place(at)) is not None and (stop is None or here < stop):
                (n,) = struct.unpack("<i", blocks.take(at, 4))
                if n < 32:
                    raise ValueError(f"{path}: no record at {here}")
                raw = blocks.take(at + 4, n)
                if raw is None:
                    raise ValueError(f"{path}: the file ends within a record")
                at += 4 + n
                blocks.forget(at)
                ref, pos = struct.unpack_from("<ii", raw)
                if wanted is None or ref in wanted and pos >= self.least:
                    rows.append(_row(raw, head.names))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
            if not known and hi < f.size() and (found := _first_record(path, f, hi, head.sizes)) != here:
                raise ValueError(f"{path}: records after byte {hi} begin at {here}, not at {found}; read it with an index or another range_bytes")
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _tag_bytes(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    head = name.encode() + kind.encode()
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value.encode()[:1]
    if kind == "B":
        inner, *values = value.split(",")
        put = float if inner == "f" else int
        return head + inner.encode() + struct.pack(f"<I{len(values)}{NUMBERS[inner]}", len(values), *map(put, values))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    number = int(value)
    return name.encode() + (b"i" + struct.pack("<i", number) if number < 1 << 31 else b"I" + struct.pack("<I", number))


def _bin(start: int, end: int) -> int:
    """The smallest bin of the format's five levels that holds a stretch."""
    end -= 1
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if start >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def _record(r: dict, ids: dict[str, int]) -> tuple[bytes, int, int, int]:
    """A row's bytes with its reference, start and end; a contig that the header lacks is an error."""
    name = (r["name"] or "").encode()
    ref = -1 if r["contig"] is None else ids[r["contig"]]
    mate = -1 if r["next_contig"] is None else ids[r["next_contig"]]
    pos, next_pos = (-1 if r[c] is None else r[c] for c in ("start", "next_start"))
    ops = [(int(n), o) for n, o in _OPS.findall(r["cigar"] or "")]
    span = sum(n for n, o in ops if o in _ON_REFERENCE)
    codes, tags = [n << 4 | OPERATIONS.index(o) for n, o in ops], b"".join(map(_tag_bytes, r["tags"] or ()))
    seq = r["seq"] or ""
    if len(codes) > MOST_OPERATIONS:
        tags += b"CGBI" + struct.pack(f"<I{len(codes)}I", len(codes), *codes)
        codes = [len(seq) << 4 | 4, span << 4 | 3]
    nibbles = [_NIBBLES.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2]))
    quality = bytes(ord(c) - 33 for c in r["quality"]) if r["quality"] is not None and len(r["quality"]) == len(seq) else b"\xff" * len(seq)
    end = pos + max(span, 1)
    fixed = _FIXED.pack(ref, pos, len(name) + 1, r["mapq"] or 0, _bin(pos, end) & 0xFFFF if pos >= 0 else 4680, len(codes), r["flag"] or 0, len(seq), mate, next_pos, r["template_length"] or 0)
    raw = fixed + name + b"\0" + struct.pack(f"<{len(codes)}I", *codes) + packed + quality + tags
    return struct.pack("<i", len(raw)) + raw, ref, pos, end


@dataclass
class _Done(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """A whole file with its index for each partition of rows, which must be in the order of references and starts."""

    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool) -> None:
        self.path, self.columns, self.overwrite = options["path"].rstrip("/"), columns, overwrite
        self.contigs = [(n, int(s)) for n, s in (x.rsplit(":", 1) for x in options["contigs"].split("\t"))] if options.get("contigs") else []
        self.job = uuid.uuid4().hex

    def write(self, rows) -> _Done:
        from pyspark import TaskContext

        fs, path = _located(self.path)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.job[:8]}.bam"
        mine = f"_{name}-{context.taskAttemptId()}"
        ids = {n: i for i, (n, _) in enumerate(self.contigs)}
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{s}\n" for n, s in self.contigs)
        head = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(ids))
        head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in self.contigs)
        bins: list[dict[int, list[list[int]]]] = [{} for _ in ids]
        windows: list[dict[int, int]] = [{} for _ in ids]
        last = None
        with fs.open_output_stream(f"{path}/{mine}") as out:
            done = 0
            for i in range(0, len(head), BLOCK_BYTES):
                done += out.write(_deflated(head[i : i + BLOCK_BYTES]))
            held = bytearray()
            for row in rows:
                raw, ref, pos, end = _record(dict(zip(self.columns, row)), ids)
                key = (ref if ref >= 0 else len(ids), pos)
                if last is not None and key < last:
                    raise ValueError("alignments must be in the order of references and starts")
                last = key
                # a record that the block has no room for begins a new one; longer ones go over several
                if held and len(held) + len(raw) > BLOCK_BYTES:
                    done += out.write(_deflated(bytes(held)))
                    held.clear()
                begin = done << 16 | len(held)
                held += raw
                while len(held) > BLOCK_BYTES:
                    done += out.write(_deflated(bytes(held[:BLOCK_BYTES])))
                    del held[:BLOCK_BYTES]
                if ref >= 0 and pos >= 0:
                    chunks = bins[ref].setdefault(_bin(pos, end), [])
                    after = done << 16 | len(held)
                    if chunks and chunks[-1][1] == begin:
                        chunks[-1][1] = after
                    else:
                        chunks.append([begin, after])
                    for w in range(pos >> 14, (end - 1 >> 14) + 1):
                        windows[ref].setdefault(w, begin)
            if held:
                out.write(_deflated(bytes(held)))
            out.write(END_BLOCK)
        with fs.open_output_stream(f"{path}/{mine}.bai") as out:
            out.write(b"BAI\x01" + struct.pack("<i", len(ids)))
            for ours, places in zip(bins, windows):
                out.write(struct.pack("<i", len(ours)))
                for number, chunks in sorted(ours.items()):
                    out.write(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(v for c in chunks for v in c)))
                filled, before = [], 0
                for w in range(max(places, default=-1) + 1):
                    before = places.get(w, before)
                    filled.append(before)
                out.write(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        return _Done([(mine, name), (f"{mine}.bai", f"{name}.bai")])

    def commit(self, messages) -> None:
        fs, path = _located(self.path)
        old = [x.base_name for x in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if x.base_name.endswith((".bam", ".bai")) and x.base_name.startswith("part-")]
        for m in messages:
            for mine, name in m.names if m else ():
                fs.move(f"{path}/{mine}", f"{path}/{name}")
        if self.overwrite:
            for name in old:
                fs.delete_file(f"{path}/{name}")

    def abort(self, messages) -> None:
        fs, path = _located(self.path)
        for m in messages:
            for mine, _ in m.names if m else ():
                fs.delete_file(f"{path}/{mine}")


def read_bam(spark: SparkSession, path: str, index: bool = False, range_bytes: int = RANGE_BYTES, contigs: list[str] | None = None, least_start: int = 0) -> DataFrame:
    """name, flag, contig, start, end, mapq, cigar, next_contig, next_start, template_length, seq, quality, tags of each
    alignment of a file or of a folder's files.

    contigs: of these alone, and of these from least_start on; with the index ('.bai' beside each file) other ranges are not read.
    """
    spark.dataSource.register(Alignments)
    reader = spark.read.format("alignments").option("path", path).option("index", str(index).lower()).option("range_bytes", str(range_bytes))
    return (reader if contigs is None else reader.option("contigs", "\t".join(contigs)).option("least_start", str(least_start))).load()


def read_bam_references(spark: SparkSession, path: str) -> DataFrame:
    """contig, size by the header of a file, or of a folder's first; in the order of the header under `ordinal`."""
    files = _files(path)
    head = _header(files[0]) if files else None
    rows = [(i, n, int(s)) for i, (n, s) in enumerate(zip(head.names, head.sizes))] if head else []
    return spark.createDataFrame(rows, "ordinal int, contig string, size long")


def write_bam(alignments: DataFrame, path: str, contigs: list[tuple[str, int]]) -> None:
    """Rows of read_bam's columns as files with an index each, in the order of contigs and starts, reads without a place last.

    contigs: name and size in the header's order. Rows are dealt to ranges of contig, start, name and flag, so one contig may
    hold any share of the rows; each file holds a range. Missing columns are absent fields.
    """
    spark = alignments.sparkSession
    spark.dataSource.register(Alignments)
    have = set(alignments.columns)
    wanted = [c.strip().split(" ", 1) for c in re.sub(r"array<string>", "array_string", SCHEMA).split(",")]
    rows = alignments.select(*[(F.col(n) if n in have else F.lit(None)).cast(t.replace("array_string", "array<string>")).alias(n) for n, t in wanted])
    order = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(contigs)], "_at int, contig string")
    placed = rows.join(F.broadcast(order), "contig", "left").withColumn("_at", F.coalesce("_at", F.lit(len(contigs)))).withColumn("_from", F.coalesce("start", F.lit(-1)))
    keys = ["_at", "_from", "name", "flag"]
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*[n for n, _ in wanted])
    placed.write.format("alignments").mode("overwrite").option("path", path).option("contigs", "\t".join(f"{n}:{s}" for n, s in contigs)).save()
