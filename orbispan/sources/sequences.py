"""FASTA, FASTQ, PAF and BLAST readers and writers, through Spark's text reader, and an indexed FASTA data source."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orbispan.functions.reads import tag_value
from orbispan.scratch import checkpointed
from orbispan.sources.order import tagged, with_blocks, with_ordinals

# Parts of contig names that stand for alternative and mitochondrial sequence.
EXCLUDED = ("chrM", "chrUn", "_random", "_alt", "_hap")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return tagged(spark.read.text(path)).select("_file", "_block", "_at", "value")


def _runs(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple[bool, tuple, str]]:
    """(a block begins, (file, block, extras), line) of each row."""
    last = None
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("_file", "_block", *extra)]
        for line, *key in zip(b.column("value").to_pylist(), *cols):
            new = (key[0], key[1]) != last
            last = (key[0], key[1])
            yield new, tuple(key), line


def _fasta_blocks(lines: DataFrame) -> DataFrame:
    """_file, _block, and what goes on from the blocks before: the open contig, its bases so far, and bytes before the block's
    first line. Only a row for each block is looked at across blocks."""

    def summed(batches):
        held = None
        for new, key, line in _runs(batches):
            if new:
                if held:
                    yield _batch([held], "_file", "_block", "last", "bases", "bytes")
                held = [*key, None, 0, 0]
            if line.startswith(">"):
                held[2:4] = _contig(line), 0
            else:
                held[3] += len(line.strip())
            held[4] += len(line.encode()) + 1
        if held:
            yield _batch([held], "_file", "_block", "last", "bases", "bytes")

    blocks = checkpointed(lines.select("_file", "_block", "value").mapInArrow(summed, "_file string, _block long, last string, bases long, bytes long"))
    in_file = Window.partitionBy("_file").orderBy("_block")
    upto = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumns({"_open": F.last("last", ignorenulls=True).over(upto), "_group": F.count("last").over(upto), "_bytes": F.sum("bytes").over(upto) - F.col("bytes")})
    blocks = blocks.withColumn("_sofar", F.sum("bases").over(Window.partitionBy("_file", "_group").orderBy("_block")))
    return checkpointed(blocks.select("_file", "_block", F.lag("_open").over(in_file).alias("_open"), F.coalesce(F.lag("_sofar").over(in_file), F.lit(0)).alias("_sofar"), "_bytes", F.lit(True).alias("_known")))


def _contig(header: str) -> str:
    """First word of a header line; none gives an empty name."""
    return next(iter(header[1:].split()), "")


def _batch(rows: list, *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], list(names))


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """chrom, chunk, seq of pieces of `chunk` bases, upper case; plain or gzipped.

    A line that begins with '>' is a header, and its first word names the contig; '>' elsewhere is text. Lines may have any
    lengths, blanks around them do not count. Blocks of the files are read apart, a contig may span any number of them, and
    no task holds more than a chunk of a contig. A contig without bases has one empty chunk; lines before the first header
    are left out. Names should differ; contigs of one name in different files stay apart and give chunks of one number.
    """
    lines = _lines(spark, path)
    placed = with_blocks(lines, _fasta_blocks(lines)).select("_file", "_block", "_open", "_sofar", "value")

    def cut(batches):
        out, name, at, held, size = [], None, 0, [], 0

        def flush():
            nonlocal held, size
            text, held, size = "".join(held).upper(), [], 0
            start = at - len(text)
            while text:
                room = chunk - start % chunk
                out.append((source, name, start // chunk, start, text[:room]))
                start, text = start + room, text[room:]

        source = None
        for new, (file, _, carried, sofar), line in _runs(batches, "_open", "_sofar"):
            if new:
                flush()
                source, name, at = file, carried, sofar
            if line.startswith(">"):
                flush()
                name, at = _contig(line), 0
                out.append((source, name, 0, -1, ""))
            elif name is not None and (text := line.strip()):
                held.append(text)
                at, size = at + len(text), size + len(text)
                if size >= chunk:
                    flush()
            if len(out) >= 256:
                yield _batch(out, "_file", "chrom", "chunk", "start", "part")
                out = []
        flush()
        if out:
            yield _batch(out, "_file", "chrom", "chunk", "start", "part")

    pieces = placed.mapInArrow(cut, "_file string, chrom string, chunk long, start long, part string")
    for part in excluded:
        pieces = pieces.where(~F.col("chrom").contains(part))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "")
    return pieces.groupBy("_file", "chrom", "chunk").agg(whole.alias("seq")).select("chrom", "chunk", "seq")


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """file, chrom, length, offset, line_bases, line_width of each contig of plain files whose lines end in one byte: byte b of
    a contig stands at offset + b // line_bases * line_width + b % line_bases if all its lines but the last are equal."""
    lines = _lines(spark, path)
    placed = with_blocks(lines, _fasta_blocks(lines)).select("_file", "_block", "_open", "_sofar", "_bytes", "value")

    def found(batches):
        out, name, at, place = [], None, 0, 0
        source, first = None, 0
        for new, (file, _, carried, sofar, before), line in _runs(batches, "_open", "_sofar", "_bytes"):
            if new:
                if name is not None:
                    out.append((source, name, None, at, first))
                source, name, at, place, first = file, carried, sofar, before, 0
            place += len(line.encode()) + 1
            if line.startswith(">"):
                if name is not None:
                    out.append((source, name, None, at, first))
                name, at, first = _contig(line), 0, 0
                out.append((source, name, place, 0, 0))
            elif name is not None:
                first = first or (len(line.strip()) if at == 0 else 0)
                at += len(line.strip())
        if name is not None:
            out.append((source, name, None, at, first))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "chrom", "offset", "length", "line_bases"])

    seen = placed.mapInArrow(found, "file string, chrom string, offset long, length long, line_bases long")
    agg = seen.groupBy("file", "chrom").agg(F.max("length").alias("length"), F.max("offset").alias("offset"), F.max("line_bases").alias("line_bases"))
    return agg.withColumn("line_width", F.col("line_bases") + 1)


def write_index(index: DataFrame, path: str, files: bool = False) -> None:
    """Index rows, one for each contig, as lines of five fields in the order of file and offset; files: with the file as a
    sixth field, for sequences in several files."""
    fields = ["chrom", "length", "offset", "line_bases", "line_width"] + ["file"] * files
    index.coalesce(1).sortWithinPartitions("file", "offset").select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)


#: Bases that a task reads from an indexed file.
RANGE_BASES = 1 << 26


class IndexedFasta(DataSource):
    """Chunks of a plain FASTA file by its index: options path, index (default: path + '.fai'), chunk,
    excluded (comma-separated), contigs (tab-separated; others are not read).

    A task reads ranges of bytes, whatever the contigs' lengths. Filters are not pushed down: Spark keeps one set of ranges for
    a table that is used under several filters, so contigs are named when the table is made. An index line's sixth field, if
    there is one, names another file than path; the index may be a folder that Spark wrote. Paths are opened through Arrow,
    so they must be of a kind that it knows (local, S3, GCS, HDFS with its library).
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_fasta"

    def schema(self) -> str:
        return "chrom string, chunk long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _IndexedReader(dict(self.options))


def _located(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("/"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _opened(uri: str):
    """A random-access file of a path or URI."""
    fs, path = _located(uri)
    return fs.open_input_file(path)


def _text(uri: str) -> str:
    """A file, or all files that Spark wrote to a folder."""
    fs, path = _located(uri)
    if fs.get_file_info(path).type != pa.fs.FileType.Directory:
        paths = [path]
    else:
        paths = sorted(x.path for x in fs.get_file_info(pa.fs.FileSelector(path)) if x.base_name.startswith("part-"))
    return "".join(fs.open_input_file(p).read().decode() for p in paths)


class _IndexedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.index = options.get("index") or f"{self.path}.fai"
        self.chunk = int(options.get("chunk") or 1 << 16)
        self.excluded = tuple(x for x in (options.get("excluded") or "").split(",") if x)
        only = options.get("contigs")
        self.only: set[str] | None = None if only is None else set(only.split("\t"))

    def partitions(self) -> list[InputPartition]:
        out, room, mine = [], RANGE_BASES, []
        for line in _text(self.index).splitlines():
            if not line.strip():
                continue
            name, *numbers = line.split("\t")
            length, offset, bases, width = map(int, numbers[:4])
            file = numbers[4] if len(numbers) > 4 else self.path
            if any(x in name for x in self.excluded) or self.only is not None and name not in self.only:
                continue
            step = max(self.chunk, RANGE_BASES // self.chunk * self.chunk)
            for start in range(0, max(length, 1), step):
                end = min(length, start + step)
                mine.append((file, name, start, end, offset, bases, width))
                room -= end - start + 1
                if room <= 0:
                    out, room, mine = [*out, InputPartition(mine)], RANGE_BASES, []
        return [*out, InputPartition(mine)] if mine or not out else out

    def read(self, partition: InputPartition):
        for file, ranges in groupby(partition.value, key=lambda r: r[0]):
            with _opened(file) as f:
                for _, name, start, end, offset, bases, width in ranges:
                    at = lambda b: offset + b // bases * width + b % bases if bases else offset  # noqa: B023, E731
                    for lo in range(start, max(end, start + 1), self.chunk):
                        hi = min(end, lo + self.chunk)
                        f.seek(at(lo))
                        text = f.read(at(hi - 1) + 1 - at(lo)) if hi > lo else b""
                        yield name, lo // self.chunk, b"".join(text.split()).decode().upper()


def read_indexed_fasta(spark: SparkSession, path: str, index: str | None = None, chunk: int = 1 << 16, excluded: tuple[str, ...] = EXCLUDED, contigs: list[str] | None = None) -> DataFrame:
    """The rows of read_fasta from the byte ranges that an index gives; contigs: of these alone, and no others are read."""
    spark.dataSource.register(IndexedFasta)
    reader = spark.read.format("indexed_fasta").option("path", path).option("chunk", str(chunk)).option("excluded", ",".join(excluded))
    reader = reader.option("index", index) if index else reader
    return (reader if contigs is None else reader.option("contigs", "\t".join(contigs))).load()


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, record, read_id, name, seq, quality of every four lines of each file, in whichever blocks they lie.

    read_id is the first line without '@' and blanks around it, name its first word. A line's meaning is its place in the
    file alone, so quality lines may begin with '@'. Records within a block are put together where they are read; only those
    that a block's border cuts are shuffled. A last record with lines missing has nulls; blank lines at the end are none.
    """
    lines = with_ordinals(spark.read.text(path), in_file="line", file="file").select("file", "line", "value")

    def framed(cut: bool):
        def run(batches):
            held: pa.Table | None = None
            for b in (*batches, None):
                if b is not None:
                    held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
                if held is None or not held.num_rows:
                    continue
                file = held.column("file").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                record = held.column("line").to_numpy() // 4
                starts = np.concatenate([[0], np.flatnonzero((record[1:] != record[:-1]) | (file[1:] != file[:-1])) + 1])
                sizes = np.diff(np.append(starts, held.num_rows))
                # the last record may go on in the next batch
                stop = int(starts[-1]) if b is not None and sizes[-1] < 4 else held.num_rows
                starts, sizes = starts[starts < stop], sizes[starts < stop]
                if cut:
                    rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes) if n < 4] or [np.zeros(0, dtype=np.int64)])
                    yield from held.take(pa.array(rows, pa.int64())).to_batches()
                else:
                    at = starts[sizes == 4]
                    value = held.column("value")
                    yield from pa.table([held.column("file").take(pa.array(at)), pa.array(record[at]), *[value.take(pa.array(at + j)) for j in (0, 1, 3)]], ["file", "record", "head", "seq", "quality"]).combine_chunks().to_batches()
                held = held.slice(stop)

        return run

    whole = lines.mapInArrow(framed(False), "file string, record long, head string, seq string, quality string")
    rest = lines.mapInArrow(framed(True), "file string, line long, value string")
    field = lambda j: F.max(F.when(F.col("line") % 4 == j, F.col("value")))
    rest = rest.groupBy("file", F.expr("line div 4").alias("record")).agg(field(0).alias("head"), field(1).alias("seq"), field(3).alias("quality"))
    rest = rest.where((F.trim("head") != "") | F.col("seq").isNotNull())
    header = F.trim(F.regexp_replace("head", r"^\s*@+", ""))
    return whole.unionByName(rest).select("file", "record", header.alias("read_id"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), "seq", "quality")


def read_fastq_ids(spark: SparkSession, path: str) -> DataFrame:
    """read_id of every record."""
    return read_fastq(spark, path).select("read_id")


def write_fastq(reads: DataFrame, path: str, by_name: bool = False) -> None:
    """read_id, seq, quality as records of four lines. by_name: the files, in order of their names, hold the reads in order of
    read_id (bytewise), equal ones by sequence and quality; they are dealt to ranges of all three, so one name may have any
    share of the reads."""
    order = ["read_id", "seq", "quality"]
    rows = reads.select(*order)
    if by_name:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), "quality").alias("value")).write.mode("overwrite").text(path)


_PAF = ("query", "query_length", "query_start", "query_end", "strand", "target", "target_length", "target_start", "target_end", "matches", "aligned", "mapq")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Twelve PAF columns with divergence and cs of the tags."""
    f = F.split("value", "\t")
    t = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 12)
    cols = [(F.col("f")[i] if n in ("query", "strand", "target") else F.col("f")[i].try_cast("bigint")).alias(n) for i, n in enumerate(_PAF)]
    tags = F.slice("f", 13, 1000)
    return t.select(*cols, tag_value(tags, "de:f:").try_cast("double").alias("divergence"), tag_value(tags, "cs:Z:").alias("cs"))


def read_blast(spark: SparkSession, path: str, min_identity: float = 0.0, min_length: int = 0) -> DataFrame:
    """Tabular BLAST with 14 columns, filtered by identity and length."""
    schema = "name string, sseqid string, pident double, length bigint, mismatch bigint, gapopen bigint, qstart bigint, qend bigint, sstart bigint, send bigint, evalue double, bitscore double, qlen bigint, slen bigint"
    return spark.read.csv(path, sep="\t", schema=schema, comment="#").where((F.col("pident") >= min_identity) & (F.col("length") >= min_length))


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 80) -> None:
    """Records with lines of `width` bases, one text file a partition."""
    lines = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)
