"""FASTQ as a Spark data source, batch and streaming, plain or gzip.

Plain files are read in byte ranges by many tasks; a task starts at the first record that
begins in its range. So are block-gzip files, whose blocks a first pass counts; other gzip cannot
be split, so such a file is one task, and its reads are spread afterwards. A row's ``offset`` is
the (decompressed) byte at which its record begins, which orders the reads of a file.
"""

from __future__ import annotations

import gzip
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandweave.session import save_scratch, spread
from strandweave.sources import block_gzip

SCHEMA = (
    "file string, mate int, offset bigint, number bigint, range_start bigint, place bigint, "
    "name string, seq string, qual string"
)
SPLIT_BYTES = 128 << 20
BLOCK_BYTES = 8 << 20
#: Read at a time once a range is over and only its last record may go on.
TAIL_BYTES = 1 << 14

# A read id is the number of its file in the high bits and the record's offset in the low ones.
OFFSET_BITS = 43


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[pafs.FileInfo]:
    """The file itself, or the files of a folder in order of time and name."""
    fs, name = _open(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(name, recursive=False))
    kept = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted(kept, key=lambda f: (f.mtime_ns, f.path))


def _is_gzip(name: str) -> bool:
    return name.lower().endswith(".gz")


@dataclass
class FastqRange(InputPartition):
    """Records that begin in ``[start, stop)`` of a file; a negative ``stop`` is its end.

    In a block-gzip file ``block`` is the place of the block that holds decompressed byte ``start``, and
    ``after_line`` says whether a line ends right before it.
    """

    root: str
    path: str
    start: int
    stop: int
    number: int = 0
    block: int | None = None
    after_line: bool = True


@dataclass
class FastqRanges(InputPartition):
    """Ranges that one task reads one after another."""

    parts: list[FastqRange]


#: Tasks over which the ranges of a path are dealt at most; more ranges than this share tasks.
MOST_TASKS = 1024


def _dealt(ranges: list[FastqRange]) -> list[FastqRanges]:
    each = max(-(-len(ranges) // MOST_TASKS), 1)
    return [FastqRanges(ranges[i : i + each]) for i in range(0, len(ranges), each)]


def _records_begin(lines: list[bytes]) -> int | None:
    """First line that opens a record. A quality line may begin with ``@`` too, but then the
    line two below is bases, never ``+``."""
    for i in range(len(lines) - 2):
        if lines[i].startswith(b"@") and lines[i + 2].startswith(b"+"):
            return i
    return None


def _blocks(stream, start: int, rest: bytes = b"", stop: int = -1) -> Iterator[tuple[int, list[bytes]]]:
    """Whole lines with the offset of the first; the unfinished line is carried over.

    ``rest`` is what stands before the stream, from ``start`` on. Little is read beyond ``stop``, if there is one.
    """
    at = start
    ahead = start + len(rest)
    while True:
        wanted = BLOCK_BYTES if stop < 0 else min(max(stop - ahead, TAIL_BYTES), BLOCK_BYTES)
        block = stream.read(wanted)
        ahead += len(block)
        if not block:
            if rest:
                yield at, [rest]
            return
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        if lines:
            yield at, lines
            at += sum(map(len, lines)) + len(lines)


def _read_range(part: FastqRange) -> Iterator[tuple[list[int], list[bytes]]]:
    """Record offsets and their lines, four per record."""
    fs, _ = _open(part.root)
    if part.block is not None:
        raw = fs.open_input_file(part.path)
        raw.seek(part.block)
        stream = gzip.open(raw, "rb")
    elif _is_gzip(part.path):
        stream = gzip.open(fs.open_input_stream(part.path, compression=None), "rb")
    else:
        stream = fs.open_input_file(part.path)
    with stream:
        synced = part.start == 0
        before = b""
        if part.block is not None:
            before = b"" if synced else b"\n" if part.after_line else b" "
        elif not synced:
            # Step back one byte: a record right at the start has a line break before it.
            stream.seek(part.start - 1)
        held: list[bytes] = []
        held_at = 0
        for at, lines in _blocks(stream, 0 if synced else part.start - 1, before, part.stop):
            if not held:
                held_at = at
            held += lines
            if not synced:
                begin = _records_begin(held[1:])
                if begin is None:
                    continue
                dropped = held[: begin + 1]
                held, held_at = held[begin + 1 :], held_at + sum(map(len, dropped)) + len(dropped)
                synced = True
            whole = len(held) - len(held) % 4
            offsets, pos = [], held_at
            for i in range(0, whole, 4):
                if 0 <= part.stop <= pos or not any(line.strip() for line in held[i : i + 4]):
                    break
                offsets.append(pos)
                pos += len(held[i]) + len(held[i + 1]) + len(held[i + 2]) + len(held[i + 3]) + 4
            if offsets:
                yield offsets, held[: 4 * len(offsets)]
            if 4 * len(offsets) < whole:
                # The next task's range, or blank lines, which only the end of a file may have.
                rest = held[4 * len(offsets) :] if part.stop < 0 or pos < part.stop else []
                if any(line.strip() for line in rest) or (rest and _any_text(stream)):
                    raise ValueError(f"{part.path}: blank lines before byte {pos} are not at the end of the file")
                return
            held, held_at = held[whole:], pos
        if any(line.strip() for line in held) and synced:
            raise ValueError(f"{part.path}: incomplete record at the end of the file")


def _any_text(stream) -> bool:
    """Whether anything but white space is left to read."""
    while block := stream.read(BLOCK_BYTES):
        if block.strip():
            return True
    return False


def _clean(lines: list[bytes]) -> list[bytes]:
    return [line.rstrip(b"\r") for line in lines]


def _batches(part: FastqRange, schema: StructType, mate: int) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    so_far = 0
    for offsets, lines in _read_range(part):
        heads, seqs, pluses, quals = (lines[i::4] for i in range(4))
        if not all(h.startswith(b"@") for h in heads) or not all(p.startswith(b"+") for p in pluses):
            raise ValueError(f"{part.path}: not a FASTQ record near byte {offsets[0]}")
        n = len(offsets)
        make = {
            "file": lambda: pa.array([part.path] * n, pa.string()),
            "mate": lambda: pa.array([mate] * n, pa.int32()),
            "offset": lambda: pa.array(offsets, pa.int64()),
            "number": lambda: pa.array([part.number] * n, pa.int64()),
            "range_start": lambda: pa.array([part.start] * n, pa.int64()),
            "place": lambda: pa.array(range(so_far, so_far + n), pa.int64()),
            "name": lambda: pa.array([h[1:] for h in _clean(heads)], pa.binary()).cast(pa.string()),
            "seq": lambda: pa.array(_clean(seqs), pa.binary()).cast(pa.string()),
            "qual": lambda: pa.array(_clean(quals), pa.binary()).cast(pa.string()),
        }
        yield pa.RecordBatch.from_arrays([make[f.name]() for f in arrow], schema=arrow)
        so_far += n


class _FastqReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.mate = int(options.get("mate", 1))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.first = int(options.get("firstNumber", 0))
        self.index = json.loads(options.get("blockIndex", "{}"))

    def ranges(self, files: list[pafs.FileInfo]) -> list[FastqRange]:
        out = []
        for number, f in enumerate(files, start=self.first):
            if f.path in self.index:
                out += [
                    FastqRange(self.path, f.path, start, stop, number, block, after_line)
                    for start, stop, block, after_line in self.index[f.path]
                ]
            elif _is_gzip(f.path) or f.size <= self.split:
                out.append(FastqRange(self.path, f.path, 0, -1, number))
            else:
                starts = range(0, f.size, self.split)
                out += [FastqRange(self.path, f.path, s, s + self.split, number) for s in starts]
        return out

    def partitions(self):
        return _dealt(self.ranges(list_files(self.path)))

    def read(self, partition):
        for part in partition.parts if partition is not None else ():
            yield from _batches(part, self.schema, self.mate)


class _FastqStreamReader(_FastqReader, DataSourceStreamReader):
    """A batch is the files that were not there before, whatever their times and names.

    The offset, which Spark keeps in the checkpoint, names all files so far. A new file's number goes on
    from how many there were, so no two files of a stream share one while files stay in the folder.
    """

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": sorted(f.path for f in list_files(self.path))}

    def partitions(self, start: dict, end: dict):
        known, wanted = set(start["files"]), set(end["files"])
        taken = sorted((f for f in list_files(self.path) if f.path in wanted - known), key=lambda f: f.path)
        numbers = {f.path: len(known) + i for i, f in enumerate(taken)}
        return _dealt([replace(part, number=numbers[part.path]) for part in self.ranges(taken)])


class FastqDataSource(DataSource):
    """``spark.read.format("fastq")``; name only the columns wanted in ``schema`` to leave out
    names and qualities at the source. ``number`` counts the files, ``place`` the records of a range. Options:
    ``mate``, ``splitBytes``, ``firstNumber``, ``blockIndex`` (of ``_block_index``)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FastqReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FastqStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    # By value, as the process that plans a stream has no access to the package that is sent to workers.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(block_gzip)
    spark.dataSource.register(FastqDataSource)


def _with_read_id(df: DataFrame) -> DataFrame:
    return df.withColumn("read_id", F.shiftleft("number", OFFSET_BITS) + F.col("offset")).drop("number")


def _block_index(spark: SparkSession, root: str, files: list[pafs.FileInfo], split_bytes: int) -> dict[str, list]:
    """Per block-gzip file of over ``split_bytes`` its ranges ``[start, stop, block, after_line]``.

    Tasks count the decompressed bytes of the blocks that begin in each stretch of ``split_bytes``; the
    driver adds up one row for each stretch.
    """
    fs, _ = _open(root)
    stretches = [
        (f.path, f.size, at, min(at + split_bytes, f.size))
        for f in files
        if _is_gzip(f.path) and f.size > split_bytes and block_gzip.is_block_gzip(fs, f.path)
        for at in range(0, f.size, split_bytes)
    ]
    if not stretches:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _open(root)
        for batch in batches:
            rows = batch.to_pylist()
            found = [block_gzip.measure(own, r["path"], r["size"], r["start"], r["stop"]) for r in rows]
            yield pa.RecordBatch.from_pylist(
                [
                    {"path": r["path"], "start": r["start"], "block": block, "n_bytes": n, "ends_line": ends}
                    for r, (block, n, ends) in zip(rows, found, strict=True)
                ],
                schema=pa.schema(
                    [("path", "string"), ("start", "int64"), ("block", "int64"), ("n_bytes", "int64"), ("ends_line", "bool")]
                ),
            )

    table = spark.createDataFrame(stretches, "path string, size bigint, start bigint, stop bigint")
    table = table.repartition(min(len(stretches), 4 * spark.sparkContext.defaultParallelism), "path", "start")
    measured = table.mapInArrow(run, "path string, start bigint, block bigint, n_bytes bigint, ends_line boolean")
    index: dict[str, list] = {path: [] for path, *_ in stretches}
    for row in measured.filter("n_bytes > 0").orderBy("path", "start").collect():
        ranges = index[row.path]
        begin = ranges[-1][1] if ranges else 0
        ranges.append([begin, begin + row.n_bytes, row.block, ends_line if ranges else True])
        ends_line = row.ends_line
    for ranges in index.values():
        if ranges:
            ranges[-1][1] = -1
    return index


def _ordinal(lengths: list[int], number: Column, record: Column) -> Column:
    """Place of a file's record when the files take turns; one that has ended is left out."""
    sizes = F.array(*[F.lit(n).cast("bigint") for n in lengths])
    earlier_turns = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, n: total + F.least(n, record))
    return earlier_turns + F.size(F.filter(sizes, lambda n, i: (i < number) & (n > record)))


def read_fastq(
    spark: SparkSession, *paths: str, with_quality: bool = False, split_bytes: int = SPLIT_BYTES, numbered: bool = False
) -> DataFrame:
    """Reads of all files, ``(read_id, file, mate, offset, seq[, name, qual][, record, ordinal])``.

    The first path holds mate 1, the second mate 2, and so on; a path may be a folder. Read ids
    are unique over all files. ``numbered`` adds ``record``, the number of a read in its file, and ``ordinal``, its
    place when all files give one record in turn, where a shorter file simply ends; both count from 0. It reads the
    files twice: once for the number of records in each range. Neither pass shuffles reads.
    """
    register(spark)
    plans, lists, number = [], [], 0
    for mate, path in enumerate(paths, start=1):
        files = list_files(path)
        index = _block_index(spark, path, files, split_bytes)
        whole = any(_is_gzip(f.path) and f.size > split_bytes and f.path not in index for f in files)
        plans.append((mate, path, number, json.dumps(index), whole))
        lists += files
        number += len(files)

    def load(columns: str) -> DataFrame:
        out = None
        for mate, path, first, index, whole in plans:
            df = (
                spark.read.format("fastq")
                .schema(columns)
                .option("mate", str(mate))
                .option("splitBytes", str(split_bytes))
                .option("firstNumber", str(first))
                .option("blockIndex", index)
                .load(path)
            )
            df = spread(df) if whole else df
            out = df if out is None else out.unionByName(df)
        return out

    columns = "file string, mate int, offset bigint, number bigint, seq string"
    if with_quality:
        columns += ", name string, qual string"
    if not numbered:
        return _with_read_id(load(columns))
    counts = load("number bigint, range_start bigint").groupBy("number", "range_start").agg(F.count(F.lit(1)).alias("n"))
    counts = save_scratch(counts)
    totals = {row.number: row.n for row in counts.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("number").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("number", "range_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    df = load(f"{columns}, range_start bigint, place bigint").join(before, ["number", "range_start"])
    df = df.withColumn("record", F.col("before") + F.col("place")).drop("before", "place", "range_start")
    lengths = [totals.get(i, 0) for i in range(len(lists))]
    return _with_read_id(df.withColumn("ordinal", _ordinal(lengths, F.col("number"), F.col("record"))))


def stream_fastq(spark: SparkSession, path: str, mate: int = 1) -> DataFrame:
    """Reads of the files that appear in a folder, as a stream; late files with old times count too.

    Read ids are unique as long as files stay in the folder.
    """
    register(spark)
    stream = (
        spark.readStream.format("fastq")
        .schema("file string, mate int, offset bigint, number bigint, seq string")
        .option("mate", str(mate))
        .load(path)
    )
    return _with_read_id(stream)
