"""Packing of documents into sequences: shortest pack first over the length histogram.

Documents are encoded and cut where they are read; only ``(id, start, length, crc)`` goes on. Whole
pieces of the sequence length are sequences of their own. The others are packed as counts: lengths are
placed longest first, each into the packs with the fewest tokens (what no pack can hold opens new
ones), and packs of equal content are one pattern with a count. The histogram and the patterns are bounded
by the sequence length, whatever the input. Pieces then find their place by rank: the r-th piece of a
length belongs to the pattern slot whose range of ranks holds r.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.batches import given_back
from strandweave.llm.common import text_of
from strandweave.llm.subwords import WordEncoder, chunks, vocabulary_path
from strandweave.session import save_scratch, ship_package

SEQUENCE_LENGTH = 2048
#: The id that ends each document.
END_ID = 1
#: Pieces ranked together in one window group, about.
RANK_GROUP = 500
#: Characters of text that are encoded at a time.
CHUNK_CHARS = 2 << 20


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE_LENGTH,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens[, ids])``: each document cut into whole sequences and a rest.

    A document is its subword ids and then ``END_ID``; null text is empty. ``ids_crc32`` is over
    little-endian unsigned 32-bit ids; ``ids`` are these bytes. ``start`` counts from the document's
    beginning. The id column keeps its type.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary or vocabulary_path())
        for batch in batches:
            for first, texts in chunks(batch.column(1), CHUNK_CHARS):
                ids, starts = encoder.encode(texts)
                found: dict[str, list] = {name: [] for name in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for i in range(len(starts) - 1):
                    own = np.append(ids[starts[i] : starts[i + 1]], np.uint32(END_ID)).astype("<u4").tobytes()
                    for at in range(0, len(own), 4 * length):
                        piece = own[at : at + 4 * length]
                        found["row"].append(first + i)
                        found["start"].append(at // 4)
                        found["length"].append(len(piece) // 4)
                        found["ids_crc32"].append(zlib.crc32(piece))
                        found["doc_tokens"].append(len(own) // 4)
                        if with_ids:
                            found["ids"].append(piece)
                columns = [batch.column(0).take(pa.array(found["row"], pa.int64()))]
                names = ["start", "length", "ids_crc32", "doc_tokens"]
                columns += [pa.array(found[name], pa.int64()) for name in names]
                if with_ids:
                    names, columns = [*names, "ids"], [*columns, pa.array(found["ids"], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", *names])

    schema = f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).mapInArrow(lambda batches: given_back(cut(batches)), schema)


def pack_histogram(histogram: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, count)`` that hold the histogram's pieces in packs of at most ``limit``.

    Longest lengths first, each into the shortest pack: as many of a length as fit side by side go into
    the packs of the fewest tokens, all packs of one pattern at once.
    """
    by_tokens: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    fills: list[int] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        tokens = sum(pattern)
        if not by_tokens[tokens]:
            heapq.heappush(fills, tokens)
        by_tokens[tokens].append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while fills and not by_tokens[fills[0]]:
                heapq.heappop(fills)
            if fills and fills[0] + size <= limit:
                pattern, count = by_tokens[fills[0]].pop()
                used = min(count, left)
                if used < count:
                    by_tokens[fills[0]].append((pattern, count - used))
                put((*pattern, size), used)
                left -= used
            else:
                # Packs are opened for all that is left, as many of this length in each as fit.
                each = min(limit // size, left)
                put((size,) * each, left // each)
                left %= each
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for held in by_tokens.values():
        for pattern, count in held:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Per place in a pattern: its length, the first rank there, the first sequence and the offset."""
    ranks: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, ranks[size], base, offset))
            ranks[size] += count
            offset += size
        base += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def ranked(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Saved pieces with ``rank``, dense among those of a length, without ordering all of a length together.

    A length's pieces are dealt into groups of about ``RANK_GROUP`` by hash, ranked within the group and
    moved up by the sizes of the groups before.
    """
    deals = cut.sparkSession.createDataFrame(
        [(size, max(1, n // RANK_GROUP)) for size, n in histogram.items()], "length long, n_groups long"
    )
    key = F.xxhash64("id", "start", "ids_crc32", "tag")
    dealt = cut.join(F.broadcast(deals), "length").withColumn("part", F.pmod(key, "n_groups"))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # Running sums over blocks of groups first, so that a common length is no single task's.
    sizes = save_scratch(sizes.withColumn("block", F.expr("part div 1000")))
    blocks = sizes.groupBy("length", "block").agg(F.sum("n").alias("block_n"))
    ahead = lambda *by: Window.partitionBy(*by)
    blocks = blocks.withColumn(
        "block_base",
        F.coalesce(F.sum("block_n").over(ahead("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("block_n")
    in_block = ahead("length", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("part_base", F.coalesce(F.sum("n").over(in_block), F.lit(0))).join(blocks, ["length", "block"])
    bases = bases.select("length", "part", (F.col("block_base") + F.col("part_base")).alias("base"))
    place = Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32", "tag")
    within = dealt.withColumn("rank", F.row_number().over(place) - 1).drop("n_groups")
    return within.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE_LENGTH,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the id column, then ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of every document lies in one piece; a sequence's pieces fill it gaplessly from offset 0
    and hold at most ``length`` ids. Documents with null or empty text are one piece, their end; equal
    rows are packed each; an empty table gives an empty result. ``with_ids`` adds the ids' bytes.
    """
    cut = pieces(docs, id_col, text_col, length, vocabulary, with_ids)
    # Saved, so that pieces are encoded once and the tags that tell equal rows apart never change.
    cut = save_scratch(cut.withColumn("tag", F.monotonically_increasing_id()))
    # At most ``length`` rows come to the driver.
    counted = {row.length: row.n for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(pack_histogram(counted, length))
    span = max([1, *counted.values()]) + 1
    keys = table["length"] * span + table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, size * span + rank, side="right") - 1
            sequence = table["sequence"][slot] + rank - table["rank"][slot]
            yield batch.drop_columns("rank").append_column("sequence_id", pa.array(sequence)).append_column(
                "offset", pa.array(table["offset"][slot])
            )

    ready = ranked(cut, counted) if counted else cut.withColumn("rank", F.col("tag"))
    names = ["id", *[name for name in cut.columns if name not in ("id", "tag")]]
    schema = ", ".join(f"{name} {cut.schema[name].dataType.simpleString()}" for name in names)
    placed = ready.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
