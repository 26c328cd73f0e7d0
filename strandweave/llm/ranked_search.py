"""Ranked lexical search by presence masks: every document is searched for every item, whole texts.

Documents become matched terms once per block of items: ``(id, n, terms, counts)`` with the terms the
block knows. A task then takes a segment of documents at a time. Each term has a bitmap of the documents that hold it;
the bitmaps of an item's terms, turned over, give each document the mask of the terms it matches.
Documents of one mask share the highest score their terms can reach in the segment, so masks are
evaluated by falling bound, and an item is finished once no mask left can reach its best documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import text_of
from strandweave.llm.subwords import chunks
from strandweave.operators.ordering import running_total
from strandweave.session import save_scratch, ship_package

TOP = 50
#: Bytes of item terms searched in one pass over the documents (an item alone may have more).
BLOCK_BYTES = 8 << 20
#: Cells (terms of the block times documents) scored at one time in a task.
SEGMENT_CELLS = 12_000_000
#: Documents scored at a time while masks are evaluated, at first.
FIRST_LOOK = 256
#: Lists of best documents of an item merged before the last merge.
MERGES = 64

# Terms are runs of these bytes, A-Z lower-cased; what is above ASCII always belongs to a term.
_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytearray(b" " * 128 + bytes(range(128, 256)))
for _byte in _LETTERS:
    _TERM_BYTES[_byte] = _byte
    _TERM_BYTES[ord(chr(_byte).upper())] = _byte
_TERM_BYTES = bytes(_TERM_BYTES)


def split_terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, id, terms, size)``: a number for each row, its distinct terms and their bytes."""
    ship_package(items.sparkSession)
    id_type = items.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(split_terms(text))) for text in batch.column(2).cast(pa.binary()).to_pylist()]
            size = [sum(map(len, own)) + 16 * len(own) for own in terms]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary())), pa.array(size, pa.int64())],
                ["item", "id", "terms", "size"],
            )

    numbered = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")
    )
    return numbered.mapInArrow(split, f"item long, id {id_type}, terms array<binary>, size long")


def matched_terms(docs: DataFrame, vocabulary: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, terms, counts)`` of every document: its number of terms, and those of ``vocabulary`` it holds.

    ``vocabulary`` maps terms to numbers from 0. Whole texts are split; null counts as empty.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        width = max(len(vocabulary.value), 1)
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                n, keys = np.zeros(len(texts), np.int64), []
                for row, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                    terms = split_terms(text)
                    n[row] = len(terms)
                    known = np.fromiter(map(number, terms, repeat(-1)), np.int64, len(terms))
                    keys.append(known[known >= 0] + row * width)
                key, count = np.unique(np.concatenate(keys), return_counts=True)
                ends = np.searchsorted(key, np.arange(len(texts) + 1) * width).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(ends, (key % width).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, count.astype(np.int64)),
                ]
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), *lists], ["id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(match, f"id {id_type}, n long, terms array<int>, counts array<long>")


def document_frequencies(matched: DataFrame, n_terms: int) -> DataFrame:
    """``(term, df)``, summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    per_task = matched.select("terms").mapInArrow(count, "term int, df long")
    return per_task.groupBy("term").agg(F.sum("df").alias("df"))


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _contributions(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 20 * m)


class Segment:
    """Some documents with the bitmaps of the terms and what each term adds to each document, before its weight."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int, stats) -> None:
        n_docs, n_words = stats
        self.size = len(n)
        m = 50 + (50 * n * n_docs) // n_words
        row = np.repeat(np.arange(self.size), np.diff(ends))
        held = np.zeros((n_terms, self.size), bool)
        held[terms, row] = True
        self.bitmaps = np.packbits(held, axis=1)
        self.added = np.zeros((n_terms, self.size), np.int32)
        self.added[terms, row] = _contributions(counts, m[row])
        self.highest = self.added.max(axis=1).astype(np.int64)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct masks (one row of bits each) of the documents over these terms, and each document's mask."""
        bits = np.unpackbits(self.bitmaps[terms], axis=1, count=self.size)
        packed = np.packbits(bits, axis=0).T
        width = -(-packed.shape[1] // 8) * 8
        words = np.zeros((self.size, width), np.uint8)
        words[:, : packed.shape[1]] = packed
        words = words.view(np.uint64)
        order = np.argsort(words[:, 0]) if words.shape[1] == 1 else np.lexsort(words.T)
        ordered = words[order]
        fresh = np.ones(self.size, bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        of_doc = np.empty(self.size, np.int64)
        of_doc[order] = np.cumsum(fresh) - 1
        return np.unpackbits(packed[order[fresh]], axis=1, count=len(terms)), of_doc

    def best(self, terms: np.ndarray, weights: np.ndarray, rank: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the item's ``top`` best here that score at least ``floor`` (and above 0).

        ``rank`` orders the documents by id and settles ties.
        """
        bits, of_doc = self.masks(terms)
        bound = (bits * (weights * self.highest[terms])).sum(axis=1)[of_doc]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], -max(floor, 1), side="right")]
        found, scores, at, look = order[:0], bound[:0], 0, FIRST_LOOK
        while at < len(order) and bound[order[at]] >= floor:
            docs = order[at : at + look]
            fresh = weights @ self.added[terms[:, None], docs].astype(np.int64)
            found, scores = np.concatenate([found, docs]), np.concatenate([scores, fresh])
            kept = np.flatnonzero(scores >= max(floor, 1))
            kept = kept[np.lexsort((rank[found[kept]], -scores[kept]))[:top]]
            found, scores = found[kept], scores[kept]
            if len(found) == top:
                floor = max(floor, int(scores[-1]))
            at, look = at + look, 2 * look
        return found, scores


def _search(matched: DataFrame, block: Broadcast, id_type: str, top: int) -> DataFrame:
    """``(item, id, score)``: the best documents of each item in each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = block.value
        n_terms, stats = searched["n_terms"], searched["stats"]
        rows = max(SEGMENT_CELLS // max(n_terms, 1), 64)
        floors = [0] * len(searched["items"])
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                lists = part.column(2)
                ends = lists.offsets.to_numpy().astype(np.int64)
                segment = Segment(
                    part.column(1).to_numpy(),
                    ends - ends[0],
                    lists.flatten().to_numpy(),
                    part.column(3).flatten().to_numpy(),
                    n_terms,
                    stats,
                )
                rank = np.empty(part.num_rows, np.int64)
                rank[pc.array_sort_indices(part.column(0)).to_numpy()] = np.arange(part.num_rows)
                rank = np.where(part.column(0).is_null().to_numpy(zero_copy_only=False), -1, rank)
                items, docs, scores = [], [], []
                for i, (item, terms, weights) in enumerate(searched["items"]):
                    found, score = segment.best(terms, weights, rank, top, floors[i])
                    if len(found) == top:
                        floors[i] = max(floors[i], int(score[-1]))
                    items.append(np.full(len(found), item))
                    docs.append(found)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(items)),
                        part.column(0).take(pa.array(np.concatenate(docs))),
                        pa.array(np.concatenate(scores)),
                    ],
                    ["item", "id", "score"],
                )

    return matched.mapInArrow(run, f"item long, id {id_type}, score long")


def _ranked(found: DataFrame, top: int, *groups: str) -> DataFrame:
    best = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents with a score above 0, all rows searched.

    A document scores the sum, over the item's distinct terms, of weight times saturated count, in 64-bit
    integers. Equal scores rank by id, null ids first; rows equal in id and score are interchangeable and
    all count. Items sharing an id are ranked one by one. An item or text that is null, empty or without
    terms matches nothing; empty tables give no rows. Only the named columns are read, so others may have
    any name. The id columns keep their types.

    Items are searched in blocks of ``block_bytes`` of terms, with one pass over the documents for each,
    so what is sent to the tasks is bounded by that (or by one item) however many items there are.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    split = save_scratch(item_terms(items, item_id_col, item_text_col))
    ordered = save_scratch(
        running_total(split.filter("size > 0"), "item", "size", "before").withColumn("block", F.expr(f"before div {int(block_bytes)}"))
    )
    n_blocks = ordered.agg(F.coalesce(F.max("block"), F.lit(-1)) + 1).first()[0]
    results = []
    for block in range(n_blocks):
        own = ordered.filter(F.col("block") == block).select("item", "terms").collect()
        if not own:
            continue
        vocabulary: dict[bytes, int] = {}
        numbers = [np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in row.terms], np.int64) for row in own]
        known = spark.sparkContext.broadcast(vocabulary)
        matched = save_scratch(matched_terms(docs, known, id_col, text_col))
        n_docs, n_words = matched.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_words == 0:
            break
        df = np.zeros(len(vocabulary), np.int64)
        counted = document_frequencies(matched, len(vocabulary)).toArrow()
        df[counted["term"].to_numpy()] = counted["df"].to_numpy()
        weights = term_weights(df, n_docs)
        searched = {
            "n_terms": len(vocabulary),
            "stats": (n_docs, n_words),
            "items": [(row.item, own_terms, weights[own_terms]) for row, own_terms in zip(own, numbers, strict=True)],
        }
        found = _search(matched, spark.sparkContext.broadcast(searched), id_type, top)
        # Two steps, so that no task gets the lists of all tasks for an item.
        merge = F.pmod(F.xxhash64("id"), F.lit(MERGES)).alias("merge")
        first = _ranked(found.select("*", merge), top, "item", "merge")
        results.append(_ranked(first.select("item", "id", "score"), top, "item"))
    if not results:
        ids = split.select(F.col("id").alias(item_id_col)).limit(0)
        nothing = docs.select(F.col(f"`{id_col}`").alias("doc_id")).limit(0)
        return ids.select(F.col(item_id_col).alias("item_id"), F.lit(0).alias("rank")).join(
            nothing.select("doc_id", F.lit(0).cast("long").alias("score")), F.lit(False)
        )
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    # One row for each item searched.
    names = split.select("item", F.col("id").alias("item_id"))
    return every.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
