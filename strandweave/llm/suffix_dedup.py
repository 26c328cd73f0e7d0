"""Substring dedup by suffix arrays: bytes covered by a long string that starts elsewhere too.

Strings of ``length`` bytes that occur twice hold the same gram (of about a third of it) at the same place, the
one of the least hash among its grams: its anchor. Only anchors travel first, about one for each hundred
bytes. Where an anchor's gram occurs again, the text around it goes to a shard, and equal strings meet in the
shard of their gram. A shard sorts its suffixes by Larsson-Sadakane refinement (ranks of ties are refined by the
ranks a doubled distance away) and gets the common prefixes of neighbours in Kasai's order, both in numpy.

A gram that fills more than a shard is dealt over several. These cut their sorted distinct strings at fixed
places of a hash, and whoever merges a range finds equal strings among the shards by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.batches import whole_groups
from strandweave.functions.kernels import slices, text_bytes
from strandweave.llm.common import HOT_SHARE, join_groups, text_of, unpacked
from strandweave.session import save_scratch, ship_package

LENGTH = 400
#: Bytes of text sorted together, and bytes of one gram's text beyond which it is dealt over shards.
SHARD_BYTES = 3 << 19
SPLIT_BYTES = 1 << 20
#: Bytes of shards in one task, which sorts them one by one.
TASK_BYTES = 32 << 20
#: Strings merged in one range of the cross-shard merge.
MERGE_STRINGS = 2_000_000
#: Bytes hashed at a time; a longer text is hashed in parts.
HASH_BYTES = 1 << 20
#: Starts of one text that stay in one row.
ROW_STARTS = 1 << 14
#: Starts in a row along which common prefixes are carried on.
LANE = 128

_RANDOM = np.random.default_rng(20)
_TABLES = _RANDOM.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_PLACE_BITS = np.uint64(22)
_OWN = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def gram_length(length: int) -> int:
    return 1 << max((length // 3).bit_length() - 1, 0)


# ---- anchors -----------------------------------------------------------------------------


def string_hashes(data: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """64-bit hash of every string of ``length`` bytes, by joining hashes of shorter ones."""
    base, size, out, done, left = _BASES[kind], 1, None, 0, length
    h = _TABLES[kind][data]
    while True:
        if left & 1:
            if out is None:
                out, done = h, size
            else:
                n = max(len(data) - done - size + 1, 0)
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + h[done : done + n]
                done += size
        left >>= 1
        if not left:
            return out
        n = max(len(data) - 2 * size + 1, 0)
        h = h[:n] * np.uint64(pow(base, size, 1 << 64)) + h[size : size + n]
        size *= 2


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(row, gram, lo, hi, n)``: runs of string starts of a text that share their anchor, and its gram's hash.

    Runs with one gram that follow each other are one, of ``n`` anchors.
    """
    gram = gram_length(length)
    width = length - gram + 1
    n_starts = len(data) - length + 1
    if n_starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = string_hashes(data, gram)
    key = (hashes * np.uint64(0xBF58476D1CE4E5B9)) & ~np.uint64((1 << int(_PLACE_BITS)) - 1)
    key |= np.arange(len(key), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: reach - width], key[width - reach :])
    # A run ends where the anchor changes or its text has no more starts.
    changes = np.flatnonzero(key[1:] != key[:-1]) + 1
    first, last = offsets[:-1], np.minimum(np.maximum(offsets[1:] - length + 1, offsets[:-1]), n_starts)
    bounds = np.unique(np.concatenate([changes, first[first < n_starts], last]))
    bounds = bounds[bounds <= n_starts]
    lo, hi = bounds[:-1], bounds[1:]
    row = np.searchsorted(offsets, lo, side="right") - 1
    valid = lo < last[row]
    row, lo, hi = row[valid], lo[valid], hi[valid]
    if not len(lo):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place = (key[lo] & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    own = hashes[place].view(np.int64)
    fresh = np.flatnonzero((np.diff(own, prepend=~own[:1]) != 0) | (np.diff(row, prepend=-1) != 0))
    ends = np.append(fresh[1:], len(own)) - 1
    base = offsets[row[fresh]]
    return row[fresh], own[fresh], lo[fresh] - base, hi[ends] - 1 - base, ends - fresh + 1


def text_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``(k1, k2, gram, lo, hi, n)`` of the whole texts of ``(k1, k2, text)``; a task hashes equal texts once."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once_each(batches):
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in slices(offsets, HASH_BYTES):
                # A text over the limit is a slice of its own.
                begin, end = offsets[lo], offsets[hi]
                for at in range(begin, max(end - length + 1, begin + 1), 2 * HASH_BYTES if hi == lo + 1 else end - begin + 1):
                    stop = min(at + 2 * HASH_BYTES + length - 1, end) if hi == lo + 1 else end
                    inner = np.array([0, stop - at]) if hi == lo + 1 else offsets[lo : hi + 1] - begin
                    row, gram, first, last, n = anchors(data[at:stop], inner, length)
                    shift = at - begin
                    rows = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, (gram, first + shift, last + shift, n))],
                        ["k1", "k2", "gram", "lo", "hi", "n"],
                    )

    return texts.mapInArrow(run, "k1 long, k2 long, gram long, lo long, hi long, n long")


def once_each(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows whose first two columns a task has not seen lately."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        kept = []
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                kept.append(i)
        if len(seen) > limit:
            seen.clear()
        # take() also makes the text begin at its buffer's start.
        yield batch.take(pa.array(kept, pa.int64()))


# ---- shards ------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes at least, their ranks, and the first seven symbols of each.

    ``left`` counts the bytes up to the end of a suffix's own row; a suffix that ends sorts before those that go on.
    Suffixes of one rank are equal to that depth or to their ends.
    """
    n = len(data)
    one = data.astype(np.int64) + 1

    def beyond(part: np.ndarray, step: int) -> np.ndarray:
        moved = np.zeros(n, np.int64)
        moved[: max(n - step, 0)] = part[step:]
        return np.where(left > step, moved, 0)

    two = one << 9 | beyond(one, 1)
    three = two << 9 | beyond(one, 2)
    seven = (two << 18 | beyond(two, 2)) << 27 | beyond(three, 4)
    del one, two, three
    order = np.argsort(seven)
    rank = np.empty(n, np.int64)
    slots, value, h = np.arange(n), seven[order], 7
    while True:
        # Tied suffixes get the slot of the first of them as their rank.
        fresh = np.ones(len(slots), bool)
        fresh[1:] = value[1:] != value[:-1]
        starts = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        rank[order[slots]] = slots[starts][group]
        sizes = np.diff(np.append(starts, len(slots)))
        tied = (sizes[group] > 1) & (left[order[slots]] >= h)
        slots = slots[tied]
        if h >= depth or not len(slots):
            return order, rank, seven
        members = order[slots]
        onward = np.where(left[members] > h, rank[np.minimum(members + h, n - 1)] + 1, 0)
        value = rank[members] * (n + 1) + onward
        again = np.argsort(value, kind="stable")
        order[slots], value = members[again], value[again]
        h *= 2


def common_prefixes(order, rank, seven, left, starts: np.ndarray, stops: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(at, before, common)``: for all places in the ranges, the suffix before it in order and their common bytes, at most ``depth``.

    Kasai's order: the next place of a text shares at least one byte less with what precedes it, unless the
    two were tied, whose common bytes are known. All ranges advance together, a place of each at a time.
    """
    before = np.full(len(order), -1, np.int64)
    before[order[1:]] = order[:-1]
    counts = -(-(stops - starts) // LANE)
    lane = np.repeat(starts, counts) + LANE * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    lane_stop = np.minimum(lane + LANE, np.repeat(stops, counts))
    common = np.zeros(len(order), np.int64)
    held = np.zeros(len(lane), np.int64)
    for step in range(int((lane_stop - lane).max(initial=0))):
        going = lane + step < lane_stop
        lane, lane_stop, held = lane[going], lane_stop[going], held[going]
        at = lane + step
        other = before[at]
        cap = np.where(other >= 0, np.minimum(np.minimum(left[at], left[other]), depth), 0)
        tied = (other >= 0) & (rank[at] == rank[other])
        length = np.where(tied, cap, np.minimum(np.maximum(held - 1, 0), cap))
        open_lanes = np.flatnonzero(length < cap)
        while len(open_lanes):
            i = at[open_lanes] + length[open_lanes]
            j = other[open_lanes] + length[open_lanes]
            differ = seven[i] ^ seven[j]
            same = np.where(differ == 0, 7, 0)
            for symbols in range(1, 7):
                same += (differ != 0) & (differ >> (9 * (7 - symbols)) == 0)
            length[open_lanes] = np.minimum(length[open_lanes] + same, cap[open_lanes])
            open_lanes = open_lanes[(same == 7) & (length[open_lanes] < cap[open_lanes])]
        held = np.where(tied, 0, length)
        common[at] = length
    places = np.repeat(starts, stops - starts) + np.arange((stops - starts).sum()) - np.repeat(np.cumsum(stops - starts) - (stops - starts), stops - starts)
    return places, before[places], common[places]


def repeats_in_shard(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the shard: whether a string that occurs again starts there, and whether one starts there
    that none before it in order equals. Rows end at ``offsets``."""
    repeated, first = np.zeros(len(data), bool), np.zeros(len(data), bool)
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    order, rank, seven = suffix_array(data, left, length)
    at, before, common = common_prefixes(order, rank, seven, left, offsets[:-1], offsets[1:] - length + 1, length)
    equal = common >= length
    repeated[at[equal]] = True
    repeated[before[equal]] = True
    first[at[~equal]] = True
    return repeated, first


_PARTS = "k1 long, k2 long, start long, stop long, part long, hashes binary, others binary, k1s binary, k2s binary, starts binary"


def _spans(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of the strings that start at these places, those next to each other in one."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start = k1[order], k2[order], start[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(start))[: len(at)] - 1
    none, empty = np.full(len(at), -1), pa.nulls(len(at), pa.binary())
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, (k1[at], k2[at], start[at], start[last] + length, none)), *[empty] * 5],
        ["k1", "k2", "start", "stop", "part", "hashes", "others", "k1s", "k2s", "starts"],
    )


def _each_shard(table: pa.Table) -> Iterator[pa.Table]:
    """The shards of a table sorted by them, one by one."""
    shard = table["shard"].to_numpy()
    starts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in zip(starts, starts[1:]):
        # take() makes the text begin at its buffer's start.
        yield table.take(pa.array(np.arange(a, b)))


def _sort_shards(contexts: DataFrame, length: int, n_parts: int) -> DataFrame:
    """Spans of repeated strings found inside shards; of dealt grams also the sorted hashes of distinct strings, cut into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in (shard for held in whole_groups(batches, "shard", SHARD_BYTES) for shard in _each_shard(held)):
            data, offsets = text_bytes(table["bytes"].combine_chunks())
            k1, k2, lo = (table[name].to_numpy() for name in ("k1", "k2", "lo"))
            split = table["split"].to_numpy()
            repeated, first = repeats_in_shard(data, offsets, length)

            def starts_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                row = np.searchsorted(offsets, places, side="right") - 1
                return k1[row], k2[row], lo[row] + places - offsets[row]

            yield _spans(*starts_of(np.flatnonzero(repeated)), length)
            if not split.any():
                continue
            shared = np.flatnonzero(first & np.repeat(split, np.diff(offsets)))
            own, others = string_hashes(data, length)[shared], string_hashes(data, length, 1)[shared]
            order = np.argsort(own)
            own, others, shared = own[order], others[order], shared[order]
            refs = starts_of(shared)
            # Parts are equal ranges of the hash; binary search finds where they begin.
            edges = np.array([(part << 64) // n_parts for part in range(1, n_parts)], np.uint64)
            ends = [0, *np.searchsorted(own, edges).tolist(), len(own)]
            rows = [(part, a, b) for part, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            blobs = [[x[a:b].tobytes() for _, a, b in rows] for x in (own, others, *refs)]
            none = np.full(len(rows), -1)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (none, none, none, none, np.array([part for part, _, _ in rows], np.int64))), *[pa.array(x, pa.binary()) for x in blobs]],
                ["k1", "k2", "start", "stop", "part", "hashes", "others", "k1s", "k2s", "starts"],
            )

    return contexts.mapInArrow(run, _PARTS)


def merge_runs(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Two sorted runs of distinct strings as one; columns: hash, other hash, two keys, start, found again."""
    at = np.searchsorted(a[0], b[0])
    inside = np.minimum(at, len(a[0]) - 1)
    equal = (a[0][inside] == b[0]) & (a[1][inside] == b[1])
    a[5][inside[equal]] = True
    b[5][equal] = True
    # Strings found again stay once in order; their other copies follow at the end of their key's place.
    return [np.insert(x, at, y) for x, y in zip(a, b, strict=True)]


def _merge_shards(parts: DataFrame, length: int) -> DataFrame:
    """Spans of strings that several shards hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part", 1):
            for part in np.unique(table["part"].to_numpy()):
                rows = table.filter(pc.equal(table["part"], int(part)))
                columns = [rows[name].to_pylist() for name in ("hashes", "others", "k1s", "k2s", "starts")]
                kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
                runs = [
                    [np.frombuffer(x, kind) for x, kind in zip(blobs, kinds, strict=True)] for blobs in zip(*columns, strict=True)
                ]
                runs = [[*x, np.zeros(len(x[0]), bool)] for x in runs]
                while len(runs) > 1:
                    runs = [merge_runs(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
                again = runs[0][5]
                yield _spans(*[x[again] for x in runs[0][2:5]], length)

    return parts.mapInArrow(run, _PARTS)


# ---- documents ---------------------------------------------------------------------------


def _keyed(docs: DataFrame, text_col: str, *columns) -> DataFrame:
    """``k1, k2``: 120 bits of the text's SHA-256, with ``columns``."""
    sha = F.sha2(text_of(text_col).cast("binary"), 256)
    digits = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    return docs.select(sha.alias("sha"), *columns).select(digits(1).alias("k1"), digits(16).alias("k2"), "*")


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, split_bytes: int = SPLIT_BYTES):
    """``(texts, keyed)``: per distinct text with removed bytes ``(k1, k2, copies, n_removed, n_spans, kept_sha256, spans)``,
    and the saved keys ``(k1, k2, n_bytes)`` of all rows, for joining.

    A text that occurs more than once is removed whole if it has ``length`` bytes; all other repeats are found by
    the suffix arrays, where a text takes part once.
    """
    keyed = save_scratch(
        _keyed(docs, text_col, F.octet_length(text_of(text_col)).cast("long").alias("n_bytes")).select("k1", "k2", "n_bytes")
    )
    copies = save_scratch(keyed.groupBy("k1", "k2", "n_bytes").agg(F.count(F.lit(1)).alias("copies")).filter(f"copies > 1 AND n_bytes >= {length}"))
    texts = _keyed(docs, text_col, text_of(text_col).alias("text")).filter(F.octet_length("text") >= length).select("k1", "k2", "text")
    found = save_scratch(text_anchors(texts, length))
    size = F.col("hi") - F.col("lo") + length
    grams = found.groupBy("gram").agg(F.sum("n").alias("total"), F.sum(size).alias("gram_bytes")).filter("total > 1")
    n_anchors = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    twice = join_groups(found.drop("n"), save_scratch(grams), "gram", "total", n_anchors)
    # A text that several tasks hashed is there once from here on.
    twice = save_scratch(twice.groupBy("k1", "k2", "gram", "lo", "hi").agg(F.max(F.col("gram_bytes") > split_bytes).alias("split")))
    split = F.col("split")
    kept_bytes, split_size, n_split = twice.agg(
        F.coalesce(F.sum(F.when(~split, size)), F.lit(0)),
        F.coalesce(F.sum(F.when(split, size)), F.lit(0)),
        F.coalesce(F.sum(F.when(split, size - length + 1)), F.lit(0)),
    ).first()
    n_whole, n_dealt = (max(-(-x // shard_bytes), 1) for x in (kept_bytes, split_size))
    n_parts = max(-(-n_split // MERGE_STRINGS), 1)
    pieces = twice.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(hi - lo) div {ROW_STARTS}"))))
    pieces = pieces.withColumn("first", F.col("lo") + F.col("part") * ROW_STARTS)
    shard = F.when(split, n_whole + F.pmod(F.xxhash64("gram", "k1", "k2", "first"), F.lit(n_dealt))).otherwise(
        F.pmod(F.xxhash64("gram"), F.lit(n_whole))
    )
    piece = F.struct(
        F.col("first").alias("lo"), F.least("hi", F.col("first") + ROW_STARTS - 1).alias("hi"), shard.cast("long").alias("shard"), "split"
    )
    wanted = pieces.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(piece)).alias("wanted"))
    once = _once(texts).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    chosen = save_scratch(once)
    n_shards, usual = n_whole + n_dealt, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_tasks = max(-(-n_shards * shard_bytes // TASK_BYTES), min(n_shards, usual))
    contexts = _cut_contexts(chosen, length).repartition(n_tasks, "shard").sortWithinPartitions("shard")
    sorted_shards = save_scratch(_sort_shards(contexts, length, n_parts))
    merged = _merge_shards(sorted_shards.filter("part >= 0").repartition(n_parts, "part").sortWithinPartitions("part"), length)
    spans = sorted_shards.filter("part < 0").unionByName(merged).select("k1", "k2", "start", "stop")
    whole = copies.select("k1", "k2", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))
    removed = spans.join(copies, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")
    )
    partly = _measure(chosen.select("k1", "k2", "text").join(removed, ["k1", "k2"]))
    fully = whole.join(copies.select("k1", "k2", "copies"), ["k1", "k2"]).select(
        "k1",
        "k2",
        "copies",
        F.col("stop").alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"),
        F.array(F.struct("start", "stop")).alias("spans"),
    )
    return save_scratch(partly.unionByName(fully)), keyed


def _once(texts: DataFrame) -> DataFrame:
    """The rows without most repeats: what a task reads more than once stays once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from once_each(batches)

    return texts.mapInArrow(run, texts.schema)


def _cut_contexts(chosen: DataFrame, length: int) -> DataFrame:
    """``(shard, split, k1, k2, lo, bytes)``: the strings that start from ``lo`` on, as one piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                text, wanted = texts[i].as_buffer(), batch.column(3)[i].values
                text = memoryview(text)
                lo, hi = wanted.field("lo"), wanted.field("hi")
                pieces = [bytes(text[a : b + length]) for a, b in zip(lo.to_pylist(), hi.to_pylist(), strict=True)]
                same = pa.array(np.zeros(len(pieces), np.int64) + i)
                yield pa.RecordBatch.from_arrays(
                    [wanted.field("shard"), wanted.field("split"), batch.column(0).take(same), batch.column(1).take(same), lo, pa.array(pieces, pa.binary())],
                    ["shard", "split", "k1", "k2", "lo", "bytes"],
                )

    return chosen.mapInArrow(run, "shard long, split boolean, k1 long, k2 long, lo long, bytes binary")


def union_of_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of sorted ones that overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, stop in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


_MEASURED = "k1 long, k2 long, copies long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"


def _measure(rows: DataFrame) -> DataFrame:
    """Merged spans of ``(k1, k2, text, spans)`` and what is left beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, n_spans, shas, merged = [], [], [], []
            for text, spans in zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
                own = union_of_spans([(x["start"], x["stop"]) for x in spans])
                sha, at, whole = hashlib.sha256(), 0, memoryview(text.as_buffer())
                for start, stop in own:
                    sha.update(whole[at:start])
                    at = stop
                sha.update(whole[at:])
                n_removed.append(sum(b - a for a, b in own))
                n_spans.append(len(own))
                shas.append(sha.hexdigest())
                merged.append([{"start": a, "stop": b} for a, b in own])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([1] * batch.num_rows, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(shas),
                    pa.array(merged, kind),
                ],
                ["k1", "k2", "copies", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return rows.mapInArrow(run, _MEASURED)


def mark_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, columns: list[str] | None = None, **sizes: int
) -> DataFrame:
    """Every row with ``n_bytes, n_removed, n_spans, kept_sha256, spans`` of its UTF-8 text.

    ``spans`` (start and stop in bytes, maximal, in order) are the bytes covered by a string of ``length`` bytes
    that also starts anywhere else, in this text or another row's; strings are judged on the input, overlaps
    count, and no string crosses texts. ``kept_sha256`` is of the other bytes. Null counts as empty, and a
    text of fewer bytes than ``length`` loses nothing. Equal rows are repeats of each other. ``columns`` (all by default) are
    carried; those named like an added one are replaced. An empty table gives an empty result.
    """
    texts, keyed = repeated_spans(docs, text_col, length, **sizes)
    doc = F.struct(*[F.col(f"`{name}`") for name in columns or docs.columns]).alias("doc")
    rows = _keyed(docs, text_col, doc, F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"))
    # Texts of very many copies are few; the others are joined by shuffle.
    total = keyed.count()
    hot = F.broadcast(texts.filter(F.col("copies") * HOT_SHARE > total))
    cold = texts.filter(F.col("copies") * HOT_SHARE <= total)
    rest = rows.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti").join(cold, ["k1", "k2"], "left")
    every = rows.join(hot, ["k1", "k2"]).unionByName(rest)
    zero = F.lit(0).cast("long")
    return unpacked(
        every.withColumns(
            {
                "n_removed": F.coalesce("n_removed", zero),
                "n_spans": F.coalesce("n_spans", zero),
                "kept_sha256": F.coalesce("kept_sha256", "sha"),
                "spans": F.coalesce("spans", F.expr("cast(array() as array<struct<start: long, stop: long>>)")),
            }
        ),
        *_OWN,
    )


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, **sizes: int) -> DataFrame:
    """The rows of ``mark_repeats`` with ``kept``, the bytes that stay (a cut may part a character)."""
    marked = mark_repeats(docs, text_col, length, **sizes)
    whole = text_of(text_col).cast("binary")
    none = F.lit(0).cast("long")
    ends = F.concat(F.array(none), F.transform("spans", lambda s: s["stop"]))
    begins = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.col("n_bytes")))
    pieces = F.zip_with(ends, begins, lambda a, b: F.hex(F.substring(whole, (a + 1).cast("int"), (b - a).cast("int"))))
    return marked.withColumn("kept", F.unhex(F.array_join(pieces, "")))
