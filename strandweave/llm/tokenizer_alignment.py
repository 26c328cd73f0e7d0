"""Alignment of two tokenizers: spans where both end a token cut a text into groups.

A is a byte-level ``tokenizers`` file and encodes a space and the text; B is a ``sentencepiece`` model with byte fallback
and encodes the text, adding that space itself. Character offsets of A and the spans of B's proto are
coarse cuts; inside a character, and for byte-fallback tokens, the decoded bytes of the tokens tell
where each ends.

Neither tokenizer has a token that runs on from a visible character into a space or a line end, so texts
fall into units there, and a task aligns each distinct unit once. What a pair of ids counts is the number
of documents that hold it linked, over all documents.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.batches import sliced
from strandweave.functions.kernels import text_bytes
from strandweave.llm.common import text_of
from strandweave.llm.subwords import chunks, vocabulary_path
from strandweave.session import save_scratch, ship_package

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
#: Units a worker remembers; beyond, those that came only once are forgotten, which only costs time.
REMEMBERED = 600_000
#: Longer units are not remembered.
REMEMBERED_CHARS = 64
#: Pairs of ids whose counts are sent to the tasks at one time.
BLOCK_PAIRS = 2_000_000

#: Marks that may begin a unit after a letter.
_MARKS = ".,;:!?"
#: Units that are encoded at one time.
BATCH_UNITS = 20_000
#: Characters of text that are aligned at one time, and bytes of aligned rows that are read at one time.
CHUNK_CHARS = 1 << 20
ROW_BYTES = 4 << 20
#: Links of a group beyond which its equal tokens are taken together.
LARGE_GROUP = 64
#: The last character of white space.
_LAST_SPACE = 0x3000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, turned over.

    Printable bytes stand for themselves, all others for the letters from U+0100 on, in order.
    """
    letters, spare = {}, 0x100
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte:
            letters[chr(byte)] = byte
        else:
            letters[chr(spare)] = byte
            spare += 1
    return letters


def _ends(sizes: np.ndarray) -> np.ndarray:
    """Where each of the parts of these sizes ends, with 0 ahead."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return ends


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` places from ``first`` on, of all ranges in a row."""
    ends = _ends(n)
    return np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)


def _joined(pieces: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbouring strings as one, up to each of ``ends``."""
    data, offsets = text_bytes(pieces)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets[ends]), pa.py_buffer(data))


#: What a unit is as numbers: tokens of A and of B, groups, links.
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Units:
    """Aligned units in arrays: ``fine`` (the tokens give the bytes), numbers, groups as text (``;`` after each), and links.

    The links of unit i are ``codes[ends[i] : ends[i + 1]]`` (A id * 2^32 + B id), each ``times`` over.
    """

    fine: np.ndarray
    numbers: np.ndarray
    shown: pa.Array
    ends: np.ndarray
    codes: np.ndarray
    times: np.ndarray

    @classmethod
    def none(cls) -> Units:
        return cls(
            np.zeros(0, bool), np.zeros((0, len(_NUMBERS)), np.int64), pa.array([], pa.large_string()), np.zeros(1, np.int64),
            np.zeros(0, np.int64), np.zeros(0, np.int64),
        )

    def take(self, at: np.ndarray) -> Units:
        n = np.diff(self.ends)[at]
        links = _places(self.ends[:-1][at], n)
        return Units(self.fine[at], self.numbers[at], self.shown.take(pa.array(at)), _ends(n), self.codes[links], self.times[links])

    def plus(self, other: Units) -> Units:
        return Units(
            np.concatenate([self.fine, other.fine]),
            np.concatenate([self.numbers, other.numbers]),
            pa.concat_arrays([self.shown, other.shown]),
            np.concatenate([self.ends, other.ends[1:] + self.ends[-1]]),
            np.concatenate([self.codes, other.codes]),
            np.concatenate([self.times, other.times]),
        )


class Aligner:
    """Both tokenizers, with the groups of the units aligned so far."""

    _shared: dict[tuple[str, str], Aligner] = {}

    def __init__(self, byte_path: str, piece_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # A task has one core; threads of the tokenizer's own would take others'.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings are then ordinary text
        self.b = SentencePieceProcessor(model_file=piece_path)
        letters = _byte_letters()
        entries = self.a.get_vocab(with_added_tokens=False)
        # A special token (its text is never encoded to it) may hold letters that stand for no byte.
        self.a_bytes = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values(), default=0) + 1)
        for token, i in entries.items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.b_is_byte, strict=True)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # Ids as text with the mark that follows them.
        n_ids = max(len(self.a_bytes), len(self.b_bytes))
        self.written = pa.array([f"{i}{mark}" for mark in (",", "|", ";") for i in range(n_ids)], pa.large_string())
        self.n_ids = n_ids
        self.unit_wise = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
        # A always ends a token between a letter and one of these marks; B does if no piece holds the two in a row.
        inner = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        marks = [mark for mark in _MARKS if not any(x + mark in inner for x in ascii_letters)]
        self.visible, self.letter, self.mark, self.gap = (np.zeros(_LAST_SPACE + 2, bool) for _ in range(4))
        self.visible[:] = [not chr(c).isspace() for c in range(len(self.visible))]
        self.letter[[ord(x) for x in ascii_letters]] = True
        self.mark[[ord(x) for x in marks]] = True
        self.gap[[ord(" "), ord("\n")]] = True
        self.forget()

    @classmethod
    def of(cls, byte_path: str, piece_path: str) -> Aligner:
        """The worker's aligner for these files."""
        key = (byte_path, piece_path)
        if key not in cls._shared:
            cls._shared[key] = cls(*key)
        return cls._shared[key]

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.units, self.again = Units.none(), np.zeros(0, bool)

    def _a_tokens(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many tokens of A each text has, their ids, and the byte at which each ends, all texts in a row."""
        coded = self.a.encode_batch(texts, add_special_tokens=False)
        each = [x.ids for x in coded]
        n = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.int64, int(n.sum()))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(x.offsets for x in coded)), np.int64, 2 * len(ids)).reshape(-1, 2)
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), n)
        begins, stops = spans[:, 0], spans[:, 1]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        bytes_before = _ends(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
        ends = bytes_before[_ends(chars)[owner] + stops]
        # Tokens that share a character have its end as theirs; their own bytes say how far each goes.
        shared = np.zeros(len(ids) + 1, bool)
        shared[1:-1] = (begins[1:] < stops[:-1]) & (owner[1:] == owner[:-1])
        shared = shared[1:] | shared[:-1]
        own = self.a_sizes[ids]
        return n, ids, np.where(shared, self._byte_ends(own, n, sizes), ends)

    def _b_tokens(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of B.

        A line end is put before a text, which is a token of its own, so that B's space stays apart. Where
        a model has other tokens with a line end, only whole texts come here, whose space B adds itself.
        """
        given, skipped, shift = (["\n" + text for text in texts], 2, -1) if self.unit_wise else ([text[1:] for text in texts], 0, 1)
        coded = self.b.encode(given, return_type="offset_mapping", return_bytes=True, num_threads=1)
        each = [x["ids"][skipped:] for x in coded]
        n = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.int64, int(n.sum()))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(x["offsets"][skipped:] for x in coded)), np.int64, 2 * len(ids))
        # The span of byte-fallback tokens is that of the whole character, at its last byte.
        ends = spans[1::2] + shift + np.repeat(_ends(sizes)[:-1], n)
        return n, ids, np.where(self.b_is_byte[ids], self._byte_ends(self.b_sizes[ids], n, sizes), ends)

    @staticmethod
    def _byte_ends(own: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where tokens of ``own`` bytes end if each text's begin where it does."""
        ends = _ends(own)
        return ends[1:] + np.repeat(_ends(sizes)[:-1] - ends[_ends(n)[:-1]], n)

    def align(self, texts: list[str]) -> Units:
        """The texts as they stand inside others, each beginning with a space or another sign that begins a unit."""
        # The tokenizers' many small lists hold no cycles; looking for some would take a tenth of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._aligned(texts)
        finally:
            if collects:
                gc.enable()

    def _aligned(self, texts: list[str]) -> Units:
        encoded = [text.encode() for text in texts]
        sizes = np.fromiter(map(len, encoded), np.int64, len(texts))
        a_n, a, a_end = self._a_tokens(texts, sizes)
        b_n, b, b_end = self._b_tokens(texts, sizes)
        fine = self._gives(encoded, sizes, self.a_bytes, self.a_sizes, a_n, a) & self._gives(encoded, sizes, self.b_bytes, self.b_sizes, b_n, b)
        if not fine.all():
            a_kept, b_kept = np.repeat(fine, a_n), np.repeat(fine, b_n)
            a, a_end, b, b_end = a[a_kept], a_end[a_kept], b[b_kept], b_end[b_kept]
            a_n, b_n = np.where(fine, a_n, 0), np.where(fine, b_n, 0)
        return self._groups(fine, a_n, a, a_end, b_n, b, b_end)

    @staticmethod
    def _gives(encoded: list[bytes], sizes: np.ndarray, bytes_of: list[bytes], sizes_of: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the bytes of a text's tokens are the text's."""
        own = _ends(sizes_of[ids])
        own = own[_ends(n)]
        same = np.diff(own) == sizes
        joined = b"".join([bytes_of[i] for i in ids.tolist()])
        if same.all() and joined == b"".join(encoded):
            return same
        return np.array([joined[x:y] == text for x, y, text in zip(own[:-1].tolist(), own[1:].tolist(), encoded, strict=True)], bool)

    def _groups(self, fine, a_n, a, a_end, b_n, b, b_end) -> Units:
        """Units from both sides' tokens, which cover the same bytes."""
        n_texts = len(fine)
        # A group ends with a token of A that ends where one of B does.
        meets = np.searchsorted(b_end, a_end)
        a_last = np.flatnonzero(b_end[np.minimum(meets, max(len(b_end) - 1, 0))] == a_end) if len(b_end) else np.zeros(0, np.int64)
        b_last = meets[a_last]
        a_stop, b_stop = np.concatenate([[0], a_last + 1]), np.concatenate([[0], b_last + 1])
        n_left, n_right = np.diff(a_stop), np.diff(b_stop)
        a_first, b_first = a_stop[:-1], b_stop[:-1]
        owner = np.repeat(np.arange(n_texts), a_n)[a_last]
        text_groups = np.searchsorted(owner, np.arange(n_texts + 1))
        links = _ends(n_left * n_right)
        numbers = np.stack([a_n, b_n, np.diff(text_groups), np.diff(links[text_groups])], axis=1)

        # The tokens of a group, those of A first, each with the mark after it.
        group_a, group_b = np.repeat(np.arange(len(a_last)), n_left), np.repeat(np.arange(len(b_last)), n_right)
        place_a, place_b = np.arange(len(a)) + b_first[group_a], np.arange(len(b)) + a_stop[1:][group_b]
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[a_last], mark_b[b_last] = 1, 2
        pieces = np.empty(len(a) + len(b), np.int64)
        pieces[place_a], pieces[place_b] = mark_a * self.n_ids + a, mark_b * self.n_ids + b
        shown = _joined(self.written.take(pa.array(pieces)), _ends(a_n + b_n))

        # In a large group equal tokens are taken together.
        n_each = n_left * n_right
        large = np.flatnonzero(n_each > LARGE_GROUP)
        wide = {}
        for g in large.tolist():
            x, n_x = np.unique(a[a_first[g] : a_stop[g + 1]], return_counts=True)
            y, n_y = np.unique(b[b_first[g] : b_stop[g + 1]], return_counts=True)
            wide[g] = ((x[:, None] << 32) | y).ravel(), (n_x[:, None] * n_y).ravel()
            n_each[g] = len(wide[g][0])
        ends = _ends(n_each)
        small = np.ones(len(n_each), bool)
        small[large] = False
        codes, times = np.empty(ends[-1], np.int64), np.ones(ends[-1], np.int64)
        group = np.repeat(np.flatnonzero(small), n_each[small])
        inside = _places(np.zeros(int(small.sum()), np.int64), n_each[small])
        left, right = a_first[group] + inside // n_right[group], b_first[group] + inside % n_right[group]
        codes[ends[group] + inside] = (a[left] << 32) | b[right]
        for g, (pairs, n) in wide.items():
            codes[ends[g] : ends[g + 1]], times[ends[g] : ends[g + 1]] = pairs, n
        return Units(fine, numbers, shown, ends[text_groups], codes, times)

    def units_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of a space and each text, in a row, and where each text's begin, with the end.

        Between parts both tokenizers always end a token. An empty text has none.
        """
        texts = texts.cast(pa.large_string())
        filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(pa.array(filled)), pa.scalar("", pa.large_string()))
        data, offsets = text_bytes(whole)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        if self.unit_wise and len(data):
            text = data.tobytes()
            codes = np.frombuffer(text if text.isascii() else text.decode().encode("utf-32-le"), np.uint8 if text.isascii() else "<u4")
            kind = codes if codes.dtype == np.uint8 else np.minimum(codes, _LAST_SPACE + 1)
            starts = self.visible[kind[:-1]] & self.gap[kind[1:]]
            starts |= self.letter[kind[:-1]] & self.mark[kind[1:]]
            at = np.flatnonzero(starts) + 1
            if codes.dtype != np.uint8:
                # A byte that doesn't go on with a character begins one.
                at = np.flatnonzero((data & 0xC0) != 0x80)[at]
            begins[at] = True
        cuts = np.flatnonzero(begins).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        return units, np.searchsorted(cuts, offsets)[np.concatenate([[0], np.cumsum(filled)])]

    def known(self, units: list[str]) -> Units:
        """Each of the distinct units aligned; those not met lately are aligned together."""
        if len(self.place) > REMEMBERED:
            # Units that came only once make room.
            kept = np.flatnonzero(self.again)[-REMEMBERED // 2 :]
            order = np.full(len(self.again), -1)
            order[kept] = np.arange(len(kept))
            self.place = {unit: int(order[at]) for unit, at in self.place.items() if order[at] >= 0}
            self.units, self.again = self.units.take(kept), np.zeros(len(kept), bool)
        n_old = len(self.units.fine)
        at = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        self.again[at[at >= 0]] = True
        missing = np.flatnonzero(at < 0)
        at[missing] = n_old + np.arange(len(missing))
        every = self.units
        for first in range(0, len(missing), BATCH_UNITS):
            every = every.plus(self.align([units[i] for i in missing[first : first + BATCH_UNITS].tolist()]))
        short = [i for i, m in enumerate(missing.tolist()) if len(units[m]) <= REMEMBERED_CHARS]
        self.place.update((units[missing[i]], n_old + k) for k, i in enumerate(short))
        self.units = every if len(short) == len(missing) else every.take(np.concatenate([np.arange(n_old), n_old + np.array(short, np.int64)]))
        self.again = np.concatenate([self.again, np.zeros(len(short), bool)])
        return every.take(at)


class Aligned:
    """The texts of a batch as numbers of their distinct units."""

    def __init__(self, aligner: Aligner, texts: pa.Array) -> None:
        units, begins = aligner.units_of(texts)
        coded = units.dictionary_encode()
        self.units = aligner.known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.unit = coded.indices.to_numpy().astype(np.int64)
        self.n = np.diff(begins)
        bad = ~self.units.fine[self.unit]
        if bad.any():
            # Parts may differ from their tokens where the whole does not.
            row = np.repeat(np.arange(len(texts)), self.n)
            wrong = np.unique(row[bad])
            whole = aligner.align([" " + texts[i].as_py() for i in wrong.tolist()])
            number = np.flatnonzero(whole.fine)
            stays = ~np.isin(row, wrong)
            row = np.concatenate([row[stays], wrong[number]])
            order = np.argsort(row, kind="stable")
            self.unit = np.concatenate([self.unit[stays], len(self.units.fine) + number])[order]
            self.n = np.bincount(row, minlength=len(texts))
            self.units = self.units.plus(whole)

    def sums(self) -> np.ndarray:
        """Tokens of A and of B, groups and links of each text."""
        per_unit = np.cumsum(self.units.numbers[self.unit], axis=0)
        return np.diff(np.concatenate([np.zeros((1, len(_NUMBERS)), np.int64), per_unit])[_ends(self.n)], axis=0)

    def groups(self) -> pa.Array:
        return pc.ascii_rtrim(_joined(self.units.shown.take(pa.array(self.unit)), _ends(self.n)), ";")

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List ends, distinct pairs and how often each is linked, for the texts in order."""
        n_links = np.diff(self.units.ends)[self.unit]
        at = _places(self.units.ends[:-1][self.unit], n_links)
        row = np.repeat(np.repeat(np.arange(len(self.n)), self.n), n_links)
        known, place = np.unique(self.units.codes, return_inverse=True)
        key = row * max(len(known), 1) + place[at]
        times = self.units.times[at]
        if (times == 1).all():
            key, total = np.unique(key, return_counts=True)
        else:
            key, back = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, times)
        ends = np.searchsorted(key, np.arange(len(self.n) + 1) * max(len(known), 1)).astype(np.int32)
        return ends, known[key % max(len(known), 1)], total.astype(np.int64)


def align_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_path: str | None = None,
    piece_path: str | None = None,
    with_groups: bool = True,
) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, times)`` of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (ids in order, groups apart by ``;``); ``pairs`` are the distinct
    linked ids ``a * 2^32 + b`` and ``times`` how often each is linked. A text that is null or empty, or whose
    tokens don't give its bytes, has no tokens: zeros, and empty groups and hash. The paths are those of
    the tokenizer files on the workers (the installed public ones by default). Without ``with_groups`` only
    the hash of the groups is returned.
    """
    ship_package(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(byte_path or vocabulary_path(BYTE_VOCABULARY), piece_path or vocabulary_path(PIECE_MODEL))
        for batch in batches:
            for first, texts in chunks(batch.column(1), CHUNK_CHARS):
                aligned = Aligned(aligner, texts)
                shown, sums, (ends, pairs, times) = aligned.groups(), aligned.sums(), aligned.pairs()
                hashes = [hashlib.sha256(x.as_buffer()).hexdigest() if x.as_buffer().size else "" for x in shown]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        *[pa.array(sums[:, k]) for k in range(len(_NUMBERS))],
                        *([shown.cast(pa.string())] if with_groups else []),
                        pa.array(hashes, pa.string()),
                        pa.ListArray.from_arrays(ends, pairs),
                        pa.ListArray.from_arrays(ends, times),
                    ],
                    ["id", *_NUMBERS, *(["groups"] if with_groups else []), "groups_sha256", "pairs", "times"],
                )

    schema = (
        f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, {'groups string, ' * with_groups}groups_sha256 string, "
        "pairs array<long>, times array<long>"
    )
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, a, count, best)``: how many documents hold a pair linked, and whether none of its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROW_BYTES):
            pair, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    per_batch = aligned.select("pairs").mapInArrow(count, "pair long, n long")
    counts = save_scratch(per_batch.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32)))
    # An A id has at most as many pairs as B has ids.
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("pair", "a", "count", (F.col("count") == F.col("highest")).alias("best"))


def _add_counts(rows: DataFrame, block: Broadcast) -> DataFrame:
    """Add what the pairs of one block give to ``n_best`` and ``count_sum``."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = block.value
        for batch in sliced(batches, ROW_BYTES):
            lists = batch.column(names.index("pairs"))
            own, times = lists.flatten().to_numpy(), batch.column(names.index("times")).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
            known = np.flatnonzero(pair[at] == own)
            row, at, times = row[known], at[known], times[known]
            sums = {
                "n_best": np.bincount(row, times * best[at], batch.num_rows),
                "count_sum": np.zeros(batch.num_rows, np.int64),
            }
            # Exact in 64 bits, where bincount would add up in doubles.
            np.add.at(sums["count_sum"], row, times * count[at])
            columns = [
                pa.array(column.to_numpy() + sums[name].astype(np.int64)) if name in sums else column
                for name, column in zip(names, batch.columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def link_counts(aligned: DataFrame, counts: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The rows of ``aligned`` (saved) with ``n_best`` and ``count_sum`` over their links.

    Counts go to the tasks in blocks of about ``block_pairs`` pairs, dealt by hash, with one pass over
    the rows for each, so that no pair is joined by shuffle, however common it is.
    """
    spark = aligned.sparkSession
    zero = F.lit(0).cast("long")
    rows = aligned.withColumns({"n_best": zero, "count_sum": zero})
    n_blocks = -(-counts.count() // block_pairs)
    block_of = F.pmod(F.xxhash64("pair"), F.lit(max(n_blocks, 1)))
    for block in range(n_blocks):
        table = counts.filter(block_of == block).select("pair", "count", "best").toArrow().sort_by("pair")
        if not table.num_rows:
            continue
        arrays = table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy()
        rows = _add_counts(rows, spark.sparkContext.broadcast(arrays))
        if block + 1 < n_blocks:
            rows = save_scratch(rows)
    return rows


def tokenizer_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_path: str | None = None,
    piece_path: str | None = None,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row for each document.

    ``n_best`` counts the links whose pair is in as many documents as any pair of their A id, ``count_sum``
    adds up the pairs' documents over the links. Rows equal in id or text stay apart and count each; ids
    may be null and keep their type; other columns are not read. An empty table gives no row.
    """
    aligned = save_scratch(align_documents(docs, id_col, text_col, byte_path, piece_path, with_groups=False))
    linked = link_counts(aligned, save_scratch(pair_counts(aligned)), block_pairs)
    return linked.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
