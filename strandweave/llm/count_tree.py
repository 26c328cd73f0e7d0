"""Sets of word shingles, their count vectors, and an R-tree over the vectors.

A set's count vector says how many of its shingles fall into each of G hash groups. Two sets share at
most the sum of the smaller counts of each group, so points whose sum is too small can't be similar. A
tree node keeps the largest counts below it, which bounds all of its points at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from strandweave.llm.subwords import split_words

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Groups of the vectors that the tree's nodes hold; points keep finer ones.
NODE_GROUPS = 32
#: Children of a node, and points of a leaf.
FANOUT = 16
LEAST_GROUPS = 16
#: Pairs whose counts are compared at one time.
PAIRS = 1 << 16
#: Groups of folded vectors held at one time.
TABLE_GROUPS = 1 << 22


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles of so many words.

    A-Z are lower-cased. A text with fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    split, starts = split_words(texts)
    coded = split.dictionary_encode()
    each = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    hashed = each[coded.indices.to_numpy()] if len(each) else np.empty(0, np.uint64)
    joined = np.zeros(max(len(hashed) - words + 1, 0), np.uint64)
    for i in range(words):
        joined = joined * _ODD + hashed[i : i + len(joined)]
    joined = _mixed(joined)
    sets = []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if end - begin >= words:
            sets.append(np.unique(joined[begin : end - words + 1]))
        elif end > begin:
            whole = np.full(1, end - begin, np.uint64)
            for h in hashed[begin:end]:
                whole = whole * _ODD + h
            sets.append(_mixed(whole))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def count_vector(members: np.ndarray) -> bytes:
    """Counts of the groups, four bits each; the number of groups is a power of two of about the set's size.

    Should a group hold over 15, the number of groups is doubled, so that counts are never cut off.
    """
    groups = max(LEAST_GROUPS, 1 << (len(members).bit_length() - 1)) if len(members) else LEAST_GROUPS
    while True:
        counts = np.bincount((members & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() <= 15:
            return (counts[0::2] * 16 + counts[1::2]).astype(np.uint8).tobytes()
        groups *= 2


def unpacked_vectors(packed: list[bytes]) -> list[np.ndarray]:
    found = []
    for one in packed:
        pairs = np.frombuffer(one, np.uint8)
        counts = np.empty(2 * len(pairs), np.uint8)
        counts[0::2], counts[1::2] = pairs >> 4, pairs & 15
        found.append(counts)
    return found


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The vector of fewer groups (of more, for a shorter vector, the even upper bound of each part)."""
    if len(counts) >= groups:
        return counts.reshape(-1, groups).sum(axis=0, dtype=np.int64)
    return np.tile(counts.astype(np.int64), groups // len(counts))


def similar_enough(shared: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of together ``total`` members that share so many reach the Jaccard similarity."""
    return (100 + percent) * shared >= percent * total


class CountTree:
    """A bulk-loaded R-tree over count vectors, for finding pairs of points that may be similar."""

    def __init__(self, sizes: np.ndarray, vectors: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        coarse = np.zeros((len(vectors), NODE_GROUPS), np.int32)
        for i, v in enumerate(vectors):
            coarse[i] = folded(v, NODE_GROUPS)
        # Packed by size first, then by the group that varies most.
        widest = int(np.argmax(coarse.std(axis=0))) if len(vectors) else 0
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (FANOUT * FANOUT)
        self.order = np.lexsort((coarse[:, widest], slab))
        tops, lows, highs = coarse[self.order], sizes[self.order], sizes[self.order]
        #: From the points up: largest counts, smallest and largest size below each node.
        self.levels = [(tops, lows, highs)]
        while len(tops) > 1:
            first = np.arange(0, len(tops), FANOUT)
            tops, lows, highs = (
                np.maximum.reduceat(tops, first, axis=0),
                np.minimum.reduceat(lows, first),
                np.maximum.reduceat(highs, first),
            )
            self.levels.append((tops, lows, highs))

    def _may(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tops, lows, highs = self.levels[level]
        sized = (100 * highs[a] >= self.percent * lows[b]) & (100 * highs[b] >= self.percent * lows[a])
        a, b = a[sized], b[sized]
        shared = np.empty(len(a), np.int64)
        for at in range(0, len(a), PAIRS):
            part = slice(at, at + PAIRS)
            shared[part] = np.minimum(tops[a[part]], tops[b[part]]).sum(axis=1, dtype=np.int64)
        sized[sized] = similar_enough(shared, lows[a] + lows[b], self.percent)
        return sized

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes one level below those of the given pairs, each once."""
        n_below = len(self.levels[level - 1][0])
        grid = np.arange(FANOUT)
        left = (a[:, None, None] * FANOUT + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
        right = (b[:, None, None] * FANOUT + 0 * grid[None, :, None] + grid[None, None, :]).ravel()
        inside = (left < n_below) & (right < n_below) & (left <= right)
        return left[inside], right[inside]

    def _below(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            apart = a < b
            a, b = a[apart], b[apart]
        keep = self._may(level, a, b)
        a, b = a[keep], b[keep]
        if level == 0:
            yield self.order[a], self.order[b]
            return
        step = PAIRS // (FANOUT * FANOUT)
        for at in range(0, len(a), step):
            yield from self._below(level - 1, *self._children(level, a[at : at + step], b[at : at + step]))

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the points of all pairs that no node or point bound rules out, each pair once.

        At most ``PAIRS`` come at a time, and as few are looked at on each level.
        """
        top = np.zeros(1, np.int64)
        yield from self._below(len(self.levels) - 1, top, top)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All ``parts`` together."""
        none = np.empty(0, np.int64)
        left, right = zip((none, none), *self.parts(), strict=True)
        return np.concatenate(left), np.concatenate(right)


def bounds(vectors: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most that the sets of each pair can share, by their finest common groups."""
    found = np.zeros(len(a), np.int64)
    sizes = np.array([len(v) for v in vectors])
    for wide, narrow in {(int(max(x, y)), int(min(x, y))) for x, y in zip(sizes[a], sizes[b], strict=True)}:
        these = np.flatnonzero((np.maximum(sizes[a], sizes[b]) == wide) & (np.minimum(sizes[a], sizes[b]) == narrow))
        # Folded vectors of a few million groups at a time, of pairs next to each other in their first set.
        these = these[np.lexsort((b[these], a[these]))]
        step = max(1, TABLE_GROUPS // (2 * narrow))
        for at in range(0, len(these), step):
            part = these[at : at + step]
            used, place = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
            table = np.empty((len(used), narrow), np.uint16)
            for row, i in enumerate(used.tolist()):
                table[row] = folded(vectors[i], narrow)
            found[part] = np.minimum(table[place[: len(part)]], table[place[len(part) :]]).sum(axis=1, dtype=np.int64)
    return found
