"""Small numpy helpers that run inside Arrow tasks; Spark does the partitioning around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bases turned into windows at one time, which bounds the memory of a task.
MAX_BASES = 4_000_000

_CODE = np.full(256, 4, dtype=np.uint8)
for _digit, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _letter in _letters:
        _CODE[ord(_letter)] = _digit


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of an Arrow string column, without copying the text."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(digits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed value of every length-k window and of its reverse complement.

    Windows of length a and b that follow each other join into one of length a + b, so k is
    reached by doubling, in O(log k) array passes.
    """
    fwd, rev = digits.astype(np.int64), (3 - digits).astype(np.int64)
    have, out = 1, None
    remaining = k
    while True:
        if remaining & 1:
            if out is None:
                out, length = (fwd, rev), have
            else:
                n = max(len(digits) - length - have + 1, 0)
                f, r = out
                out = (
                    (f[:n] << (2 * have)) | fwd[length : length + n],
                    r[:n] | (rev[length : length + n] << (2 * length)),
                )
                length += have
        remaining >>= 1
        if not remaining:
            return out
        n = max(len(digits) - 2 * have + 1, 0)
        fwd, rev = (
            (fwd[:n] << (2 * have)) | fwd[have : have + n],
            rev[:n] | (rev[have : have + n] << (2 * have)),
        )
        have *= 2


def canonical_windows(data: np.ndarray, offsets: np.ndarray, k: int):
    """Row number, 0-based position and canonical packed k-mer of every valid window.

    A window is valid when it lies inside one row and holds only ACGT.
    """
    none = np.empty(0, np.int64)
    if len(data) < k:
        return none, none, none
    codes = _CODE[data]
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    fwd, rev = _windows(np.where(codes > 3, 0, codes), k)
    n = len(fwd)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.arange(n)
    ok = (bad[k:] == bad[:n]) & (start + k <= offsets[row + 1])
    at = np.flatnonzero(ok)
    return row[at], at - offsets[row[at]], np.minimum(fwd[at], rev[at])


# ---- runs of windows that share a minimizer --------------------------------------------------

_SCRAMBLE = 0x2C1B5
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def minimizer_runs(data: np.ndarray, offsets: np.ndarray, k: int, m: int):
    """Runs of valid windows of a row that follow each other and share their smallest m-mer.

    Returns the codes of ``data``, each run's row, first base, number of bases, and hash of its m-mer. An
    m-mer counts as its smaller strand, scrambled so that none is favoured; both strands of a window agree.
    """
    none = np.empty(0, np.int64)
    codes = _CODE[data]
    if len(data) < k:
        return codes, none, none, none, none.view(np.uint64)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    codes = np.where(codes > 3, 0, codes).astype(np.uint8)
    fwd, rev = _windows(codes, m)
    low = (np.minimum(fwd, rev) * _SCRAMBLE) & ((1 << 2 * m) - 1)
    reach, width = 1, k - m + 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: reach - width], low[width - reach :])
    n = len(low)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    ok = (bad[k:] == bad[:n]) & (np.arange(n) + k <= offsets[row + 1])
    # Between the valid windows of two rows there are always windows that are not valid.
    begins = ok.copy()
    begins[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    ends = ok.copy()
    ends[:-1] &= ~ok[1:] | (low[1:] != low[:-1])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    return codes, row[first], first, last + k - first, low[first].astype(np.uint64) * _SPREAD


def runs_by_slices(data: np.ndarray, offsets: np.ndarray, k: int, m: int, limit: int = MAX_BASES // 8):
    """What :func:`minimizer_runs` returns, worked out a few rows at a time, as its arrays take many times their bases."""
    found = []
    for lo, hi in slices(offsets, limit):
        codes, row, first, size, own = minimizer_runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k, m)
        found.append((codes, row + lo, first + offsets[lo], size, own))
    return [np.concatenate(parts) for parts in zip(*found, strict=True)]


def each(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``first .. first + size - 1`` of every item, in a row."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def pack_runs(codes: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bases a byte, every run on bytes of its own, and the byte at which each run ends."""
    ends = np.cumsum((size + 3) // 4)
    packed = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = 0
    while at < len(size):
        # Places are eight bytes a base, so a few runs at a time.
        begin = int(ends[at - 1]) if at else 0
        stop = max(int(np.searchsorted(ends, begin + MAX_BASES // 32, side="right")), at + 1)
        own = size[at:stop]
        padded = (own + 3) // 4 * 4
        bases = np.zeros(int(padded.sum()), np.uint8)
        bases[each(np.cumsum(padded) - padded, own)] = codes[each(first[at:stop], own)]
        quads = bases.reshape(-1, 4)
        packed[begin : int(ends[stop - 1])] = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
        at = stop
    return packed, ends


def distinct_runs(
    packed: np.ndarray, ends: np.ndarray, size: np.ndarray, bucket: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of :func:`pack_runs` sorted by bucket, equal ones once, and how often each occurs.

    Runs of over 64 bases are not compared.
    """
    width = np.diff(ends, prepend=0)
    begin = ends - width
    held = np.concatenate([packed, np.zeros(16, np.uint8)])
    words = np.ndarray(len(held) - 8, ">u8", held, strides=(1,))
    unused = (64 - 8 * np.minimum(width, 8)).astype(np.uint64)
    head = words[begin].astype(np.uint64) >> unused
    unused = (64 - 8 * np.clip(width - 8, 1, 8)).astype(np.uint64)
    tail = np.where(width > 8, words[begin + 8].astype(np.uint64) >> unused, np.uint64(0))
    mixed = (head * _SPREAD) ^ (tail + size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    order = np.lexsort((mixed, bucket))
    equal = size[order] <= 64
    equal[:1] = False
    for column in (bucket, size, head, tail):
        equal[1:] &= column[order[1:]] == column[order[:-1]]
    starts = np.flatnonzero(~equal)
    kept = order[starts]
    times = np.diff(np.append(starts, len(order)))
    return packed[each(begin[kept], width[kept])], np.cumsum(width[kept]), size[kept], bucket[kept], times


def _loader(packed: np.ndarray):
    """Reads ``k`` bases of packed runs from given places (in bases, four to a byte).

    They are read from the eight bytes they begin in and, where they reach further, a ninth.
    """
    held = np.concatenate([packed, np.zeros(16, np.uint8)])
    words = np.ndarray(len(held) - 8, ">u8", held, strides=(1,))

    def load(place: np.ndarray, k: int) -> np.ndarray:
        shift = (2 * (place & 3)).astype(np.uint64)
        place = place >> 2
        value = words[place].astype(np.uint64) << shift
        if k > 29:
            value |= held[place + 8].astype(np.uint64) >> (np.uint64(8) - shift)
        return (value >> np.uint64(64 - 2 * k)).astype(np.int64)

    return load


def run_starts(size: np.ndarray) -> np.ndarray:
    """Where packed runs begin, in bases of whole bytes."""
    return 4 * (np.cumsum((size + 3) // 4) - (size + 3) // 4)


_LETTERS = np.array([[b"ACGT"[byte >> shift & 3] for shift in (6, 4, 2, 0)] for byte in range(256)], np.uint8)


def unpacked(packed: np.ndarray, size: np.ndarray, skip: int = 0) -> np.ndarray:
    """Letters of packed runs in a row, without the first ``skip`` of each."""
    return _LETTERS[packed].reshape(-1)[each(run_starts(size) + skip, size - skip)]


def oriented_windows(packed: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed k-mers of all windows of packed runs as they are read, and their reverse complements."""
    n_windows = size - k + 1
    fwd = _loader(packed)(each(run_starts(size), n_windows), k)
    return fwd, _revcomp(fwd, k)


def first_windows(packed: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Canonical packed first k-mer of each packed run."""
    kmer = _loader(packed)(run_starts(size), k)
    return np.minimum(kmer, _revcomp(kmer, k))


def run_windows(packed: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Canonical packed k-mers of all windows of packed runs, run by run."""
    load = _loader(packed)
    n_windows = size - k + 1
    first = run_starts(size)
    found = np.empty(int(n_windows.sum()), np.int64)
    ends = np.cumsum(n_windows)
    at = 0
    while at < len(size):
        begin = int(ends[at - 1]) if at else 0
        stop = max(int(np.searchsorted(ends, begin + MAX_BASES // 8, side="right")), at + 1)
        kmer = load(each(first[at:stop], n_windows[at:stop]), k)
        found[begin : int(ends[stop - 1])] = np.minimum(kmer, _revcomp(kmer, k))
        at = stop
    return found


#: Lowest bits of a weighted k-mer that say how many times it stands there (1 to 3); 62 bits are left for the k-mer.
WEIGHT_BITS = 2


def weighted_windows(packed: np.ndarray, size: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers of the windows of packed runs that occur several times, above :data:`WEIGHT_BITS` bits of weight."""
    most = (1 << WEIGHT_BITS) - 1
    keys = run_windows(packed, size, k).view(np.uint64)
    keys <<= np.uint64(WEIGHT_BITS)
    n_windows = size - k + 1
    more = (times - 1) // most
    often = np.flatnonzero(more)
    extra = keys[each((np.cumsum(n_windows) - n_windows)[often], n_windows[often])] | np.uint64(most)
    keys |= np.repeat((times - most * more).astype(np.uint8), n_windows)
    return np.concatenate([keys, np.repeat(extra, np.repeat(more[often], n_windows[often]))]) if len(often) else keys


def counted_chains(
    packed: np.ndarray, size: np.ndarray, times: np.ndarray, k: int, min_count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers of packed runs that occur at least ``min_count`` times, chained as they stand in the runs.

    Returns the k-mers as they are read, the number of k-mers of each chain, and the count of each k-mer.
    """
    n_windows = size - k + 1
    fwd, rc = oriented_windows(packed, size, k)
    kmer = np.minimum(fwd, rc)
    del rc
    order = np.argsort(kmer)
    kmer = kmer[order]
    first = np.flatnonzero(np.diff(kmer, prepend=~kmer[:1]))
    del kmer
    cnt = np.add.reduceat(np.repeat(times, n_windows)[order], first) if len(first) else first
    at = np.minimum.reduceat(order, first) if len(first) else first
    del order
    kept = np.flatnonzero(cnt >= min_count)
    kept = kept[np.argsort(at[kept])]
    at, cnt = at[kept], cnt[kept]
    # A chain goes on where the window before it in the run was kept too.
    run_begins = np.zeros(len(fwd) + 1, bool)
    run_begins[np.cumsum(n_windows) - n_windows] = True
    begins = np.flatnonzero((np.diff(at, prepend=-2) != 1) | run_begins[at])
    return fwd[at], np.diff(np.append(begins, len(at))), cnt


def counted(values: np.ndarray, limit: int = MAX_BASES // 8, bits: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct values in order and how often each occurs; sorts ``values`` in place.

    They come in parts of about ``limit`` values, as the arrays of a part take many times its values. With ``bits``
    the lowest bits of a value are its weight.
    """
    values.sort()
    begin, weight, shift = 0, values.dtype.type((1 << bits) - 1), values.dtype.type(bits)
    while begin < len(values):
        stop = min(begin + limit, len(values))
        # A part ends where a value does.
        stop = int(np.searchsorted(values, values[stop - 1] | weight, side="right"))
        part = values[begin:stop] >> shift
        first = np.flatnonzero(np.diff(part, prepend=~part[:1]))
        times = np.add.reduceat(values[begin:stop] & weight, first) if bits else np.diff(np.append(first, len(part)))
        yield part[first].astype(np.int64), times.astype(np.int64)
        begin = stop


def counted_apart(
    parts: list[np.ndarray], limit: int = MAX_BASES // 8, bits: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of several arrays, each counted by itself and the sorted counts merged, a range of values at a time."""
    parts = [part for part in parts if len(part)]
    for part in parts:
        part.sort()
    while parts:
        # Up to the value that the first of the parts reaches after ``limit`` values.
        top = min((part[limit - 1] for part in parts if len(part) > limit), default=None)
        if top is not None:
            top |= top.dtype.type((1 << bits) - 1)
        stops = [len(part) if top is None else int(np.searchsorted(part, top, side="right")) for part in parts]
        counts_of = (x for part, stop in zip(parts, stops, strict=True) for x in counted(part[:stop], max(stop, 1), bits))
        values, counts = zip(*counts_of, strict=True)
        values, counts = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.flatnonzero(np.diff(values, prepend=~values[:1]))
        yield values[first], np.add.reduceat(counts[order], first)
        parts = [part[stop:] for part, stop in zip(parts, stops, strict=True) if stop < len(part)]


def slices(offsets: np.ndarray, limit: int = MAX_BASES):
    """Row ranges that hold about ``limit`` bases each (at least one row)."""
    row, n_rows = 0, len(offsets) - 1
    while row < n_rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n_rows)
        yield row, stop
        row = stop


# ---- chains ----------------------------------------------------------------------------


def link_ranks(nxt: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head and rank of every item of the chains given by ``nxt`` (-1 ends a chain)."""
    prev = np.full(len(nxt), -1, dtype=np.int64)
    has_next = np.flatnonzero(nxt >= 0)
    prev[nxt[has_next]] = has_next
    return chain_ranks(prev, key)


def chain_ranks(prev: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head and rank of every item from its predecessor (-1 for none).

    A closed ring is opened in front of its item with the smallest ``key``.
    """
    head, rank = _jump(prev)
    ring = np.flatnonzero(prev[head] >= 0)
    if len(ring):
        least = ring[_ring_minimum(prev, key, ring)]
        prev = prev.copy()
        prev[least] = -1
        head, rank = _jump(prev)
    return head, rank


def rank_links(ids: np.ndarray, prev_ids: np.ndarray, low: np.ndarray):
    """Head id, rank and ring flag of items linked by id; a head itself is not among the items."""
    if not len(ids):
        return ids, ids, np.empty(0, dtype=bool)
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, prev_ids, sorter=order), len(ids) - 1)]
    prev = np.where(ids[at] == prev_ids, at, -1)
    head, rank = chain_ranks(prev, low)
    ring = prev[head] >= 0
    return np.where(ring, ids[head], prev_ids[head]), np.where(ring, rank, rank + 1), ring


def _jump(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointer doubling towards the head; items of a ring keep a head that has a predecessor."""
    items = np.arange(len(prev))
    anc = np.where(prev >= 0, prev, items)
    rank = (prev >= 0).astype(np.int64)
    open_items = np.count_nonzero(prev[anc] >= 0)
    while open_items:
        rank = rank + rank[anc]
        anc = anc[anc]
        left = np.count_nonzero(prev[anc] >= 0)
        if left == open_items:
            break
        open_items = left
    return anc, rank


def _ring_minimum(prev: np.ndarray, key: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """True for the ring items that hold the smallest key of their ring."""
    low, anc = key.copy(), prev.copy()
    while True:
        new = low.copy()
        new[ring] = np.minimum(low[ring], low[anc[ring]])
        anc[ring] = anc[anc[ring]]
        if np.array_equal(new, low):
            return key[ring] == low[ring]
        low = new


def kmer_chains(kmer: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical k-mers put in chains, each overlapping the next by k - 1 bases.

    Returns the order, the k-mers as they stand in their chains, and the number of k-mers of each chain. Every k-mer
    is in one chain once; any k-mers may be chained in any way, as chains only serve to store them in little space.
    """
    n, rest = len(kmer), (1 << 2 * (k - 1)) - 1
    rc = _revcomp(kmer, k)
    # Where a k-mer is left: side 2 i is its start, read backwards, and side 2 i + 1 its end.
    leaves = np.empty(2 * n, np.int64)
    leaves[0::2] = _nodes(kmer >> 2, rc & rest) ^ 1
    leaves[1::2] = _nodes(kmer & rest, rc >> 2)
    order = np.argsort(leaves, kind="stable")
    strand = leaves[order] & 1
    node = leaves[order] >> 1
    starts = np.flatnonzero(np.diff(node, prepend=~node[:1]))
    size = np.diff(np.append(starts, 2 * n))
    n_back = np.add.reduceat(strand, starts) if n else starts
    # Sides that leave to a node and to its twin are paired in turn.
    back = np.flatnonzero(strand)
    group = np.repeat(np.arange(len(starts)), size)[back]
    turn = back - starts[group] - (size - n_back)[group]
    paired = turn < (size - n_back)[group]
    a, b = order[starts[group[paired]] + turn[paired]], order[back[paired]]
    mate = np.full(2 * n, -1, np.int64)
    mate[a], mate[b] = b, a
    # State 2 i reads k-mer i forwards and leaves by side 2 i + 1; the side entered by is the next state.
    states = np.arange(2 * n)
    head, rank = link_ranks(mate[states ^ 1], states)
    # A chain and the same chain read backwards share no state; one of them stays.
    kept = np.flatnonzero(head < head[head ^ 1])
    n_of = np.bincount(head[kept], minlength=2 * n)
    first = np.cumsum(n_of) - n_of
    placed = np.empty(n, np.int64)
    placed[first[head[kept]] + rank[kept]] = kept
    at = placed >> 1
    return at, np.where(placed & 1, rc[at], kmer[at]), n_of[n_of > 0]


def pack_chains(oriented: np.ndarray, n_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs of chained k-mers (see :func:`kmer_chains`) and the number of bases of each."""
    size = n_of + k - 1
    begin = np.cumsum(size) - size
    codes = np.empty(int(size.sum()), np.uint8)
    heads = oriented[np.cumsum(n_of) - n_of]
    for i in range(k - 1):
        codes[begin + i] = (heads >> 2 * (k - 1 - i)) & 3
    codes[each(begin + k - 1, n_of)] = oriented & 3
    return pack_runs(codes, begin, size)[0], size


#: Columns of a chain segment: a path of edges whose inner nodes are all linear.
SEGMENT_SCHEMA = (
    "src bigint, dst bigint, src_linear boolean, first_eid bigint, last_eid bigint, "
    "w_sum bigint, n_edges bigint, bases string"
)
#: What is told about rings besides: their edge with the smallest source node, its place, and the edge with the
#: smallest source among twins.
RING_SCHEMA = "low_src bigint, low_at bigint, low_eid bigint, twin_eid bigint"


def _revcomp(kmer: np.ndarray, k: int) -> np.ndarray:
    """Reverse complement of packed k-mers: swap ever wider neighbouring groups of bits."""
    x = ~kmer.astype(np.uint64)
    for width in (2, 4, 8, 16, 32):
        low = np.uint64(sum(((1 << width) - 1) << at for at in range(0, 64, 2 * width)))
        step = np.uint64(width)
        x = ((x & low) << step) | ((x >> step) & low)
    return (x >> np.uint64(64 - 2 * k)).astype(np.int64)


def end_minimizers(kmer: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest m-mer of the first and of the last k - 1 bases of packed k-mers, either strand, scrambled."""
    rc, window = _revcomp(kmer, k), (1 << 2 * m) - 1

    def at(i: int) -> np.ndarray:
        own, back = (kmer >> 2 * (k - m - i)) & window, (rc >> 2 * i) & window
        return (np.minimum(own, back) * _SCRAMBLE) & window

    first, last = at(0), at(k - m)
    for i in range(1, k - m):
        inner = at(i)
        np.minimum(first, inner, out=first)
        np.minimum(last, inner, out=last)
    return first, last


def hashed_bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (((values.astype(np.uint64) * _SPREAD) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _nodes(text: np.ndarray, text_rc: np.ndarray) -> np.ndarray:
    """Oriented nodes of packed (k-1)-mers, given both strands."""
    return np.where(text <= text_rc, 2 * text, 2 * text_rc + 1)


def edge_nodes(eid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Source and destination of edges, worked out from the k-mer."""
    kmer, forward, rest = eid >> 1, (eid & 1) == 0, (1 << 2 * (k - 1)) - 1
    rc = _revcomp(kmer, k)
    u, v = _nodes(kmer >> 2, rc & rest), _nodes(kmer & rest, rc >> 2)
    return np.where(forward, u, v ^ 1), np.where(forward, v, u ^ 1)


def linear_sources(src: np.ndarray) -> np.ndarray:
    """Whether the source of each edge has one way out and one way in, from all out-edges of both its strands."""
    order = np.argsort(src)
    ordered = src[order]
    node = ordered >> 1
    fresh = np.diff(node, prepend=-1) != 0
    # Two edges, one from each strand.
    pair = np.zeros(len(src), bool)
    pair[:-1] = fresh[:-1] & ~fresh[1:] & (ordered[:-1] != ordered[1:])
    pair[:-2] &= fresh[2:]
    pair[1:] |= pair[:-1].copy()
    out = np.empty(len(src), bool)
    out[order] = pair
    return out


def strand_degrees(src: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical sources of edges, and how many edges leave the forward and the other strand of each."""
    ordered = np.sort(src)
    starts = np.flatnonzero(np.diff(ordered >> 1, prepend=-1))
    rev = np.add.reduceat(ordered & 1, starts) if len(starts) else starts
    return ordered[starts] >> 1, np.diff(np.append(starts, len(src))) - rev, rev


def lighter_edges(src: np.ndarray, w: np.ndarray, share: float) -> np.ndarray:
    """Places of the edges lighter than ``share`` times the heaviest of their source, in single precision."""
    order = np.argsort(src)
    starts = np.flatnonzero(np.diff(src[order], prepend=-1))
    heaviest = np.repeat(np.maximum.reduceat(w[order], starts), np.diff(np.append(starts, len(src))))
    return order[w[order].astype(np.float32) < np.float32(share) * heaviest.astype(np.float32)]


def edges_to_segments(eid: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, k: int) -> pa.Table:
    """Segments of one edge each, given all out-edges of their sources."""
    n, kmer = len(eid), eid >> 1
    last = np.where((eid & 1) == 0, kmer, _revcomp(kmer, k)) & 3
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[last]
    return pa.table(
        {
            "src": src,
            "dst": dst,
            "src_linear": linear_sources(src),
            "first_eid": eid,
            "last_eid": eid,
            "w_sum": w,
            "n_edges": np.ones(n, np.int64),
            "bases": pa.StringArray.from_buffers(
                n, pa.py_buffer(np.arange(n + 1, dtype=np.int32)), pa.py_buffer(letters)
            ),
        }
    )


def with_rings(segments: pa.Table, k: int) -> pa.Table:
    """Add the columns of :data:`RING_SCHEMA` to joined segments; they are null but for rings, which still start at a
    linear node."""
    ring = np.flatnonzero(segments["src_linear"].to_numpy())
    found: dict[str, list] = {name: [None] * segments.num_rows for name in ("low_src", "low_at", "low_eid", "twin_eid")}
    for row in ring.tolist():
        eid = np.array([segments["first_eid"][row].as_py()])
        oriented = int((eid if eid[0] & 1 == 0 else 2 * _revcomp(eid >> 1, k))[0]) >> 1
        start = np.array([(oriented >> 2 * i) & 3 for i in range(k - 1, 0, -1)], np.uint8)
        fwd, rev = _windows(np.concatenate([start, _CODE[np.frombuffer(segments["bases"][row].as_py().encode(), np.uint8)]]), k)
        eids = np.where(fwd <= rev, 2 * fwd, 2 * rev + 1)
        src, dst = edge_nodes(eids, k)
        low, twin = int(np.argmin(src)), int(np.argmin(dst ^ 1))
        for name, value in (("low_src", src[low]), ("low_at", low), ("low_eid", eids[low]), ("twin_eid", eids[twin] ^ 1)):
            found[name][row] = int(value)
    for name, values in found.items():
        segments = segments.append_column(name, pa.array(values, pa.int64()))
    return segments


def join_segments(segments: pa.Table) -> pa.Table:
    """Join the segments at hand wherever one ends at the linear node another starts from.

    Whatever has its neighbour elsewhere is passed on unjoined, so any split of the segments
    over calls is right; a good split only leaves fewer segments.
    """
    if not segments.num_rows:
        return segments
    col = {c: segments[c].to_numpy() for c in segments.column_names if c != "bases"}
    linear = np.flatnonzero(col["src_linear"])
    linear = linear[np.argsort(col["src"][linear], kind="stable")]
    sources = col["src"][linear]
    nxt = np.full(segments.num_rows, -1, dtype=np.int64)
    if len(sources):
        at = np.minimum(np.searchsorted(sources, col["dst"]), len(sources) - 1)
        nxt = np.where(sources[at] == col["dst"], linear[at], -1)
    head, rank = link_ranks(nxt, col["first_eid"])

    order = np.lexsort((rank, head))
    col = {c: v[order] for c, v in col.items()}
    starts = np.flatnonzero(np.diff(head[order], prepend=-1))
    stops = np.append(starts[1:], len(order))
    first, last = starts, stops - 1

    text, offsets = text_bytes(_one_array(segments["bases"]).take(pa.array(order)))
    joined = pa.LargeStringArray.from_buffers(
        len(starts),
        pa.py_buffer(np.append(offsets[starts], offsets[-1])),
        pa.py_buffer(np.ascontiguousarray(text)),
    )
    return pa.table(
        {
            "src": col["src"][first],
            "dst": col["dst"][last],
            "src_linear": col["src_linear"][first],
            "first_eid": col["first_eid"][first],
            "last_eid": col["last_eid"][last],
            "w_sum": np.add.reduceat(col["w_sum"], starts),
            "n_edges": np.add.reduceat(col["n_edges"], starts),
            "bases": joined.cast(pa.string()),
        }
    )


_MARKED = ("first_eid", "last_eid", "src", "dst")


def pack_segments(segments: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments as packed runs, source node included, with the bases, weight and marks of each.

    Marks say whether the source is linear, the directions of the first and the last edge and the strands of both nodes,
    which palindromes don't tell.
    """
    src, n_edges = segments["src"].to_numpy(), segments["n_edges"].to_numpy()
    text = np.where(src & 1, _revcomp(src >> 1, k - 1), src >> 1)
    size = n_edges + k - 1
    begin = np.cumsum(size) - size
    codes = np.empty(int(size.sum()), np.uint8)
    for i in range(k - 1):
        codes[begin + i] = (text >> 2 * (k - 2 - i)) & 3
    letters, _ = text_bytes(_one_array(segments["bases"]))
    codes[each(begin + k - 1, n_edges)] = _CODE[letters]
    marks = segments["src_linear"].to_numpy().astype(np.uint8)
    for bit, name in enumerate(_MARKED, 1):
        marks |= ((segments[name].to_numpy() & 1) << bit).astype(np.uint8)
    return pack_runs(codes, begin, size)[0], size, segments["w_sum"].to_numpy(), marks


def segment_ends(packed: np.ndarray, size: np.ndarray, marks: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Columns of packed segments that their bases tell."""
    load, begin = _loader(packed), run_starts(size)

    def number(name: str, place: np.ndarray, length: int) -> np.ndarray:
        text = load(place, length)
        return 2 * np.minimum(text, _revcomp(text, length)) + (marks >> (_MARKED.index(name) + 1) & 1)

    n_edges = size - k + 1
    return {
        "src": number("src", begin, k - 1),
        "dst": number("dst", begin + n_edges, k - 1),
        "src_linear": (marks & 1).astype(bool),
        "first_eid": number("first_eid", begin, k),
        "last_eid": number("last_eid", begin + n_edges - 1, k),
    }


def unpack_segments(packed: np.ndarray, size: np.ndarray, w_sum: np.ndarray, marks: np.ndarray, k: int) -> pa.Table:
    """The segments of :func:`pack_segments`."""
    n_edges = size - k + 1
    letters = unpacked(packed, size, k - 1)
    offsets = np.concatenate(([0], np.cumsum(n_edges))).astype(np.int64)
    bases = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(letters))
    columns = segment_ends(packed, size, marks, k) | {"w_sum": w_sum.astype(np.int64), "n_edges": n_edges}
    return pa.table(columns | {"bases": bases.cast(pa.string())})


def taken_runs(packed: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs in another order, and the byte at which each ends."""
    width = (size + 3) // 4
    begin = np.cumsum(width) - width
    return packed[each(begin[order], width[order])], np.cumsum(width[order])


def scattered(nodes: np.ndarray, turn: int) -> np.ndarray:
    """Hashes of numbers, others in each turn."""
    x = (nodes.astype(np.uint64) + np.uint64((turn + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * _SPREAD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


# ---- graph ------------------------------------------------------------------------------


def component_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of an edge list and the smallest vertex each is connected to."""
    vertices, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(vertices))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        new = new[new]
        if np.array_equal(new, label):
            return vertices, vertices[label]
        label = new


def greedy_walks(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk (row of its first unitig) and step of every unitig, in sweep order of the rows.

    Walks begin at unitigs nothing leads to, heaviest first, then at whatever is left in row
    order. A walk goes on with the heaviest unvisited unitig and ends where there is none.
    """
    n = len(src)
    by_weight = np.argsort(-weight, kind="stable")
    onward: dict[int, list[int]] = {}
    for row in by_weight[::-1].tolist():
        onward.setdefault(int(src[row]), []).append(row)
    is_source = ~np.isin(src, dst)
    starts = by_weight[is_source[by_weight]].tolist() + list(range(n))
    ends = dst.tolist()
    walk, step = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for first in starts:
        row, at = first, 0
        while row is not None and walk[row] < 0:
            walk[row], step[row], at = first, at, at + 1
            options = onward.get(ends[row], [])
            while options and walk[options[-1]] >= 0:
                options.pop()
            row = options[-1] if options else None
    return walk, step


# ---- mapping ----------------------------------------------------------------------------


def majority_votes(row: np.ndarray, contig: np.ndarray, n_rows: int, min_hits: int):
    """Contig and hits of every row from its hits in order; see ``operators.mapping.vote``.

    Rows are advanced together, one hit of each per pass.
    """
    winner, counter, streak = (np.zeros(n_rows, dtype=np.int64) for _ in range(3))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    left = np.diff(np.append(first, len(row)))
    at = first
    while len(at):
        r, c = row[at], contig[at]
        fresh = counter[r] == 0
        same = ~fresh & (winner[r] == c)
        winner[r[fresh]] = c[fresh]
        streak[r[fresh]] = 0
        counter[r] += np.where(fresh | same, 1, -1)
        streak[r] += fresh | same
        more = left > 1
        at, left = at[more] + 1, left[more] - 1
    total = np.bincount(row[winner[row] == contig], minlength=n_rows)
    hits = np.where(streak == counter, streak, total)
    return np.where(hits >= min_hits, winner, 0), hits


def plurality_votes(row: np.ndarray, contig: np.ndarray, n_rows: int, min_hits: int):
    """Contig with the most hits of every row, the lowest id when tied, and its hits."""
    known, place = np.unique(contig, return_inverse=True)
    key, n = np.unique(row * max(len(known), 1) + place, return_counts=True)
    of_row, place = key // max(len(known), 1), key % max(len(known), 1)
    order = np.lexsort((place, -n, of_row))
    best = order[np.diff(of_row[order], prepend=-1) != 0]
    winner, hits = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    winner[of_row[best]], hits[of_row[best]] = known[place[best]], n[best]
    return np.where(hits >= min_hits, winner, 0), hits
