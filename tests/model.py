"""Plain sequential model of the graph steps, for checking small cases."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.translate(COMPLEMENT)[::-1]


def canonical(s: str) -> str:
    return min(s, rc(s))


def pack(s: str) -> int:
    value = 0
    for base in s:
        value = value * 4 + "ACGT".index(base)
    return value


def count(reads: list[str], k: int) -> Counter:
    windows = (r[i : i + k] for r in reads for i in range(len(r) - k + 1))
    return Counter(canonical(w) for w in windows if set(w) <= set("ACGT"))


def node(s: str) -> int:
    return 2 * pack(canonical(s)) + (s > rc(s))


class Edge:
    def __init__(self, kmer: str, direction: int, weight: int):
        u, v = node(kmer[:-1]), node(kmer[1:])
        self.eid = 2 * pack(kmer) + direction
        self.kmer, self.w = kmer, weight
        self.src, self.dst = (u, v) if direction == 0 else (v ^ 1, u ^ 1)
        self.label = kmer[-1] if direction == 0 else rc(kmer[0])


def edges_of(counts: dict[str, int]) -> list[Edge]:
    every = [Edge(kmer, d, w) for kmer, w in counts.items() for d in (0, 1)]
    return sorted(every, key=lambda e: (e.src, e.eid))


def prune(counts: dict[str, int], floor: int, threshold: float) -> tuple[dict[str, int], int]:
    """Surviving k-mers and the number of relative passes that removed something."""
    live = {s: w for s, w in counts.items() if w >= floor}
    passes = 0
    while True:
        heaviest = defaultdict(int)
        for e in edges_of(live):
            heaviest[e.src] = max(heaviest[e.src], e.w)
        limit = np.float32(threshold)
        weak = {e.kmer for e in edges_of(live) if np.float32(e.w) < limit * np.float32(heaviest[e.src])}
        if not weak:
            return live, passes
        passes += 1
        live = {s: w for s, w in live.items() if s not in weak}


class Unitig:
    def __init__(self, path: list[Edge], ring: bool):
        self.path, self.ring = path, ring
        self.uid, self.src, self.dst = path[0].eid, path[0].src, path[-1].dst
        self.bases = "".join(e.label for e in path)
        self.w_sum = sum(e.w for e in path)
        self.weight = np.float32(self.w_sum) / np.float32(len(path))


def unitigs(counts: dict[str, int]) -> list[Unitig]:
    every = edges_of(counts)
    out, into = defaultdict(list), Counter()
    for e in every:
        out[e.src].append(e)
        into[e.dst] += 1

    def linear(v: int) -> bool:
        return len(out[v]) == 1 and into[v] == 1

    seen: set[int] = set()

    def walk(e: Edge) -> list[Edge]:
        path = [e]
        seen.add(e.eid)
        while linear(path[-1].dst):
            onward = out[path[-1].dst][0]
            if onward.eid in seen:
                break
            path.append(onward)
            seen.add(onward.eid)
        return path

    found = [Unitig(walk(e), False) for e in every if not linear(e.src)]
    found += [Unitig(walk(e), True) for e in every if e.eid not in seen]
    return found


def twins(found: list[Unitig]) -> dict[int, int]:
    owner = {e.eid: u.uid for u in found for e in u.path}
    return {u.uid: owner[u.uid ^ 1] for u in found}


def components(found: list[Unitig]) -> dict[int, int]:
    near = defaultdict(set)
    for u in found:
        near[u.src >> 1].add(u.dst >> 1)
        near[u.dst >> 1].add(u.src >> 1)
    label: dict[int, int] = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            v = todo.pop()
            if v not in label:
                label[v] = start
                todo += near[v]
    return {u.uid: label[u.src >> 1] for u in found}


def walks(found: list) -> list[list]:
    """Greedy walks over unitigs of one or more components, in sweep order of ``found``."""
    entered = {u.dst for u in found}
    sources = sorted((u for u in found if u.src not in entered), key=lambda u: -u.weight)
    visited: set[int] = set()
    result = []
    for start in sources + list(found):
        path, here = [], start
        while here is not None and here.uid not in visited:
            visited.add(here.uid)
            path.append(here)
            options = [u for u in found if u.src == here.dst and u.uid not in visited]
            here = max(options, key=lambda u: u.weight, default=None)
        if path:
            result.append(path)
    return result


def node_text(v: int, n: int) -> str:
    text = "".join("ACGT"[(v >> 1) >> (2 * i) & 3] for i in reversed(range(n)))
    return rc(text) if v & 1 else text


def contigs(counts: dict[str, int], k: int) -> list[tuple[str, float, int]]:
    found = unitigs(counts)
    label = components(found)
    kept: dict[str, tuple[str, float, int]] = {}
    for c in sorted(set(label.values())):
        for path in walks([u for u in found if label[u.uid] == c]):
            text = node_text(path[0].src, k - 1) + "".join(u.bases for u in path)
            total, size = np.float32(0), 0
            for u in path:
                total = np.float32(total + u.weight * np.float32(len(u.bases)))
                size += len(u.bases)
            kept.setdefault(canonical(text), (text, float(total / np.float32(size)), len(path)))
    return sorted(kept.values(), key=lambda c: -len(c[0]))


def vote(hits: list[int], min_hits: int) -> tuple[int, int]:
    winner = counter = streak = 0
    for c in hits:
        if counter == 0:
            winner, counter, streak = c, 1, 1
        elif c == winner:
            counter, streak = counter + 1, streak + 1
        else:
            counter -= 1
    if not winner:
        return 0, 0
    n = streak if streak == counter else hits.count(winner)
    return (winner if n >= min_hits else 0), n
