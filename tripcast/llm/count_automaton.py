"""Weighted acyclic automata: counts of word sequences, built incrementally from sorted input.

A state has a weight (the count of the sequence that ends there, 0 if none does)
and labelled edges. Sequences are added in order; whatever the next one can no
longer extend is frozen, and frozen states with equal weight and equal edges are
one state. Labels are byte strings: the language first, then the words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

Path = tuple[bytes, ...]
_SPREAD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def label_code(label: bytes) -> int:
    return zlib.crc32(label)


def prefix_hash(codes: list) -> int | np.ndarray:
    """Hash of a prefix from its label codes; whole numbers and uint64 arrays give equal values."""
    if isinstance(codes[0], np.ndarray):
        h = np.uint64(len(codes))
        for c in codes:
            h = (h ^ c) * np.uint64(_SPREAD)
            h ^= h >> np.uint64(29)
        return h * np.uint64(_SPREAD)
    h = len(codes)
    for c in codes:
        h = ((h ^ c) * _SPREAD) & _MASK
        h ^= h >> 29
    return (h * _SPREAD) & _MASK


def range_of(path: Path, bits: int) -> int:
    """Prefix range of a sequence: the leading bits of the hash of its language and first two words."""
    return prefix_hash([label_code(x) for x in path[:3]]) >> (64 - bits)


class Builder:
    """Incremental construction from sequences in sorted order."""

    def __init__(self, names: list[bytes] | None = None):
        """Labels are byte strings, or positions in ``names`` if that is given."""
        self.names = names
        self.weights: list[int] = []
        self.edges: list[tuple] = []  # flat (label, target, label, target ..) of every frozen state
        self.register: dict[tuple, int] = {}
        self.path: list = []
        self.open: list[list] = [[0]]  # [weight, label, target, ...] of every state on the current path

    def _freeze(self) -> None:
        state = tuple(self.open.pop())
        at = self.register.get(state)
        if at is None:
            at = self.register[state] = len(self.weights)
            self.weights.append(state[0])
            self.edges.append(state[1:])
        self.open[-1] += (self.path.pop(), at)

    def add(self, sequence: tuple, weight: int) -> None:
        path, k = self.path, 0
        for a, b in zip(path, sequence):
            if a != b:
                break
            k += 1
        while len(path) > k:
            self._freeze()
        for label in sequence[k:]:
            path.append(label)
            self.open.append([0])
        self.open[-1][0] += weight

    def finish(self) -> bytes:
        """The automaton as bytes, with its labels as byte strings."""
        while self.path:
            self._freeze()
        root = self.open[0]
        weights, edges = [*self.weights, root[0]], [*self.edges, tuple(root[1:])]
        labels = sorted({x for e in edges for x in e[::2]})
        number = {x: i for i, x in enumerate(labels)}
        starts = np.zeros(len(edges) + 1, np.int32)
        np.cumsum([len(e) // 2 for e in edges], out=starts[1:])
        return self._pack(labels, np.array(weights, np.int64), starts, np.array([number[x] for e in edges for x in e[::2]], np.int32),
                          np.array([x for e in edges for x in e[1::2]], np.int32))

    def _pack(self, labels: list, weights: np.ndarray, starts: np.ndarray, on: np.ndarray, to: np.ndarray) -> bytes:
        text = [self.names[i] for i in labels] if self.names is not None else labels
        sizes = np.array([len(x) for x in text], np.int32)
        head = np.array([len(text), len(weights), len(on)], np.int32)
        return b"".join([head.tobytes(), weights.tobytes(), sizes.tobytes(), starts.tobytes(), on.tobytes(), to.tobytes(), *text])


class Automaton:
    """A finished automaton; state ``root`` is where every sequence starts."""

    def __init__(self, packed: bytes):
        n_labels, n_states, n_edges = np.frombuffer(packed, np.int32, 3).tolist()
        at = 12
        parts = []
        for kind, n in ((np.int64, n_states), (np.int32, n_labels), (np.int32, n_states + 1), (np.int32, n_edges), (np.int32, n_edges)):
            parts.append(np.frombuffer(packed, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.weights, sizes, self.starts, on, self.to = (p.tolist() for p in parts)
        ends = np.cumsum(parts[1], dtype=np.int64) + at
        self.labels = [packed[e - s: e] for s, e in zip(sizes, ends.tolist())]
        self.on = [self.labels[i] for i in on]
        self.root = n_states - 1

    def sequences(self, state: int | None = None, path: Path = ()) -> Iterator[tuple[Path, int]]:
        """All sequences with their weights, in sorted order."""
        state = self.root if state is None else state
        for e in range(self.starts[state], self.starts[state + 1]):
            longer, to = (*path, self.on[e]), self.to[e]
            if self.weights[to]:
                yield longer, self.weights[to]
            yield from self.sequences(to, longer)


def union(parts: list[Automaton], least: int = 1) -> Iterator[tuple[Path, int]]:
    """The sequences of all automata with their weights added, in sorted order. A sequence lighter than ``least`` goes,
    and all longer ones with it (none of them is heavier)."""

    def walk(states: list[tuple[Automaton, int]], path: Path) -> Iterator[tuple[Path, int]]:
        below: dict[bytes, list] = {}
        for a, s in states:
            for e in range(a.starts[s], a.starts[s + 1]):
                to = (a, a.to[e])
                if (found := below.get(a.on[e])) is None:
                    below[a.on[e]] = [to]
                else:
                    found.append(to)
        for label in sorted(below):
            total = 0
            for a, s in below[label]:
                total += a.weights[s]
            if 0 < total < least:
                continue
            longer = (*path, label)
            if total:
                yield longer, total
            yield from walk(below[label], longer)

    return walk([(a, a.root) for a in parts], ())


def compose(asked: Automaton, counts: Automaton) -> Iterator[tuple[Path, int]]:
    """The sequences of ``asked`` with their weights in ``counts``, by one walk over both."""

    def walk(s: int, t: int, path: Path) -> Iterator[tuple[Path, int]]:
        edges = {counts.on[e]: counts.to[e] for e in range(counts.starts[t], counts.starts[t + 1])}
        for e in range(asked.starts[s], asked.starts[s + 1]):
            if (to := edges.get(asked.on[e])) is not None:
                longer = (*path, asked.on[e])
                if asked.weights[asked.to[e]] and counts.weights[to]:
                    yield longer, counts.weights[to]
                yield from walk(asked.to[e], to, longer)

    return walk(asked.root, counts.root, ())
