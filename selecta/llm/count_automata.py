"""Weighted acyclic automata over word sequences: count transducers.

A transducer maps strings of a fixed number of labels (a language, then ``depth`` words, the end marked by the
empty word) to counts; the weight of a prefix is the sum over the strings that begin with it. It is built level
by level from sorted strings: equal states (same labels, same targets, same weights) are
registered once, from the last level upwards, so common continuations are stored once. Labels are
numbers into the transducer's own sorted word list, so their order is the byte order of the words.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

from selecta.llm.common import U64, mix

_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def vocabulary(words: pa.Array) -> tuple[np.ndarray, list]:
    """(number of each word, sorted distinct words); number 0 is the empty word, which marks an end."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = coded.dictionary.to_pylist()
    order = sorted(set(distinct) | {b""})
    number = {w: i for i, w in enumerate(order)}
    rank = np.array([number[w] for w in distinct], np.int64)
    return rank[np.asarray(coded.indices)] if len(distinct) else np.empty(0, np.int64), order


@dataclass
class Trie:
    """Sorted distinct strings by level: node i of level d is the label ``label[d][i]`` below node
    ``parent[d][i]`` of the level before; ``total`` is the sum of the weights below each node."""

    words: list
    parent: list
    label: list
    total: list

    def paths(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """(nodes x level + 1) labels on the way to nodes of a level."""
        out = np.empty((len(nodes), level + 1), np.int64)
        for d in range(level, -1, -1):
            out[:, d] = self.label[d][nodes]
            nodes = self.parent[d][nodes]
        return out

    def leaves(self) -> np.ndarray:
        last = len(self.label) - 1
        return self.paths(last, np.arange(len(self.label[last])))


def distinct(columns: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strings x levels) sorted distinct strings of word numbers, and their summed weights.

    Columns are folded into one integer key as long as it fits 62 bits; then its distinct values are numbered."""
    if not len(weights):
        return np.empty((0, len(columns)), np.int64), weights
    key, span = np.zeros(len(weights), np.int64), 1
    for column in columns:
        top = int(column.max()) + 1
        if span * top >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            span = len(values)
        key, span = key * top + column, span * top
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return np.stack([c[order[first]] for c in columns], axis=1), np.add.reduceat(weights[order], first)


def trie(strings: np.ndarray, weights: np.ndarray, words: list) -> Trie:
    """The trie of sorted distinct strings, one column for each level."""
    parents, labels, totals = [], [], []
    new = np.zeros(len(strings), bool)
    new[:1] = True
    above = np.zeros(len(strings), np.int64)
    for column in strings.T:
        new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        parents.append(above[first])
        labels.append(column[first])
        totals.append(np.add.reduceat(weights, first) if len(first) else weights)
        above = np.cumsum(new) - 1
    return Trie(words, parents, labels, totals)


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in _WIDTHS if top <= np.iinfo(t).max))


def _registered(first: np.ndarray, count: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state of each node, nodes that stand for the states): nodes with equal arcs are one state."""
    with np.errstate(over="ignore"):
        arc = mix(mix(label.astype(U64)) + target.astype(U64))
        print_ = np.add.reduceat(arc, first) if len(first) else np.empty(0, U64)
    _, stands, state = np.unique(print_, return_index=True, return_inverse=True)
    as_good = count == count[stands[state]]
    if as_good.all():
        at = np.repeat(first[stands[state]] - first, count) + np.arange(len(label))
        if np.array_equal(label[at], label) and np.array_equal(target[at], target):
            return state, stands
    return np.arange(len(first)), np.arange(len(first))      # two states share a hash: register none


def packed(t: Trie) -> bytes:
    """The automaton of the strings of ``t``: for each level the arcs of its distinct states."""
    arrays = []
    values, target = np.unique(t.total[-1], return_inverse=True)     # final states are weights
    arrays.append(_small(values))
    for d in range(len(t.label) - 1, 0, -1):
        first = np.flatnonzero(np.diff(t.parent[d], prepend=-1))
        count = np.diff(first, append=len(t.parent[d]))
        state, stands = _registered(first, count, t.label[d], target)
        arcs = np.repeat(first[stands], count[stands]) + _within(count[stands])
        arrays += [_small(count[stands]), _small(t.label[d][arcs]), _small(target[arcs])]
        target = state
    arrays += [_small(t.label[0]), _small(target), _small(np.array([len(w) for w in t.words], np.int64))]
    head = np.array([[len(a), a.itemsize] for a in arrays], np.int64)
    body = b"".join([np.array([len(arrays)], np.int64).tobytes(), head.tobytes(), *[a.tobytes() for a in arrays], *t.words])
    return zstandard.ZstdCompressor(level=1).compress(body)


def _within(count: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of ``count``, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def unpacked(blob: bytes) -> tuple[list, np.ndarray, list]:
    """(columns, weights, words): the strings of a packed automaton."""
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, 2 * n, 8).reshape(-1, 2)
    at, arrays = 8 + head.nbytes, []
    for length, width in head:
        kind = next(t for t in _WIDTHS if np.dtype(t).itemsize == width)
        arrays.append(np.frombuffer(body, kind, int(length), at).astype(np.int64))
        at += int(length * width)
    ends = at + np.cumsum(arrays[-1])
    words = [body[z - size:z] for z, size in zip(ends.tolist(), arrays[-1].tolist())]
    columns, state = [arrays[-3]], arrays[-2]
    for i in range(len(arrays) - 6, 0, -3):
        count, label, target = arrays[i:i + 3]
        first = np.cumsum(count) - count
        arcs = np.repeat(first[state], count[state]) + _within(count[state])
        columns = [np.repeat(c, count[state]) for c in columns] + [label[arcs]]
        state = target[arcs]
    return columns, arrays[0][state], words


def union(blobs: list) -> Trie:
    """The sum of packed automata over one common word list."""
    parts = [unpacked(b) for b in blobs]
    numbers, words = vocabulary(pa.array([w for _, _, ws in parts for w in ws], pa.binary()))
    starts = np.cumsum([0] + [len(ws) for _, _, ws in parts])
    maps = [numbers[a:z] for a, z in zip(starts[:-1], starts[1:])]
    columns = [np.concatenate([m[cols[d]] for (cols, _, _), m in zip(parts, maps)]) for d in range(len(parts[0][0]))]
    return trie(*distinct(columns, np.concatenate([w for _, w, _ in parts])), words)


def split(t: Trie, cuts: list) -> list:
    """(range, packed automaton) of the strings of ``t`` in each range that has some. Range i holds the
    strings from cut i - 1 up to cut i; cuts are tuples of words in order."""
    leaves = t.leaves()

    def string(i: int) -> tuple:
        return tuple(t.words[x] for x in leaves[i])

    places = [bisect_left(range(len(leaves)), cut, key=string) for cut in cuts]
    out = []
    for r, (a, z) in enumerate(zip([0] + places, places + [len(leaves)])):
        if z > a:
            used = np.zeros(len(t.words), bool)
            used[leaves[a:z].ravel()] = used[0] = True
            number = np.cumsum(used) - 1
            out.append((r, packed(trie(number[leaves[a:z]], t.total[-1][a:z], [t.words[x] for x in np.flatnonzero(used)]))))
    return out


def compose(acceptor: Trie, own: np.ndarray) -> np.ndarray:
    """(strings x levels) weights that a transducer gives to the prefixes of its strings.

    ``acceptor`` accepts the strings of the transducer (the word 0 fills them up), and ``own`` is the weight of each. A
    prefix that is no string itself has -1. Both walk the same arcs, so the composition is one walk down the levels."""
    levels = len(acceptor.label)
    strings = acceptor.leaves()
    length = (strings[:, 1:] != 0).sum(axis=1)
    nodes = np.empty(strings.shape, np.int64)
    node = np.arange(len(strings))
    for d in range(levels - 1, -1, -1):
        nodes[:, d] = node
        node = acceptor.parent[d][node]
    out = np.full(strings.shape, -1, np.int64)
    for d in range(levels):
        weight = np.full(len(acceptor.label[d]), -1, np.int64)
        weight[nodes[length == d, d]] = own[length == d]
        out[:, d] = weight[nodes[:, d]]
    return out
