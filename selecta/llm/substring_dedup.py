"""Operator 6: substring deduplication by fixed-block anchors.

A window is ``width`` consecutive words. Every document is cut into
non-overlapping reference blocks of half a window, so any window holds a whole
block of the document it lies in. The blocks are the index; every
rolling run of a block's length, of every document, probes it. Where a probe meets a block of another
document, all windows around the hit are compared by a 128-bit hash of their words, and
windows that a document with a smaller id also holds are joined up: their union is
the maximal exact repeats.

Plan. Probes and blocks are 8-byte records (32 bits of hash, place in the batch), packed into one binary row for each
batch and bucket; buckets follow the hash, one for each shuffle partition. Before
the shuffle a batch keeps one document of those that share a run, so a passage in a third of all documents
sends one record a batch, not one a document. Texts are not shuffled, but for those that
may have a hit (a bitmap of fixed size tells), which join their hits by id. The replies are runs of
places, packed the same way and dealt by document.

Defined results: null text has no words. Ids name documents: rows with one id never
make each other's words go. Rows with a null id stay whole and remove nothing.
Texts shorter than a window stay whole. Repeated rows give one row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import U64, byte_rows, by_bucket, hashed_words, mix, partitions_for, stage, texts, window_hashes, with_maybe

WIDTH = 50
#: Words that are sorted together; a longer text takes several groups, which overlap by a run.
GROUP_WORDS = 1 << 21
_PLACE = 24                                   # bits of a place in a group
_MASK = U64((1 << _PLACE) - 1)
_SECOND = 0xC2B2AE3D27D4EB4F

_DEALT = "bucket int, head binary, hash binary, at binary, runs binary"
_NAMES = ["bucket", "head", "hash", "at", "runs"]
_RUNS = "doc_id long, print long, runs array<bigint>"


def block_of(width: int) -> int:
    """Words in a block: any window holds a whole one, since width >= 2 * block - 1."""
    return (width + 1) // 2


def _pieces(offsets: np.ndarray, order: np.ndarray, width: int, limit: int = GROUP_WORDS):
    """Groups of (row, first word, end word) of at most about 2 * ``limit`` words, rows in the given order."""
    held, size = [], 0
    for r in order:
        a, z = int(offsets[r]), int(offsets[r + 1])
        while z - a >= width:
            end = min(z, a + limit)
            held.append((int(r), a, end))
            size += end - a
            if size >= limit:
                yield held
                held, size = [], 0
            if end == z:
                break
            a = end - (width - 1)
    if held:
        yield held


class _Group:
    """The words of some pieces, one after another, and where each came from."""

    def __init__(self, pieces: list, h: np.ndarray, offsets: np.ndarray, ids: np.ndarray, prints: np.ndarray):
        self.words = np.concatenate([h[a:z] for _, a, z in pieces])
        sizes = np.array([z - a for _, a, z in pieces])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        rows = np.array([r for r, _, _ in pieces])
        self.ids, self.prints = ids[rows], prints[rows]
        self.first = np.array([a for _, a, _ in pieces]) - offsets[rows]     # place of the piece in its text
        self.piece = np.repeat(np.arange(len(pieces)), sizes)

    def places(self, width: int) -> np.ndarray:
        """Starts of the runs of ``width`` words that lie in one piece."""
        at = np.arange(len(self.words) - width + 1)
        return at[self.ends[self.piece[at]] - at >= width]

    def head(self) -> bytes:
        return np.stack([self.ids, self.prints, self.starts, self.first], axis=1).astype(np.int64).tobytes()

    def runs(self, mark: np.ndarray) -> bytes:
        """(id, print, first, last place) of the marked runs, in places of the text."""
        p = np.flatnonzero(mark)
        if not len(p):
            return b""
        piece = self.piece[p]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(p) > 1) | (np.diff(piece) > 0)]))
        lo, hi = p[cut], p[np.concatenate([cut[1:], [len(p)]]) - 1]
        piece = piece[cut]
        shift = self.first[piece] - self.starts[piece]
        return np.stack([self.ids[piece], self.prints[piece], lo + shift, hi + shift], axis=1).astype(np.int64).tobytes()


def _rows(group: _Group, bucket: np.ndarray, n: int, hashes: np.ndarray, at: np.ndarray, mark: np.ndarray):
    """Record batches: one row for each bucket, and one for the runs settled here."""
    head, local = group.head(), group.runs(mark)
    rows = [(b, head, hashes[i].tobytes(), at[i].tobytes(), b"") for b, i in by_bucket(bucket, n)]
    if local:
        rows.append((int(abs(int(group.ids[0]))) % n, b"", b"", b"", local))
    kinds = [pa.int32()] + [pa.binary()] * 4
    for i in range(0, len(rows), 256):
        part = list(zip(*rows[i:i + 256]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=_NAMES)


def _same_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: group number of each, and first and last index of each group."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1, first, np.concatenate([first[1:], [len(keys)]]) - 1


def _probe(n: int, block: int):
    """Blocks and probes of a batch of texts, dealt by hash."""
    def run(batches):
        for b in batches:
            ids, prints = b.column("doc_id").to_numpy(), b.column("print").to_numpy()
            h, offsets = hashed_words(byte_rows(b.column("text")))
            for pieces in _pieces(offsets, np.argsort(ids, kind="stable"), block):
                g = _Group(pieces, h, offsets, ids, prints)
                at = g.places(block)
                packed = (window_hashes(g.words, block)[at] & ~_MASK) | at.astype(U64)
                packed.sort()                                     # by hash, then place, so by id
                at = (packed & _MASK).astype(np.int64)
                hashes = packed >> U64(_PLACE)
                group, first, last = _same_groups(hashes)
                piece = g.piece[at]
                doc = g.ids[piece]
                several = doc[first] != doc[last]
                block_start = (at - g.starts[piece] + g.first[piece]) % block == 0
                indexed = np.logical_or.reduceat(block_start, first)
                mark = np.zeros(len(g.words), bool)
                mark[at[several[group]]] = True
                mine = np.flatnonzero(doc == doc[first][group])   # one document speaks for the batch
                key = hashes[mine]
                yield from _rows(g, (key % U64(n)).astype(np.int64), n, (key // U64(n)).astype(np.uint32),
                                 (at[mine] << 1 | indexed[group[mine]]).astype(np.uint32), mark)
    return run


def _records(pdf: pd.DataFrame, kind) -> tuple:
    """Of a bucket: (hashes, places in the group with flag, row of each record), the rows' heads, and the settled runs."""
    hashes, ats, rows, heads, runs = [np.empty(0, kind)], [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], [], [np.empty((0, 4), np.int64)]
    for head, h, at, local in zip(pdf["head"], pdf["hash"], pdf["at"], pdf["runs"]):
        if local:
            runs.append(np.frombuffer(local, np.int64).reshape(-1, 4))
            continue
        hashes.append(np.frombuffer(h, kind))
        ats.append(np.frombuffer(at, np.uint32))
        rows.append(np.full(len(hashes[-1]), len(heads), np.uint32))
        heads.append(head)
    return np.concatenate(hashes), np.concatenate(ats), np.concatenate(rows), heads, np.concatenate(runs)


def _owners(some: np.ndarray, ats: np.ndarray, rows: np.ndarray, heads: list) -> np.ndarray:
    """(id, print, place, place) of the records ``some``."""
    out = np.empty((len(some), 4), np.int64)
    order = np.argsort(rows[some], kind="stable")
    ends = np.searchsorted(rows[some][order], np.arange(len(heads) + 1))
    for r, head in enumerate(heads):
        i = order[ends[r]:ends[r + 1]]
        if not len(i):
            continue
        head = np.frombuffer(head, np.int64).reshape(-1, 4)
        place = (ats[some[i]] >> 1).astype(np.int64)
        piece = np.searchsorted(head[:, 2], place, "right") - 1
        out[i, :2] = head[piece, :2]
        out[i, 2] = out[i, 3] = place - head[piece, 2] + head[piece, 3]
    return out


def _joined(runs: np.ndarray) -> np.ndarray:
    """Rows (id, print, lo, hi) in order, adjoining and overlapping runs of a text made one."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    ids, prints, lo, hi = runs.T
    doc = np.cumsum(np.concatenate([[False], (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])]))
    wide = int(max(hi.max(), 0)) + 3
    reach = np.maximum.accumulate(hi + doc * wide)               # documents lie apart, so reaches never cross
    cut = np.flatnonzero(np.concatenate([[True], (lo + doc * wide)[1:] > reach[:-1] + 1]))
    ends = np.concatenate([cut[1:], [len(reach)]]) - 1
    return np.stack([ids[cut], prints[cut], lo[cut], (reach - doc * wide)[ends]], axis=1)


def _replies(runs: np.ndarray, n: int) -> pd.DataFrame:
    """Runs dealt to buckets by their document, packed: one row for each bucket."""
    runs = _joined(runs)
    packed = [(b, runs[i].tobytes()) for b, i in by_bucket((mix(runs[:, 0].astype(U64)) % U64(n)).astype(np.int64), n)]
    return pd.DataFrame({"bucket": np.array([b for b, _ in packed], np.int32), "runs": pd.Series([r for _, r in packed], dtype=object)})


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for each document that has runs."""
    runs = _joined(np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 4) for r in pdf["runs"]]))
    new = np.flatnonzero(np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]))
    ends = np.concatenate([new[1:], [len(runs)]])
    return pd.DataFrame({"doc_id": runs[new, 0], "print": runs[new, 1], "runs": [runs[a:z, 2:].ravel().tolist() for a, z in zip(new, ends)]})


def _hits(n: int):
    """Runs whose hash is a block's and that lie in several documents."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, ats, rows, heads, runs = _records(pdf, np.uint32)
        found = np.empty((0, 4), np.int64)
        if len(hashes):
            order = np.argsort(hashes, kind="stable")
            group, first, last = _same_groups(hashes[order])
            good = (last > first) & np.logical_or.reduceat((ats[order] & 1).astype(bool), first)
            some = order[good[group]]
            del order, group
            if len(some):
                found = _owners(some, ats, rows, heads)
                _, first, _ = _same_groups(hashes[some])
                low, high = np.minimum.reduceat(found[:, 0], first), np.maximum.reduceat(found[:, 0], first)
                found = found[np.repeat(low != high, np.diff(np.concatenate([first, [len(some)]])))]
        return _replies(np.concatenate([found, runs]), n)
    return run


def _compare(n: int, width: int, block: int):
    """Windows around the hits of a batch of texts, dealt by hash; those that a
    smaller id of the same batch holds are settled here."""
    def run(batches):
        for b in batches:
            ids, prints = b.column("doc_id").to_numpy(), b.column("print").to_numpy()
            h, offsets = hashed_words(byte_rows(b.column("text")))
            near = np.zeros(len(h) + 1, np.int64)
            for r, runs in enumerate(b.column("runs").to_pylist()):
                a, z = int(offsets[r]), int(offsets[r + 1])
                runs = np.array(runs, np.int64).reshape(-1, 2)
                np.add.at(near, a + np.maximum(runs[:, 0] - (width - block), 0), 1)
                np.add.at(near, np.minimum(a + runs[:, 1] + 1, z), -1)
            near = np.cumsum(near)[:-1] > 0
            for pieces in _pieces(offsets, np.argsort(ids, kind="stable"), width):
                g = _Group(pieces, h, offsets, ids, prints)
                wanted = np.concatenate([near[a:z] for _, a, z in pieces])
                at = g.places(width)
                at = at[wanted[at]]
                if not len(at):
                    continue
                one = window_hashes(g.words, width)[at]
                two = window_hashes(g.words, width, _SECOND)[at]
                order = np.lexsort((at, two, one))
                at, one, two = at[order], one[order], two[order]
                new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                first = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                doc = g.ids[g.piece[at]]
                mine = doc == doc[first][group]
                mark = np.zeros(len(g.words), bool)
                mark[at[~mine]] = True
                yield from _rows(g, (two[mine] % U64(n)).astype(np.int64), n, np.stack([one[mine], two[mine]], axis=1),
                                 (at[mine] << 1).astype(np.uint32), mark)
    return run


_PAIR = np.dtype([("one", "<u8"), ("two", "<u8")])


def _repeats(n: int):
    """Windows that a smaller id holds too."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, ats, rows, heads, runs = _records(pdf, _PAIR)
        found = np.empty((0, 4), np.int64)
        if len(hashes):
            order = np.lexsort((hashes["two"], hashes["one"]))
            h = hashes[order]
            new = np.concatenate([[True], (h["one"][1:] != h["one"][:-1]) | (h["two"][1:] != h["two"][:-1])])
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate([first, [len(h)]]))
            some, size = order[np.repeat(size > 1, size)], size[size > 1]
            if len(some):
                found = _owners(some, ats, rows, heads)
                first = np.cumsum(size) - size
                found = found[found[:, 0] > np.repeat(np.minimum.reduceat(found[:, 0], first), size)]
        return _replies(np.concatenate([found, runs]), n)
    return run


def _settled(dealt: DataFrame, settle, name: str) -> DataFrame:
    """(doc_id, print, runs) from records dealt by hash: settled per bucket, then dealt by document."""
    replies = dealt.groupBy("bucket").applyInPandas(settle, "bucket int, runs binary")
    return stage(replies.groupBy("bucket").applyInPandas(_by_document, _RUNS), name)


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, print, runs): first and last starts of the windows to remove, for the
    documents (doc_id, text, print) that have any."""
    n, block = partitions_for(docs.sparkSession), block_of(width)
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    dealt = known.mapInArrow(_probe(n, block), _DEALT)
    hits = _settled(dealt, _hits(n), "hits")
    near = with_maybe(known, "doc_id", hits.select("doc_id"), "_maybe").filter("_maybe").drop("_maybe").join(hits, ["doc_id", "print"])
    windows = near.mapInArrow(_compare(n, width, block), _DEALT)
    return _settled(windows, _repeats(n), "repeats")


def remove(text: bytes | None, runs: list | None, width: int) -> tuple[list, list]:
    """(words of a text, the kept ones)."""
    words = (text or b"").split()
    if not runs:
        return words, words
    keep = np.ones(len(words), bool)
    for lo, hi in zip(runs[0::2], runs[1::2]):
        keep[lo:hi + width] = False
    return words, [w for w, k in zip(words, keep) if k]


def _result(width: int):
    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for text, runs in zip(byte_rows(b.column("text")), b.column("runs").to_pylist()):
                words, left = remove(text, runs, width)
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; ``kept`` are the words left, joined by one space."""
    held = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print"))
    repeats = repeated_windows(held, width)
    flagged = with_maybe(held, "doc_id", repeats.select("doc_id"), "_maybe")
    none = F.lit(None).cast("array<bigint>").alias("runs")
    whole = flagged.filter(~F.col("_maybe")).select("doc_id", "text", none)
    cut = flagged.filter("_maybe").join(repeats, ["doc_id", "print"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return whole.mapInArrow(_result(width), schema).unionByName(cut.mapInArrow(_result(width), schema))
