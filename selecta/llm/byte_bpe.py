"""Operator 8: byte-level BPE encoding and decoding with a public vocabulary.

A text is split by the vocabulary's pattern into pre-tokens; each is encoded by
merging its lowest-ranked pair until none is left. A long text is cut into
chunks that overlap. Chunks are pre-tokenised independently, on any executor;
neighbours are stitched at the first position in the overlap at which both
begin a pre-token: the pattern has no look-behind, so from there on both agree.
Then each chunk encodes the pieces between its two stitches, and the ids
are put together in order. A text in which some overlap has no such position
(a pre-token longer than the overlap) is encoded in one piece.

Borders near a chunk's end are not trusted (``LOOK`` characters: the longest
look-ahead and contraction), since the pattern could match otherwise if it saw more.

Decoding concatenates the bytes of the ids; a valid text comes back exactly.

Plan: texts of one chunk are encoded where they are read, without a shuffle. Only
chunks of longer texts are dealt out and gathered by text. The vocabulary (about
50,000 entries, a fixed file) is read by the driver and broadcast.

Defined results: null text counts as empty; an empty text has no ids. Repeated
rows give one row each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selecta.llm.common import CACHE_WORDS, bounded_batches, byte_rows, lean, stage, texts

CHUNK = 32_768                      # characters
OVERLAP = 2_048
LOOK = 3


class Vocabulary:
    """Ranks and pattern, broadcast once; built from a rank file by its path."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.shared = spark.sparkContext.broadcast((ranks, pattern))


def merge(piece: bytes, ranks: dict) -> list:
    """Ids of one pre-token: merge the lowest rank first, the leftmost of equals.

    A heap of candidate pairs, so a piece of any length takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))                     # part i covers piece[i:end[i]]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PieceIds(dict):
    """pre-token -> ids: a bounded cache in front of :func:`merge`."""

    def __init__(self, ranks: dict):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str):
        ids = merge(piece.encode("utf-8"), self.ranks)
        if len(piece) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = ids
        return ids


_ENCODERS: dict = {}


def _encoder(shared):
    key = id(shared)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks, pattern = shared.value
        _ENCODERS[key] = (PieceIds(ranks), regex.compile(pattern), shared)
    return _ENCODERS[key][:2]


def encode_text(text: str, ids: PieceIds, pattern) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(map(ids.__getitem__, pattern.findall(text))), np.int32)


def _id_arrays(rows: list) -> pa.Array:
    """Arrays of ids as one Arrow list column."""
    offsets = np.cumsum([0] + [len(r) for r in rows])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def _encode_batches(shared, keys: list):
    @lean
    def run(batches):
        ids, pattern = _encoder(shared)
        for b in batches:
            rows = [encode_text(t or "", ids, pattern) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), _id_arrays(rows)], names=[*keys, "ids"])
    return run


def chunk_spans(n: int, chunk: int, overlap: int) -> list:
    """(start, end) of the chunks of a text of n characters: a chunk every
    ``chunk`` characters, each reaching ``overlap`` into the next."""
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(n, 1), chunk)]


def borders(text: str, start: int, last: bool, chunk: int, overlap: int, pattern) -> tuple[list, list]:
    """Trusted pre-token starts (absolute) in the overlap before and after a chunk."""
    head, tail = [], []
    limit = len(text) if last else len(text) - LOOK
    for m in pattern.finditer(text):
        at = m.start()
        if at > limit:
            break
        if start and at < overlap:
            head.append(start + at)
        if at >= chunk:
            tail.append(start + at)
    return head, tail


def _split(chunk: int, overlap: int):
    @lean
    def run(batches):
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                spans = chunk_spans(len(text), chunk, overlap)
                for i in range(0, len(spans), 64):
                    part = spans[i:i + 64]
                    yield pa.RecordBatch.from_pydict(
                        {"key": [key] * len(part), "k": list(range(i, i + len(part))), "start": [a for a, _ in part],
                         "last": [i + j + 1 == len(spans) for j in range(len(part))], "text": [text[a:z] for a, z in part]},
                        schema=pa.schema([("key", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]))
    return run


def _pretokenise(shared, chunk: int, overlap: int):
    @lean
    def run(batches):
        _, pattern = _encoder(shared)
        for b in batches:
            found = [borders(t, s, e, chunk, overlap, pattern) for t, s, e in
                     zip(b.column("text").to_pylist(), b.column("start").to_pylist(), b.column("last").to_pylist())]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("k"), b.column("start"), b.column("last"), b.column("text"),
                 pa.array([h for h, _ in found], kind), pa.array([t for _, t in found], kind)],
                names=["key", "k", "start", "last", "text", "head", "tail"])
    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""
    if not LOOK < overlap <= chunk:
        raise ValueError("the overlap must exceed the look-ahead and fit in a chunk")
    shared = vocabulary.shared
    held = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short_ids = held.filter(~long).mapInArrow(_encode_batches(shared, ["doc_id"]), "doc_id long, ids array<int>")

    keyed = stage(held.filter(long).withColumn("key", F.monotonically_increasing_id()), "long")
    dealt = keyed.select("key", "text").mapInArrow(_split(chunk, overlap), "key long, k int, start long, last boolean, text string")
    chunks = stage(dealt.repartition("key", "k").mapInArrow(
        _pretokenise(shared, chunk, overlap),
        "key long, k int, start long, last boolean, text string, head array<bigint>, tail array<bigint>"), "chunks")
    order = Window.partitionBy("key").orderBy("k")
    whole = Window.partitionBy("key")
    stitched = (chunks.select("key", "k", "start", "last", "head", "tail")
                .withColumn("stop", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
                .withColumn("begin", F.coalesce(F.lag("stop").over(order), F.lit(0)))
                .withColumn("torn", F.max(~F.col("last") & F.col("stop").isNull()).over(whole))
                .select("key", "k", "begin", "stop", "torn"))
    stitched = stage(stitched, "stitches")
    good = chunks.select("key", "k", "start", "text").join(stitched.filter(~F.col("torn")), ["key", "k"])
    pieces = good.select("key", "k", F.expr("substring(text, int(begin - start) + 1, int(coalesce(stop - begin, length(text))))").alias("text"))
    parts = pieces.mapInArrow(_encode_batches(shared, ["key", "k"]), "key long, k int, ids array<int>")
    # a text's own chunks, in order: bounded by the text
    joined = (parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
              .select("key", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids")))
    torn = keyed.select("key", "text").join(stitched.filter("torn").select("key").distinct(), "key")
    joined = joined.unionByName(torn.mapInArrow(_encode_batches(shared, ["key"]), "key long, ids array<int>"))
    long_ids = keyed.select("key", "doc_id").join(joined, "key").select("doc_id", "ids")
    return short_ids.unionByName(long_ids)


_TABLES: dict = {}


def _tables(shared) -> tuple[pa.Array, pa.Array]:
    """Arrow arrays by id: its bytes, and its decimal digits after a comma."""
    key = id(shared)
    if key not in _TABLES:
        _TABLES.clear()
        ranks = shared.value[0]
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _TABLES[key] = (pa.array(table, pa.binary()), pa.array([b",%d" % i for i in range(len(table))], pa.binary()), shared)
    return _TABLES[key][:2]


def joined_rows(ids: pa.ListArray, table: pa.Array) -> list:
    """For each row of a list column of ids, the table's entries of its ids put together."""
    flat = ids.flatten()
    counts = np.cumsum([0] + pc.fill_null(pc.list_value_length(ids), 0).to_pylist())
    if not len(flat):
        return [b""] * len(ids)
    out: list = []
    first = 0
    while first < len(ids):                          # 32-bit offsets: some rows at a time
        last = first + 1
        while last < len(ids) and counts[last + 1] - counts[first] < 1 << 24:
            last += 1
        taken = pc.take(table, flat.slice(counts[first], counts[last] - counts[first]))
        n = len(taken)
        at = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:taken.offset + n + 1] if n else np.zeros(1, np.int32)
        data = memoryview(taken.buffers()[2]) if n and taken.buffers()[2] else memoryview(b"")
        ends = at[counts[first:last + 1] - counts[first]]
        out += [bytes(data[x:y]) for x, y in zip(ends[:-1], ends[1:])]
        first = last
    return out


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """The input with the column ``data``: the bytes that the ids stand for."""
    shared = vocabulary.shared
    bounded_batches(encoded.sparkSession)
    schema = encoded.withColumn("data", F.lit(b"")).schema

    @lean
    def run(batches):
        table, _ = _tables(shared)
        for b in batches:
            rows = pa.array(joined_rows(b.column(ids_col), table), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, rows], names=[*b.schema.names, "data"])

    return encoded.mapInArrow(run, schema)


def digests(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids): SHA-256 of the
    ids in decimal, comma-joined, and of the bytes that they decode to."""
    shared = vocabulary.shared

    @lean
    def run(batches):
        table, digits = _tables(shared)
        for b in batches:
            ids = b.column("ids")
            sizes = pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), sizes, pa.array([hashlib.sha256(x[1:]).hexdigest() for x in joined_rows(ids, digits)], pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in joined_rows(ids, table)], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
