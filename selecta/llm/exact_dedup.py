"""Operator 9: exact deduplication by content-defined chunk recipes.

A text is normalised (each run of ASCII white space becomes one space) and cut
into chunks whose borders depend only on the bytes around them, so equal texts
get equal chunks and an edit moves only the chunks near it. A chunk's
identifier is the 64-bit hash of its bytes, verified against the bytes: all
chunks with one hash must be byte-identical (smallest = largest). Those that are
not get the digest of their bytes as a second half. A document's recipe is the ordered list
of its identifiers; documents are compared by recipes alone.

Plan: chunk bytes are shuffled once, pre-aggregated per hash before the
shuffle; afterwards only recipes (8 bytes a chunk) move. Groups are made of
counts and minima, so a group of any size is one small row, and the join back
re-reads them from the shared folder, so AQE can split a hot recipe.

Defined results: null text counts as empty, and all empty texts are equal. The
smallest id of a group stays. Ids name documents: repeated rows of the id that
stays are all marked kept, and count in ``group_size``. A null id is kept only
where its group has no other id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import U64, byte_rows, lean, mix, stage, texts

#: Chunk sizes in bytes: the least, the mean beyond it (a power of two), the most.
LEAST, MEAN, MOST = 256, 1024, 8192
_WIDTH = 8                          # bytes that decide about a border


def normalise(text: bytes | None) -> bytes:
    if not text:
        return b""
    body = b" ".join(text.split())
    if not body:
        return b" "
    lead = b" " if text[:1].isspace() else b""
    tail = b" " if text[-1:].isspace() else b""
    return lead + body + tail


def cut(text: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list:
    """Chunk ends of a text; the last is its length (no chunk for an empty text)."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    a = np.frombuffer(text + bytes(_WIDTH - n % _WIDTH), np.uint8)
    borders = []
    for shift in range(_WIDTH):                     # the 8 bytes that begin at each offset
        m = (n - shift) // _WIDTH
        v = mix(a[shift:shift + m * _WIDTH].view(U64))
        borders.append(np.flatnonzero(v & U64(mean - 1) == 0) * _WIDTH + shift + _WIDTH)
    candidates = np.sort(np.concatenate(borders))
    ends, at = [], 0
    while n - at > least:
        i = int(np.searchsorted(candidates, at + least))
        end = int(candidates[i]) if i < len(candidates) else n
        if end > at + most:
            end = at + most
        end = min(end, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(text: bytes) -> list:
    ends = cut(text)
    return [text[a:z] for a, z in zip([0] + ends, ends)]


def chunk_table(docs: DataFrame) -> DataFrame:
    """(h, chunk) of every chunk of (doc_id, text) rows."""
    @lean
    def run(batches):
        for b in batches:
            parts = [c for t in byte_rows(b.column("text")) for c in chunks(normalise(t))]
            h = np.fromiter(map(xxhash.xxh64_intdigest, parts), U64, len(parts)).view(np.int64)
            for i in range(0, len(parts), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i:i + 2000]), pa.array(parts[i:i + 2000], pa.binary())],
                                                 names=["h", "chunk"])
    return docs.select("text").mapInArrow(run, "h long, chunk binary")


def unverified_hashes(docs: DataFrame) -> DataFrame:
    """Chunk hashes that stand for more than one byte string (normally none)."""
    return (chunk_table(docs).groupBy("h").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
            .filter(F.col("least") != F.col("most")).select("h"))


def recipes(docs: DataFrame, unverified: DataFrame) -> DataFrame:
    """(doc_id, recipe binary, text_sha256): verified identifiers in order."""
    @lean
    def run(batches):
        for b in batches:
            recipe, digest = [], []
            for t in byte_rows(b.column("text")):
                t = normalise(t)
                digest.append(hashlib.sha256(t).hexdigest())
                recipe.append(b"".join(xxhash.xxh64_digest(c) for c in chunks(t)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(recipe, pa.binary()), pa.array(digest)],
                                             names=["doc_id", "recipe", "text_sha256"])

    plain = docs.mapInArrow(run, "doc_id long, recipe binary, text_sha256 string")
    if unverified.isEmpty():
        return plain
    return _with_second_halves(docs, unverified)


def _with_second_halves(docs: DataFrame, unverified: DataFrame) -> DataFrame:
    """The recipes when some hash is unverified: those chunks' identifiers also
    hold the SHA-256 of their bytes. One row per chunk, so nothing is collected
    but a document's own recipe."""
    @lean
    def run(batches):
        for b in batches:
            for key, doc, t in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), byte_rows(b.column("text"))):
                t = normalise(t)
                digest = hashlib.sha256(t).hexdigest()
                parts = chunks(t) or [b""]
                yield pa.RecordBatch.from_pydict({
                    "key": [key] * len(parts), "doc_id": [doc] * len(parts), "seq": list(range(len(parts))),
                    "h": [int.from_bytes(xxhash.xxh64_digest(c), "big", signed=True) if c else None for c in parts],
                    "second": [hashlib.sha256(c).digest() for c in parts], "text_sha256": [digest] * len(parts)},
                    schema=pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("h", pa.int64()),
                                      ("second", pa.binary()), ("text_sha256", pa.string())]))

    rows = docs.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "text").mapInArrow(
        run, "key long, doc_id long, seq long, h long, second binary, text_sha256 string")
    bad = unverified.select("h", F.lit(True).alias("bad"))
    part = F.concat(F.to_binary(F.lpad(F.hex("h"), 16, "0"), F.lit("hex")), F.when(F.col("bad"), F.col("second")).otherwise(F.lit(b"")))
    return (rows.join(bad, "h", "left")
            .groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"),
                                F.array_sort(F.collect_list(F.struct("seq", F.coalesce(part, F.lit(b"")).alias("id")))).alias("ids"))
            .select("doc_id", F.to_binary(F.array_join(F.transform("ids", lambda x: F.hex(x["id"])), ""), F.lit("hex")).alias("recipe"),
                    "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row."""
    held = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stage(recipes(held, stage(unverified_hashes(held), "unverified")), "recipes")
    groups = stage(rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each group of equal texts.

    An id whose rows hold several texts stays if one of them stays.
    """
    gone = (exact_dedup(docs, id_col, text_col).groupBy(F.col("doc_id").alias("_gone"))
            .agg(F.max("kept").alias("_kept")).filter(~F.col("_kept")).select("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
