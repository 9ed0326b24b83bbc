"""Helpers shared by the text operators.

* Operators take any DataFrame and the names of its id and text columns. They
  first project to the internal columns ``doc_id`` and ``text``, so extra
  columns of the input, whatever their names, never clash.
* Python stages read Arrow batches of at most ``BATCH_ROWS`` rows, so a task
  holds a bounded number of texts at a time.
* Results that are read more than once, or joined with a hot key, are written
  as Parquet into the shared checkpoint folder (:func:`stage`).
"""

from __future__ import annotations

import ctypes
import gc
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selecta.session import checkpoint_dir

BATCH_ROWS = 256
#: Distinct words that a worker's word caches keep before they start afresh.
CACHE_WORDS = 400_000
U64 = np.uint64


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Limit Arrow batches by row count: whole texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of ``df``, and bounded Arrow batches from here on."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the files), and gives the next
    join a fresh exchange on this side, so that AQE can split hot partitions.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that :func:`stage` wrote. Only once everything made of them has been written itself."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live table needs: it does so once the driver has collected the objects that stand for them,
    which can take until long after the last read."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:                            # not glibc
        pass


def lean(run):
    """``run`` of mapInArrow, whose worker gives freed memory back when the task ends.

    Spark keeps idle workers for the next tasks; what they hold on to would count against
    the executor through later stages that need the room."""
    def rows(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return rows


def lean_group(run):
    """As :func:`lean` for a function of applyInPandas, after each group."""
    def rows(pdf):
        try:
            return run(pdf)
        finally:
            give_back()
    return rows


def byte_rows(column: pa.Array) -> list:
    """The column's texts as UTF-8 bytes (None for null)."""
    return column.cast(pa.binary()).to_pylist()


#: Bytes that are hashed together; a longer text is hashed piece by piece.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
_BYTE64 = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64, for exponents below n."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, PIECE + 4096), base, U64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=U64)
    return _POWERS[0], _POWERS[1]


def _hash_piece(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of ``blob``, which begins and ends with a space."""
    a = np.frombuffer(blob, np.uint8)
    space = _SPACE[a]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edges[0::2], edges[1::2]
    power, inverse = _powers(len(a))
    total = np.cumsum(_BYTE64[a] * power[:len(a)], dtype=U64)
    h = (total[last - 1] - total[first - 1]) * inverse[first]
    return first, mix(h ^ (last - first).astype(U64))


def hashed_words(rows: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, in order,
    and the offsets (len(rows) + 1) at which each text's words begin.

    Every text is hashed whole; None has no words. ``lower`` lower-cases A-Z.
    """
    out: list = [np.empty(0, U64)]
    counts = np.zeros(len(rows) + 1, np.int64)
    held: list = []                                  # (row, bytes)
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            starts = np.cumsum([1] + [len(b) + 1 for _, b in held])
            first, h = _hash_piece(b" " + b" ".join(b for _, b in held) + b" ")
            ends = np.searchsorted(first, starts)
            for (row, _), n in zip(held, np.diff(ends)):
                counts[row + 1] += n
            out.append(h)
        held.clear()
        size = 0

    for i, text in enumerate(rows):
        if not text:
            continue
        if lower:
            text = text.lower()
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:                      # cut at white space only
                m = _BREAK.search(text, at + PIECE)
                end = m.start() if m else end
            part = text[at:end] if at or end < len(text) else text
            held.append((i, part))
            size += len(part)
            at = end
            if size >= PIECE:
                flush()
    flush()
    return np.concatenate(out), np.cumsum(counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 steps)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (len - width + 1).

    Polynomial in ``base`` modulo 2^64, put together from runs whose lengths
    are powers of two, so it costs about 2 * log2(width) vector operations.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, power, run, step = None, 0, U64(1), mix(h), 1
    b = U64(base | 1)
    with np.errstate(over="ignore"):
        unit = b                                   # base ** step
        while step <= width:
            if width & step:
                piece = run[done:done + n]
                out = piece.copy() if out is None else out * unit + piece
                done += step
            if step * 2 <= width:
                run = run[:len(run) - step] * unit + run[step:]
                unit = unit * unit
            step *= 2
    return mix(out)


def partitions_for(spark: SparkSession) -> int:
    """Buckets to deal packed records to: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits of the broadcast bitmap of :func:`with_maybe`: 8 MB, whatever the input's size.
MAYBE_BITS = 1 << 26


def with_maybe(df: DataFrame, id_col: str, members: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: false only for ids that are surely not among ``members``.

    ``members`` has the one column ``id_col``. A bitmap of ``MAYBE_BITS`` hashed ids, at most 8 MB, is
    broadcast; ids it lets through by chance are for a later exact step to sort
    out. With more members than bits it lets all through, and that step does all the work.
    """
    slot = F.pmod(F.xxhash64(id_col), F.lit(MAYBE_BITS))
    maps = (members.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_map")))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_map"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, (place % 8).cast("int")) == 1
    return (df.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col("_bucket"), "left")
            .select(*[df[c] for c in df.columns], F.coalesce(bit, F.lit(False)).alias(name)))


def by_bucket(bucket: np.ndarray, n: int):
    """(bucket, indices of its records in order) for every bucket that has records."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=n))
    for b in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(b), order[(ends[b - 1] if b else 0):ends[b]]
