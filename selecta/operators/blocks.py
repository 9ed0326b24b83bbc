"""Texts as blocks of counted items.

A block is one row: some hundred texts, the distinct items (words or word
pairs) that these hold together, and for every text which of them it holds how
often, as packed numbers. What depends on an item alone (a document frequency,
a log probability) is looked up once a block, not once a text: the item and its
place in the block meet the table, and the values meet the block again. So a
shuffle moves a block's numbers and its distinct items, and an item that every
text holds has one row a block.

Rows of equal keys count as one text: their texts are dealt by key and read in its order, others are read where they are.
Blocks are staged, so that both sides of a lookup read the same ones.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selecta.llm.common import bounded_batches, lean, stage

#: (text, item) entries after which a block ends.
BLOCK_ENTRIES = 1_000_000
#: Distinct items that a task counts before it passes them on.
HELD_ITEMS = 200_000
#: Keys of several rows up to which only their texts are dealt; above, all are.
MOST_REPEATED = 10_000


def words(text: str) -> list:
    """The tokens of :func:`selecta.functions.text.tokens`."""
    return [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def word_pairs(text: str) -> list:
    """Each word after the word before it and a space; the first follows the empty word."""
    t = words(text)
    return [f"{u} {w}" for u, w in zip(["", *t], t)]


def item_counts(df: DataFrame, text: str, items=words) -> DataFrame:
    """(item, c): how often each item occurs in all texts. Counted within the tasks first."""
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    held.update(items(t))
                if len(held) >= HELD_ITEMS:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    bounded_batches(df.sparkSession)
    part = df.select(text).mapInArrow(lean(run), "item string, c long")
    return part.groupBy("item").agg(F.sum("c").alias("c"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["item", "c"])


def _by_key(batches, items, lead: str | None):
    """(key, copies, counts of its items) of each key, from rows in order of the keys; the text comes last."""
    key, copies, held = None, 0, Counter()
    for batch in batches:
        for *k, t in zip(*(c.to_pylist() for c in batch.columns)):
            if copies and k != key:
                yield key, copies, held
                copies, held = 0, Counter()
            key, copies = k, copies + 1
            if t is not None:
                held.update(items(t if lead is None else f"{lead} {t}"))
    if copies:
        yield key, copies, held


def _dealt(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (k0, .., t) with those of equal keys next to each other. Texts whose key comes once stay where they are."""
    bounded_batches(df.sparkSession)
    rows = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("t"))
    names = [f"k{i}" for i in range(len(keys))]
    many = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*names).limit(MOST_REPEATED + 1).collect()
    if not many:
        return rows
    if len(many) > MOST_REPEATED:
        return rows.repartition(*names).sortWithinPartitions(*names)
    made = df.sparkSession.createDataFrame(many, rows.select(*names).schema).toDF(*(f"r{n}" for n in names))
    same = reduce(and_, (rows[n].eqNullSafe(made[f"r{n}"]) for n in names))
    again = rows.join(F.broadcast(made), same, "left_semi").repartition(*names).sortWithinPartitions(*names)
    return rows.join(F.broadcast(made), same, "left_anti").unionByName(again)


def text_counts(df: DataFrame, keys: list[str], text: str, items=words, lead: str | None = None) -> DataFrame:
    """(item, c): how many keys have each item in their texts, which follow the words ``lead``."""
    def run(batches):
        held: Counter = Counter()
        for _, _, counts in _by_key(batches, items, lead):
            held.update(counts.keys())
            if len(held) >= HELD_ITEMS:
                yield _counted(held)
                held.clear()
        yield _counted(held)

    part = _dealt(df, keys, text).mapInArrow(lean(run), "item string, c long")
    return part.groupBy("item").agg(F.sum("c").alias("c"))


def _narrow(a: np.ndarray) -> bytes:
    """The values in one, two, four or eight bytes each, whatever the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)).tobytes()


def numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def packed(df: DataFrame, keys: list[str], text: str, items=words, lead: str | None = None, name: str = "blocks") -> DataFrame:
    """Blocks (block, keys as arrays, copies, sizes, terms, index, counts) of all rows of ``df``.

    ``copies`` are the rows of a key, ``sizes`` its entries. ``terms`` are in order, ``index`` counts
    into them and rises within a text.
    """
    fields = df.select(*keys).schema.fields
    schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields),
                           T.StructField("copies", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())),
                           T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("index", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    names = schema.names

    def run(batches):
        first, types = TaskContext.get().partitionId() << 32, None

        def seen():
            nonlocal types
            for b in batches:
                types = types or b.schema.types[:-1]
                yield b

        def block(rows) -> pa.RecordBatch:
            nonlocal first
            terms = sorted(set(chain.from_iterable(c for _, _, c in rows)))
            place = {t: i for i, t in enumerate(terms)}
            sizes = np.array([len(c) for _, _, c in rows], np.int64)
            total = int(sizes.sum())
            index = np.fromiter((place[t] for _, _, c in rows for t in c), np.int64, total)
            counts = np.fromiter((n for _, _, c in rows for n in c.values()), np.int64, total)
            order = np.lexsort((index, np.repeat(np.arange(len(rows)), sizes)))
            first += 1
            columns = [pa.array([first - 1], pa.int64())]
            columns += [pa.array([[k[i] for k, _, _ in rows]], pa.list_(t)) for i, t in enumerate(types)]
            columns += [pa.array([[n for _, n, _ in rows]], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                        pa.array([terms], pa.list_(pa.string())), pa.array([_narrow(index[order])], pa.binary()), pa.array([_narrow(counts[order])], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        rows, held = [], 0
        for row in _by_key(seen(), items, lead):
            rows.append(row)
            held += len(row[2]) + 1
            if held >= BLOCK_ENTRIES:
                yield block(rows)
                rows, held = [], 0
        if rows:
            yield block(rows)

    return stage(_dealt(df, keys, text).mapInArrow(lean(run), schema), name)


def places(blocks: DataFrame, item: str) -> DataFrame:
    """(block, pos, item): the terms of every block."""
    return blocks.select("block", F.posexplode("terms").alias("pos", item))


def ranged(right: pa.Table, column: str, n: int, missing: float = 0) -> np.ndarray:
    """The looked-up values of a block's ``n`` terms, by ``pos``; ``missing`` for terms without one."""
    values = right.column(column).to_numpy()
    out = np.full(n, missing, values.dtype if len(values) else np.float64)
    out[right.column("pos").to_numpy()] = values
    return out


def with_values(blocks: DataFrame, values: DataFrame, run, schema) -> DataFrame:
    """``run(Block, values of its terms)`` -> Arrow table of every block; ``values`` is (block, pos, ..)."""
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(Block(left.to_batches()[0], 0), right)
    return blocks.groupBy("block").cogroup(values.withColumnRenamed("block", "_block").groupBy("_block")).applyInArrow(group, schema)


def text_sums(blocks: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _s, _n): sum of count * value over the items of each key, and its number of items. ``values`` is
    (block, pos, value), whole numbers; keys without an item are left out."""
    def run(block: Block, found: pa.Table) -> pa.Table:
        at = pa.array(np.flatnonzero(block.sizes))
        if found.column("value").null_count:                  # nothing is known: no corpus
            total = pa.nulls(len(block.sizes), pa.int64())
        else:
            value = ranged(found, "value", len(block.list("terms"))).astype(np.int64)
            total = pa.array(block.sums(block.counts * value[block.index]), pa.int64())
        return pa.table([*(block.list(k).take(at) for k in keys), total.take(at), pa.array(block.sums(block.counts), pa.int64()).take(at)], [*keys, "_s", "_n"])

    fields = [T.StructField(k, blocks.schema[k].dataType.elementType) for k in keys]
    return with_values(blocks, values, run, T.StructType([*fields, T.StructField("_s", T.LongType()), T.StructField("_n", T.LongType())]))


class Block:
    """Row ``i`` of a batch of blocks, with its numbers read."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.columns = {n: batch.column(j).slice(i, 1) for j, n in enumerate(batch.schema.names)}
        self.sizes = self.list("sizes").to_numpy(zero_copy_only=False)
        n = int(self.sizes.sum())
        self.index = numbers(self.columns["index"][0].as_py(), n)
        self.counts = numbers(self.columns["counts"][0].as_py(), n)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.ends = np.cumsum(self.sizes)

    def list(self, name: str) -> pa.Array:
        return self.columns[name].flatten()

    def sums(self, values: np.ndarray) -> list:
        """Exact sums of whole numbers over each text's entries."""
        if len(values) and float(np.abs(values).max()) * len(values) >= 2**62:
            return [sum(map(int, values[e - n:e])) for e, n in zip(self.ends, self.sizes)]
        total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
        return (total[self.ends] - total[self.ends - self.sizes]).tolist()


def fixed(x: np.ndarray, scale: float) -> np.ndarray:
    """x * scale to the nearest whole number, halves away from zero."""
    y = x * scale
    return np.where(np.abs(y) < 2**52, np.copysign(np.floor(np.abs(y) + 0.5), y), y)
