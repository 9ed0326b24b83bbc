"""M1 / M2: sparse TF-IDF text vectors over the corpus' own vocabulary.

A vector is (terms, weights): its distinct tokens in order, and
tf * (ln((1 + N) / (1 + df)) + 1) scaled to length 1. There is no dimension to
choose and no bucket that unlike words share. Sums are taken in fixed point, so
that weights do not depend on the partitioning.

Plan: texts are kept in blocks (:mod:`selecta.operators.blocks`), and a token's
frequency is looked up once a block that holds it, so no entry of a vector is
shuffled by its token. Vectors stay in blocks until they are returned, and so
do the dots with centroids, whose weights are looked up by label and token.

Defined results: null and blank texts have empty vectors, whose cosine with
anything is 0. A token outside the fitted corpus has df 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selecta.llm.common import bounded_batches, drop_shuffles, free, lean, stage
from selecta.operators.blocks import Block, fixed, packed, places, ranged, text_counts, with_values
from selecta.operators.joins import one_row

FIXED = 1e12
_WORDS, _WEIGHTS = pa.list_(pa.string()), pa.list_(pa.float64())


def _schema(blocks: DataFrame, keys: list[str], *more) -> T.StructType:
    return T.StructType([T.StructField(k, blocks.schema[k].dataType.elementType) for k in keys] + [T.StructField(n, t) for n, t in more])


class TfIdf:
    """Document frequencies (token, df) and the one-row number of texts."""

    def __init__(self, frequencies: DataFrame, total: DataFrame, task: str | None = None):
        self.frequencies, self.total, self.task = frequencies, total, task

    @classmethod
    def fit(cls, corpus: DataFrame, keys: list[str], text: str = "text", task: str | None = None) -> "TfIdf":
        """Frequencies over the texts of ``corpus``; ``keys`` identify a row. ``task`` is M2's description,
        whose words come before those of every text that is not null."""
        df = stage(text_counts(corpus, keys, text, lead=task).toDF("token", "df"), "frequencies")
        drop_shuffles(corpus.sparkSession)
        return cls(df, corpus.agg(F.count(F.lit(1)).alias("_n")), task)

    def _weighed(self, blocks: DataFrame, run, schema: T.StructType) -> DataFrame:
        """``run(Block, idf of its terms, norm of each text)`` of the blocks."""
        j = places(blocks, "token").join(self.frequencies, "token", "left").crossJoin(one_row(self.total))
        idf = F.log((1 + F.col("_n")) / (1 + F.coalesce(F.col("df"), F.lit(0)))) + 1

        def weigh(block: Block, found: pa.Table) -> pa.Table:
            values = ranged(found, "idf", len(block.list("terms")))
            weight = block.counts * values[block.index]
            norms = np.sqrt(np.array([float(s) for s in block.sums(fixed(weight * weight, FIXED))]) / FIXED)
            return run(block, values, norms)

        return with_values(blocks, j.select("block", "pos", idf.alias("idf")), weigh, schema)

    def units(self, df: DataFrame, keys: list[str], text: str) -> "Vectors":
        """The unit vectors, one for each key."""
        def run(block: Block, idf: np.ndarray, norms: np.ndarray) -> pa.Table:
            return pa.table({**block.columns, "idf": pa.array([idf], _WEIGHTS), "norms": pa.array([norms], _WEIGHTS)})

        numbers, blocks = T.ArrayType(T.DoubleType()), packed(df, keys, text, lead=self.task)
        vectors = stage(self._weighed(blocks, run, T.StructType([
            *blocks.schema.fields, T.StructField("idf", numbers), T.StructField("norms", numbers)])), "vectors")
        free(blocks)                                          # the vectors hold all of it
        drop_shuffles(df.sparkSession)
        return Vectors(vectors, keys)

    def encode(self, df: DataFrame, keys: list[str], text: str) -> DataFrame:
        """(keys, terms, weights): one unit vector a row, tokens in order; rows with blank text have empty arrays."""
        def run(block: Block, idf: np.ndarray, norms: np.ndarray) -> pa.Table:
            rows = np.repeat(np.arange(len(norms)), block.list("copies").to_numpy(zero_copy_only=False))
            return _rows(block, keys, block.counts * idf[block.index] / norms[block.row], rows, nameless=True)

        blocks = packed(df, keys, text, lead=self.task)
        return self._weighed(blocks, run, _schema(
            blocks, keys, ("terms", T.ArrayType(T.StringType())), ("weights", T.ArrayType(T.DoubleType()))))


def _rows(block: Block, keys: list[str], weight: np.ndarray, rows: np.ndarray, nameless: bool = False) -> pa.Table:
    """(keys, terms, weights) of texts of a block. ``nameless``: those with a null key get an empty vector, as no key equals null."""
    offsets = pa.array(np.concatenate([[0], block.ends]).astype(np.int32))
    ids = [block.list(k) for k in keys]
    terms = pa.ListArray.from_arrays(offsets, block.list("terms").take(pa.array(block.index)))
    weights = pa.ListArray.from_arrays(offsets, pa.array(weight))
    at = pa.array(rows)
    if nameless and any(k.null_count for k in ids):
        known = np.all([k.is_valid().to_numpy(zero_copy_only=False) for k in ids], axis=0)
        at_known = pa.array(rows, mask=~known[rows])
        terms, weights = terms.take(at_known).fill_null(pa.scalar([], _WORDS)), weights.take(at_known).fill_null(pa.scalar([], _WEIGHTS))
    else:
        terms, weights = terms.take(at), weights.take(at)
    return pa.table([*(k.take(at) for k in ids), terms, weights], [*keys, "terms", "weights"])


class Vectors:
    """Unit vectors in blocks: an entry weighs count * idf of its term / norm of its text."""

    def __init__(self, blocks: DataFrame, keys: list[str]):
        self.blocks, self.keys = blocks, keys

    def map(self, run, schema) -> DataFrame:
        """``run(Block, weights of its entries)`` -> Arrow table of every block."""
        def each(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(batch, i)
                    yield from run(block, _unit(block)).to_batches()

        bounded_batches(self.blocks.sparkSession)
        return self.blocks.mapInArrow(lean(each), schema)

    def rows(self) -> DataFrame:
        """(keys, terms, weights): one vector a key."""
        keys = self.keys
        return self.map(lambda block, weight: _rows(block, keys, weight, np.arange(len(block.sizes))), _schema(
            self.blocks, keys, ("terms", T.ArrayType(T.StringType())), ("weights", T.ArrayType(T.DoubleType()))))


def _unit(block: Block) -> np.ndarray:
    idf, norms = (block.list(n).to_numpy(zero_copy_only=False) for n in ("idf", "norms"))
    return block.counts * idf[block.index] / norms[block.row]


@F.pandas_udf(T.DoubleType())
def _dots(ta, wa, tb, wb):
    import pandas as pd
    out = []
    for a, x, b, y in zip(ta, wa, tb, wb):
        other = dict(zip(b, y))
        both = np.array([(v, other[t]) for t, v in zip(a, x) if t in other]).reshape(-1, 2)
        out.append(float(int(fixed(both[:, 0] * both[:, 1], FIXED).astype(np.int64).sum())) / FIXED)
    return pd.Series(out, dtype="float64")


def cosines(rows: DataFrame, keys: list[str], a: Vectors, b: Vectors) -> DataFrame:
    """(keys, cosine) of the unit vectors ``a`` and ``b`` of each row."""
    j = a.rows().join(b.rows().withColumnsRenamed({"terms": "_t", "weights": "_w"}), keys)
    dots = j.select(*keys, _dots("terms", "weights", "_t", "_w").alias("cosine"))
    return rows.select(*keys).join(dots, keys, "left").select(*keys, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def sparse_centroids(entries: Vectors, label: str, sizes: DataFrame) -> DataFrame:
    """(label, token, weight): mean unit vector of each label in long form. ``label`` is one of the keys of ``entries``,
    ``sizes`` is (label, n). A block's sums by label and token are taken first, so a label of any size is summed by many tasks."""
    def run(block: Block, weight: np.ndarray) -> pa.Table:
        kinds, code = _labels(block, label)
        slot, inverse = np.unique(code[block.row] * len(block.list("terms")) + block.index, return_inverse=True)
        sums = np.zeros(len(slot), np.int64)
        np.add.at(sums, inverse, fixed(weight, FIXED).astype(np.int64))
        n = max(len(block.list("terms")), 1)
        return pa.table([kinds.take(pa.array(slot // n)), block.list("terms").take(pa.array(slot % n)), pa.array(sums)], [label, "token", "_p"])

    kind = entries.blocks.schema[label].dataType.elementType
    part = entries.map(run, T.StructType([T.StructField(label, kind), T.StructField("token", T.StringType()), T.StructField("_p", T.LongType())]))
    sums = part.groupBy(label, "token").agg(F.sum(F.col("_p").cast("decimal(38,0)")).alias("_s"))
    out = stage(sums.join(sizes, label).select(label, "token", (F.col("_s").cast("double") / FIXED / F.col("n")).alias("weight")), "centroids")
    drop_shuffles(out.sparkSession)
    return out


def _labels(block: Block, label: str) -> tuple[pa.Array, np.ndarray]:
    """The distinct labels of a block, and which of them each text has."""
    coded = block.list(label).dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _held(entries: Vectors, label: str) -> DataFrame:
    """(block, label, pos, token): the terms that each label's texts hold in each block."""
    def run(block: Block, weight: np.ndarray) -> pa.Table:
        kinds, code = _labels(block, label)
        n = max(len(block.list("terms")), 1)
        slot = np.unique(code[block.row] * n + block.index)
        pos = pa.array(slot % n)
        own = pa.array(np.full(len(slot), block.columns["block"][0].as_py(), np.int64))
        return pa.table([own, kinds.take(pa.array(slot // n)), pos.cast(pa.int32()), block.list("terms").take(pos)], ["block", label, "pos", "token"])

    kind = entries.blocks.schema[label].dataType.elementType
    return entries.map(run, T.StructType([T.StructField("block", T.LongType()), T.StructField(label, kind), T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())]))


def centroid_cosines(entries: Vectors, keys: list[str], label: str, centroids: DataFrame) -> DataFrame:
    """(keys, cosine): cosine of each unit vector with the centroid of its own label."""
    square = F.round(F.col("weight") * F.col("weight") * FIXED).cast("decimal(38,0)")
    norms = centroids.groupBy(label).agg(F.sqrt(F.sum(square).cast("double") / FIXED).alias("_norm"))
    c = centroids.join(norms, label).select(label, "token", (F.col("weight") / F.col("_norm")).alias("_c"))
    found = _held(entries, label).join(c, [label, "token"]).select("block", label, "pos", "_c")

    def run(block: Block, values: pa.Table) -> pa.Table:
        kinds, code = _labels(block, label)
        n = len(block.list("idf"))
        center = np.full((len(kinds), max(n, 1)), np.nan)
        mine = pa.compute.index_in(values.column(label), kinds).to_numpy()
        center[mine, values.column("pos").to_numpy()] = values.column("_c").to_numpy()
        near = center[code[block.row], block.index]
        has = ~np.isnan(near)                                 # a null label has no centroid
        sums = block.sums(np.where(has, fixed(_unit(block) * np.where(has, near, 0.0), FIXED), 0.0))
        rows = np.flatnonzero(np.bincount(block.row[has], minlength=len(block.sizes)))
        at = pa.array(rows)
        return pa.table([*(block.list(k).take(at) for k in keys), pa.array([sums[i] / FIXED for i in rows], pa.float64())], [*keys, "cosine"])

    return with_values(entries.blocks.drop("terms", "copies"), found, run, _schema(entries.blocks, keys, ("cosine", T.DoubleType())))
