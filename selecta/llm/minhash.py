"""Operator 12: near-duplicate groups by SuperMinHash signatures.

Every shingle goes through the signature's slots in an order of its own, a random permutation that is
drawn step by step (Fisher-Yates); at step j it offers its slot the value j + r, r uniform in
[0, 1), and a slot keeps the least offer. As each shingle offers each slot exactly once at a distinct rank,
the slots are negatively correlated and the estimate of the similarity has a lower variance than that of plain
MinHash. Offers of step j are at least j, so a set is done after the first step at which all its slots are filled: one step for long texts.

All shingles of a batch take a step together, and sets that are done drop out; values are integers, the
step in the upper 32 bits and r in the lower ones.

Bands of ``ROWS`` slots are hashed; sets that agree in a band are candidates. :mod:`selecta.llm.linked_groups` verifies
links on the whole sets, with union-find inside a block. With 32 bands of 5 slots a pair at a similarity of
0.85 shares no band with probability 7e-9, at 0.8 with 4e-6 (fewer with the negative correlation); such a pair is still found if both
meet in one field through others.

Plan: equal sets count as one from the start. Signatures are row-local; a band key (8 bytes) and an id move
for each band of a distinct set. Bands with equal members count once. Texts of candidates alone are shuffled.

Defined results: null and wordless texts have an empty set and link with nothing. A text with
fewer than k words has its whole sequence as its one shingle. Ids name documents: repeated rows of one id have one
component, and an id with several texts ties their components together. A null id has component null and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import U64, byte_rows, free, mix, stage, texts, with_maybe
from selecta.llm.linked_groups import linked_groups
from selecta.llm.shingles import prints, shingle_sets
from selecta.llm.similarity_join import equal_sets, with_components

WORDS, NUM, DEN = 5, 80, 100
BANDS, ROWS = 32, 5
EMPTY = U64(2**64 - 1)
_LOW = U64(0xFFFFFFFF)


def draws(values: np.ndarray, step: int) -> np.ndarray:
    """64 random bits of each shingle for a step."""
    with np.errstate(over="ignore"):
        return mix(values + U64(0x9E3779B97F4A7C15) * U64(2 * step + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signature (sets x slots) of every set; sets without shingles stay ``EMPTY``."""
    sets = len(offsets) - 1
    sig = np.full(sets * slots, EMPTY, U64)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    order = None                                     # each shingle's permutation, from the second step on
    for step in range(slots):
        random = draws(values, step)
        slot = (step + (random >> U64(32)) % U64(slots - step)).astype(np.int64)
        if order is not None:
            at = np.arange(len(values))
            slot_here = order[at, slot]
            order[at, slot] = order[:, step]
            order[:, step] = slot_here
            place = slot_here.astype(np.int64)
        else:
            place = slot
        np.minimum.at(sig, owner * slots + place, (U64(step) << U64(32)) | (random & _LOW))
        open_sets = (sig.reshape(sets, slots) == EMPTY).any(axis=1)
        left = open_sets[owner]
        if not left.any():
            break
        if order is None:                            # the first step's swap, for the sets that go on
            order = np.tile(np.arange(slots, dtype=np.uint16), (int(left.sum()), 1))
            at = np.arange(len(order))
            order[at, slot[left]] = 0
            order[:, 0] = slot[left]
        elif not left.all():
            order = order[left]
        values, owner = values[left], owner[left]
    return sig.reshape(sets, slots)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two signatures."""
    return float((a == b).mean())


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets x bands) hashes of ``rows`` slots each."""
    sets, slots = sig.shape
    keys = np.empty((sets, slots // rows), U64)
    for band in range(slots // rows):
        part = sig[:, band * rows:(band + 1) * rows]
        key = np.full(sets, U64(band), U64)
        for column in part.T:
            key = mix(key ^ mix(column + U64(1)))
        keys[:, band] = key
    return keys


def _sketched(k: int, bands: int, rows: int):
    """(doc_id, n, one, two, keys): each set's size, prints and band keys; equal sets of a batch are signed once."""
    def run(batches):
        for b in batches:
            values, offsets = shingle_sets(byte_rows(b.column("text")), k)
            one, two = prints(values, offsets)
            sizes = np.diff(offsets)
            _, pick, back = np.unique(one, return_index=True, return_inverse=True)
            some = [values[offsets[i]:offsets[i + 1]] for i in pick]
            keys = band_keys(signatures(np.concatenate([np.empty(0, U64), *some]), np.concatenate([[0], np.cumsum(sizes[pick])]).astype(np.int64), bands * rows), rows)
            packed = [keys[i].tobytes() if sizes[r] else None for r, i in enumerate(back)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(one), pa.array(two), pa.array(packed, pa.binary())],
                                             names=["doc_id", "n", "one", "two", "keys"])
    return run


def _band_rows(batches):
    """(grp, rep, size), one row for each band of a set."""
    for b in batches:
        keys = [np.frombuffer(x, np.int64) for x in b.column("keys").to_pylist()]
        count = [len(x) for x in keys]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.empty(0, np.int64), *keys])), pa.array(np.repeat(np.asarray(b.column("rep"), np.int64), count)),
            pa.array(np.repeat(np.asarray(b.column("n"), np.int64), count))], names=["grp", "rep", "size"])


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(grp, rep, size) of the distinct sets (rep, n, keys) that share a band with others, one group for each distinct membership. Written."""
    rows = sets.mapInArrow(_band_rows, "grp long, rep long, size long")
    named = rows.groupBy("grp").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n"),
                                    F.bit_xor(F.xxhash64("rep")).alias("print"))
    shared = named.filter("lo != hi").groupBy("lo", "hi", "n", "print").agg(F.min("grp").alias("grp")).select("grp")
    shared = stage(shared, "bands")
    out = stage(with_maybe(rows, "grp", shared, "_maybe").filter("_maybe").select("grp", "rep", "size").join(shared, "grp"), "groups")
    free(shared)
    return out


def near_duplicates(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: links at a Jaccard similarity of num / den or more."""
    held = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = stage(held.mapInArrow(_sketched(k, bands, rows), "doc_id long, n long, one long, two long, keys binary"), "sets")
    signed = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("n", "one", "two").agg(
        F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    groups = candidate_groups(stage(signed, "signed"))
    comps = linked_groups(groups, held.filter(F.col("doc_id").isNotNull()), k, num, den)
    free(groups)
    found = with_components(sets, stage(equal_sets(sets), "classes"), comps)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: the smallest id of each component, and rows without an id."""
    gone = near_duplicates(docs, k, num, den, id_col=id_col, text_col=text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
