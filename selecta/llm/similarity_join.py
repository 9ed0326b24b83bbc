"""Operator 5: n-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of ``k`` words, as 64-bit hashes.
Two documents link when |A & B| / |A | B| reaches num / den.

Size bands: a pair that links differs little in size, so sizes are cut
into bands and a document takes part in its own band and, where a larger partner may lie in
the next, in that one too. In a band, linked sets differ in at most ``d`` shingles.
Every shingle flips one bit of a wide sketch; the bits are dealt to more than
``d`` segments, and a segment is kept as the XOR of the hashes of its set bits.
A shingle touches one segment, so the number of differing segments (a bound of the Hamming
distance) never exceeds the symmetric difference, and linked sets agree in some segment. A set with
more than ``d`` non-empty segments needs only those; the few others send the empty ones too.
Documents that agree in a segment are candidates; they are verified on the whole sets.

Groups of candidates can be large, so their pairs are not listed. Equal sets
count as one from the start; :mod:`selecta.llm.linked_groups` finds the components of the links within the groups.
There, whole parity sketches (two to four bits a shingle) are compared, and only pairs whose Hamming distance stays within the
difference that a link allows are verified, so no link between different texts is lost.

Plan: sketch records take 6 bytes, packed into one binary row for each batch and
bucket (bucket by hash, one for each shuffle partition); equal sets of a batch send one record. Only texts in a
candidate group are shuffled, twice at most.

Defined results: null and wordless texts have an empty set and link with
nothing. A text with fewer than k words has its whole sequence as its one
shingle. Ids name documents: repeated rows of one id have one component; if their texts differ, the
document links with all that any of them links with. A row with a null id links with nothing and has component null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import U64, by_bucket, byte_rows, free, lean, lean_group, mix, partitions_for, stage, texts
from selecta.llm.linked_groups import components, linked_groups
from selecta.llm.shingles import SALT, prints, shingle_sets

WORDS, NUM, DEN = 5, 80, 100
#: Sizes of one band lie within this ratio.
BAND = 1.5


def bands(limit: int) -> list:
    """Largest sizes of the bands, up to one that holds ``limit``."""
    out = [4]
    while out[-1] < limit:
        out.append(int(out[-1] * BAND))
    return out


def most_apart(size: int, num: int, den: int) -> int:
    """Largest symmetric difference of linked sets of at most ``size`` shingles each."""
    return (den - num) * 2 * size // (den + num)


def segments(apart: int) -> int:
    """Segments for sets that differ in at most ``apart`` shingles: some to spare for empty ones."""
    return apart + 1 + apart // 8 + 2


#: Dealings of the shingles to segments: a set goes on to the next while too few of its segments hold some.
DEALS = 8


def segment_keys(values: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of every sketch segment that a set sends. ``values`` are the sets' shingles, one set after the other."""
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, U64)
    tops = np.array(bands(int(sizes.max()) * den // num + 1))
    apart = np.array([most_apart(int(t), num, den) for t in tops])
    count = np.array([segments(int(a)) for a in apart])
    low = np.searchsorted(tops, sizes)
    high = np.searchsorted(tops, sizes * den // num)
    starts = np.cumsum(sizes) - sizes
    out_set, out_key = [], []
    for step in range(int((high - low).max()) + 1):
        sets = np.flatnonzero((low + step <= high) & (apart[np.minimum(low + step, len(tops) - 1)] > 0))
        if not len(sets):
            continue
        band = low[sets] + step
        n = sizes[sets]
        base = np.cumsum(count[band]) - count[band]                 # first segment of each set
        owner = np.repeat(np.arange(len(sets)), n)
        shingle = values[np.repeat(starts[sets] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        total = int(count[band].sum())
        whose = np.repeat(np.arange(len(sets)), count[band])
        segment = np.arange(total) - base[whose]
        left = np.ones(len(sets), bool)
        for deal in range(DEALS):
            at = left[owner]
            place = mix(shingle[at] ^ U64(SALT[1]) ^ U64(deal)) % count[band][owner[at]].astype(U64)
            place = base[owner[at]] + place.astype(np.int64)
            key = np.zeros(total, U64)
            np.bitwise_xor.at(key, place, mix(shingle[at] ^ U64(SALT[0])))
            filled = np.bincount(place, minlength=total) > 0
            enough = np.bincount(whose, weights=filled, minlength=len(sets)) > apart[band]
            left &= ~enough
            send = filled | (left[whose] & (deal == DEALS - 1))
            with np.errstate(over="ignore"):
                tag = mix((band[whose].astype(U64) << U64(40)) + (U64(deal) << U64(32)) + segment.astype(U64))
            out_set.append(sets[whose[send]])
            out_key.append(mix(key ^ tag)[send])
            if not left.any():
                break
    if not out_set:
        return np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(out_set), np.concatenate(out_key)


def _set_rows(k: int):
    @lean
    def run(batches):
        for b in batches:
            values, offsets = shingle_sets(byte_rows(b.column("text")), k)
            one, two = prints(values, offsets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(one), pa.array(two)],
                                             names=["doc_id", "n", "one", "two"])
    return run


def _sketch_rows(k: int, num: int, den: int, n: int):
    """Segment records of the distinct sets of each batch, dealt by key."""
    @lean
    def run(batches):
        for b in batches:
            values, offsets = shingle_sets(byte_rows(b.column("text")), k)
            sizes = np.diff(offsets)
            one, _ = prints(values, offsets)
            _, pick = np.unique(one, return_index=True)
            pick = np.sort(pick[sizes[pick] > 0])
            sizes, one = sizes[pick], one[pick]
            if not len(pick):
                continue
            values = np.concatenate([values[offsets[r]:offsets[r + 1]] for r in pick])
            whose, key = segment_keys(values, sizes, num, den)
            rest = (key // U64(n)).astype(np.uint32)
            rows = []
            for bucket, i in by_bucket((key % U64(n)).astype(np.int64), n):
                some, local = np.unique(whose[i], return_inverse=True)
                rows.append((bucket, one[some].tobytes(), sizes[some].astype(np.int32).tobytes(), rest[i].tobytes(), local.astype(np.uint16).tobytes()))
            kinds = [pa.int32()] + [pa.binary()] * 4
            for i in range(0, len(rows), 256):
                part = list(zip(*rows[i:i + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds)], names=["bucket", "node", "size", "key", "at"])
    return run


def _candidate_groups(num: int, den: int):
    """Groups (grp, node, size) of sets that agree in a segment, one for each distinct membership."""
    @lean_group
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["key"]])
        nodes = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(a, np.uint16)] for x, a in zip(pdf["node"], pdf["at"])])
        sizes = np.concatenate([np.frombuffer(x, np.int32)[np.frombuffer(a, np.uint16)] for x, a in zip(pdf["size"], pdf["at"])])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]                                        # keys of one record are most
        order = order[same]
        order = order[np.lexsort((nodes[order], keys[order]))]
        k, nodes, sizes = keys[order], nodes[order], sizes[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (nodes[1:] != nodes[:-1])
        k, nodes, sizes = k[fresh], nodes[fresh], sizes[fresh]
        if not len(k):
            return pd.DataFrame({"grp": np.empty(0, np.int64), "node": np.empty(0, np.int64), "size": np.empty(0, np.int32)})
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.concatenate([first, [len(k)]]))
        with np.errstate(over="ignore"):
            name = mix(np.add.reduceat(mix(nodes.view(U64)), first) ^ count.astype(U64)).view(np.int64)
        low, high = np.minimum.reduceat(sizes, first), np.maximum.reduceat(sizes, first)
        _, pick = np.unique(name, return_index=True)
        good = np.zeros(len(first), bool)
        good[pick] = True
        good &= (count > 1) & ((count > 2) | (low.astype(np.int64) * den >= high.astype(np.int64) * num))
        wide = np.repeat(good, count)
        return pd.DataFrame({"grp": np.repeat(name, count)[wide], "node": nodes[wide], "size": sizes[wide]})
    return run


def equal_sets(sets: DataFrame) -> DataFrame:
    """(n, one, two, rep): one representative of the rows (doc_id, n, one, two) with equal, non-empty sets."""
    return (sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
            .groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep")))


def with_components(sets: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the rows of ``sets``, from the components (node, comp) of
    representatives, a written table that is deleted."""
    classes = classes.join(comps, classes["rep"] == comps["node"], "left").select("n", "one", "two", F.coalesce("comp", "rep").alias("comp"))
    named = stage(sets.select("doc_id", "n", "one", "two").join(classes, ["n", "one", "two"], "left"), "named")
    free(comps)
    # ids whose rows hold several texts tie the components of these texts together
    ties = (named.filter("comp IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b"))
    ids = sets.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("one").alias("lo"), F.max("one").alias("hi")).filter("lo != hi")
    if not ids.isEmpty():
        spread = named.join(ties.select("doc_id", "a"), "doc_id").filter("comp IS NOT NULL").select("a", F.col("comp").alias("b"))
        merged = components(spread).select(F.col("node").alias("comp"), F.col("comp").alias("joined"))
        named = named.join(merged, "comp", "left").withColumn("comp", F.coalesce("joined", "comp"))
        whole = named.groupBy("doc_id").agg(F.min("comp").alias("least"))
        named = named.join(whole.filter("doc_id IS NOT NULL"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def similarity_classes(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    n = partitions_for(spark)
    held = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = held.filter(F.col("doc_id").isNotNull())
    sets = stage(held.mapInArrow(_set_rows(k), "doc_id long, n long, one long, two long"), "sets")
    classes = stage(equal_sets(sets), "classes")
    groups = (known.mapInArrow(_sketch_rows(k, num, den, n), "bucket int, node binary, size binary, key binary, at binary")
              .groupBy("bucket").applyInPandas(_candidate_groups(num, den), "grp long, node long, size int"))
    found = stage(groups.dropDuplicates(["grp", "node"]), "groups")
    groups = stage(found.join(classes.select(F.col("one").alias("node"), F.col("n").cast("int").alias("size"), "rep"), ["node", "size"])
                   .select("grp", "rep", "size"), "groups")
    free(found)
    comps = linked_groups(groups, known, k, num, den)
    free(groups)
    return with_components(sets, classes, comps)


def keep_one(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (or null)."""
    found = similarity_classes(docs, k, num, den, id_col, text_col)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
