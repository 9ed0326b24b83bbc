"""Components of the links within candidate groups, verified on whole sets.

An operator on near copies names groups of sets that may link. Groups that share a member are one *field*
(the components of the unverified groups, a few bytes a member).
A field of bounded size goes to one block: its texts are shuffled there once, and its links are found in
memory, whatever the number of groups and pairs: sizes and parity sketches rule out most pairs, whole sets decide the rest, and
a union-find skips pairs that are already in one component. Many fields share a block.

A field beyond that size (a third of all rows may be near copies of one text) is linked in rounds. In each
round every group names one pivot (the node with most links so far) and the others are compared with it, first
by sketches, then by whole sets. When a round finds nothing new, members of one group but of several
components remain; their sketches are compared tile by tile, and only pairs within the Hamming distance
that a link allows are verified. Both ways find every link between members of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import U64, byte_rows, free, lean, lean_group, mix, partitions_for, stage, with_maybe
from selecta.llm.shingles import SALT, shingle_sets


def linked_sets(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets of 64-bit shingles link."""
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
    return both > 0 and den * both >= num * (len(x) + len(y) - both)


def links(a: bytes, b: bytes, num: int, den: int) -> bool:
    """:func:`linked_sets` of sets as bytes."""
    return linked_sets(np.frombuffer(a, U64), np.frombuffer(b, U64), num, den)


def may_link(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """False where sizes or parity sketches rule a link out."""
    if min(na, nb) * den < max(na, nb) * num:
        return False
    x, y = np.frombuffer(a, U64)[None], np.frombuffer(b, U64)[None]
    words = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) <= (den - num) * (na + nb) // (den + num)


def _paired(pairs: DataFrame, table: DataFrame, columns: list, test, name: str) -> DataFrame:
    """``pairs`` (a, b) with the boolean column ``name``: test(*columns of a, *columns of b). A row of ``table``
    has the key rep; only the rows of ids in pairs are shuffled."""
    @lean
    def run(batches):
        for b in batches:
            sides = [b.column(f"{side}{c}").to_pylist() for side in "ab" for c in columns]
            n = len(columns)
            ok = [test(row[:n], row[n:]) for row in zip(*sides)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", name])

    named = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    some = with_maybe(table, "rep", named, "_maybe").filter("_maybe")
    full = pairs
    for side in "ba":
        full = full.join(some.select(F.col("rep").alias(side), *[F.col(c).alias(f"{side}{c}") for c in columns]), side)
    full = full.select("a", "b", *[f"{side}{c}" for side in "ab" for c in columns])
    return full.mapInArrow(run, f"a long, b long, {name} boolean").groupBy("a", "b").agg(F.max(name).alias(name))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b) of representatives: by sketches, the rest by whole sets. Written."""
    pairs = stage(pairs, "pairs")
    near = stage(_paired(pairs, sets.select("rep", "n", "sketch"), ["n", "sketch"],
                         lambda a, b: may_link(a[1], b[1], a[0], b[0], num, den), "near"), "near")
    told = _paired(near.filter("near").select("a", "b"), sets.select("rep", "set"), ["set"],
                   lambda a, b: links(a[0], b[0], num, den), "linked")
    out = stage(told.unionByName(near.filter("NOT near").select("a", "b", F.lit(False).alias("linked"))), "verified")
    free(pairs, near)
    return out


#: Edges that a task holds in its union-find at once.
FOREST = 500_000


def find(parent: dict, x):
    """Root of ``x``; halves the path on its way."""
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as ``edges``: each task joins its edges by union-find
    and gives one edge (root, node) for each node; the root is the smallest node it has seen."""
    @lean
    def run(batches):
        parent: dict = {}

        def rows():
            pairs = [(find(parent, x), x) for x in parent]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = find(parent, a), find(parent, b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) >= FOREST:
                yield rows()
                parent.clear()
        yield rows()
    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components as ``edges``, twice joined by union-find. Written.

    A node of a large component has an edge from every task that saw it, so the edges that tasks are left with are
    dealt anew to as few tasks as hold ``FOREST`` of them each: one such task leaves one edge a node."""
    less = stage(forest(edges).distinct(), "forest")
    out = stage(forest(less.coalesce(max(1, -(-less.count() // FOREST)))), "forest")
    free(less)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each component of the edges (a, b). Written.

    Tasks first join what they can by union-find (:func:`thinned`). A node with one edge has its neighbour's
    component, so the rounds are run by the others alone: labels spread along their edges and jump to the
    label of their label; rounds grow with the logarithm of the longest path. Each round is
    written to the shared folder, and the one before it is deleted.
    """
    less = thinned(edges)
    seen = less.select(F.col("b").alias("node"), F.lit(1).alias("n")).unionByName(less.select(F.col("a").alias("node"), F.lit(2).alias("n")))
    once = seen.groupBy("node").agg(F.sum("n").alias("n")).filter("n = 1").select("node", F.lit(True).alias("leaf"))
    told = stage(less.join(once, less["b"] == once["node"], "left").select("a", "b", F.coalesce("leaf", F.lit(False)).alias("leaf")), "told")
    free(less)
    core, leaves = told.filter("NOT leaf").select("a", "b"), told.filter("leaf").select(F.col("a").alias("at"), "b")
    both = stage(core.unionByName(core.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = _spread(both)
    free(both)
    kept = label.select("node", "comp")
    alone = leaves.select(F.col("at").alias("node")).distinct().join(kept, "node", "left_anti").select("node", F.col("node").alias("comp"))
    tips = leaves.join(kept, leaves["at"] == kept["node"], "left").select(F.col("b").alias("node"), F.coalesce("comp", "at").alias("comp"))
    out = stage(kept.unionByName(alone).unionByName(tips), "components")
    free(label, told)
    return out


def _spread(both: DataFrame) -> DataFrame:
    """(node, old, comp) of the edges (a, b), given in both directions. Written."""
    label = stage(both.groupBy("a").agg(F.min("b").alias("m"))
                  .select(F.col("a").alias("node"), F.lit(None).cast("long").alias("old"), F.least("a", "m").alias("comp")), "labels")
    while True:
        pushed = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("comp").alias("p"))
        near = label.join(pushed, label["node"] == pushed["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "p").alias("comp"))
        near = stage(near, "near")
        parent = near.select(F.col("node").alias("pn"), F.col("comp").alias("pc"))
        then = stage(near.join(parent, near["comp"] == parent["pn"]).select("node", "old", F.least("comp", "pc").alias("comp")), "labels")
        free(near, label)
        if then.filter(F.col("old") != F.col("comp")).isEmpty():
            return then
        label = then


def _unequal(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Group rows (grp, rep, size) with ``comp``, without groups that are settled:
    those in one component, and pairs, which the first round has verified."""
    if comps is None:
        return rows.withColumn("comp", F.col("rep"))
    rows = rows.join(comps.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = (rows.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
             .filter("lo < hi AND n > 2").select("grp"))
    return rows.join(mixed, "grp")


#: Members of a group that are compared with one another at once.
TILE = 1_024


def sketch(shingles: bytes) -> bytes:
    """Parity sketch of a set: every shingle flips one of 2 to 4 bits a shingle (a power of two)."""
    x = np.frombuffer(shingles, U64)
    bits = max(64, 1 << (2 * len(x) - 1).bit_length())
    at = (mix(x ^ U64(SALT[0])) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of (rows, more words) as they would be with ``words`` words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near_pairs(a: dict, b: dict, same: bool, num: int, den: int) -> np.ndarray:
    """(x, y) of members of two tiles that differ in component and that sizes and
    sketches do not rule out. A tile has arrays rep, size, comp and a list sketch."""
    out = [np.empty((0, 2), np.int64)]
    words = [np.array([len(x) // 8 for x in t["sketch"]]) for t in (a, b)]
    for wa in np.unique(words[0]):
        ia = np.flatnonzero(words[0] == wa)
        sa = np.frombuffer(b"".join(a["sketch"][i] for i in ia), U64).reshape(len(ia), wa)
        for wb in np.unique(words[1]):
            ib = np.flatnonzero(words[1] == wb)
            sb = np.frombuffer(b"".join(b["sketch"][i] for i in ib), U64).reshape(len(ib), wb)
            x, y = _folded(sa, min(wa, wb)), _folded(sb, min(wa, wb))
            nb, cb, rb = b["size"][ib], b["comp"][ib], b["rep"][ib]
            for j, i in enumerate(ia):
                n = a["size"][i]
                ok = (cb != a["comp"][i]) & (np.minimum(nb, n) * den >= np.maximum(nb, n) * num)
                if same:
                    ok &= rb > a["rep"][i]
                k = np.flatnonzero(ok)
                if len(k):
                    apart = np.bitwise_count(y[k] ^ x[j]).sum(axis=1, dtype=np.int64)
                    k = k[apart <= (den - num) * (nb[k] + n) // (den + num)]
                    out.append(np.stack([np.full(len(k), a["rep"][i]), rb[k]], axis=1))
    found = np.concatenate(out)
    return np.unique(np.sort(found, axis=1), axis=0)


def _near_rows(num: int, den: int):
    """Pairs (a, b) of each tile pair (grp, lo, hi) of a bucket."""
    @lean_group
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grp", "lo", "hi"], kind="stable")
        keys = pdf[["grp", "lo", "hi"]].to_numpy()
        cols = {c: pdf[c].to_numpy(np.int64) for c in ("rep", "size", "comp", "tile")}
        sketches = pdf["sketch"].tolist()
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        out = [np.empty((0, 2), np.int64)]
        for x, y in zip(first, np.concatenate([first[1:], [len(keys)]])):
            lo, hi = keys[x, 1], keys[x, 2]

            def tile(t, x=x, y=y):
                i = x + np.flatnonzero(cols["tile"][x:y] == t)
                return {c: cols[c][i] for c in ("rep", "size", "comp")} | {"sketch": [sketches[j] for j in i]}

            a = tile(lo)
            out.append(near_pairs(a, a if lo == hi else tile(hi), lo == hi, num, den))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def remaining_pairs(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of group rows (grp, rep, size, comp) that only the whole sets can decide."""
    n = partitions_for(rows.sparkSession)
    count = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tiled = rows.join(count, "grp").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("grp", "rep", "size", "comp", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    tiled = tiled.withColumn("bucket", F.pmod(F.xxhash64("grp", "lo", "hi"), F.lit(4 * n)).cast("int"))
    return (tiled.join(sets.select("rep", "sketch"), "rep").groupBy("bucket").applyInPandas(_near_rows(num, den), "a long, b long").distinct())


def set_rows(texts: DataFrame, k: int, keep: list) -> DataFrame:
    """(rep, n, set, sketch) of every row (rep, text); ``keep`` names further long columns that stay."""
    @lean
    def run(batches):
        for b in batches:
            values, offsets = shingle_sets(byte_rows(b.column("text")), k)
            sets = [values[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), pa.array(np.diff(offsets)), pa.array(sets, pa.binary()), pa.array([sketch(x) for x in sets], pa.binary()),
                 *[b.column(c) for c in keep]], names=["rep", "n", "set", "sketch", *keep])
    return texts.select("rep", "text", *keep).mapInArrow(run, ", ".join(["rep long, n long, set binary, sketch binary", *[f"{c} long" for c in keep]]))


def link_in_rounds(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, comp) of the representatives in groups (grp, rep, size) of any size; ``sets`` as of :func:`set_rows`, written."""
    spark = groups.sparkSession
    none = spark.createDataFrame([], "a long, b long")
    verified: list = []                              # written tables (a, b, linked)
    degree = spark.createDataFrame([], "rep long, degree long")
    comps = None
    fits = F.least("size", "psize").cast("long") * den >= F.greatest("size", "psize").cast("long") * num

    def tested():
        out = none
        for t in verified:
            out = out.unionByName(t.select("a", "b"))
        return out

    def linked():
        out = none
        for t in verified:
            out = out.unionByName(t.filter("linked").select("a", "b"))
        return out

    while True:
        rows = stage(_unequal(groups, comps), "unequal")
        if rows.isEmpty():
            free(rows)
            break
        # one pivot for each group: the node with most links, then the smallest
        ranked = rows.join(degree, "rep", "left").withColumn("rank", F.struct(-F.coalesce("degree", F.lit(0)), "rep", "size", "comp"))
        pivots = stage(ranked.groupBy("grp").agg(F.min("rank").alias("p")).select(
            "grp", F.col("p.rep").alias("pivot"), F.col("p.size").alias("psize"), F.col("p.comp").alias("pcomp")), "pivots")
        pairs = (rows.join(pivots, "grp").filter((F.col("comp") != F.col("pcomp")) & fits)
                 .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())
        verified.append(_verify(pairs.join(tested(), ["a", "b"], "left_anti"), sets, num, den))
        last = verified[-1].filter("linked").isEmpty()
        if last:
            # no pivot links anything more: the rest by their sketches
            verified.append(_verify(remaining_pairs(rows, sets, num, den).join(tested(), ["a", "b"], "left_anti"), sets, num, den))
        free(rows, pivots)
        if last and verified[-1].filter("linked").isEmpty():
            break
        old, comps = comps, components(linked())
        if old is not None:
            free(old)
        if last:
            break
        degree = linked().select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
    out = comps if comps is not None else stage(spark.createDataFrame([], "node long, comp long"), "components")
    free(*verified)
    return out


#: Shingles and members of the largest field that is linked in memory, and shingles of a block.
FIELD_SHINGLES, FIELD_MEMBERS, BLOCK_SHINGLES = 4_000_000, 16_384, 2_000_000
#: Texts of a block that are shingled at once.
BLOCK_TEXTS = 64


def linked_in_memory(reps: np.ndarray, sets: list, num: int, den: int) -> np.ndarray:
    """Smallest representative of the component of each set; sets of one representative are linked.

    Sets are taken by size, so that the partners that its size allows follow a set directly."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(x) for x in sets], np.int64)
    _, comp = np.unique(reps[order], return_inverse=True)
    sketches = [np.frombuffer(sketch(x.tobytes()), U64) for x in sets]
    words = np.array([len(x) for x in sketches])            # grows with the size
    tables = [(int(w), int(np.searchsorted(words, w)), np.stack([sketches[i] for i in np.flatnonzero(words == w)])) for w in np.unique(words)]
    ends = np.searchsorted(sizes, sizes * den // num, side="right")
    for i in range(len(sets) - 1):
        if (comp == comp[0]).all():
            break
        for w, start, table in tables:
            lo, hi = max(i + 1, start), min(int(ends[i]), start + len(table))
            near = lo + np.flatnonzero(comp[lo:hi] != comp[i]) if hi > lo else []
            if not len(near):
                continue
            least = min(w, int(words[i]))
            apart = np.bitwise_count(_folded(table[near - start], least) ^ _folded(sketches[i][None], least)).sum(axis=1, dtype=np.int64)
            for j in near[apart <= (den - num) * (sizes[near] + sizes[i]) // (den + num)]:
                if comp[j] != comp[i] and linked_sets(sets[i], sets[j], num, den):
                    comp[comp == comp[j]] = comp[i]
    least = np.full(int(comp.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, comp, reps[order])
    out = np.empty(len(sets), np.int64)
    out[order] = least[comp]
    return out


def _block_rows(k: int, num: int, den: int):
    """(node, comp) of the texts of a block, field by field."""
    @lean_group
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.pop("text").tolist()
        sets: list = []
        while rows:                                  # a few texts at a time: shingling takes many times the set's bytes
            some = [rows.pop() for _ in range(min(BLOCK_TEXTS, len(rows)))]
            values, offsets = shingle_sets(some, k)
            sets += [values[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
        sets.reverse()
        reps, fields = pdf["rep"].to_numpy(np.int64), pdf["field"].to_numpy(np.int64)
        comp = np.empty(len(reps), np.int64)
        order = np.argsort(fields, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(fields[order])) + 1):
            comp[at] = linked_in_memory(reps[at], [sets[i] for i in at], num, den)
        return pd.DataFrame({"node": reps, "comp": comp}).drop_duplicates()
    return run


def linked_groups(groups: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, comp) of the representatives in ``groups`` (grp, rep, size); texts in ``docs`` (doc_id, text). Written."""
    spark = groups.sparkSession
    first = groups.groupBy("grp").agg(F.min("rep").alias("a"))
    # a member names the least of its groups' first members, and these with one another: bounded by its own groups
    stars = groups.join(first, "grp").filter("rep != a").groupBy("rep").agg(F.min("a").alias("a"), F.collect_set("a").alias("others"))
    edges = stars.select("a", F.explode(F.concat("others", F.array("rep"))).alias("b")).filter("a != b").distinct()
    field = components(edges)
    members = groups.groupBy("rep").agg(F.max("size").cast("long").alias("size")).join(field.select(F.col("node").alias("rep"), F.col("comp").alias("field")), "rep")
    members = stage(members, "members")
    load = members.groupBy("field").agg(F.sum("size").alias("shingles"), F.count(F.lit(1)).alias("n"))
    load = stage(load.withColumn("small", (F.col("shingles") <= FIELD_SHINGLES) & (F.col("n") <= FIELD_MEMBERS)), "load")
    total = load.filter("small").agg(F.sum("shingles")).first()[0] or 0
    buckets = max(partitions_for(spark), -(-total // BLOCK_SHINGLES))
    placed = stage(members.join(load.select("field", "small"), "field")
                   .select("rep", "field", "small", F.pmod(F.xxhash64("field"), F.lit(buckets)).alias("bucket")), "placed")
    free(field, members, load)

    def texts_of(some: DataFrame) -> DataFrame:
        held = with_maybe(docs, "doc_id", some.select(F.col("rep").alias("doc_id")), "_maybe").filter("_maybe")
        return held.select(F.col("doc_id").alias("rep"), F.col("text").cast("binary").alias("text")).join(some, "rep")

    blocks = texts_of(placed.filter("small")).select("bucket", "field", "rep", "text")
    out = stage(blocks.groupBy("bucket").applyInPandas(_block_rows(k, num, den), "node long, comp long"), "components")
    large = placed.filter("NOT small")
    if not large.isEmpty():
        sets = stage(set_rows(texts_of(large), k, []), "shingles")
        held = stage(groups.join(large.select("rep"), "rep"), "large")
        rest = link_in_rounds(held, sets, num, den)
        both = stage(out.unionByName(rest.select("node", "comp")), "components")
        free(sets, held, rest, out)
        out = both
    free(placed)
    return out
