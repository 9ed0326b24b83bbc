"""Operator 11: phrase collocation mining with weighted acyclic automata.

Every word of a text begins one string: its language and the next words of its piece, at most ``longest``. The count of
a phrase is the sum over the strings that begin with it, so one string a word carries the counts of all
phrases of all lengths. A shard's strings are sorted and become a count transducer (:mod:`selecta.llm.count_automata`), which is
cut at common borders into prefix ranges. A task unites the transducers of a range, sums weights, and
reads the counts of all phrases off the prefixes. Prefixes that pass a border are summed over their ranges.

The counts of the first parts of a phrase are those of its prefixes, the counts of the rests are those of its
suffixes, which are prefixes of the reversed phrases. So the frequent phrases, in either order, are dealt to prefix ranges once
more, with those that are prefixes of a border, and composed with the transducer of their own counts.

Plan: two passes over the texts (a sample for the borders, the shards); transducers are shuffled, pre-summed
per shard, and the borders are whole strings, so a very frequent word or phrase spans as many ranges as
it needs. Only phrases of ``min_count`` or more occurrences leave a range (parts of a frequent phrase are frequent themselves). The
driver holds the borders (one string a range). The best of a language are first taken per part of it.

Defined results: null text counts as empty, null language as ``und``. Repeated rows and ids count as often as they are
there; ids are not read. Ties in score and count go by the phrase's UTF-8 bytes. Words without a separator are one word, however
long. An empty table, and a language without frequent phrases, give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from selecta.llm.common import bounded_batches, byte_rows, partitions_for, stage
from selecta.llm.count_automata import Trie, compose, distinct, split, trie, union, vocabulary

MIN_COUNT, LONGEST, TOP, SCALE, COVERED = 30, 4, 2_000, 2_000_000, 80
#: Bytes of text of a shard, and bytes of text for each prefix range.
SHARD_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Texts and strings sampled for the borders (expected numbers; 20 strings a range if that is more), and frequent phrases of a range.
SAMPLE_TEXTS, SAMPLE_STRINGS, RANGE_PHRASES = 4_000, 50_000, 200_000
_BLANK, _BREAK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK


def strings_of(rows: list, langs: list, longest: int) -> tuple[list, list]:
    """(columns, words): one string for each word of the texts, as word numbers by level (0: no word)."""
    blob = b"\n" + b"\n".join(t.lower() for t in rows) + b"\n"
    a = np.frombuffer(blob, np.uint8)
    kind = _CLASS[a]
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edges[0::2], edges[1::2]
    piece = np.cumsum(kind == _BREAK, dtype=np.int64)[first]
    begins = np.cumsum([1] + [len(t) + 1 for t in rows])
    text = np.searchsorted(begins, first, side="right") - 1
    ends = np.cumsum(last - first)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(a[inside].tobytes())])
    number, words = vocabulary(pa.concat_arrays([found, pa.array(langs, pa.large_binary())]))
    word, lang = number[:len(first)], number[len(first):]
    columns = [lang[text], word]
    for step in range(1, longest):
        after = np.zeros(len(word), np.int64)
        if step < len(word):
            same = piece[step:] == piece[:-step]
            after[:-step][same] = word[step:][same]
        columns.append(after)
    return columns, words


def _parts(text: bytes, size: int):
    """``text`` in parts of about ``size`` bytes, cut where a piece ends."""
    at = 0
    while len(text) - at > size:
        ends = [x for x in (text.find(c, at + size) for c in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r")) if x >= 0]
        if not ends:
            break
        yield text[at:min(ends)]
        at = min(ends)
    yield text[at:]


def shards(batches, size: int):
    """(texts, languages) of about ``size`` bytes; a longer text is cut between pieces."""
    rows, langs, held = [], [], 0
    for b in batches:
        for text, lang in zip(byte_rows(b.column("text")), byte_rows(b.column("lang"))):
            for part in _parts(text or b"", size):
                rows.append(part)
                langs.append(lang)
                held += len(part) + 8
                if held >= size:
                    yield rows, langs
                    rows, langs, held = [], [], 0
    if rows:
        yield rows, langs


def borders(strings: list, ranges: int) -> list:
    """At most ``ranges`` - 1 distinct strings that cut a sample into equal parts."""
    strings = sorted(strings)
    return sorted({strings[len(strings) * i // ranges] for i in range(1, ranges)}) if strings else []


def _sampled(docs: DataFrame, size: int, n_rows: int, n_bytes: int, ranges: int, longest: int) -> list:
    """Borders of the prefix ranges of ``docs`` from a sample of its strings."""
    share = min(1.0, SAMPLE_TEXTS / max(1, n_rows))
    rate = min(1.0, max(SAMPLE_STRINGS, 20 * ranges) / max(1.0, share * n_bytes / 6))

    def run(batches):
        random = np.random.default_rng(7)
        for rows, langs in shards(batches, size):
            columns, words = strings_of(rows, langs, longest)
            pick = np.flatnonzero(random.random(len(columns[0])) < rate)
            flat = pa.array([words[x] for x in np.stack([c[pick] for c in columns], axis=1).ravel()], pa.binary())
            offsets = pa.array(np.arange(len(pick) + 1) * len(columns), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat)], names=["string"])

    sample = docs.sample(share, seed=11).mapInArrow(run, "string array<binary>")
    return borders([tuple(bytes(x) for x in r["string"]) for r in sample.collect()], ranges)


def _shard_rows(cuts: list, size: int, longest: int):
    """(range, automaton) of the ranges of each shard."""
    def run(batches):
        for rows, langs in shards(batches, size):
            columns, words = strings_of(rows, langs, longest)
            if not len(columns[0]):
                continue
            parts = split(trie(*distinct(columns, np.ones(len(columns[0]), np.int64)), words), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())],
                                             names=["range", "automaton"])
    return run


def frequent_prefixes(t: Trie, near: list, min_count: int) -> list:
    """(level, nodes): the prefixes that count ``min_count`` or more, or that begin a string of ``near``."""
    number = {w: i for i, w in enumerate(t.words)}
    out = []
    open_nodes: list = [set() for _ in t.label]
    for string in near:
        node = 0
        for d, word in enumerate(string):
            lo, hi = (0, len(t.label[0])) if not d else np.searchsorted(t.parent[d], [node, node + 1])
            at = lo + int(np.searchsorted(t.label[d][lo:hi], number.get(word, -1)))
            if word not in number or at >= hi or t.label[d][at] != number[word]:
                break
            node = at
            open_nodes[d].add(node)
    for d, label in enumerate(t.label):
        take = (t.total[d] >= min_count) & (label != 0) if d else np.ones(len(label), bool)
        take[[x for x in open_nodes[d] if not d or label[x] != 0]] = True
        out.append((d, np.flatnonzero(take)))
    return out


def _range_counts(cuts: list, min_count: int):
    """(lang, words, f) of the prefixes of a range; those that pass its borders are partial counts."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = union(pdf["automaton"].tolist())
        r = int(key[0])
        near = cuts[max(0, r - 1):r + 1]
        text = [w.decode() for w in t.words]
        out = {"lang": [], "words": [], "f": []}
        for d, nodes in frequent_prefixes(t, near, min_count):
            paths = t.paths(d, nodes)
            out["lang"] += [text[p[0]] for p in paths]
            out["words"] += [[text[x] for x in p[1:]] for p in paths.tolist()]
            out["f"] += t.total[d][nodes].tolist()
        return pd.DataFrame(out)
    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang",
                  shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, words, f) of all phrases of up to ``longest`` words that occur ``min_count`` times in their language, and
    of the empty phrase: the words of the language. Written."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    n_rows, n_bytes = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(partitions_for(spark), -(-n_bytes // range_bytes))
    cuts = _sampled(held, shard_bytes, n_rows, n_bytes, ranges, longest)
    rows = (held.mapInArrow(_shard_rows(cuts, shard_bytes, longest), "range long, automaton binary")
            .groupBy("range").applyInPandas(_range_counts(cuts, min_count), "lang string, words array<string>, f long"))
    whole = rows.groupBy("lang", "words").agg(F.sum("f").alias("f"))
    return stage(whole.filter((F.size("words") == 0) | (F.col("f") >= min_count)), "phrases")


def _dealt(cuts: list, longest: int, backward: bool):
    """(range, own, lang, words, f): a phrase in its own range, and in those whose border it begins."""
    begun: dict = {}
    for r, cut in enumerate(cuts):
        for d in range(1, longest + 1):
            if cut[d]:
                begun.setdefault(cut[:d + 1], []).append(r + 1)

    def run(batches):
        for b in batches:
            place, index, own = [], [], []
            for i, (lang, words) in enumerate(zip(b.column("lang").to_pylist(), b.column("words").to_pylist())):
                short = (lang.encode(), *[w.encode() for w in (reversed(words) if backward else words)])
                home = bisect_right(cuts, short + (b"",) * (longest + 1 - len(short)))
                for r in {home, *begun.get(short, ())}:
                    place.append(r)
                    index.append(i)
                    own.append(r == home)
            rows = b.select(["lang", "words", "f"]).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(own, pa.bool_()), *rows.columns], names=["range", "own", "lang", "words", "f"])
    return run


def _composed(longest: int, backward: bool):
    """(lang, words, f, parts): the counts of the first 1, 2 ... words of each phrase of two words or more."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [[x.encode() for x in (reversed(w) if backward else w)] for w in pdf["words"].tolist()]
        flat = [x.encode() for x in pdf["lang"]] + [x for w in lists for x in w]
        number, words = vocabulary(pa.array(flat, pa.binary()))
        size = np.array([len(w) for w in lists], np.int64)
        columns = np.zeros((len(lists), longest + 1), np.int64)
        columns[:, 0] = number[:len(lists)]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        columns[np.repeat(np.arange(len(lists)), size), at + 1] = number[len(lists):]
        order = np.lexsort(columns.T[::-1])
        acceptor = trie(columns[order], np.ones(len(order), np.int64), words)
        weights = np.empty(columns.shape, np.int64)
        weights[order] = compose(acceptor, pdf["f"].to_numpy(np.int64)[order])
        keep = np.flatnonzero(pdf["own"].to_numpy(bool) & (size > 1))
        parts = [weights[i, 1:size[i]].tolist() for i in keep]
        if any(x < 0 for p in parts for x in p):
            raise ValueError("a part of a frequent phrase has no count")
        kept = pdf.iloc[keep]
        return pd.DataFrame({"lang": kept["lang"], "words": kept["words"], "f": kept["f"], "parts": pd.Series(parts, kept.index, object)})
    return run


def part_counts(phrases: DataFrame, longest: int = LONGEST, backward: bool = False, range_phrases: int = RANGE_PHRASES) -> DataFrame:
    """(lang, words, f, parts) of the phrases of two words or more; ``parts`` counts their prefixes, or suffixes, by length."""
    spark = phrases.sparkSession
    some = phrases.filter(F.size("words") > 0)
    n = some.count()
    ranges = max(partitions_for(spark), -(-n // range_phrases))
    sample = some.sample(min(1.0, max(SAMPLE_STRINGS, 20 * ranges) / max(1, n)), seed=13).select("lang", "words").collect()
    order = (lambda w: w[::-1]) if backward else list
    cuts = borders([(r["lang"].encode(), *[w.encode() for w in order(r["words"])], *[b""] * (longest - len(r["words"]))) for r in sample], ranges)
    dealt = some.mapInArrow(_dealt(cuts, longest, backward), "range long, own boolean, lang string, words array<string>, f long")
    return dealt.groupBy("range").applyInPandas(_composed(longest, backward), "lang string, words array<string>, f long, parts array<long>")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, scale: int = SCALE, covered: int = COVERED,
                 text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES,
                 range_phrases: int = RANGE_PHRASES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    a, l, r and n count the phrase, its first part and its rest at the lowest-scoring cut, and the words of the language.
    A phrase is left out where a longer one around it occurs in ``covered`` percent of its places or more."""
    phrases = phrase_counts(docs, min_count, longest, text_col, lang_col, shard_bytes, range_bytes)
    heads = part_counts(phrases, longest, False, range_phrases).select("lang", "words", "f", F.col("parts").alias("heads"))
    tails = part_counts(phrases, longest, True, range_phrases).select("lang", "words", F.col("parts").alias("tails"))
    candidates = stage(heads.join(tails, ["lang", "words"]), "candidates")
    wide = "decimal(20,0)"
    # a longer phrase holds one that is a word longer and at least as frequent
    longer = candidates.filter(F.size("words") > 2)
    inner = longer.select("lang", "f", F.explode(F.expr("array(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1))")).alias("words"))
    around = inner.groupBy("lang", "words").agg(F.max("f").alias("around"))
    kept = (candidates.join(around, ["lang", "words"], "left")
            .filter(f"around IS NULL OR CAST(around AS {wide}) * 100 < CAST(f AS {wide}) * {int(covered)}"))
    lowest = F.expr(f"""array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
        'score', (CAST(f AS {wide}) * {int(scale)}) div (CAST(heads[k - 1] AS {wide}) + CAST(tails[size(words) - k - 1] AS {wide})),
        'k', k, 'l', heads[k - 1], 'r', tails[size(words) - k - 1])))""")
    scored = kept.withColumn("cut", lowest).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"),
                                                   F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    n = partitions_for(docs.sparkSession)
    part = F.pmod(F.xxhash64("phrase"), F.lit(n))
    scored = (scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
              .filter(F.col("rank") <= top).drop("part", "rank"))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    words = phrases.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return scored.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
