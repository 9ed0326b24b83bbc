"""Operator 7: benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, a word is a run of ASCII
letters, digits and non-ASCII characters. Every benchmark item gives its windows of ``width``
consecutive words; an item with fewer words is one window. Each distinct word
of the benchmark is coded as one character, so the automaton holds short
strings and a document is scanned once, one character per word (words that the
benchmark lacks share one code that no pattern holds). The position of a match
is therefore a word position, and is mapped back to code points of the original text.

Plan: no shuffle. The patterns are broadcast. Their size is checked first: the
items are cut into slices of at most ``slice_words`` words, and a document
passes one automaton per slice; a benchmark of any size works, in as many passes.

Defined results: null or empty text: no words, not contaminated. Null or
wordless items have no window. A window that several items share counts for each.
Items with a null id mark words but are not listed. Repeated item ids are
listed once; repeated documents give one row each.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selecta.llm.common import bounded_batches, byte_rows, lean, texts

WIDTH = 10
SLICE_WORDS = 500_000
_CODES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_RUN = re.compile(rb"[^\x20]+")
_OTHER = "\0"

_SCAN = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.IntegerType())),       # first, last word of each run that is hit
    T.StructField("items", T.ArrayType(T.LongType()))])


def words(text: bytes) -> list:
    """The normalised words of a text."""
    return text.translate(_CODES).split()


def _code(i: int) -> str:
    """Character of the i-th benchmark word: 1.., without the surrogates."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


def patterns(rows: list, width: int) -> tuple[dict, dict]:
    """(word -> character, window -> item ids) of (item_id, text) rows."""
    vocabulary: dict = {}
    windows: dict = {}
    for item_id, text in rows:
        coded = "".join(vocabulary.setdefault(w, _code(len(vocabulary))) for w in words((text or "").encode()))
        if not coded:
            continue
        for i in range(max(1, len(coded) - width + 1)):
            windows.setdefault(coded[i:i + width], set()).add(item_id)
    return vocabulary, {k: tuple(sorted(x for x in v if x is not None)) for k, v in windows.items()}


_AUTOMATA: dict = {}


def _automaton(shared):
    """This worker's automaton for a broadcast pattern set, built once."""
    key = id(shared)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        vocabulary, windows = shared.value
        a = ahocorasick.Automaton()
        for window, items in windows.items():
            a.add_word(window, (len(window), items))
        a.make_automaton()
        _AUTOMATA[key] = (vocabulary, a if windows else None, shared)
    return _AUTOMATA[key][:2]


def scan(text: bytes | None, vocabulary: dict, automaton) -> tuple[int, list, set]:
    """(number of words, hit runs as [first, last, first, last, ...], item ids)."""
    if not text:
        return 0, [], set()
    found = words(text)
    runs: list = []
    items: set = set()
    if automaton is not None:
        look = vocabulary.get
        coded = "".join([look(w, _OTHER) for w in found])
        ends = []
        for end, (size, ids) in automaton.iter(coded):
            items.update(ids)
            ends.append((end - size + 1, end))
        for first, last in sorted(ends):
            if runs and first <= runs[-1] + 1:
                runs[-1] = max(runs[-1], last)
            else:
                runs += [first, last]
    return len(found), runs, items


def _merge(old: list | None, new: list) -> list:
    pairs = sorted(zip((old or [])[0::2] + new[0::2], (old or [])[1::2] + new[1::2]))
    out: list = []
    for first, last in pairs:
        if out and first <= out[-1] + 1:
            out[-1] = max(out[-1], last)
        else:
            out += [first, last]
    return out


def _pass(shared):
    @lean
    def run(batches):
        vocabulary, automaton = _automaton(shared)
        for b in batches:
            n, hits, items = [], [], []
            old_hits, old_items = b.column("hits").to_pylist(), b.column("items").to_pylist()
            for text, h, i in zip(byte_rows(b.column("text")), old_hits, old_items):
                count, runs, ids = scan(text, vocabulary, automaton)
                n.append(count)
                hits.append(_merge(h, runs) if h else runs)
                items.append(sorted(ids.union(i)) if i else sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array(n, pa.int64()),
                 pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                names=["doc_id", "text", "n_words", "hits", "items"])
    return run


def original_spans(text: bytes, runs: list) -> list:
    """Code point spans (start, end) of the hit runs in the original text."""
    if not runs:
        return []
    places = [(m.start(), m.end()) for m in _RUN.finditer(text.translate(_CODES))]
    out, at, seen = [], 0, 0                       # code points before byte ``at``
    for first, last in zip(runs[0::2], runs[1::2]):
        a, z = places[first][0], places[last][1]
        start = seen + len(text[at:a].decode("utf-8"))
        end = start + len(text[a:z].decode("utf-8"))
        out.append({"start": start, "end": end})
        at, seen = z, end
    return out


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_words: int):
    """(item_id, text) rows in slices of at most ``slice_words`` words (one item at least)."""
    held: list = []
    size = 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len(words((r["t"] or "").encode()))
        if held and size + n > slice_words:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) for every row of ``docs``.

    ``items`` are the ids of benchmark items with an occurring window, sorted;
    ``spans`` are the hit passages as code point offsets of the original text.
    """
    spark = docs.sparkSession
    held = texts(docs, id_col, text_col).select(
        F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hits"), F.array().cast("array<bigint>").alias("items"))
    for rows in _slices(benchmark, item_col, item_text_col, slice_words):
        held = held.mapInArrow(_pass(spark.sparkContext.broadcast(patterns(rows, width))), _SCAN)

    def spans(batches):
        for b in batches:
            n_hit, out = [], []
            for text, runs in zip(byte_rows(b.column("text")), b.column("hits").to_pylist()):
                n_hit.append(int(np.sum(np.diff(runs)[0::2] + 1)) if runs else 0)
                out.append(original_spans(text, runs) if runs else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), b.column("items"),
                 pa.array(out, kind)], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    placed = held.withColumn("text", F.when(F.size("hits") > 0, F.col("text"))).mapInArrow(
        spans, "doc_id long, n_words long, n_hit long, items array<bigint>, spans array<struct<start:bigint,end:bigint>>")
    return placed.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of a benchmark item."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def clean(shared):
        @lean
        def run(batches):
            vocabulary, automaton = _automaton(shared)
            for b in batches:
                yield b.filter(pa.array([not scan(t, vocabulary, automaton)[1] for t in byte_rows(b.column(at))], pa.bool_()))
        return run

    for rows in _slices(benchmark, item_col, item_text_col, slice_words):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(patterns(rows, width))), docs.schema)
    return docs
