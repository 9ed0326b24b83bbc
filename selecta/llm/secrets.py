"""Operator 4: secret scans with corpus-wide ownership frequency.

Three base kinds are matched in every text (``assign``, ``access``, ``hex``);
bare tokens of 20 and more characters that mix letters and digits
are further candidates (``token``). Each candidate's value is hashed. The hashes are
aggregated over the whole corpus by distinct repositories and owners: a value that many owners
hold is a copied example; one that a single owner holds,
with high character entropy, looks live. Base spans are always
reported; bare tokens that look live are added to them.

Plan: one scan of the texts, whose small result (spans and hashes, never the
values) is written once. Counts per (hash, owner) are pre-aggregated before the
shuffle, so a value copied into a third of all texts is one row per task.
The verdicts are joined back on the hash from a written table, so that AQE can split a hot hash.

Defined results: null text counts as empty. A null owner is an owner of its
own, and so is a null repository. Repeated rows each count and give one row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import bounded_batches, byte_rows, stage

#: The base kinds, in report order. Fixed values.
KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_BARE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
_WORDS = (b"passw", b"secret", b"token", b"api")

#: Owners from which on a value counts as a copied example; least bits a character of a live value.
COPIED_OWNERS = 3
LIVE_BITS = 3.0


def entropy(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: bytes | None) -> list:
    """(kind, start, end, value) in bytes; base kinds first, then bare tokens
    that overlap none of them."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((a, z) for _, a, z, _ in out)
    for m in _BARE.finditer(text):
        v = m[0]
        if any(48 <= c <= 57 for c in v) and any(c > 57 for c in v) and not any(a < m.end() and m.start() < z for a, z in base):
            out.append(("token", m.start(), m.end(), v))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def code_points(text: bytes, places: list) -> dict:
    """byte offset -> code point offset, for the given offsets."""
    out, at, seen = {}, 0, 0
    for p in sorted(set(places)):
        seen += len(text[at:p].decode("utf-8"))
        out[p] = seen
        at = p
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("h", pa.int64()), ("bits", pa.float64())]))
_FOUND_SQL = "array<struct<kind:string,start:bigint,end:bigint,h:bigint,bits:double>>"


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(key, doc_id, repo, owner, found): every candidate of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
                       F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
                       F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            found = []
            for text in byte_rows(b.column("text")):
                spans = candidates(text)
                at = code_points(text, [p for s in spans for p in s[1:3]]) if spans else {}
                found.append([{"kind": k, "start": at[a], "end": at[z], "h": xxhash.xxh64_intdigest(v) - (1 << 63), "bits": entropy(v)}
                              for k, a, z, v in spans])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "doc_id", "repo", "owner")), pa.array(found, _FOUND)],
                                             names=["key", "doc_id", "repo", "owner", "found"])
    return rows.mapInArrow(run, f"key long, doc_id long, repo string, owner string, found {_FOUND_SQL}")


def ownership(found: DataFrame) -> DataFrame:
    """(h, n_repos, n_owners): distinct repositories and owners of each value's hash."""
    held = found.select("repo", "owner", F.explode(F.array_distinct(F.transform("found", lambda x: x["h"]))).alias("h"))
    # one row for each (value, owner, repository), then for each (value, owner), then for each value
    return (held.groupBy("h", "owner", "repo").agg(F.lit(1).alias("one"))
            .groupBy("h", "owner").agg(F.count("repo").alias("repos"))
            .groupBy("h").agg(F.sum("repos").alias("n_repos"), F.count("owner").alias("n_owners")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
                 owner_col: str = "source", copied_owners: int = COPIED_OWNERS, live_bits: float = LIVE_BITS) -> DataFrame:
    """(doc_id, spans) for every row; a span has kind, start, end (code points),
    base (one of the base kinds), n_repos, n_owners, verdict: live, copied or unclear."""
    found = stage(scan(docs, id_col, text_col, repo_col, owner_col), "candidates")
    held = stage(ownership(found), "ownership")
    each = found.filter(F.size("found") > 0).select("key", F.explode("found").alias("s")).select("key", "s.*")
    verdict = (F.when(F.col("n_owners") >= copied_owners, "copied")
               .when((F.col("n_owners") == 1) & (F.col("bits") >= live_bits), "live").otherwise("unclear"))
    judged = each.join(held, "h").withColumn("verdict", verdict).withColumn("base", F.col("kind") != "token")
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = (judged.filter(F.col("base") | (F.col("verdict") == "live"))
             .groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
                 "start", kind.alias("order"), "end", "kind", "base", "n_repos", "n_owners", "verdict"))).alias("spans")))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return (found.select("key", "doc_id").join(spans, "key", "left")
            .select("doc_id", F.coalesce("spans", empty).alias("spans")))
