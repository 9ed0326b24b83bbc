"""Operator 2: personal data by patterns and a character BiLSTM with a CRF.

Base spans come from four patterns (email, ip, card, phone) with their checks.
A bidirectional LSTM over characters with CRF transitions, trained here in numpy
from spans labelled by those patterns, adds spans that the patterns
miss. It reads overlapping windows; windows are laid around every digit and
every ``@`` (each kind holds one of them, so no other place can hold a span). The windows' decoded spans
are reconciled over the whole text: spans cut by a window's edge give way to
the neighbour that sees them whole, and of overlapping spans the most certain stays.
Added spans overlap no base span and reach a posterior of ``LEAST_SCORE``.

Plan: one sample of at most ``SAMPLE`` windows (least hash first) goes to the driver for training; the
weights (some 50 kB) are broadcast; all texts are scanned where they lie, without a shuffle.

Defined results: null text counts as empty. Repeated rows give one row each.
With no labelled window the model adds nothing.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.bilstm_crf import BiLstmCrf
from selecta.llm.common import byte_rows, texts
from selecta.llm.secrets import code_points

#: Kinds in report order, and their tags. Fixed values.
KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 64, 32, 24
SAMPLE = 2_500
LEAST_SCORE = 0.97
_SPLIT = 128                          # windows decoded at once

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a digit run: one that began there would have begun earlier.
_IP = re.compile(rb"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(rb"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[^0-9]")
_ANCHOR = re.compile(rb"[0-9@]")


def _emails(text: bytes) -> list:
    out, low, at = [], 0, text.find(b"@")
    while at >= 0:
        first = at
        while first > low and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
            low = m.end()
        else:
            low = max(low, at)                 # no local part reaches back over an @
        at = text.find(b"@", max(low, at + 1))
    return out


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: bytes) -> list:
    """(kind, start, end) in bytes, by kind, then start."""
    out = [("email", a, z) for a, z in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub(b"", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub(b"", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def char_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code of each character (ASCII value; 1 for any other), and its first byte."""
    a = np.frombuffer(text, np.uint8)
    first = np.flatnonzero((a & 0xC0) != 0x80)
    return np.where(a[first] < 128, a[first], 1).astype(np.uint8), first


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows around every digit and @, in characters."""
    anchors = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    if not len(anchors):
        return anchors
    lows, highs = np.maximum(anchors - MARGIN, 0), np.minimum(anchors + MARGIN, len(codes))
    new = np.flatnonzero(np.concatenate([[True], lows[1:] > highs[:-1]]))
    begin, end = lows[new], highs[np.concatenate([new[1:], [len(highs)]]) - 1]
    return np.concatenate([np.arange(a, max(z - WINDOW, a) + STRIDE, STRIDE) for a, z in zip(begin, end)])


def windows(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes, np.zeros(WINDOW, np.uint8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags(n: int, spans: list) -> np.ndarray:
    """BIO tag of each of n characters: 0, or 1 + 2 * kind for the first and 2 + 2 * kind for the others."""
    out = np.zeros(n, np.uint8)
    for kind, a, z in spans:
        if not out[a:z].any():
            out[a:z] = 2 + 2 * KINDS.index(kind)
            out[a] -= 1
    return out


def reconcile(found: list, taken: list) -> list:
    """(kind, start, end, score) that stay: whole spans before cut ones, then the
    most certain, none overlapping another or one of ``taken`` (start, end)."""
    kept = sorted(taken)
    out = []
    starts = [a for a, _ in kept]
    for cut, score, kind, a, z in sorted(set(found), key=lambda s: (s[0], -s[1], s[3] - s[4], s[3], s[2])):
        i = bisect.bisect_left(starts, z)
        if cut or (i and kept[i - 1][1] > a):
            continue
        kept.insert(i, (a, z))
        starts.insert(i, a)
        out.append((kind, a, z, score))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def model_spans(codes: np.ndarray, model: BiLstmCrf) -> list:
    """(cut, score, kind, start, end) of every window, in characters."""
    starts = window_starts(codes)
    out = []
    for i in range(0, len(starts), _SPLIT):
        some = starts[i:i + _SPLIT]
        path, sure = model.decode(windows(codes, some))
        for row in np.flatnonzero(path.any(axis=1)):
            p, s, at = path[row], sure[row], int(some[row])
            j = 0
            while j < WINDOW:
                if p[j] == 0:
                    j += 1
                    continue
                kind = (int(p[j]) - 1) // 2
                k = j + 1
                while k < WINDOW and p[k] == 2 + 2 * kind:
                    k += 1
                cut = (j == 0 and at > 0) or (k == WINDOW and at + k < len(codes))
                out.append((cut, round(float(s[j:k].min()), 6), KINDS[kind], at + j, min(at + k, len(codes))))
                j = k
    return out


def find_in(text: bytes | None, model: BiLstmCrf | None, least: float = LEAST_SCORE) -> tuple[list, list]:
    """(base spans, added spans) of one text in code points; added ones carry a score."""
    if not text or not _ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    at = code_points(text, [p for s in base for p in s[1:]]) if base else {}
    base = [(k, at[a], at[z]) for k, a, z in base]
    if model is None:
        return base, []
    codes, _ = char_codes(text)
    held = [(c, s, k, a, z) for c, s, k, a, z in model_spans(codes, model) if s >= least
            and (((codes[a:z] >= 48) & (codes[a:z] <= 57)) | (codes[a:z] == 64)).any()]
    return base, reconcile(held, [(a, z) for _, a, z in base])


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """At most ``sample`` windows (codes, tags) of (doc_id, text) rows, least hash first."""
    def run(batches):
        for b in batches:
            code_rows, tag_rows = [], []
            for text in byte_rows(b.column("text")):
                if not text or not _ANCHOR.search(text):
                    continue
                codes, first = char_codes(text)
                labelled = [(k, int(np.searchsorted(first, a)), int(np.searchsorted(first, z))) for k, a, z in base_spans(text)]
                starts = window_starts(codes)
                code_rows += [w.tobytes() for w in windows(codes, starts)]
                tag_rows += [w.tobytes() for w in windows(tags(len(codes), labelled), starts)]
            for i in range(0, len(code_rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(code_rows[i:i + 1000], pa.binary()), pa.array(tag_rows[i:i + 1000], pa.binary())],
                                                 names=["codes", "tags"])

    rows = (docs.select("text").filter(F.col("text").rlike("[0-9@]")).mapInArrow(run, "codes binary, tags binary")
            .orderBy(F.xxhash64("codes", "tags"), "codes", "tags").limit(sample).collect())
    shape = (len(rows), WINDOW)
    return (np.frombuffer(b"".join(r["codes"] for r in rows), np.uint8).reshape(shape),
            np.frombuffer(b"".join(r["tags"] for r in rows), np.uint8).reshape(shape))


def fit(docs: DataFrame, sample: int = SAMPLE, steps: int = 320) -> BiLstmCrf | None:
    """A model trained from the base spans of (doc_id, text) rows; None without any."""
    codes, wanted = training_windows(docs, sample)
    if not wanted.any():
        return None
    return BiLstmCrf(1 + 2 * len(KINDS)).fit(codes, wanted, steps=steps)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: BiLstmCrf | None = None,
                 sample: int = SAMPLE, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, spans) for every row; a span has kind, start, end (code points), base, score."""
    held = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = model or fit(held, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                               ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            out = []
            for text in byte_rows(b.column("text")):
                base, added = find_in(text, shared.value, least)
                spans = [(k, a, z, True, 1.0) for k, a, z in base] + [(k, a, z, False, s) for k, a, z, s in added]
                out.append([dict(zip(("kind", "start", "end", "base", "score"), s))
                            for s in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return held.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>")
