"""Operator 13: fill-in-middle transformation over seekable compressed frames.

A text is cut into units (a run of ASCII letters, or any other single code point). It is stored as
independent zstandard frames, each with the units and code points that begin before it. A
cut "after u units" is found by a search in these counts, and only the frame that
holds it is decompressed. Outputs are streamed from the frames in their new order, and are stored
as frames themselves, so that digests and the rebuilt text read one frame at a time.

Where a run of letters passes a frame's border, the frame notes that it begins inside a unit, so
frames have a fixed size whatever the text holds.

Form: ``plain`` (the text as it is) for an empty text, a text that holds a marker, and a share of the others;
otherwise ``spm`` or ``psm``. Shares and cuts come from a hash of the seed and the id.

Plan: row-local, no shuffle. The frame table is written to the shared folder; a lost executor reads it again.

Defined results: null text counts as empty. A null id is hashed as the empty string. Repeated rows of one id give
equal rows if their texts are equal. Extra columns of the input are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import byte_rows, stage, texts

#: Bytes of text in a frame, and zstandard's level.
FRAME = 1 << 14
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of texts that stay plain, and of the others that put the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1

FRAMES = ("doc_id long, frames array<binary>, units array<long>, chars array<long>, inside array<boolean>, "
          "n long, n_chars long, marked boolean")
OUTPUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(part: bytes, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(unit starts, code point starts) among the bytes of ``part``; ``inside``: a letter came before it."""
    a = np.frombuffer(part, np.uint8)
    letter = _LETTER[a]
    lead = (a & 0xC0) != 0x80
    start = lead.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    if inside and len(a):
        start[0] &= not letter[0]
    return start, lead


def borders(text: bytes, size: int) -> list:
    """Frame ends: every ``size`` bytes, moved on to the next code point."""
    ends, at = [], 0
    while at < len(text):
        at = min(at + size, len(text))
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        ends.append(at)
    return ends


class Store:
    """One stored text: frames, and what begins before each of them."""

    def __init__(self, frames, units, chars, inside, n, n_chars):
        self.frames, self.units, self.chars, self.inside = frames, units, chars, inside
        self.n, self.n_chars = n, n_chars
        self.unpack = zstandard.ZstdDecompressor().decompress

    @classmethod
    def of(cls, text: bytes, size: int, pack) -> Store:
        frames, units, chars, inside, n, n_chars, at = [], [], [], [], 0, 0, 0
        for end in borders(text, size):
            part = text[at:end]
            run = at > 0 and bool(_LETTER[text[at - 1]])
            start, lead = unit_starts(part, run)
            frames.append(pack(part))
            units.append(n)
            chars.append(n_chars)
            inside.append(run)
            n += int(start.sum())
            n_chars += int(lead.sum())
            at = end
        return cls(frames, units, chars, inside, n, n_chars)

    def seek(self, u: int) -> tuple[int, int, int]:
        """(frame, byte in the frame, code points before) of the end of the first ``u`` units."""
        if u >= self.n:
            return len(self.frames), 0, self.n_chars
        f = int(np.searchsorted(self.units, u, side="right")) - 1
        start, lead = unit_starts(self.unpack(self.frames[f]), self.inside[f])
        byte = int(np.flatnonzero(start)[u - self.units[f]])
        return f, byte, self.chars[f] + int(lead[:byte].sum())

    def read(self, a: tuple, b: tuple):
        """The bytes from place ``a`` to place ``b`` (frame, byte), frame by frame."""
        for f in range(a[0], min(b[0] + 1, len(self.frames))):
            if f == b[0] and not b[1]:
                break
            part = self.unpack(self.frames[f])
            yield part[a[1] if f == a[0] else 0:b[1] if f == b[0] else len(part)]


def packed(parts, size: int, pack) -> list:
    """Frames of exactly ``size`` bytes each (but the last) of a stream of bytes."""
    out, held = [], bytearray()
    for part in parts:
        held += part
        while len(held) >= size:
            out.append(pack(bytes(held[:size])))
            del held[:size]
    if held:
        out.append(pack(bytes(held)))
    return out


def choices(doc_id, seed: int) -> list:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def form_of(h: list, n: int, marked: bool, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> str:
    if not n or marked or h[2] % 100 >= plain_from:
        return "plain"
    return "spm" if h[3] % 100 < spm_below else "psm"


def arranged(store: Store, form: str, first: tuple, second: tuple):
    """The output as a stream of bytes; ``first`` and ``second`` are the places of the cuts."""
    begin, end = (0, 0), (len(store.frames), 0)
    prefix, middle, suffix = (begin, first[:2]), (first[:2], second[:2]), (second[:2], end)
    if form == "plain":
        order = [(b"", (begin, end))]
    elif form == "psm":
        order = [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)]
    else:
        order = [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)]
    for marker, (a, b) in order:
        if marker:
            yield marker
        yield from store.read(a, b)


class Output:
    """An output as frames of ``size`` bytes, read by byte ranges."""

    def __init__(self, frames: list, size: int):
        self.frames, self.size = frames, size
        self.unpack = zstandard.ZstdDecompressor().decompress

    def parts(self):
        return (self.unpack(f) for f in self.frames)

    def find(self, marker: bytes, start: int) -> int:
        """Offset of the first ``marker`` at or after ``start``."""
        tail, base = b"", 0
        for f in range(start // self.size, len(self.frames)):
            part = self.unpack(self.frames[f])
            base = f * self.size - len(tail)
            at = (tail + part).find(marker, max(0, start - base))
            if at >= 0:
                return base + at
            tail = (tail + part)[-(len(marker) - 1):]
        raise ValueError("the output lacks a marker")

    def read(self, a: int, b: int | None):
        """The bytes a to b (None: the end)."""
        last = len(self.frames) if b is None else -(-b // self.size)
        for f in range(a // self.size, last):
            part, base = self.unpack(self.frames[f]), f * self.size
            yield part[max(0, a - base):len(part) if b is None else b - base]

    def restored(self, form: str):
        """The text as a stream of bytes, from the output and its form alone.

        A text with a marker in it is always plain, and no marker can arise over the border of
        another, so the first marker found is the one that was put there."""
        if form == "plain":
            yield from self.parts()
            return
        second, w = (SUFFIX if form == "psm" else PREFIX), len(PREFIX)
        one = self.find(second, w)
        two = self.find(MIDDLE, one + w)
        left, right, middle = (w, one), (one + w, two), (two + w, None)
        for a, b in ((left, middle, right) if form == "psm" else (right, middle, left)):
            yield from self.read(a, b)


def frame_table(docs: DataFrame, size: int = FRAME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as frames (``FRAMES``), one row per input row."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            rows = [t or b"" for t in byte_rows(b.column("text"))]
            stores = [Store.of(t, size, pack) for t in rows]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([s.frames for s in stores], pa.list_(pa.binary())),
                pa.array([s.units for s in stores], pa.list_(pa.int64())), pa.array([s.chars for s in stores], pa.list_(pa.int64())),
                pa.array([s.inside for s in stores], pa.list_(pa.bool_())), pa.array([s.n for s in stores], pa.int64()),
                pa.array([s.n_chars for s in stores], pa.int64()), pa.array([any(m in t for m in MARKERS) for t in rows], pa.bool_())],
                names=["doc_id", "frames", "units", "chars", "inside", "n", "n_chars", "marked"])

    held = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return held.mapInArrow(run, FRAMES)


def fill_in_middle(table: DataFrame, seed: int = SEED, size: int = FRAME, plain_from: int = PLAIN_FROM,
                   spm_below: int = SPM_BELOW) -> DataFrame:
    """Transformed texts (``OUTPUTS``) of a frame table; ``output`` holds frames of ``size`` bytes."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            out = {name: [] for name in ("form", "prefix_chars", "middle_chars", "output")}
            cols = b.select(["frames", "units", "chars", "inside", "n", "n_chars", "marked"]).to_pylist()
            for doc_id, row in zip(b.column("doc_id").to_pylist(), cols):
                marked = row.pop("marked")
                store, h = Store(**row), choices(doc_id, seed)
                form = form_of(h, store.n, marked, plain_from, spm_below)
                first = second = (0, 0, None)
                if form != "plain":
                    first, second = (store.seek(u) for u in sorted(x % (store.n + 1) for x in h[:2]))
                out["form"].append(form)
                out["prefix_chars"].append(first[2])
                out["middle_chars"].append(None if form == "plain" else second[2] - first[2])
                out["output"].append(packed(arranged(store, form, first, second), size, pack))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("n"), pa.array(out["form"], pa.string()), pa.array(out["prefix_chars"], pa.int64()),
                pa.array(out["middle_chars"], pa.int64()), pa.array(out["output"], pa.list_(pa.binary()))],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return table.mapInArrow(run, OUTPUTS)


def _with_streams(outputs: DataFrame, size: int, made: dict) -> DataFrame:
    """The columns of ``outputs`` but ``output``, and for each name of ``made`` a string made of (Output, form)."""
    kept = [f for f in outputs.schema.fields if f.name != "output"]
    names = [*[f.name for f in kept], *made]

    def run(batches):
        for b in batches:
            rows = [(Output(frames, size), form) for frames, form in zip(b.column("output").to_pylist(), b.column("form").to_pylist())]
            new = [pa.array([fn(o, form) for o, form in rows], pa.string()) for fn in made.values()]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *new], names=names)

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], *[f"{name} string" for name in made]])
    return outputs.mapInArrow(run, schema)


def _digest(parts) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(part)
    return h.hexdigest()


def output_texts(outputs: DataFrame, size: int = FRAME) -> DataFrame:
    """Outputs with ``text`` (what a model trains on) in place of the frames."""
    return _with_streams(outputs, size, {"text": lambda o, form: b"".join(o.parts()).decode()})


def digests(outputs: DataFrame, size: int = FRAME) -> DataFrame:
    """Outputs with the digests of output and rebuilt text in place of the frames."""
    return _with_streams(outputs, size, {"output_sha256": lambda o, form: _digest(o.parts()),
                                         "restored_sha256": lambda o, form: _digest(o.restored(form))})


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`fill_in_middle` of all rows of ``docs``, over a written frame table."""
    return fill_in_middle(stage(frame_table(docs, FRAME, id_col, text_col), "frames"))
