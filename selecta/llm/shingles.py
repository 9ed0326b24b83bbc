"""Sets of distinct word shingles as sorted 64-bit hashes, shared by the operators on near copies."""

from __future__ import annotations

import numpy as np

from selecta.llm.common import U64, hashed_words, mix, window_hashes

SALT = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def shingle_sets(rows: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and their offsets."""
    h, offsets = hashed_words(rows, lower=True)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(rows)), sizes)
    if len(h) >= k:
        w = window_hashes(h, k)
        at = np.arange(len(w))
        whole = offsets[text[:len(w)] + 1] - at >= k
        owner, values = text[:len(w)][whole], w[whole]
    else:
        owner, values = np.empty(0, np.int64), np.empty(0, U64)
    for r in np.flatnonzero((sizes > 0) & (sizes < k)):
        owner = np.append(owner, r)
        values = np.append(values, window_hashes(h[offsets[r]:offsets[r + 1]], int(sizes[r])) ^ U64(sizes[r]))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]).astype(np.int64)


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[U64(0)], np.cumsum(values, dtype=U64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def prints(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each set; equal sets have equal prints."""
    return tuple(mix(_sum_by(mix(values ^ U64(s)), offsets)).view(np.int64) for s in SALT)
