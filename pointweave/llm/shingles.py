"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

from pointweave.llm.quality_rules import mixed

STEP = np.uint64(0x9E3779B97F4A7C15)
#: The bytes that part words: space, tab, newline, VT, FF, CR.
PARTS = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
#: Places in a word whose factors are kept; longer words have theirs worked out.
KEPT_PLACES = 4096


@functools.cache
def _kept_factors() -> np.ndarray:
    return mixed(np.arange(KEPT_PLACES, dtype=np.uint64))


def factors(places: np.ndarray) -> np.ndarray:
    """A random 64-bit factor for each place in a word."""
    return _kept_factors()[places] if not len(places) or places.max() < KEPT_PLACES else mixed(places.astype(np.uint64))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts on end, A-Z lowered, and how many words each text has.

    A word's hash is the sum of its bytes times the factors of their places, mixed with its length: all words of a batch
    at once, without a Python object for any of them.
    """
    texts = [t or b"" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    whole = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    inside = ~PARTS[whole]
    letters = np.flatnonzero(inside)
    if not len(letters):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(letters) > 1]))
    starts = letters[first]
    lengths = np.diff(np.append(first, len(letters)))
    with np.errstate(over="ignore"):
        parts = (whole[letters].astype(np.uint64) + np.uint64(1)) * factors(letters - np.repeat(starts, lengths))
        hashes = mixed(np.add.reduceat(parts, first) ^ lengths.astype(np.uint64) * STEP)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    return hashes, counts


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words."""
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            out = out * STEP + hashes[k : k + n]
        return mixed(out)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; a shorter text is one shingle, a text without words has none."""
    hashes, counts = word_hashes(texts)
    windows, out, at = rolled(hashes, width), [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(windows[at : at + n - width + 1]))
        else:
            out.append(rolled(hashes[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out
