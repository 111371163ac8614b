"""Hashes of all words of a batch of texts, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: What separates words: ASCII white space, controls and punctuation. All else
#: (letters, digits, bytes beyond ASCII) belongs to a word.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, dtype=np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


@dataclass
class Batch:
    """``hashes[offsets[k]:offsets[k + 1]]`` are the words of text k, each at ``starts`` in ``raw`` bytes."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    raw: np.ndarray
    text_starts: np.ndarray


def hashed_words(texts: list[str | None], lower: bool = True) -> Batch:
    """64-bit hashes of the words (lower-cased) of each text; null is an empty text."""
    parts = [((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    text_starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    folded = _FOLD[raw]
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[1:] = folded != 0
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    up, down = _power(len(raw))
    total = np.cumsum(_BYTE[folded] * up, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    hashes = mix((total[ends - 1] - before) * down[starts])
    return Batch(hashes, np.searchsorted(starts, text_starts), starts, raw, text_starts)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * _BASE + words[k : k + len(out)])
    return out


def sliced(chunks: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what is made of each is let go before the next."""
    for batch in chunks:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches(texts: list[str | None], most: int = 1 << 18):
    """Slices of ``texts`` of about ``most`` characters each, one text at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
