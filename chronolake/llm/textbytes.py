"""Vectorised word work on Arrow text: chunks of bounded bytes, word bounds, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # what numpy works on stays in the cache
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = True
WORD[128:] = True
LOWER_WORD = np.where(WORD, LOWER, 0).astype(np.uint8)  # folded bytes of words, 0 elsewhere

_POWERS: dict[str, np.ndarray] = {}


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text: slice, its bytes, row offsets. Null text: no bytes."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        stop = min(stop, n)
        yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    have = len(_POWERS.get("up", ()))
    if have < n:
        n = max(n, 2 * have, 1 << 16)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(n, BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row of each word. Words do not cross rows. No ``is_word``: words are what is not 0."""
    inside = data != 0 if is_word is None else is_word[data]
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data):
        at = np.concatenate([np.zeros(int(inside[0]), np.int64), at, np.full(int(inside[-1]), len(data))])
    cut = np.unique(offsets[1:-1])  # empty rows share a bound
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut - 1]]
    if len(both):
        at = np.sort(np.concatenate([at, both, both]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    first = np.searchsorted(starts, offsets)
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands; no byte of a word is 0."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    if len(_POWERS.get("sums", ())) <= n:
        # kept between chunks, unless one is far larger than most
        _POWERS["parts"], _POWERS["sums"] = np.empty(n, np.uint64), np.zeros(n + 1, np.uint64)
    parts, total = _POWERS["parts"][:n], _POWERS["sums"][: n + 1]
    np.multiply(data, up[:n], out=parts)
    np.cumsum(parts, out=total[1:])
    found = mix((total[ends] - total[starts]) * down[starts])
    if n > 8 * CHUNK:
        for name in ("parts", "sums", "up", "down"):
            _POWERS.pop(name, None)
    return found


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside a row, their rows and first words.

    A row with 1 to k-1 words gives its whole sequence as one shingle; none gives none.
    """
    n = len(words)
    count = np.bincount(rows, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    first = np.cumsum(count) - count
    out = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if n >= k:
        out = np.full(n - k + 1, np.uint64(k))
        for j in range(k):
            out = (out ^ words[j : n - k + 1 + j]) * BASE
        at = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
        out = mix(out[at])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = []
        for r in short:
            h = np.uint64(count[r])
            with np.errstate(over="ignore"):
                for w in words[first[r] : first[r] + count[r]]:
                    h = (h ^ w) * BASE
            extra.append(h)
        out = np.concatenate([out, mix(np.array(extra, np.uint64))])
        at = np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, rows[at] if len(at) else at, at
