"""Arrow batches as byte arrays: words, rolling hashes and word windows, all as array operations.

Helpers run inside ``mapInArrow``; a batch is worked on in slices of about ``SLICE`` bytes, so the
memory of a task follows its longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes from which a word is hashed by itself.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


BYTE_VALUES = constants(256, 11)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + (SLICE >> 2))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base & _MASK, dtype=np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any span of ``data``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) of ``data``.

    Spans' hashes are polynomials modulo 2**64, whose values agree for certain pairs of 1,024 letters
    and more whatever the base; words of ``LONG`` bytes and more, which are rare, are hashed one by
    one instead.
    """
    out = span_hash(prefix_hash(data), start, end)
    for i in np.flatnonzero(end - start >= LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i]: end[i]].tobytes())
    return out


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a text column; null is empty."""
    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        cut = offsets[first: last + 1]
        yield first, last, data[cut[0]: cut[-1]], cut - cut[0]
        first = last


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal word runs; a run ends where its row ends."""
    n = len(is_word)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], is_word[:-1]))
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.concatenate((is_word[1:], [False]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word: a maximal run of other bytes than white space, A-Z lowered."""
    data = LOWER[data]
    starts, ends, rows = word_spans(~SPACE[data], offsets)
    return word_hash(data, starts, ends), rows


def windows(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets by row) of all windows of ``k`` words; a row with fewer words, but at least
    one, has its whole sequence as its only window."""
    factors = constants(k, 23)
    counts = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(counts)))
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(n)))
    if not len(words):
        return np.zeros(0, dtype=np.uint64), offsets
    at = np.repeat(begin[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, k), n)
    out = length.astype(np.uint64) * np.uint64(BASE)
    last = len(words) - 1
    for j in range(k):
        term = words[np.minimum(at + j, last)] * factors[j]
        out += np.where(j < length, term, np.uint64(0))
    return mix(out), offsets
