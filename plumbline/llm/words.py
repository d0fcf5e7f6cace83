"""Word hashes of whole Arrow string columns with numpy, without a Python step per word.

Texts are UTF-8 bytes. A byte class table says which bytes belong to words; A-Z count as a-z. The hash of a word is a
polynomial over its bytes (prefix sums, modulo 2**64) put through a bit mixer. Work is done over runs of whole rows of
about ``RUN_BYTES``; a longer text is cut between words and put together again, so memory follows the longest text only
by 40 bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64

# Words are runs of anything but [\x20\x09-\x0D].
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
# Words are runs of letters, digits and bytes above ASCII.
LETTERS = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    LETTERS[_lo:_hi + 1] = True

# A sentence ends at . ! ? or a line's end.
STOPS = np.zeros(256, dtype=np.int64)
STOPS[[0x2E, 0x21, 0x3F, 0x0A]] = 1

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += U64(0x20)
_LOWER += U64(1)


@dataclass
class Words:
    """Words of the rows ``first`` to ``first + rows`` of a column: row within the run, hash, byte range in the row, sentence.

    ``sentence`` counts sentences that have words through the run; ``prefix`` has the hashes of the words' first bytes.
    """
    first: int
    rows: int
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    prefix: tuple[np.ndarray, ...]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64 finaliser) over uint64."""
    x = x.astype(np.uint64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    inverse = pow(BASE, -1, 1 << 64)
    done = 1
    while done < n:
        up[done:2 * done] = up[:done] * U64(pow(BASE, done, 1 << 64))
        down[done:2 * done] = down[:done] * U64(pow(inverse, done, 1 << 64))
        done *= 2
    return up, down


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _scan(b: np.ndarray, starts_of_rows: np.ndarray, ends_of_rows: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...]):
    """Start, end, stops before, hash and prefix hashes of the words in one run of bytes."""
    kind = inside[b]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = False, kind[:-1]
    after[-1], after[:-1] = False, kind[1:]
    before[starts_of_rows[starts_of_rows < len(b)]] = False
    after[ends_of_rows[ends_of_rows > 0] - 1] = False
    start, end = np.flatnonzero(kind & ~before), np.flatnonzero(kind & ~after) + 1
    up, down = _powers(max(int(len(b)).bit_length(), RUN_BYTES.bit_length()))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LOWER[b] * up[:len(b)], out=total[1:])
    at, scale = total[start], down[start]
    hashes = mix((total[end] - at) * scale)
    heads = tuple(mix((total[np.minimum(start + k, end)] - at) * scale + U64(k)) for k in prefixes)
    return start, end, np.cumsum(STOPS[b])[start], hashes, heads


def words(texts: pa.Array, inside: np.ndarray = SPACED, prefixes: tuple[int, ...] = (), run: int = RUN_BYTES) -> Iterator[Words]:
    """All words of a column, in runs of whole rows. Every row lies in exactly one run."""
    at, data = column_bytes(texts)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + run, side="right")) - 1)
        lo, hi = int(at[first]), int(at[last])
        if hi - lo <= 2 * run:
            parts = [(0, data[lo:hi])] if hi > lo else []
            rows_at = at[first:last + 1] - lo
        else:
            parts, rows_at = list(_cut(data[lo:hi], inside, run)), np.array([0, hi - lo])
        found = [(shift, *_scan(b, rows_at[:-1] if len(parts) == 1 else np.array([0]),
                                np.unique(rows_at[1:][rows_at[1:] > rows_at[:-1]]) if len(parts) == 1 else np.array([len(b)]), inside, prefixes))
                 for shift, b in parts]
        if found:
            start = np.concatenate([s + shift for shift, s, *_ in found])
            end = np.concatenate([e + shift for shift, _, e, *_ in found])
            stops = np.concatenate([x[3] + (int(STOPS[data[lo:lo + x[0]]].sum()) if x[0] else 0) for x in found])
            hashes = np.concatenate([h for *_, h, _ in found])
            heads = tuple(np.concatenate([x[-1][k] for x in found]) for k in range(len(prefixes)))
        else:
            start = end = stops = np.zeros(0, np.int64)
            hashes, heads = np.zeros(0, np.uint64), tuple(np.zeros(0, np.uint64) for _ in prefixes)
        row = np.searchsorted(rows_at, start, side="right") - 1
        new = np.ones(len(row), np.int64)
        new[1:] = (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])
        yield Words(first, last - first, row, hashes, start - rows_at[row], end - rows_at[row], np.cumsum(new) - 1, heads)
        first = last


def _cut(b: np.ndarray, inside: np.ndarray, run: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that end between words."""
    lo = 0
    while lo < len(b):
        hi = min(lo + run, len(b))
        while hi < len(b) and inside[b[hi - 1]]:
            gap = np.flatnonzero(~inside[b[hi:hi + run]])
            hi = hi + int(gap[0]) + 1 if len(gap) else min(hi + run, len(b))
        yield lo, b[lo:hi]
        lo = hi


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of ``k`` words of each row, end to end, and the rows' offsets in them.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    count = np.bincount(w.row, minlength=w.rows)
    at = np.concatenate([[0], np.cumsum(count)])
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | U64(1)
    out, sizes = [], np.zeros(w.rows + 1, np.int64)
    full = np.zeros(max(len(w.hash) - k + 1, 0), np.uint64)
    for j in range(k if len(full) else 0):
        full += w.hash[j:j + len(full)] * weights[j]
    full = mix(full)
    for r in range(w.rows):
        lo, hi = at[r], at[r + 1]
        if hi - lo >= k:
            mine = np.unique(full[lo:hi - k + 1])
        elif hi > lo:
            mine = mix(np.array([(w.hash[lo:hi] * weights[:hi - lo]).sum(dtype=np.uint64) + U64(hi - lo)], np.uint64))
        else:
            continue
        out.append(mine)
        sizes[r + 1] = len(mine)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)
