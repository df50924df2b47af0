"""Words of whole texts as arrays: boundaries and 64-bit hashes of all words of an Arrow batch at once.

A word is a run of bytes other than blanks [\\x20\\x09-\\x0D]; A-Z count as a-z where asked for. Hashes
are sums of byte codes times powers of an odd number (mod 2**64), so that one running sum over the bytes
gives the hash of every word; a mixing step follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: For words(): 0 for blanks, 1 for all else; and with ASCII punctuation as a kind of its own.
WHOLE = (~BLANK).astype(np.uint8)
PARTED = WHOLE.copy()
PARTED[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_CODES = _CODES[LOWER]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for x in (_BASE, _INVERSE):
            p = np.full(size, np.uint64(x), np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each starts (and the last ends). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text, or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(lengths), 0
        while first < len(lengths):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """hashes, starts, ends (byte offsets into body) by word; doc_at: the words of text i are doc_at[i]:doc_at[i+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc_at: np.ndarray
    body: np.ndarray
    byte_at: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_at) - 1), np.diff(self.doc_at))

    def word(self, i: int) -> str:
        return self.body[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def words(texts: pa.Array, lower: bool = True, kinds: np.ndarray = WHOLE, chunk: int = CHUNK) -> Words:
    """All words of the texts: runs of bytes of one kind other than 0. chunk: so many bytes are looked at together; it changes no result."""
    body, byte_at = flat(texts)
    codes = _LOWER_CODES if lower else _CODES
    edges = np.unique(byte_at)
    hashes, starts, ends = [], [], []
    first, n = 0, len(body)
    while first < n:
        last = _cut(body, edges, first, min(n, first + chunk))
        part = body[first:last]
        full = np.zeros(len(part) + 2, np.uint8)
        kinds.take(part, mode="clip", out=full[1:-1])
        split = edges[np.searchsorted(edges, first, "right") : np.searchsorted(edges, last, "left")] - first
        change = full[1:] != full[:-1]
        change[split] = True
        begin = change[:-1] & (full[1:-1] > 0)
        end = change[1:] & (full[1:-1] > 0)
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        power, inverse = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes.take(part, mode="clip") * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s]))
        starts.append(s + first)
        ends.append(e + first)
        first = last
    none = np.zeros(0, np.int64)
    s = np.concatenate(starts) if starts else none
    return Words(np.concatenate(hashes) if hashes else none.astype(np.uint64), s, np.concatenate(ends) if ends else none, np.searchsorted(s, byte_at), body, byte_at)


def _cut(body: np.ndarray, edges: np.ndarray, first: int, last: int) -> int:
    """Where to end a chunk so that no word is divided: at a text's end or a blank, else after the long word."""
    if last == len(body):
        return last
    edge = edges[np.searchsorted(edges, last, "right") - 1]
    if edge > first:
        return int(edge)
    blank = np.flatnonzero(BLANK[body[first + 1 : last]])
    if len(blank):
        return first + 1 + int(blank[-1])
    after = int(edges[np.searchsorted(edges, last, "left")])
    blank = np.flatnonzero(BLANK[body[last:after]])
    return last + int(blank[0]) if len(blank) else after
