"""Vectorised helpers on the bytes of an Arrow batch: words, hashes, tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: \x20 and \x09-\x0D end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if wide else pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` has about ``limit`` bytes in each part (a longer row stands alone)."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true within each row: starts, ends, and each row's offsets into them."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def stir(x: np.ndarray) -> np.ndarray:
    """A cheaper, non-linear step between the parts of a hash; :func:`mix` ends it."""
    with np.errstate(over="ignore"):
        return (x ^ (x >> U64(29))) * _BASE


def blocks8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number (zeros beyond the end), as a view of a copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run.

    Every block of 8 bytes is mixed with its place before the blocks are added,
    so no pattern of letters cancels out as it does in a polynomial modulo 2**64.
    """
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    at8 = blocks8(data)
    tail = U64(64) - ((np.minimum(lengths, 8).astype(U64)) << U64(3))
    with np.errstate(over="ignore"):
        first = np.where(lengths > 0, at8[starts] << tail, U64(0))
        total = stir(first + _STEP)
        long_ = np.flatnonzero(lengths > 8)
        if len(long_):
            n = (lengths[long_] - 1) // 8  # blocks after the first
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n) + 1
            from_ = np.repeat(starts[long_], n) + 8 * place
            left = np.minimum(np.repeat(ends[long_], n) - from_, 8).astype(U64)
            value = at8[from_] << (U64(64) - (left << U64(3)))
            total[long_] += np.add.reduceat(mix(value ^ mix(place.astype(U64) * _STEP)), begin)
        return mix(total + lengths.astype(U64) * U64(0xA24BAED4963EE407))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, and each row's offsets into them."""
    return runs(~SPACE[data], offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; entry i starts at word i.  Length is len(words) - k + 1, or 0.

    Hashes of twice as many words are made from two neighbours, each time through
    a non-linear step, and k words from the powers of two in k.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out, done, block, size, left = None, 0, words, 1, k
        while left:
            if left & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else stir(out * _STEP + part)
                done += size
            left >>= 1
            if left:
                block = stir(block[: len(block) - size] * _STEP + block[size:])
                size *= 2
        return mix(out + U64(k) * U64(0x9FB21C651E98DF25))


def row_grams(word_hashes: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams that stay inside their row: hashes, first words, and each row's offsets into them."""
    all_grams = gram_hashes(word_hashes, k)
    counts = np.maximum(np.diff(word_offsets) - k + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(word_offsets[:-1], counts)
    return all_grams[place] if len(place) else np.zeros(0, U64), place, offsets


class IntTable:
    """An immutable map from 64-bit keys to 32-bit values with vectorised look-up."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int = -1):
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.mask, self.shift, self.missing = (1 << bits) - 1, U64(64 - bits), missing
        self.keys = np.zeros(1 << bits, np.int64)
        self.values = np.full(1 << bits, missing, np.int32)
        self.used = np.zeros(1 << bits, bool)
        keys = np.asarray(keys).astype(np.int64, copy=False)
        left = np.arange(len(keys))
        at = self._at(keys)
        while len(left):
            free = ~self.used[at]
            _, winner = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[winner]
            self.used[at[put]], self.keys[at[put]], self.values[at[put]] = True, keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(U64) * _BASE) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys).astype(np.int64, copy=False)
        at = self._at(keys)
        out = np.where(self.keys[at] == keys, self.values[at], self.missing)
        open_ = np.flatnonzero(self.used[at] & (self.keys[at] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            hit = self.keys[at] == keys[open_]
            out[open_] = np.where(hit, self.values[at], self.missing)
            more = self.used[at] & ~hit
            open_, at = open_[more], at[more]
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
