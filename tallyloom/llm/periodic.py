"""Periodic runs of words by maximal pairs from the LCP-interval tree.

A run of length L and period q is a maximal pair of occurrences q words apart: the
L - q words from its start on stand again q words later, and neither a word before
nor one after continues both.  So every maximal pair (place, distance d, length l) with
d <= l is a run as it stands, of length l + d, and nothing has to be extended.

The suffixes of all documents of a slice are sorted together by doubling, each with
its document, and the tree of their LCP intervals is climbed from the leaves.  An
interval keeps the places below it in order, with their classes by the word to the
left.  Where a child joins an interval, each place of the smaller side looks up its
neighbours on the larger: of all places there only these can be the next occurrence at
a smallest period (one in between would make a smaller one), and of neighbours those of
different classes are maximal pairs; two sides of one and the same class have none.

Before that, places are left out that can't belong to any run: a run of at least
``least`` words repeats grams of half as many words, at a distance not longer than the
stretch of such repeated grams around it.  In ordinary prose hardly any stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import hash_runs, mix, row_grams, slices, text_bytes, words_of
from .columns import set_aside

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Bytes of text handled at once.
SLICE = 1 << 20
#: The class of a place with no word to its left.
NO_WORD = np.uint64(0)


def likely_places(words: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Places whose gram stands in the same row again, no farther away than the stretch of such places allows."""
    hashes, place, upto = row_grams(words, at, gram)
    row = np.repeat(np.arange(len(at) - 1), np.diff(upto))
    with np.errstate(over="ignore"):
        hashes = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
    while True:
        n = len(place)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        gap = np.diff(place[order])
        far = np.iinfo(np.int64).max
        near = np.full(n, far)
        near[order[1:][same]] = gap[same]
        near[order[:-1][same]] = np.minimum(near[order[:-1][same]], gap[same])
        again = np.flatnonzero(near < far)
        # Stretches of such places without a gap; those of two rows never touch, as each row ends in places without a gram.
        begins = np.ones(len(again), bool)
        begins[1:] = np.diff(place[again]) > 1
        size = np.diff(np.append(np.flatnonzero(begins), len(again)))
        keep = again[near[again] <= np.repeat(size, size) + gram - 1]
        place, hashes = place[keep], hashes[keep]
        if len(keep) in (0, n):
            return place


class Suffixes:
    """The suffixes at some places, sorted, with the lengths that neighbours have in common.

    Doubling starts from the grams at these places and those that follow them, in
    the order of their words.  A place farther on that isn't among them can't belong to
    a run and counts as different from all.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, own: np.ndarray, gram: int):
        end = at[np.searchsorted(at, own, "right")]
        place = np.union1d(own, (own + gram)[own + gram < end])
        n = len(place)
        number = np.full(len(words) + 1, -1)  # each place's number; the last entry: none
        number[place] = np.arange(n)
        row = np.searchsorted(at, place, "right")
        padded = np.append(words, np.zeros(gram, np.uint64))
        grams = np.stack([np.where(place + i < at[row], padded[place + i], 0) for i in range(gram)])
        order = np.lexsort((*grams[::-1], row))
        rank = self._ranks(np.concatenate([grams, row[None].astype(np.uint64)])[:, order], order, np.arange(n))
        levels, step = [rank], gram  # equal at level i: equal in the first gram * 2**i words
        while True:
            left = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(left):
                break
            then = number[np.minimum(place[left] + step, len(words))]
            second = np.where(then >= 0, rank[then], n + left)
            order = np.lexsort((second, rank[left]))
            key = np.stack([rank[left], second])[:, order]
            rank = rank.copy()
            rank[left] = self._ranks(key, order, key[0] + np.arange(len(order)) - np.searchsorted(key[0], key[0]))
            levels.append(rank)
            step *= 2
        sorted_ = np.empty(n, np.int64)
        sorted_[rank] = place
        kept = np.zeros(len(words), bool)
        kept[own] = True
        self.places = sorted_[kept[sorted_]]
        self.common = self._common(words, at, number, levels, gram)

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray, position: np.ndarray) -> np.ndarray:
        """For sorted keys (columns): the position of the first of each group of equals, in the order before sorting."""
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        out = np.empty(key.shape[1], np.int64)
        out[order] = position[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return out

    def _common(self, words: np.ndarray, at: np.ndarray, number: np.ndarray, levels: list[np.ndarray], gram: int) -> np.ndarray:
        """Words that each suffix shares with the one before it in order (0 if not a gram); exact where they may be a run."""
        out = np.zeros(len(self.places), np.int64)
        x, y = self.places[1:].copy(), self.places[:-1].copy()
        end = at[np.searchsorted(at, x, "right")]
        last = len(number) - 1
        for i in reversed(range(len(levels))):
            a, b = number[np.minimum(x, last)], number[np.minimum(y, last)]
            equal = (a >= 0) & (b >= 0)
            equal[equal] = levels[i][a[equal]] == levels[i][b[equal]]
            more = np.where(equal, gram << i, 0)
            x, y, out[1:] = x + more, y + more, out[1:] + more
        open_ = np.flatnonzero(out[1:] > 0)
        for _ in range(gram - 1):
            open_ = open_[(x[open_] < end[open_]) & (y[open_] < end[open_])]
            open_ = open_[words[x[open_]] == words[y[open_]]]
            x[open_] += 1
            y[open_] += 1
            out[1 + open_] += 1
        return out


def climb(places: list[int], common: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Maximal pairs (place, distance, length) with distance <= length, from suffixes in order.

    ``left``: the class of each suffix's left word.  An interval is its length, its
    places in order, and the class of all of them (-1: of several).
    """
    found: list[tuple[int, int, int]] = []
    class_of = dict(zip(places, left))

    def join(one: list[int], one_class: int, other: list[int], other_class: int, length: int) -> tuple[list[int], int]:
        if len(one) < len(other):
            one, one_class, other, other_class = other, other_class, one, one_class
        if one_class != other_class or one_class == -1:
            for p in other:
                i = bisect_left(one, p)
                own = class_of[p]
                if i < len(one) and one[i] - p <= length and (class_of[one[i]] != own or not own):
                    found.append((p, one[i] - p, length))
                if i and p - one[i - 1] <= length and (class_of[one[i - 1]] != own or not own):
                    found.append((one[i - 1], p - one[i - 1], length))
            one_class = -1
        if len(other) < 8:
            for p in other:
                insort(one, p)
        else:
            one += other
            one.sort()
        return one, one_class

    open_: list[list] = []  # intervals not yet closed: length, places, class
    mine, my_class = [places[0]], left[0]
    for place, length, own in zip(places[1:], common[1:], left[1:]):
        while open_ and open_[-1][0] > length:
            above = open_.pop()
            mine, my_class = join(above[1], above[2], mine, my_class, above[0])
        if length:
            if open_ and open_[-1][0] == length:
                open_[-1][1:] = join(open_[-1][1], open_[-1][2], mine, my_class, length)
            else:
                open_.append([length, mine, my_class])
        mine, my_class = [place], own
    while open_:
        above = open_.pop()
        mine, my_class = join(above[1], above[2], mine, my_class, above[0])
    return found


def find_runs(words: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Rows of (row, start, length, period), in that order, of all runs in rows of word hashes (never 0); ``at``: where rows begin, and the end."""
    none = np.zeros((0, 4), np.int64)
    gram = -(-least // 2)
    place = likely_places(words, at, gram)
    if not len(place):
        return none
    suffixes = Suffixes(words, at, place, gram)
    places, common = suffixes.places, suffixes.common
    row = np.searchsorted(at, places, "right") - 1
    left = np.where(places > at[row], words[np.maximum(places - 1, 0)], NO_WORD).astype(np.uint64)
    # Pairs of two suffixes alone need no climbing.
    alone = common > 0
    first = alone & ~np.append(False, alone[:-1]) & ~np.append(alone[1:], False)
    pair = np.flatnonzero(first)
    a, b = np.minimum(places[pair], places[pair - 1]), np.maximum(places[pair], places[pair - 1])
    fits = (b - a <= common[pair]) & ((left[pair] != left[pair - 1]) | (left[pair] == NO_WORD))
    found = [np.stack([a, b - a, common[pair]], axis=1)[fits]]
    rest = ~first & ~np.append(first[1:], False)
    if rest.any():
        classes = np.where(left[rest] == NO_WORD, 0, np.unique(left[rest], return_inverse=True)[1] + 1)
        pairs = climb(places[rest].tolist(), common[rest].tolist(), classes.tolist())
        found.append(np.array(pairs, np.int64).reshape(-1, 3))
    start, period, shared = np.concatenate(found).T
    length = shared + period
    fits = length >= least
    start, period, length = start[fits], period[fits], length[fits]
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    # Multiples of the smallest period give the same stretch.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, period, length = start[new], period[new], length[new]
    row = np.searchsorted(at, start, "right") - 1
    out = np.stack([row, start - at[row], length, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def collapse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Each row's words, but those in a run after its first period, joined by single spaces (binary column)."""
    n = len(starts)
    change = np.zeros(n + 1, np.int64)
    base = at[runs[:, 0]] + runs[:, 1]
    np.add.at(change, base + runs[:, 3], 1)
    np.add.at(change, base + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    # Every word with a space after it, but for a row's last one.
    size = ends[kept] - starts[kept] + 1
    cuts = np.concatenate([[0], np.cumsum(size)])
    padded = np.append(data, np.uint8(0x20))
    source = np.repeat(starts[kept] - cuts[:-1], size) + np.arange(cuts[-1])
    text = padded[source]
    text[cuts[1:] - 1] = 0x20
    bounds = cuts[np.searchsorted(kept, at)]
    filled = np.flatnonzero(np.diff(bounds))
    text = np.delete(text, bounds[1:][filled] - 1)
    drop = np.zeros(len(bounds), np.int64)
    drop[1:] = np.cumsum(np.diff(bounds) > 0)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((bounds - drop).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs`` with runs, array<struct<start, length, period>> in the order of start and period, and collapsed, the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of consecutive
    words with smallest period q and length >= max(least, 2 * q) that no neighbouring
    word continues.  ``collapsed`` holds the words that no run contains after its first
    q words, joined by single spaces.

    Null, empty and wordless texts have no runs and collapse to an empty text.  Repeated
    rows get a row each, an empty table gives none; other columns stay, and one
    with the name of a new one gives way to it.  Words are told apart by 64-bit hashes.
    """
    own, back = set_aside(docs, ["text"])
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_bytes(part.column("text"))
                starts, ends, at = words_of(data, offsets)
                runs = find_runs(np.maximum(hash_runs(data, starts, ends), np.uint64(1)), at, least)
                cuts = pa.array(np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)), pa.int32())
                fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, i])) for i in (1, 2, 3)], fields=list(RUN))
                columns = [*part.columns, pa.ListArray.from_arrays(cuts, fields), collapse(data, starts, ends, at, runs).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "runs", "collapsed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return back(own.mapInArrow(run, f"{schema}, runs array<struct<start:long,length:long,period:long>>, collapsed string"), "runs", "collapsed")
