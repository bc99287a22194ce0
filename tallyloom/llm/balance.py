"""Packing tokenised documents into near-equal windows by multiway differencing.

Karmarkar-Karp for many ways: every item starts as a partition of its own, with all
windows but one empty.  The two partitions whose windows differ most are merged, the
fullest window of one with the emptiest of the other, so that their imbalances
oppose each other, and what all windows of the merged one have in common is taken
off.  The last partition left has windows of nearly the same length.  The number of
windows is the least that the tokens need; it rises whenever a window exceeds its
capacity.

Rows are dealt into blocks of about ``WINDOWS`` windows by their number, and each
block is balanced in a task of its own, so no task and no driver sees more than a
block, whatever the size of the table.  Near-equal windows are then made full ones
(:func:`filled`): the last window or two of a block are dissolved, their tokens fill
the few places left in the others, and what is still left lies in sequences whose
lengths are powers of two.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .scratch import Scratch
from .wordbpe import load_words

#: Windows and items of a block, about; bytes of text encoded at once.
WINDOWS, ITEMS, SLICE = 256, 10_000, 2 << 20
PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
PACKED = f"{PIECE}, sequence_id long, offset long"


def differenced(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, from largest differencing into ``windows`` ways.

    A partition holds its windows, fullest first: sums (less what they had in common),
    and the first and last item of each window's chain.  Empty windows aren't stored.
    """
    n = len(lengths)
    after = np.full(n, -1)
    one = np.arange(n)
    parts = {i: (lengths[i : i + 1], one[i : i + 1], one[i : i + 1]) for i in range(n)}
    heap = [(-int(x), i) for i, x in enumerate(lengths)] if windows > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    new = n
    while len(heap) > 1:
        (a_sums, a_first, a_last), (b_sums, b_first, b_last) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        # b's fullest windows take a's empty ones; where there are too few of those, b's emptiest meet a's emptiest.
        meet = max(0, len(a_sums) + len(b_sums) - windows)
        alone, moved = len(a_sums) - meet, len(b_sums) - meet
        met = slice(moved, None)
        after[a_last[alone:]] = b_first[met][::-1]
        sums = np.concatenate([a_sums[:alone], a_sums[alone:] + b_sums[met][::-1], b_sums[:moved]])
        first = np.concatenate([a_first, b_first[:moved]])
        last = np.concatenate([a_last[:alone], b_last[met][::-1], b_last[:moved]])
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        parts[new] = sums, first[order], last[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == windows else 0)), new))
        new += 1
    window = np.zeros(n, np.int64)
    if heap:
        at, name = parts[heap[0][1]][1], np.arange(len(parts[heap[0][1]][1]))
        while len(at):
            window[at] = name
            at = after[at]
            at, name = at[at >= 0], name[at >= 0]
    return window


def balanced(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item (lengths 1 to ``capacity``) and each window's length; none above ``capacity``."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differenced(lengths, windows)
        sums = np.bincount(window, lengths, windows).astype(np.int64)
        if sums.max() <= capacity:
            return window, sums
        windows += 1


def filled(lengths: np.ndarray, window: np.ndarray, sums: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Pieces (item, begin within it, length, sequence, offset) that lie in full sequences or in ones as long as a power of two.

    The fullest windows stay whole.  The others are dissolved: their items, end to
    end, are cut to fill what is left in those that stay, then to powers of two.
    """
    total = int(lengths.sum())
    ranked = np.empty(len(sums), np.int64)
    ranked[np.argsort(-sums, kind="stable")] = np.arange(len(sums))
    sequence, stay = ranked[window], total // capacity
    whole = np.flatnonzero(sequence < stay)
    whole = whole[np.argsort(sequence[whole], kind="stable")]
    before = np.cumsum(lengths[whole]) - lengths[whole]
    offset = before - before[np.searchsorted(sequence[whole], sequence[whole])]
    used = np.bincount(sequence[whole], lengths[whole], stay).astype(np.int64)
    rest = np.flatnonzero(sequence >= stay)
    # What the dissolved items are cut to, one place after another.
    left = total % capacity
    powers = [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
    room = np.concatenate([capacity - used, np.array(powers, np.int64)])
    item_end, room_end = np.cumsum(lengths[rest]), np.cumsum(room)
    cuts = np.unique(np.concatenate([[0], item_end, room_end]))
    begin, size = cuts[:-1], np.diff(cuts)
    item, place = np.searchsorted(item_end, begin, "right"), np.searchsorted(room_end, begin, "right")
    inside = begin - (item_end - lengths[rest])[item]
    at = begin - (room_end - room)[place] + np.concatenate([used, np.zeros(len(powers), np.int64)])[place]
    return tuple(np.concatenate(x) for x in ((whole, rest[item]), (np.zeros(len(whole), np.int64), inside), (lengths[whole], size), (sequence[whole], place), (offset, at)))


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids and then ``end_id``, cut after every ``capacity`` tokens: PIECE, ids as little-endian numbers of 2 bytes (4 for a large vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_words(path)
        width = id_bytes(max(encoder.largest, end_id))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = encoder.encode(part.column("text"))
                flat = np.insert(ids, at[1:], end_id).astype(f"<u{width}")
                at = at + np.arange(len(at))
                total = np.diff(at)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, total[row] - start)
                columns = [part.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, total[row]))]
                yield pa.RecordBatch.from_arrays([*columns, _blobs(flat, width, length)], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def id_bytes(largest: int) -> int:
    return 2 if largest < 1 << 16 else 4


def _blobs(flat: np.ndarray, width: int, lengths: np.ndarray) -> pa.Array:
    """Stretches of ids that lie end to end, as a binary column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * width
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _wide(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return _blobs(ids.astype("<u4"), 4, lengths)


def pack_block(rows: pa.Table, capacity: int, fill: bool) -> pa.Table:
    """One block's pieces with their places: PACKED.  Any order of the rows gives the same result."""
    rows = rows.sort_by("row").combine_chunks()
    lengths = rows["length"].to_numpy()
    flat, at = _ids(rows["ids"], lengths)
    window, sums = balanced(lengths, capacity)
    if fill:
        item, begin, size, sequence, offset = filled(lengths, window, sums, capacity)
    else:
        item = np.argsort(window, kind="stable")
        begin, size, sequence = np.zeros(len(item), np.int64), lengths[item], window[item]
        before = np.cumsum(size) - size
        offset = before - before[np.searchsorted(sequence, sequence)]
    take = np.repeat(at[item] + begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    named = rows["block"][0].as_py() << 32
    columns = [rows["doc_id"].take(pa.array(item)), pa.array(rows["start"].to_numpy()[item] + begin), pa.array(size), rows["doc_tokens"].take(pa.array(item))]
    columns += [_wide(flat[take], size), pa.array(named + sequence), pa.array(offset)]
    return pa.Table.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])


def _ids(column: pa.Array | pa.ChunkedArray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, one row after another, and where each row begins."""
    blob = b"".join(column.to_pylist())
    total = int(lengths.sum())
    return np.frombuffer(blob, f"<u{len(blob) // total}"), np.cumsum(lengths) - lengths


def pack_balanced(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, fill: bool = True) -> DataFrame:
    """Tokenise and pack all documents: a row for each piece, with its ids and its place.

    doc_id, start (its document's ids before it), length, doc_tokens (with ``end_id``),
    ids (binary, little-endian numbers of 4 bytes), sequence_id, offset (gapless from
    0 in each sequence).  A document is cut after every ``capacity`` ids; what is left of
    it goes into a block of near-equal windows.  With ``fill`` no sequence needs padding:
    each is full or as long as a power of two, and less than two windows of each
    block are cut for it; without, nothing else is cut and windows stay near-equal.

    A null or empty text is ``end_id`` alone.  Rows with the same doc_id, repeated
    rows and rows without an id are separate documents; other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "balance")
    # Numbered as they are written: blocks hold the same rows whenever they are read, and equal rows differ.
    pieces = token_pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    pieces = scratch.save(pieces, "pieces")

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat, _ = _ids(batch.column("ids"), lengths := batch.column("length").to_numpy())
                sequence, zero = -1 - batch.column("row").to_numpy(), np.zeros(batch.num_rows, np.int64)
                columns = [*(batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens")), _wide(flat, lengths), pa.array(sequence), pa.array(zero)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"])

    full = pieces.where(F.col("length") == capacity).mapInArrow(widen, PACKED)
    rest = pieces.where(F.col("length") < capacity)
    seen = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    blocks = max(1, -(-seen["tokens"] // (WINDOWS * capacity)), -(-seen["n"] // ITEMS))
    blocked = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    balanced_ = blocked.groupBy("block").applyInArrow(lambda rows: pack_block(rows, capacity, fill), PACKED)
    return full.union(balanced_)
