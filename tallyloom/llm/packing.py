"""Best-fit-decreasing packing of tokenised documents into sequences.

Items of one length are interchangeable, so the plan needs only how many items
there are of each length: at most ``capacity`` numbers however large the corpus.
Best-fit decreasing then runs over those counts.  Open bins are kept by
remaining capacity in a segment tree whose leaves are the capacities, so the
tightest bin that fits is found in O(log capacity); a run of equal items goes
into a run of equal bins in one step (a *slab*).  Each item finds its slab from
its length and its rank among the items of that length, which Spark counts
block by block, so no length, however common, is gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices, text_bytes
from .bpe import SLICE, load
from .columns import set_aside
from .scratch import Scratch


class RoomTree:
    """Segment tree over remaining capacities 0..size; a leaf is set while some open bin has that room."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)

    def set(self, room: int, present: bool) -> None:
        at = room + self.width
        self.any[at] = present
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The smallest room of at least ``need`` that some bin has, or -1."""
        at = need + self.width
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at + (0 if self.any[2 * at] else 1)
                return at - self.width
            at >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts by length.

    Returns slabs (length, first_rank, items_per_bin, first_bin, offset): item
    ``r`` of a length, in the slab with the largest first_rank <= r, lies in bin
    ``first_bin + (r - first_rank) // items_per_bin`` at ``offset`` plus
    ``(r - first_rank) % items_per_bin`` lengths.  Same bins as placing items
    one by one, ties among equally tight bins going to the earliest opened run.
    """
    tree, open_bins = RoomTree(capacity), defaultdict(list)  # room -> [(first_bin, bins)]
    slabs, bins = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_bins[room]:
                tree.set(room, True)
            open_bins[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                first, n, room = bins, -(-left // each), capacity
                bins += n
            else:
                first, n = open_bins[room].pop(0)
                if not open_bins[room]:
                    tree.set(room, False)
                each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            slabs.append((length, rank, each, first, capacity - room))
            used = full * each + rest
            rank, left = rank + used, left - used
            add(room - each * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
                full += 1
            if room < capacity:
                add(room, first + full, n - full)
    return slabs


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then ``end_id`` (null or empty text: end_id alone);
    one longer than ``capacity`` is cut so that only the first piece may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = bpe.encode(*text_bytes(part.column("text")))
                rows = len(at) - 1
                flat = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(rows + 1)
                total = np.diff(at)
                n = -(-total // capacity)
                row = np.repeat(np.arange(rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = total - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                view, begin = memoryview(flat).cast("B"), at[row] + start
                crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist())]
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, block_rows: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    Any columns may accompany; those named sequence_id or offset give way.  Rows
    that repeat are packed each.  An empty table stays empty.  Rows are numbered as
    they are written, so equal ones differ; ``block_rows``: about how many have their
    ranks counted together.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    own, back = set_aside(pieces, ["length"])
    pieces = scratch.save(own.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))
    blocked = pieces.withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(blocks)))
    sizes = blocked.groupBy("length", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    counts = {r["length"]: r["n"] for r in blocked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slabs = defaultdict(lambda: ([], []))
    for length, first_rank, each, first_bin, offset in plan(counts, capacity):
        slabs[length][0].append(first_rank)
        slabs[length][1].append((first_rank, each, first_bin, offset))
    names = pieces.columns
    shared = pieces.sparkSession.sparkContext.broadcast(dict(slabs))  # by length; bounded by capacity, not by rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("__rank").to_pylist()):
                ranks, found = shared.value[length]
                first_rank, each, first_bin, offset = found[bisect_right(ranks, rank) - 1]
                bins.append(first_bin + (rank - first_rank) // each)
                offsets.append(offset + (rank - first_rank) % each * length)
            columns = [batch.column(c) for c in names] + [pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    within = Window.partitionBy("length", "__block").orderBy("__row")
    ranked = blocked.withColumn("__in", F.row_number().over(within)).join(starts, ["length", "__block"])
    ranked = ranked.select(*names, (F.col("__before") + F.col("__in") - 1).alias("__rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return back(ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long"), "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise, cut and pack all documents: one row for each piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or empty
    text is ``end_id`` alone.  Rows with the same doc_id, or with none, are separate
    documents; other columns are ignored; an empty table gives no rows.
    """
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
