"""Near-duplicate vectors through an inverted multi-index.

The halves of the unit vectors get codebooks of their own; a vector lies in one
cell of the product grid.  From a vector, cells are visited in order of how much
farther their two centroids are than the nearest ones (multi-sequence traversal:
both halves' sorted lists are walked together).  How far to go is fitted: pairs made
from sampled vectors at exactly the threshold cosine tell how deep the partner's
cell lies, and traversal ends where the share ``target`` of them is reached; closer
pairs lie less deep.  Of two vectors in different cells, the one in the cell with
the smaller number looks for the other, so a pair meets once.

Cells lie in tiles of the grid, by blocks of codes that are near each other, and a
vector travels once to each tile that it visits, with the list of its cells there, as
a code of two bytes a component and the norm of what the code leaves out.  The codes
tell the cosine within a certain bound, which decides nearly every pair met in a
visited cell; a block returns counts and a spanning forest of these links, never pairs.
Only pairs within the bound of the threshold fetch their vectors, and are verified in
double precision.

Equal vectors of a label are one class, a numbered node; a repeated row (same id,
label and vector) counts once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .samples import part_of, share
from .scratch import Scratch
from .vectors import matrix, usable

#: Vectors in one block of a comparison, vectors that codebooks are fitted on, pairs that the depth is fitted on.
BLOCK, SAMPLE, PAIRS = 2000, 10_000, 10_000
#: Vectors of the largest label in a tile, about.
TILE = 2000
#: Codes of a half for n vectors: GROWTH times the fourth root of n, so cells grow as the root; at most MOST_CODES.
GROWTH, MOST_CODES = 2.5, 1024


def fit_codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids; fewer if there are fewer distinct points."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(7)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        centres = np.array([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


def gaps(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and how much farther each centroid is."""
    d = distances(x, centres)
    own = d.argmin(1)
    return own, d - d[np.arange(len(x)), own][:, None]


def in_line(centres: np.ndarray) -> np.ndarray:
    """Centroids in order along the direction in which they spread most, so near numbers are near centroids."""
    apart = centres - centres.mean(0)
    return centres[np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable")]


def even_parts(counts: np.ndarray, n: int) -> np.ndarray:
    """The part, 0 to n - 1, of each of a row of codes, in which parts hold about the same number."""
    middle = np.cumsum(counts) - counts / 2
    return np.minimum((middle * n / max(counts.sum(), 1)).astype(np.int64), n - 1)


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by increasing a[i] + b[j], as long as the sum is at most ``limit``."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(a[order_a[0]] + b[order_b[0]], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(order_a[i]), int(order_b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[order_a[x]] + b[order_b[y]], x, y))


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of extreme values finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Grid:
    """Codebooks of the two halves of vectors of one length, how deep to search, and the tiles of the grid.

    ``members``: vectors of the largest label, by which the number of tiles goes.
    """

    def __init__(self, x: np.ndarray, k: int, threshold: float, target: float, members: int = 0):
        self.half = x.shape[1] // 2
        self.first, self.second = in_line(fit_codebook(x[:, : self.half], k)), in_line(fit_codebook(x[:, self.half :], k))
        self.limit = self._depth(x, threshold, target)
        tiles = math.ceil(members / TILE)
        rows = max(1, math.isqrt(tiles))
        columns = max(1, -(-tiles // rows))
        parts = (x[:, : self.half], self.first, rows), (x[:, self.half :], self.second, columns)
        row, column = (even_parts(np.bincount(gaps(half, book)[0], minlength=len(book)), n) for half, book, n in parts)
        #: The tile of each cell.
        self.tile = (row[:, None] * columns + column[None, :]).ravel()

    def _depth(self, x: np.ndarray, threshold: float, target: float) -> float:
        """The ``target`` quantile of the partner's depth over pairs at the threshold; half the partners lie in
        a random direction, half in that of the difference of two sampled vectors."""
        rng = np.random.default_rng(5)
        z = x[rng.integers(len(x), size=PAIRS)]
        away = rng.standard_normal(z.shape)
        apart = x[rng.integers(len(x), size=PAIRS)] - x[rng.integers(len(x), size=PAIRS)]
        apart[np.abs(apart).max(1) < 1e-6] = 1.0
        away[::2] = apart[::2] / np.sqrt((apart[::2] ** 2).sum(1, keepdims=True))
        away -= (away * z).sum(1, keepdims=True) * z
        size = np.sqrt((away * away).sum(1))
        z, away = z[size > 1e-6], away[size > 1e-6] / size[size > 1e-6][:, None]
        if not len(z):
            return 0.0
        partner = threshold * z + math.sqrt(max(1 - threshold * threshold, 0)) * away
        row, depth = np.arange(len(z)), 0.0
        for half, centres in ((slice(0, self.half), self.first), (slice(self.half, None), self.second)):
            depth = depth + gaps(z[:, half], centres)[1][row, distances(partner[:, half], centres).argmin(1)]
        return float(np.quantile(depth, target))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell of each unit vector, and the cells from its own number on that it visits."""
        width = len(self.second)
        a, gap_a = gaps(x[:, : self.half], self.first)
        b, gap_b = gaps(x[:, self.half :], self.second)
        own = a * width + b
        visits = []
        for i in range(len(x)):
            found = (p * width + q for p, q in multi_sequence(gap_a[i], gap_b[i], self.limit))
            visits.append([c for c in found if c >= own[i]])
        return own, visits


def short_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in two bytes a component, the step of each, and the norm of what is left."""
    step = np.abs(x).max(1) / 32767
    code = np.rint(x / step[:, None]).astype(np.int16)
    left = x - code * step[:, None]
    return code, step, np.sqrt((left * left).sum(1))


def fit_grids(classes: DataFrame, threshold: float, target: float) -> dict[int, Grid]:
    """A grid for each length of vector in a sample of about SAMPLE classes; lengths it lacks, and 1, are one cell."""
    n = classes.count()
    rows = classes.where(part_of(F.col("node")) < share(n, SAMPLE)).select("dim", "embedding").collect()  # about SAMPLE at most
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    k = max(1, min(MOST_CODES, math.ceil(GROWTH * n**0.25)))
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return {d: Grid(_unit(np.array(v, np.float64)), k, threshold, target, largest) for d, v in by_dim.items() if d > 1}


def placed_vectors(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """(label, dim, node, n, code, step, left, cell, tile, visits): visits lists the cells to visit by tile."""
    shared = classes.sparkSession.sparkContext.broadcast(grids)  # at most 2 * MOST_CODES half vectors for each length
    names = ["label", "dim", "node", "n"]
    kind = pa.list_(pa.struct([("tile", pa.int32()), ("cells", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _unit(matrix(part.column("embedding")))
                own, visits, tile = np.zeros(len(x), np.int64), [[0]] * len(x), np.zeros(1, np.int64)
                if dim in shared.value:
                    own, visits = shared.value[dim].cells(x)
                    tile = shared.value[dim].tile
                by_tile: list[list[dict]] = []
                for found in visits:
                    of: dict[int, list[int]] = {}
                    for cell, t in zip(found, tile[found].tolist()):
                        of.setdefault(t, []).append(cell)
                    by_tile.append([{"tile": t, "cells": cells} for t, cells in of.items()])
                code, step, left = short_codes(x)
                columns = [*(part.column(c) for c in names), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(left)]
                columns += [pa.array(own, pa.int32()), pa.array(tile[own], pa.int32()), pa.array(by_tile, kind)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "code", "step", "left", "cell", "tile", "visits"])

    schema = "label string, dim int, node long, n long, code binary, step double, left double, cell int, tile int, visits array<struct<tile:int,cells:array<int>>>"
    return classes.select(*names, "embedding").mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each node's component, over links between nodes a and b."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)


def compare(q: pa.Table, m: pa.Table, threshold: float) -> Iterator[list[np.ndarray]]:
    """Links between visitors (with the cells that each visits) and the members of those cells, cell by cell: rows (a, b, n)
    with the links (a, b, 0) of a spanning forest, the counts (a, -1, n) of linked vectors, and pairs (a, b, -1) that the
    codes leave open.

    A visitor at home meets every member of its cell, itself left out, and each of these
    pairs comes from both sides; a visitor from elsewhere counts for both.
    """
    decoded = lambda t: np.frombuffer(b"".join(t["code"].to_pylist()), np.int16).reshape(len(t), -1) * t["step"].to_numpy()[:, None]
    x, y = decoded(q), decoded(m)
    q_all, m_all, q_n, m_n, q_left, m_left = (t[c].to_numpy() for c in ("node", "n", "left") for t in (q, m))
    lists, home_cell, member_cell = q["cells"].combine_chunks(), q["cell"].to_numpy(), m["cell"].to_numpy()
    who, cell = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    who, cell = who[order], cell[order]
    members = np.argsort(member_cell, kind="stable")
    for j in np.split(members, np.flatnonzero(np.diff(member_cell[members])) + 1):
        at = member_cell[j[0]]
        i = who[np.searchsorted(cell, at) : np.searchsorted(cell, at, "right")]
        if not len(i):
            continue
        q_id, m_id = q_all[i], m_all[j]
        cosine = x[i] @ y[j].T
        error = q_left[i][:, None] + m_left[j][None, :] + 1e-12
        other = q_id[:, None] != m_id[None, :]
        linked = (cosine - error >= threshold) & other
        away = home_cell[i] != at
        unsure = (np.abs(cosine - threshold) < error) & other & (away[:, None] | (q_id[:, None] < m_id[None, :]))
        n_q, n_m = linked @ m_n[j], linked[away].T @ q_n[i][away]
        a, b = np.nonzero(linked)
        ids, where = np.unique(np.concatenate([q_id, m_id]), return_inverse=True)
        label = _forest(where[: len(q_id)][a], where[len(q_id) :][b], ids)
        star, some_q, some_m = np.flatnonzero(label != ids), np.flatnonzero(n_q), np.flatnonzero(n_m)
        none = np.full(len(some_q) + len(some_m), -1)
        a, b = np.nonzero(unsure)
        yield [
            np.concatenate([ids[star], q_id[some_q], m_id[some_m], q_id[a]]),
            np.concatenate([label[star], none, m_id[b]]),
            np.concatenate([np.zeros(len(star), np.int64), n_q[some_q], n_m[some_m], np.full(len(a), -1)]),
        ]


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) as :func:`compare` gives them, of pairs (a, b), by their vectors in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x, y = _unit(matrix(part.column("x"))), _unit(matrix(part.column("y")))
                cosine = (x * y).sum(1)
                for i in np.flatnonzero(np.abs(cosine - threshold) < 1e-9).tolist():  # the sum's order mustn't decide
                    cosine[i] = math.fsum(x[i] * y[i])
                keep = cosine >= threshold
                a, b, n_a, n_b = (part.column(c).to_numpy()[keep] for c in ("a", "b", "n_a", "n_b"))
                none = np.full(len(a), -1)
                columns = np.concatenate([np.maximum(a, b), a, b]), np.concatenate([np.minimum(a, b), none, none]), np.concatenate([np.zeros(len(a), np.int64), n_b, n_a])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    end = lambda name, vector, n: classes.select(F.col("node").alias(name), F.col("embedding").alias(vector), F.col("n").alias(n))
    both = pairs.join(end("a", "x", "n_a"), "a").join(end("b", "y", "n_b"), "b").withColumn("dim", F.size("x"))
    return both.select("a", "b", "n_a", "n_b", "dim", "x", "y").mapInArrow(run, "a long, b long, n long")


def compared(both: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(a, b, n) of all blocks; ``both``: visitors and members by block, each block's rows together."""

    def results(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        visitor = pc.is_valid(rows["cells"])
        for out in compare(rows.filter(visitor), rows.filter(pc.invert(visitor)), threshold):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the block at hand: at most about two BLOCKs
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, bool)
            for c in keys:
                column = batch.column(c)
                change |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in keys):
                yield from results(pa.Table.from_batches(held))
                held = []
            for i, j in zip(cuts, cuts[1:]):
                if i:
                    yield from results(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from results(pa.Table.from_batches(held))

    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, target: float = 0.998) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Vectors of one label and one length with cosine >= threshold are linked; of
    links right at the threshold about the share ``target`` is found, of closer ones
    more, and none below it.  Rows with a null id or label, and vectors that are
    null, empty, zero or hold null or non-finite components link with nothing:
    n_links 0, component_id their own id.  Repeated rows are each returned, with the
    same result; rows that share an id but not the vector are judged each by its own.
    Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    fine = usable("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", fine.alias("usable"))
    good = rows.where("usable").select("vec_id", "label", "embedding")
    same = good.distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    same = scratch.save(same, "same")
    # Nodes are numbered in the order of their smallest vec_id, so a smallest node leads to a smallest vec_id.
    numbered = same.repartitionByRange("rep").sortWithinPartitions("rep").withColumn("node", F.monotonically_increasing_id())
    classes = scratch.save(numbered.withColumn("dim", F.size("embedding")), "classes")
    members = good.join(classes.select("label", "embedding", "rep", "node", "n"), ["label", "embedding"])
    members = scratch.save(members.select("vec_id", "rep", "node", "n"), "members")
    placed = scratch.save(placed_vectors(classes, fit_grids(classes, threshold, target)), "cells")

    tile, up_to = ["label", "dim", "tile"], lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    coded = ["node", "n", "code", "step", "left", "cell"]
    asked = placed.select("label", "dim", F.explode("visits").alias("v"), *coded).select("label", "dim", "v.tile", *coded, "v.cells")
    sizes = placed.groupBy(*tile).agg(F.ceil(F.count("*") / BLOCK).alias("m_blocks"))
    loads = asked.groupBy(*tile).agg(F.ceil(F.count("*") / BLOCK).alias("q_blocks"))
    grid = scratch.save(sizes.join(loads, tile), "grid")
    # The blocks of a hot tile meet each other, each pair of blocks in a task of its own.
    blocks = [*tile, "q", "m"]
    visitors = asked.join(grid, tile).withColumn("q", F.pmod(F.xxhash64("node"), "q_blocks")).withColumn("m", up_to("m_blocks"))
    stored = placed.select(*tile, *coded).join(grid, tile)
    stored = stored.withColumn("m", F.pmod(F.xxhash64("node"), "m_blocks")).withColumn("q", up_to("q_blocks"))
    both = visitors.select(*blocks, *coded, "cells").unionByName(stored.select(*blocks, *coded), allowMissingColumns=True)
    found = scratch.save(compared(both, blocks, threshold), "found")
    close = scratch.save(verified(found.where("n < 0").select("a", "b"), classes, threshold), "close")
    found = found.where("n >= 0").union(close)
    labels = components(found.where("n = 0").select("a", "b"), scratch)
    low = classes.select(F.col("node").alias("component"), F.col("rep").alias("low"))
    lows = labels.join(low, "component").select("node", "low")
    others = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    known = scratch.save(others.join(lows, "node", "full"), "known")
    scratch.drop(same, classes, placed, grid, close, labels)
    out = members.join(known, "node", "left")
    out = out.select("vec_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
