"""Nearest neighbours through randomly rotated one-bit codes in coarse cells.

A vector's unit direction, padded with zeros to ``code_length`` components, is
rotated by a fixed random orthogonal matrix and kept as its sign bits, with its norm
and the inner product between the direction and its code's direction as correction
scalars.  A query's rotated direction is quantised to a few bits per component; AND
and population count over bit planes give its inner product with every code, and
dividing by the correction scalar an unbiased estimate of the true one, with a known
error bound.  Vectors whose upper bound reaches the query's floor are estimated again
from a second code, one byte a component, whose error has a certain bound.

Candidates lie in cells by direction (k-means on a sample) and level of norm, and
cells in groups of about a block's size.  A query first meets the best of a few cells,
which gives its floor: the k-th best lower bound so far.  It then visits the cells in
which more than a share ``miss`` of the k neighbours may lie above the floor, by the
spread of directions about each centroid.  Only codes and scalars of candidates
travel to the groups' blocks, and a query travels once to a group, with the list of
its cells there.  Original vectors are joined by row number, for the candidates
whose bound reaches the k-th best lower bound of all, and decide.

Of equal vectors only the smallest ids can be among the k nearest, ties going to
smaller ids, so no more of them go on, and equal query vectors are searched once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .samples import part_of, share
from .scratch import Scratch
from .vectors import matrix, usable

#: Queries and candidates in one block, about; bits of a query component; error bound in standard deviations; least code length.
QUERY_BLOCK, CANDIDATE_BLOCK, QUERY_BITS, SIGMAS, LEAST_BITS = 512, 8192, 4, 3.5, 256
#: Vectors that centroids are fitted on, most centroids for a length, and members that a first visit meets for each neighbour.
SAMPLE, MOST_CELLS, FIRST = 32_768, 2048, 30


def code_length(dim: int) -> int:
    return max(LEAST_BITS, -(-dim // 64) * 64)


@functools.lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    """The same random orthonormal rows, dim by code_length(dim), everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(20_000 + dim).standard_normal((code_length(dim), dim)))
    return (q * np.sign(np.diag(r))).T


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, a multiple of 64, as 64-bit words."""
    return np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as words, norms, and inner products between directions and their codes' directions."""
    norm = np.sqrt((x * x).sum(1))
    turned = (x / norm[:, None]) @ turn
    return _pack(turned > 0), norm, np.abs(turned).sum(1) / np.sqrt(turn.shape[1])


def quantise(queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated directions of queries in QUERY_BITS bits a component: bit planes as words, least value, step."""
    size = np.sqrt((queries * queries).sum(1, keepdims=True))
    turned = (queries / size) @ turn
    low, top = turned.min(1, keepdims=True), (1 << QUERY_BITS) - 1
    step = np.maximum((turned.max(1, keepdims=True) - low) / top, 1e-12)
    noise = np.random.default_rng(1).random(turned.shape[1])
    level = np.clip(np.floor((turned - low) / step + noise), 0, top).astype(np.int64)
    planes = np.stack([_pack(level >> j & 1) for j in range(QUERY_BITS)], axis=1)
    return planes, low[:, 0], step[:, 0]


def estimates(words: np.ndarray, norm: np.ndarray, align: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of all quantised queries (rows; ``size``: their norms) with all coded vectors, and the upper bounds."""
    n = 64 * words.shape[1]
    total = np.zeros((len(planes), len(words)), np.float32)
    for j in range(QUERY_BITS):
        count = np.zeros(total.shape, np.uint16)
        for w in range(words.shape[1]):
            count += np.bitwise_count(words[None, :, w] & planes[:, j, w, None])
        total += count * np.float32(1 << j)
    ones = np.bitwise_count(words).sum(1, dtype=np.float64)
    levels = np.bitwise_count(planes).sum(2, dtype=np.float64) @ (2.0 ** np.arange(QUERY_BITS))
    low, step, size = low[:, None], step[:, None], size[:, None]
    inner = 2 * step * total + 2 * low * ones - (step * levels[:, None] + n * low)
    scale = norm / align
    spread = SIGMAS * norm * np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(n - 1)
    value = inner * scale * (size / np.sqrt(n))
    return value, value + size * (spread + (SIGMAS / 2) * step * scale)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact scores row by row, added component by component: the same sum on every machine, for equal vectors too."""
    return np.add.accumulate(x * y, axis=1)[:, -1]


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centroids of directions; fewer if there are fewer distinct ones."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(7).choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = (2 * x @ centres.T - (centres * centres).sum(1)).argmax(1)
        order = np.argsort(near, kind="stable")
        cut = np.searchsorted(near[order], np.arange(len(centres)))
        full = np.flatnonzero(np.bincount(near, minlength=len(centres)))
        sums = np.add.reduceat(x[order], cut[full])
        centres[full] = sums / np.bincount(near, minlength=len(centres))[full][:, None]
    return centres


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.abs(x).max(1, keepdims=True)
    norm = np.sqrt(((x / top) ** 2).sum(1, keepdims=True))
    return x / top / norm, (top * norm)[:, 0]


def byte_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in one signed byte a component, the step of each, and the norm of what is left."""
    step = np.abs(x).max(1) / 127
    fine = np.rint(x / step[:, None]).astype(np.int8)
    left = x - fine * step[:, None]
    return fine, step, np.sqrt((left * left).sum(1))


#: A candidate's codes as they travel.
CODES = ["code", "norm", "align", "fine", "step", "left"]


def placed(candidates: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(dim, cell, level, row, CODES, off): candidates with their cell, codes and squared distance from the centroid."""
    shared = candidates.sparkSession.sparkContext.broadcast(books)  # at most MOST_CELLS directions for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column("embedding"))
                turn = turns.setdefault(dim, rotation(dim))
                unit, size = _directions(x)
                centres = shared.value.get(dim, np.zeros((1, dim)))
                near = (2 * unit @ centres.T - (centres * centres).sum(1)).argmax(1)
                code, norm, align = encode(x, turn)
                fine, step, left = byte_codes(x)
                level = pa.array(np.floor(2 * np.log2(size) + 0.5), pa.int32())
                columns = [part.column("dim"), pa.array(near, pa.int32()), level, part.column("row")]
                columns += [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(align)]
                columns += [pa.array([c.tobytes() for c in fine], pa.binary()), pa.array(step), pa.array(left), pa.array(((unit - centres[near]) ** 2).sum(1))]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "cell", "level", "row", *CODES, "off"])

    schema = "dim int, cell int, level int, row long, code binary, norm double, align double, fine binary, step double, left double, off double"
    return candidates.select("dim", "row", "embedding").mapInArrow(run, schema)


class Cells:
    """The cells of one length: centroid, number and largest norm of members, spread of directions along any one line.

    Cells lie one after another in groups of about CANDIDATE_BLOCK members; a larger cell has several groups of its own.
    """

    def __init__(self, rows: list, centres: np.ndarray):
        self.key = np.array([(r["cell"], r["level"]) for r in rows])
        self.centres = centres[[r["cell"] for r in rows]]
        self.n, self.norm = (np.array([r[c] for r in rows], np.float64) for c in ("n", "norm"))
        self.spread = np.sqrt(np.array([r["off"] for r in rows]) / centres.shape[1]) + 1e-9
        self.parts = np.ceil(self.n / CANDIDATE_BLOCK).astype(np.int64)
        self.group = np.zeros(len(rows), np.int64)
        at, held = 0, 0.0
        for i, (n, parts) in enumerate(zip(self.n.tolist(), self.parts.tolist())):
            if held and held + n > CANDIDATE_BLOCK:
                at, held = at + 1, 0.0
            self.group[i], held = at, held + n
            if parts > 1:
                at, held = at + parts, 0.0

    def first(self, query: np.ndarray, least: int) -> np.ndarray:
        """The most promising cells that hold ``least`` members together."""
        order = np.argsort(-(self.centres @ query + self.spread) * self.norm)
        return order[: int(np.searchsorted(np.cumsum(self.n[order]), least)) + 1]

    def to_visit(self, query: np.ndarray, floor: float, missed: float, least: int) -> np.ndarray:
        """The first cells, and all others but those that together hold ``missed`` members above the floor, by expectation."""
        if floor == -np.inf:
            return np.arange(len(self.n))
        direction, size = _directions(query[None])
        far = (floor / (size[0] * self.norm) - self.centres @ direction[0]) / self.spread
        hits = self.n * _tail(far)
        order = np.argsort(hits)
        return np.union1d(order[np.cumsum(hits[order]) > missed], self.first(query, least))


def _tail(z: np.ndarray) -> np.ndarray:
    """Chance of a standard normal beyond z: an upper bound, within a tenth where it matters."""
    near = np.maximum(z, 0)
    return np.where(z < 0, 1.0, np.exp(-near * near / 2) * np.minimum(0.5, 0.4 / np.maximum(near, 0.1)))


ASKED = ["node", "embedding", "floor", "wide", "planes", "low", "width", "cells"]


def visits(queries: DataFrame, cells: dict[int, Cells], k: int, missed: float) -> DataFrame:
    """(dim, group, ASKED): each query, quantised, in each group with cells that it visits (without a floor: the first ones)."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)  # a row for each cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in shared.value:
                    continue
                part, known = batch.filter(pa.array(dims == dim)), shared.value[dim]
                x, floors, wide = matrix(part.column("embedding")), part.column("floor").to_pylist(), part.column("wide").to_pylist()
                planes, low, width = quantise(x, rotation(dim))
                query, group, lists = [], [], []
                for i, (q, floor, w) in enumerate(zip(x, floors, wide)):
                    found = known.first(q, FIRST * w) if floor is None else known.to_visit(q, floor, missed, FIRST * k)
                    every = np.repeat(found, known.parts[found])
                    at = known.group[every] + np.arange(len(every)) - np.repeat(np.cumsum(known.parts[found]) - known.parts[found], known.parts[found])
                    order = np.argsort(at, kind="stable")
                    distinct, begin = np.unique(at[order], return_index=True)
                    query += [i] * len(distinct)
                    group += distinct.tolist()
                    lists += [c.tolist() for c in np.split(every[order], begin[1:])]
                at = pa.array(query, pa.int64())
                columns = [part.column("dim").take(at), pa.array(group, pa.int32()), *(part.column(c).take(at) for c in ("node", "embedding", "floor", "wide"))]
                columns += [c.take(at) for c in (pa.array([p.tobytes() for p in planes], pa.binary()), pa.array(low), pa.array(width))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, pa.list_(pa.int32()))], ["dim", "group", *ASKED])

    kind = queries.schema["embedding"].dataType.simpleString()
    schema = f"dim int, group int, node long, embedding {kind}, floor double, wide long, planes binary, low double, width double, cells array<int>"
    return queries.select("dim", "node", "embedding", "floor", "wide").mapInArrow(run, schema)


def within_bounds(q: pa.Table, c: pa.Table) -> pa.RecordBatch:
    """(node, row, least, most): bounds of candidates that can be among the best ``wide`` of a query, by what this block holds.

    A query without a floor meets the best by estimate, and only the ``wide`` best lower bounds are returned.
    """
    rows, number = c["row"].to_numpy(), c["number"].to_numpy()
    bits = np.frombuffer(b"".join(c["code"].to_pylist()), np.uint64).reshape(len(rows), -1)
    norm, align, step, left = (c[x].to_numpy() for x in ("norm", "align", "step", "left"))
    fine = np.frombuffer(b"".join(c["fine"].to_pylist()), np.int8).reshape(len(rows), -1).astype(np.float32)
    y, node, wide = matrix(q["embedding"]), q["node"].to_numpy(), q["wide"].to_numpy()
    planes = np.frombuffer(b"".join(q["planes"].to_pylist()), np.uint64).reshape(len(node), QUERY_BITS, -1)
    low, width, size = q["low"].to_numpy(), q["width"].to_numpy(), np.sqrt((y * y).sum(1))
    floor = q["floor"].fill_null(-np.inf).to_numpy().copy()
    asked = q["cells"].combine_chunks()
    who, cell = pc.list_parent_indices(asked).to_numpy(), asked.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    who, cell = who[order], cell[order]
    by_cell = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[by_cell])) + 1
    out = []
    for j in np.split(by_cell, cuts):
        i = who[np.searchsorted(cell, number[j[0]]) : np.searchsorted(cell, number[j[0]], "right")]
        if not len(i):
            continue
        value, reach = estimates(bits[j], norm[j], align[j], planes[i], low[i], width[i], size[i])
        wanted, open_ = reach >= floor[i][:, None], floor[i] == -np.inf
        best = 4 * int(wide[i].max())
        if open_.any() and len(j) > best:  # no floor yet: the best by estimate go on
            wanted[open_] = value[open_] >= -np.partition(-value[open_], best - 1, axis=1)[:, best - 1 : best]
        a, b = np.nonzero(wanted)
        for at in range(0, len(a), 1 << 16):
            p, r = i[a[at : at + (1 << 16)]], j[b[at : at + (1 << 16)]]
            about = np.einsum("ij,ij->i", fine[r], y[p]) * step[r]
            error = (left[r] + 1e-12 * norm[r]) * size[p]
            near = about + error >= floor[p]
            out.append((p[near], r[near], (about - error)[near], (about + error)[near]))
    p, r, least, most = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
    order = np.lexsort((-least, p))
    p, r, least, most = p[order], r[order], least[order], most[order]
    rank = np.arange(len(p)) - np.searchsorted(p, p)
    reached = rank == wide[p] - 1
    floor[p[reached]] = np.maximum(floor[p[reached]], least[reached])
    keep = (most >= floor[p]) & ((rank < wide[p]) | q["floor"].is_valid().to_numpy()[p])
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (node[p], rows[r], least, most)], ["node", "row", "least", "most"])


def searched(asked: DataFrame, stored: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, row, least, most) of each query's visits, block by block: a block is a group of candidates and about QUERY_BLOCK queries."""
    group = ["dim", "group"]
    loads = scratch.save(asked.groupBy(*group).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks")), "loads")
    keys = [*group, "q"]
    left = asked.join(loads, group).withColumn("q", F.pmod(F.xxhash64("node"), F.col("blocks"))).select(*keys, *ASKED)
    right = stored.join(loads, group).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = left.unionByName(right.select(*keys, "row", "number", *CODES), allowMissingColumns=True)

    def results(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        query = pc.is_valid(table["node"])
        return within_bounds(table.filter(query).combine_chunks(), table.filter(pc.invert(query)).combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the block at hand: at most about QUERY_BLOCK and CANDIDATE_BLOCK
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys], axis=1)
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            if held and (last != number[0]).any():
                yield results(held)
                held = []
            for i, j in zip(cuts, cuts[1:]):
                if i:
                    yield results(held)
                    held = []
                held.append(batch.slice(i, j - i))
            last = number[-1]
        if held:
            yield results(held)

    return both.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, row long, least double, most double")


def scored(pairs: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(node, vec_id, score) of pairs (node, row), on the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                score = inner_products(matrix(part.column("embedding")), matrix(part.column("asked")))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("vec_id"), pa.array(score)], ["node", "vec_id", "score"])

    pairs = pairs.join(candidates.select("row", "dim", "vec_id", "embedding"), "row").join(queries.select("node", F.col("embedding").alias("asked")), "node")
    return pairs.select("node", "vec_id", "dim", "embedding", "asked").mapInArrow(run, "node long, vec_id long, score double")


def _floors(bounds: DataFrame) -> DataFrame:
    """(node, reached): each query's ``wide``-th best lower bound, where it has so many."""
    order = Window.partitionBy("node").orderBy(F.desc("least"))
    ranked = bounds.select("node", "wide", "least").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") == F.col("wide")).select("node", F.col("least").alias("reached"))


def nearest(vectors: DataFrame, is_query: str, k: int = 20, miss: float = 0.002) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the SQL condition ``is_query`` holds, the k largest inner products.

    Candidates are all rows of the query's length but those with its id; ties go to
    the smaller vec_id.  Cells that by expectation hold ``miss`` * k neighbours of a
    query together stay out.  Rows with a null id, and vectors that are null, empty,
    zero or hold null or non-finite components take no part.  Queries with fewer
    candidates get fewer rows; an empty table gives none.  A repeated row (same id
    and vector) counts once.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "nearest")
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    good = scratch.save(good.distinct(), "rows")
    # A query leaves out one row at most of those with equal vectors: its own.
    few = Window.partitionBy("dim", "embedding").orderBy("vec_id")
    candidates = good.withColumn("i", F.row_number().over(few)).where(F.col("i") <= k + 1).drop("i")
    candidates = scratch.save(candidates.withColumn("row", F.monotonically_increasing_id()), "candidates")
    sizes = {r["dim"]: r["n"] for r in candidates.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length
    sample: dict[int, list] = {}
    for r in candidates.where(part_of(F.xxhash64("vec_id", "embedding")) < share(sum(sizes.values()), SAMPLE)).select("dim", "embedding").toLocalIterator():
        sample.setdefault(r["dim"], []).append(r["embedding"])  # about SAMPLE rows
    books = {d: fit_centroids(_directions(np.array(v, np.float64))[0], min(MOST_CELLS, int(np.ceil(np.sqrt(sizes[d]))))) for d, v in sample.items()}
    stored = scratch.save(placed(candidates, books), "cells")
    rows: dict[int, list] = {}
    stats = stored.groupBy("dim", "cell", "level").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.avg("off").alias("off"))
    for r in stats.orderBy("dim", "cell", "level").collect():  # a row for each cell
        rows.setdefault(r["dim"], []).append(r)
    cells = {d: Cells(v, books.get(d, np.zeros((1, d)))) for d, v in rows.items()}
    where = [(d, *map(int, x.key[i]), i, int(x.group[i]), int(x.parts[i])) for d, x in cells.items() for i in range(len(x.n))]
    where = spark.createDataFrame(where, "dim int, cell int, level int, number int, group int, parts long")
    stored = stored.join(F.broadcast(where), ["dim", "cell", "level"])  # a row for each cell: MOST_CELLS for a length and level of norm
    stored = stored.withColumn("group", F.col("group") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    asked = good.where(is_query)
    # A query's own rows may be among the best: it looks for that many more.
    own = good.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    queries = asked.join(own, "vec_id").groupBy("dim", "embedding").agg((F.max("own") + k).alias("wide")).withColumn("node", F.monotonically_increasing_id())
    queries = scratch.save(queries, "queries")
    width = queries.select("node", "wide")
    no_floor = queries.withColumn("floor", F.lit(None).cast("double"))
    met = scratch.save(searched(scratch.save(visits(no_floor, cells, k, miss * k), "first"), stored, scratch).join(width, "node"), "met")
    known = queries.join(_floors(met), "node", "left").withColumn("floor", F.coalesce("reached", F.lit(float("-inf")))).drop("reached")
    bounds = searched(scratch.save(visits(known, cells, k, miss * k), "visits"), stored, scratch)
    bounds = scratch.save(bounds.join(width, "node"), "bounds")
    pairs = bounds.join(_floors(bounds), "node", "left").where("reached is null or most >= reached").select("node", "row")
    found = scratch.save(scored(scratch.save(pairs, "pairs"), candidates, queries), "found")
    scratch.drop(candidates, met, bounds)
    named = asked.select(F.col("vec_id").alias("query_id"), "dim", "embedding").join(queries, ["dim", "embedding"]).select("query_id", "node")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = named.join(found, "node").where("vec_id <> query_id").withColumn("rank", F.row_number().over(best))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
