"""Near-duplicate documents by MinHash bands and odd sketches.

Each document's distinct word shingles are MinHashed once.  The samples serve
twice: bands of them name candidate buckets, and all of them are folded into an
odd sketch, a bitmap in which sample i with value v toggles bit hash(i, v).  The
population count of the XOR of two odd sketches estimates high similarities far
more sharply than as many bits of plain MinHash would, so nearly every false
candidate is rejected from 64 bytes; the rest are confirmed on the full sets.

Rows with equal shingle sets form one class, a numbered node; only one signature
and one text of each goes on, however often its rows repeat.  Buckets aren't expanded into pairs: each member is first compared with
its bucket's smallest member, and components of the confirmed links are found.
Members of buckets that still hold several components are compared across those
components as an exact set-similarity join does: their shingles are put in order from
rare to frequent, and two sets can only reach the threshold if short prefixes of them
share a shingle.  With sizes and the odd sketches of the full sets this decides within
the join, on short arrays, which pairs come out; first each member's best-estimated partner
in each other component, then all that remain.  A pair inside one component can't change
the result and isn't formed, so no link between components is lost.

A pair is confirmed with one end as its centre: the centre's text stands once for a
block of its partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, gram_hashes, hash_runs, mix, row_grams, signed, slices, text_bytes, words_of
from .columns import set_aside
from .components import components
from .scratch import Scratch

#: Bits of the odd sketch of MinHash samples, and of that of the full set.
SKETCH_BITS, SET_BITS = 512, 1024
#: Partners that meet their centre in one block, about.
BLOCK = 512


def odd_sketches(bits: np.ndarray, rows: np.ndarray, n: int, size: int) -> np.ndarray:
    """n bitmaps of ``size`` bits as 64-bit words; entry i toggles bit bits[i] of bitmap rows[i]."""
    odd = np.bincount(rows * size + bits.astype(np.int64), minlength=n * size) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little").view(np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles; a shorter row is one shingle, one without words none."""
    data = LOWER[data]
    starts, ends, at = words_of(data, offsets)
    words = hash_runs(data, starts, ends)
    grams, _, upto = row_grams(words, at, k)
    out = []
    for i in range(len(offsets) - 1):
        if upto[i + 1] > upto[i]:
            out.append(np.unique(grams[upto[i] : upto[i + 1]]))
        else:
            out.append(gram_hashes(words[at[i] : at[i + 1]], int(at[i + 1] - at[i])) if at[i + 1] > at[i] else grams[:0])
    return out


SIGNATURE = "doc_id long, name long, n_shingles long, set_a long, set_b long, keys array<long>, sketch array<long>, parity array<long>"


def _lists(matrix: np.ndarray, pick: pa.Array) -> pa.Array:
    """Rows of a matrix as a list column, in the order of ``pick`` (null: null)."""
    flat = pa.array(signed(np.ascontiguousarray(matrix)).ravel(), pa.int64())
    return pa.FixedSizeListArray.from_arrays(flat, matrix.shape[1]).cast(pa.list_(pa.int64())).take(pick)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, name (the text's hash by Spark), n_shingles, set_a, set_b (a 128-bit name of the set),
    keys (one for each band), sketch and parity (odd sketches of the MinHash samples and of the full set).

    Documents without words have 0 shingles and null for the rest.
    """
    n = bands * rows
    salts = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    shifts = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def samples(all_: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each set's MinHash samples and band keys."""
        low = np.empty((len(begin), n), np.uint64)
        keys = np.zeros((len(begin), bands), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                low[:, i] = np.minimum.reduceat((all_ ^ shifts[i]) * salts[i], begin)
            low = mix(low)
            grouped = low.reshape(len(begin), bands, rows)
            for j in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, j])
            keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :])
        return low, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                sets = shingle_sets(*text_bytes(part.column("text")), k)
                sizes = np.array([len(s) for s in sets])
                has = np.flatnonzero(sizes)
                row_of = np.full(len(sets), -1)
                row_of[has] = np.arange(len(has))
                pick = pa.array(row_of, pa.int64(), mask=row_of < 0)
                if len(has):
                    all_ = np.concatenate(sets)
                    begin = (np.cumsum(sizes) - sizes)[has]
                    low, keys = samples(all_, begin)
                    set_a, set_b = np.add.reduceat(all_, begin), np.add.reduceat(mix(all_), begin)
                    each = np.repeat(np.arange(len(has)), n)
                    sketch = odd_sketches((mix(low ^ salts[None, :]) % np.uint64(SKETCH_BITS)).ravel(), each, len(has), SKETCH_BITS)
                    each = np.repeat(np.arange(len(has)), sizes[has])
                    parity = odd_sketches(mix(~all_) % np.uint64(SET_BITS), each, len(has), SET_BITS)
                else:
                    set_a = set_b = np.zeros(0, np.uint64)
                    keys, sketch, parity = (np.zeros((0, w), np.uint64) for w in (bands, SKETCH_BITS // 64, SET_BITS // 64))
                columns = [part.column("doc_id"), part.column("name"), pa.array(sizes, pa.int64())]
                columns += [pa.array(signed(x), pa.int64()).take(pick) for x in (set_a, set_b)]
                columns += [_lists(x, pick) for x in (keys, sketch, parity)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n_shingles", "set_a", "set_b", "keys", "sketch", "parity"])

    return docs.select("doc_id", F.xxhash64("text").alias("name"), "text").mapInArrow(run, SIGNATURE)


def most_differing_bits(samples: int, similarity: float) -> int:
    """The XOR population count expected of two sets with this similarity."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / SKETCH_BITS)))


def differing_bits(a: str, b: str, size: int):
    """Population count of the XOR of two columns with bitmaps of ``size`` bits."""
    total = F.lit(0)
    for i in range(size // 64):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def centred(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, block, b, text): each pair as its partner b with b's text, and for each block of a centre's partners one row with b null and a's text."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    centres = sizes.join(texts, F.col("a") == F.col("node")).select("a", every, F.lit(None).cast("long").alias("b"), "text")
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")
    partners = pairs.join(sizes, "a").join(texts, F.col("b") == F.col("node")).select("a", block, "b", "text")
    return centres.union(partners)


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                keep = []
                for b, own in zip(part.column("b").to_pylist(), shingle_sets(*text_bytes(part.column("text")), k)):
                    if b is None:  # the first of its block
                        centre = own
                        keep.append(False)
                        continue
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(centre) + len(own) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    block = centred(pairs, texts).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    return block.mapInArrow(run, "a long, b long")


def set_tokens(members: DataFrame, k: int) -> DataFrame:
    """(node, component, n, h): each shingle of each member's text (node, component, text), n in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                sets = shingle_sets(*text_bytes(part.column("text")), k)
                sizes = np.array([len(s) for s in sets])
                row = pa.array(np.repeat(np.arange(len(sets)), sizes))
                columns = [part.column("node").take(row), part.column("component").take(row), pa.array(np.repeat(sizes, sizes)), pa.array(signed(np.concatenate(sets)))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "component", "n", "h"])

    return members.select("node", "component", "text").mapInArrow(run, "node long, component long, n long, h long")


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """(node, index, probe): the short and the long prefix of each set, by which sets that may reach the threshold meet.

    ``tokens``: a written table as :func:`set_tokens` makes it.  Shingles that a single
    component has come first in the order, as no two components share them, and the rest from
    rare to frequent.  The first shingle that two sets share lies in a prefix of each:
    of the larger as long as a set of the least possible size allows, of the smaller only as
    long as one of its own size does.  Shingles that no other component has aren't listed.
    """
    spread = tokens.groupBy("h", "component").agg(F.count("*").alias("held"))
    spread = spread.groupBy("h").agg(F.sum("held").alias("held"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    node = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(node) + F.row_number().over(node.orderBy("held", "h"))
    as_index = F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)) + 1
    as_probe = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    placed = tokens.join(spread, "h").withColumn("i", place).where(F.col("i") <= as_probe)
    return placed.groupBy("node").agg(F.collect_list(F.when(F.col("i") <= as_index, F.col("h"))).alias("index"), F.collect_list("h").alias("probe"))


def within_reach(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Rows of ``left`` and ``right`` of one key and block, of different components, whose sets may reach the threshold.

    Columns end in _a on the left and _b on the right.  Sizes, the sketches of the full
    sets and the prefixes tell; a pair of which either end is in the key's main component comes once.
    """
    by_size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    by_sets = differing_bits("p_a", "p_b", SET_BITS) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    meet = F.when(smaller, F.arrays_overlap("index_a", "probe_b")).otherwise(F.arrays_overlap("probe_a", "index_b"))
    return left.join(right, ["key", "block"]).where("c_a <> c_b and (c_b = m_b or a < b)").where(by_size).where(by_sets).where(meet)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, slack: float = 0.2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, name (the text's hash by Spark) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows with 100 * intersection >= percent * union of their distinct k-word
    shingles (ASCII lower case) are linked; component_id is the smallest doc_id
    reachable; kept: doc_id = component_id.  Null, empty and wordless texts have 0
    shingles and link with nothing.  A row without a doc_id links with nothing, has
    a null component_id and is kept.  Repeated rows are each returned, with the
    same result; rows that share a doc_id but not the text are judged each by its
    own text.  An empty table gives no rows.

    ``bands`` x ``rows`` MinHash samples miss a pair at exactly 0.8 with probability
    (1 - 0.8**6)**40, about 5e-6, and one at 0.85 with 6e-9.  A candidate whose
    sketch estimate lies more than ``slack`` below the threshold (over five standard
    errors) is dropped without the full check.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs, set_name = docs.select("doc_id", "text"), ["set_a", "set_b", "n_shingles"]
    signed_docs = scratch.save(signatures(docs, k, bands, rows), "signatures")
    known = signed_docs.where("n_shingles > 0 and doc_id is not null")
    # Nodes are numbered in the order of their smallest doc_id, so a smallest node leads to a smallest doc_id.
    named = scratch.save(known.groupBy(*set_name).agg(F.min("doc_id").alias("rep")), "names")
    numbered = named.repartitionByRange("rep").sortWithinPartitions("rep", "set_a", "set_b")
    sets = scratch.save(numbered.withColumn("node", F.monotonically_increasing_id()), "sets")
    rows_of_sets = known.select("doc_id", "name", *set_name).join(sets, set_name)
    one_text = rows_of_sets.where("doc_id = rep").groupBy("node").agg(F.first("rep").alias("doc_id"), F.min("name").alias("name"))
    one_text = scratch.save(one_text, "chosen")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    classes = signed_docs.select("doc_id", "name", *set_name).join(sets, set_name, "left")
    classes = scratch.save(classes.select("doc_id", "n_shingles", own("node"), own("rep"), "name"), "classes")
    arrays = known.groupBy(*set_name).agg(*(F.first(c).alias(c) for c in ("keys", "sketch", "parity")))
    reps = arrays.join(sets, set_name).select(F.col("node").alias("id"), "n_shingles", "keys", "sketch", "parity")
    reps = scratch.save(reps, "representatives")
    scratch.drop(signed_docs, named)

    banded = reps.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(shared.select("key", "centre"), "shared")
    members = scratch.save(banded.join(shared, "key"), "members")
    sketches = reps.select("id", "n_shingles", "sketch", "parity")
    limit = most_differing_bits(bands * rows, percent / 100 - slack)
    by_size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    by_samples = differing_bits("s_a", "s_b", SKETCH_BITS) <= limit
    by_sets = differing_bits("p_a", "p_b", SET_BITS) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)

    def side(x: str) -> DataFrame:
        """Columns of one end of a pair, named for it."""
        return sketches.select(F.col("id").alias(x), *(F.col(c).alias(f"{c[0]}_{x}") for c in ("n_shingles", "sketch", "parity")))

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that may reach the threshold, by set sizes and sketches."""
        return pairs.join(side("b"), "b").join(side("a"), "a").where(by_size & by_samples & by_sets).select("a", "b")

    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    tried = scratch.save(plausible(stars), "stars")
    in_buckets = one_text.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    texts = docs.withColumn("name", F.xxhash64("text")).join(in_buckets, ["doc_id", "name"]).select("node", "text")
    texts = scratch.save(texts.dropDuplicates(["node"]), "texts")
    links = scratch.save(confirm(tried, texts, k, percent), "links")
    labels = components(links, scratch)

    arrays_of = None
    for last in (False, True):
        labelled = members.select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
        labelled = labelled.select("key", "id", F.coalesce("component", "id").alias("component"))
        by_component = labelled.groupBy("key", "component").agg(F.count("*").alias("held"))
        main = F.max(F.struct("held", "component"))["component"].alias("main")
        mixed = by_component.groupBy("key").agg(main, F.count("*").alias("parts"), F.ceil(F.sum("held") / BLOCK).alias("blocks"))
        open_ = scratch.save(labelled.join(mixed.where("parts > 1"), "key").drop("parts"), "open")
        if open_.isEmpty():
            break
        if arrays_of is None:  # components only grow, so the prefixes of the first round hold for the second
            inside = open_.select(F.col("id").alias("node"), "component").distinct()
            tokens = scratch.save(set_tokens(inside.join(texts, "node"), k), "tokens")
            found = prefixes(tokens, percent).withColumnRenamed("node", "id").join(sketches.select("id", "n_shingles", "parity"), "id")
            arrays_of = scratch.save(found, "prefixes")
            scratch.drop(tokens)
        # Of two members in different components, one at least is outside the bucket's main component.
        # A large bucket is cut into blocks; its members outside the main component meet each of them.
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        names = {"id": "{}", "component": "c_{}", "main": "m_{}", "n_shingles": "n_{}", "parity": "p_{}", "index": "index_{}", "probe": "probe_{}"}
        end = lambda rows_, x: rows_.join(arrays_of, "id").select("key", "block", *(F.col(c).alias(n.format(x)) for c, n in names.items()))
        left = end(open_.where("component <> main").withColumn("block", every), "a")
        right = end(open_.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")), "b")
        across = within_reach(left, right, percent)
        if last:
            pairs = across.select("a", "b")
        else:  # first each with its best partner in each other component
            best = F.min(F.struct(differing_bits("p_a", "p_b", SET_BITS).alias("d"), F.col("b"))).alias("best")
            pairs = across.groupBy("a", "c_b").agg(best).select("a", F.col("best.b").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = scratch.save(plausible(pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        found = scratch.save(confirm(pairs, texts, k, percent), "links")
        if not found.isEmpty():
            links = scratch.save(links.union(found), "links")
            labels = components(links, scratch)
        tried = tried.union(pairs)
        scratch.drop(open_)

    low = sets.select(F.col("node").alias("component"), F.col("rep").alias("low"))
    lows = scratch.save(labels.join(low, "component").select("node", "low"), "lows")
    scratch.drop(sets, one_text, reps, shared, members, texts, links, labels)
    # A row that links with nothing has no node, or no component beyond its class.
    low = F.coalesce("low", "rep", "doc_id")
    out = classes.join(lows, "node", "left")
    return out.select("doc_id", "n_shingles", low.alias("component_id"), F.col("doc_id").eqNullSafe(low).alias("kept"), "name")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` doesn't keep, and with one row of each repeated (doc_id, text).

    A row goes by its doc_id and its text, so another text under the same doc_id
    stays.  Rows without a doc_id, and any other columns, stay as they are.
    """
    own, back = set_aside(docs, ["doc_id", "text"])
    scratch = Scratch(docs.sparkSession, "near")
    row = ["doc_id", "name"]
    judged = near_duplicates(own, k, percent).where("doc_id is not null").groupBy(*row).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    # Only rows that go or repeat are joined; of those that repeat and stay, one comes back.
    judged = scratch.save(judged.where("not kept or n > 1"), "judged")
    own = own.withColumn("name", F.xxhash64("text"))
    once = own.join(judged.select(*row), row, "left_anti")
    again = own.join(judged.where("kept").select(*row), row, "left_semi").dropDuplicates(row)
    return back(once.unionByName(again))
