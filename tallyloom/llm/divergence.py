"""How far the sources of a language diverge in the words they use, by in-mapper stripes.

Every task folds whole documents into a table of stripes: for each language and term,
the number of documents that hold it and its count in each source.  The table is kept
as one sorted run of (language, term, source) entries that further documents are merged
into; when it exceeds ``ENTRIES`` its stripes are spilled, on their way to the task that
merges all stripes of a key as they arrive, in key order, holding one batch and the
key at hand.  The merged stripes of terms that enough documents hold are written once.
Each of them then gives, by itself, its part of every divergence: how a source's share
differs from any other source's, and from the language's.  Tasks sum the parts of
pairs, and keep only the terms of each group that can be among its first.

Shares are whole numbers (a scale of 10**9), formed by long division in steps that
fit 64 bits, so all results are exact and don't depend on order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, runs, slices, text_bytes
from .scratch import Scratch

#: Entries of a task's table of stripes, and shares (terms x sources) in a block of merged stripes, about.
ENTRIES, SHARES = 400_000, 100_000
#: Letters: A-Z, a-z and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
STRIPE = "lang string, term string, documents long, source array<string>, n array<long>"
ENTRY = ["lang", "term", "source"]


def entries(batch: pa.RecordBatch) -> pa.Table:
    """(lang, term, source, n, documents) of some whole documents (lang, source, text without nulls)."""
    data, offsets = text_bytes(batch.column("text"))
    data = LOWER[data]
    inside = LETTERS[data]
    starts, ends, at = runs(inside, offsets)
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    word, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), np.diff(at))
    # One number for each group and term, and for each document and term.
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    sources = max(1, len(source.dictionary))
    group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
    size = max(1, len(coded.dictionary))
    each, n = np.unique(row * size + word, return_counts=True)
    key, which = np.unique(group[each // size] * size + each % size, return_inverse=True)
    total = np.bincount(which, n, len(key)).astype(np.int64)
    held = np.bincount(which, minlength=len(key)).astype(np.int64)
    term = coded.dictionary.take(pa.array(key % size)).cast(pa.string())
    of = {"lang": lang.dictionary.take(pa.array(key // size // sources)), "source": source.dictionary.take(pa.array(key // size % sources))}
    return pa.table({"lang": of["lang"], "term": term, "source": of["source"], "n": pa.array(total), "documents": pa.array(held)})


def folded(table: pa.Table) -> pa.Table:
    """One row for each (lang, term, source), in that order."""
    out = table.group_by(ENTRY, use_threads=False).aggregate([("n", "sum"), ("documents", "sum")])
    return out.rename_columns({"n_sum": "n", "documents_sum": "documents"}).sort_by([(c, "ascending") for c in ENTRY]).combine_chunks()


def stripes(table: pa.Table) -> pa.RecordBatch:
    """Folded entries as STRIPE rows, one for each (lang, term)."""
    lang, term = table["lang"].combine_chunks(), table["term"].combine_chunks()
    n = len(lang)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    cuts = pa.array(np.append(first, n), pa.int32())
    documents = np.add.reduceat(table["documents"].to_numpy(), first) if n else np.zeros(0, np.int64)
    lists = [pa.ListArray.from_arrays(cuts, table[c].combine_chunks()) for c in ("source", "n")]
    return pa.RecordBatch.from_arrays([lang.take(pa.array(first)), term.take(pa.array(first)), pa.array(documents, pa.int64()), *lists], ["lang", "term", "documents", "source", "n"])


def unfolded(batch: pa.RecordBatch) -> pa.Table:
    """STRIPE rows as entries; a stripe's documents stand with its first."""
    source, n = batch.column("source"), batch.column("n")
    row = pc.list_parent_indices(source)
    each = row.to_numpy()
    documents = np.zeros(len(each), np.int64)
    first = np.searchsorted(each, np.arange(batch.num_rows))
    documents[first] = batch.column("documents").to_numpy()
    columns = {c: batch.column(c).take(row) for c in ("lang", "term")} | {"source": source.flatten(), "n": n.flatten()}
    return pa.table(columns | {"documents": pa.array(documents)})


def document_stripes(docs: DataFrame) -> DataFrame:
    """STRIPE rows of ``docs`` (lang, source, text): about one for each task, language and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                held.append(entries(part))
                size += held[-1].num_rows
                if size > ENTRIES:
                    held = [folded(pa.concat_tables(held))]
                    size = held[0].num_rows
                    if size > ENTRIES // 2:
                        yield from _chunks(held[0])
                        held, size = [], 0
        if size:
            yield from _chunks(folded(pa.concat_tables(held)))

    return docs.select("lang", "source", "text").mapInArrow(run, STRIPE)


def _chunks(table: pa.Table, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    whole = stripes(table)
    for i in range(0, whole.num_rows, rows):
        yield whole.slice(i, rows)


def merged(spilled: DataFrame, least: int) -> DataFrame:
    """One stripe for each (lang, term) that at least ``least`` documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # entries of the key at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            new = unfolded(batch)
            both = folded(pa.concat_tables([held, new]) if held is not None else new)
            last = pc.and_(pc.equal(both["lang"], both["lang"][-1]), pc.equal(both["term"], both["term"][-1]))
            held = both.filter(last)
            out = stripes(both.filter(pc.invert(last)))
            yield out.filter(pc.greater_equal(out.column("documents"), least))
        if held is not None:
            out = stripes(held)
            yield out.filter(pc.greater_equal(out.column("documents"), least))

    key = ["lang", "term"]
    return spilled.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, STRIPE)


def shares(count: np.ndarray, total: np.ndarray, scale_steps: int = 3) -> np.ndarray:
    """1 + floor(1000**scale_steps * count / total), exactly, for 0 <= count <= total < 2**53."""
    out, left = np.zeros(np.broadcast(count, total).shape, np.int64), count % total
    out += count // total
    for _ in range(scale_steps):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def block_parts(own: pa.Table, groups: pa.Table, smoothing: int, top: int) -> pa.Table:
    """What a block of one language's merged stripes adds to its divergences: (lang, source, other, null, value) and (lang, source, null, term, value).

    ``groups``: source and total count of each group, and the number of terms of the language.
    """
    names = groups["source"].to_pylist()
    number = {s: i for i, s in enumerate(names)}
    v, total = groups["v"][0].as_py() or 0, groups["total"].to_numpy()
    source, other, term, value = [], [], [], []
    if own.num_rows:
        flat = unfolded(own.combine_chunks().to_batches()[0])
        counts = np.zeros((len(names), own.num_rows), np.int64)
        row = pc.list_parent_indices(own["source"].combine_chunks()).to_numpy()
        counts[np.array([number[s] for s in flat["source"].to_pylist()]), row] = flat["n"].to_numpy()
        of_all = shares(counts.sum(0) + smoothing, np.int64(total.sum() + smoothing * v))
        of_each = shares(counts + smoothing, (total + smoothing * v)[:, None])
        for i, a in enumerate(names):
            gap = np.abs(of_each[i] - of_each[i + 1 :]).sum(1).tolist()
            source += [a] * len(gap)
            other += names[i + 1 :]
            term += [None] * len(gap)
            value += gap
        terms = own["term"].combine_chunks()
        place = np.empty(len(terms), np.int64)
        place[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
        for i, a in enumerate(names):
            over = of_each[i] - of_all
            more = np.flatnonzero((counts[i] > 0) & (over > 0))
            best = more[np.lexsort((place[more], -over[more]))[:top]]
            source += [a] * len(best)
            other += [None] * len(best)
            term += terms.take(pa.array(best)).to_pylist()
            value += over[best].tolist()
    lang = [groups["lang"][0].as_py()] * len(source)
    strings = [pa.array(x, pa.string()) for x in (lang, source, other, term)]
    return pa.Table.from_arrays([*strings, pa.array(value, pa.int64())], ["lang", "source", "other", "term", "value"])


def source_divergence(docs: DataFrame, least: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs``.

    Part ``pair``: the other sources of the language by how far their shares lie apart, summed over
    the language's terms.  Part ``term``: the ``top`` terms whose share in the group most exceeds
    that in the language.  Terms are runs of letters (A-Z lower-cased) that at least ``least``
    rows of the language hold; a term's share is 1 + floor(10**9 * (count + smoothing) / (N + smoothing * V))
    of the group's N counted terms and the language's V.  Ranks go by value, then by item.

    A null text, lang or source is read as ''.  Groups without terms are compared all the same; a
    language with one source has no pairs.  Repeated rows count each; other columns are ignored;
    an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = scratch.save(merged(document_stripes(read), least), "stripes")
    each = kept.select("lang", F.explode(F.arrays_zip("source", "n")).alias("e"))
    counts = each.groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = read.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = scratch.save(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    # A language's stripes are cut into blocks; each meets all groups of the language, which are fewer than its pairs in the result.
    blocks = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.max("v") * F.count("*") / SHARES)).alias("blocks"))
    blocks = scratch.save(blocks, "blocks")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    left = kept.join(blocks, "lang").select("lang", block, "term", "documents", "source", "n")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    right = groups.join(blocks, "lang").select("lang", every, "source", "total", "v")
    key = ["lang", "block"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        lambda own, groups_: block_parts(own, groups_.sort_by("source"), smoothing, top),
        "lang string, source string, other string, term string, value long",
    )
    parts = scratch.save(parts, "parts")
    sums = parts.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    # Languages without a term have groups, too, all 0 apart.
    one = groups.select("lang", "source", "v")
    none = one.where("v = 0").join(one.select("lang", F.col("source").alias("other")), "lang").where("source < other")
    none = none.select("lang", "source", "other", F.lit(0).cast("long").alias("value"))
    sums = sums.unionByName(none)
    pair = lambda a, b: sums.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(b).alias("item"), "value")
    terms = parts.where("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pair("source", "other").union(pair("other", "source")).union(terms).withColumn("rank", F.row_number().over(order))
    return out.where((F.col("part") == "pair") | (F.col("rank") <= top))
