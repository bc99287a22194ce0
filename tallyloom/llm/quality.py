"""Quality by an interpolated modified Kneser-Ney model of trusted text.

Symbols are the bytes of the text (white space as one blank) and a mark for a word
equal to the word before it, so that repetition is a sequence the model can find
unlikely.  N-gram counts of trusted text are summed and joined as Spark tables
sharded by context: counts with their context totals and discounts, n-grams with
the continuation counts of the next shorter ones.

Of four symbols or more, the model stays such a table.  Documents lie in blocks of
about ``BLOCK`` bytes; a block sends each of its distinct n-grams once, a shuffled
join finds their probabilities and the weights of their contexts, and what is found
goes back to the block, whose documents then stream past it (:func:`joined_scores`).
N-grams by document would write many times the corpus to disk (the README has
figures); those of a block repeat so much that few are left.

A model of three symbols has at most ``SYMBOLS`` ** 3 entries whatever the corpus,
which is the proven bound under which it is handed to every task.  A document is
rejected if its perplexity exceeds a quantile of the perplexities of trusted
documents of its language, each by the counts of the folds that it is not in.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import hash_runs, slices, text_bytes, words_of
from .columns import set_aside
from .samples import part_of
from .scratch import Scratch

#: All bytes, and the mark of a repeated word.
SYMBOLS, REPEAT, BLANK = 257, 256, 0x20
FOLDS = 4
#: Share of a symbol's probability that is spread over all symbols.
SPREAD = 0.05
#: Size of the bit set of trusted ids.
BITS = 1 << 26
#: An n-gram's number has a digit from 1 to SYMBOLS for each symbol, so that those of all lengths differ.
BASE, LONGEST = SYMBOLS + 1, 7
#: Bytes of text in a block, and into how many shares documents are cut at most, one scored after another to bound the disk.
BLOCK, ROUNDS = 1 << 24, 4
#: Distinct n-grams that a task gathers before it sends them on.
GATHERED = 1 << 21


def symbols(data: np.ndarray, offsets: np.ndarray, pad: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each row, ``pad`` blanks before its first, and each row's offsets."""
    starts, ends, at = words_of(data, offsets)
    hashes = hash_runs(data, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[at[:-1][at[:-1] < len(starts)]] = False
    # Each word gives its bytes and a blank; a repeat gives the mark alone, so marks in a row are each other's context.
    length = np.where(same, 1, ends - starts + 1)
    begin = np.cumsum(length) - length
    rows = len(offsets) - 1
    total = int(length.sum())
    out = np.full(total + pad * rows, BLANK, np.int32)
    row = np.repeat(np.arange(rows), np.diff(at))
    begin = begin + pad * (row + 1)
    plain = np.flatnonzero(~same)
    n = (ends - starts)[plain]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(begin[plain], n) + within] = data[np.repeat(starts[plain], n) + within]
    out[begin[same]] = REPEAT
    upto = np.concatenate([[0], np.cumsum(length)])[at] + pad * np.arange(rows + 1)
    return out, upto


def trigrams(syms: np.ndarray, upto: np.ndarray, size: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's trigram numbers in base ``size``, one after another, and each row's offsets into them."""
    if len(syms) < 3:
        return np.zeros(0, np.int64), np.zeros(len(upto), np.int64)
    keys = (syms[:-2].astype(np.int64) * size + syms[1:-1]) * size + syms[2:]
    counts = np.maximum(np.diff(upto) - 2, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(at[-1]) - np.repeat(at[:-1] - upto[:-1], counts)
    return keys[place], at


def ngrams(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams that end in each symbol of each text, ``order`` - 1 blanks before its first, and each text's offsets."""
    syms, upto = symbols(*text_bytes(column), order - 1)
    if len(syms) < order:
        return np.zeros(0, np.int64), np.zeros(len(upto), np.int64)
    keys = np.zeros(len(syms) - order + 1, np.int64)
    for i in range(order):
        keys = keys * BASE + syms[i : i + len(keys)] + 1
    counts = np.diff(upto) - (order - 1)
    at = np.concatenate([[0], np.cumsum(counts)])
    return keys[np.arange(at[-1]) + np.repeat(np.arange(len(counts)) * (order - 1), counts)], at


def suffix(key, length: int):
    """The last ``length`` symbols of an n-gram (array or column)."""
    return key % BASE**length


def fold_counts(docs: DataFrame) -> DataFrame:
    """(fold, a, b, c, n): trigram counts over all (fold, text); a task sends a sum for each trigram it has seen in a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found, at = trigrams(*symbols(*text_bytes(part.column("text"))))
                fold = np.repeat(part.column("fold").to_numpy().astype(np.int64), np.diff(at))
                found, n = np.unique(fold * SYMBOLS**3 + found, return_counts=True)
                every = np.concatenate([keys, found])
                keys, which = np.unique(every, return_inverse=True)
                sums = np.bincount(which, np.concatenate([sums, n]), len(keys)).astype(np.int64)
        columns = [keys // SYMBOLS**3, keys // SYMBOLS**2 % SYMBOLS, keys // SYMBOLS % SYMBOLS, keys % SYMBOLS]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(sums)], ["fold", "a", "b", "c", "n"])

    sums = docs.select("fold", "text").mapInArrow(run, "fold int, a int, b int, c int, n long")
    return sums.groupBy("fold", "a", "b", "c").agg(F.sum("n").alias("n"))


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(fold, key, n): counts of n-grams over all (fold, text); a task sends a sum for each that it has seen since it last sent."""
    shift = BASE**order

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def sent(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys // shift).astype(np.int32)), pa.array(keys % shift), pa.array(n)], ["fold", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                found, at = ngrams(part.column("text"), order)
                fold = np.repeat(part.column("fold").to_numpy().astype(np.int64), np.diff(at))
                parts.append(np.unique(fold * shift + found, return_counts=True))
                waiting += len(parts[-1][0])
                if waiting > 2 * GATHERED:
                    parts = [merged(parts)]
                    waiting = len(parts[0][0])
                    if waiting > GATHERED:
                        yield sent(*parts[0])
                        parts, waiting = [], 0
        if parts:
            yield sent(*merged(parts))

    sums = docs.select("fold", "text").mapInArrow(run, "fold int, key long, n long")
    return sums.groupBy("fold", "key").agg(F.sum("n").alias("n"))


def _discounted(grams: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """Modified Kneser-Ney over (m, context..., symbol, n), for each model m: grams with their discounted share
    of the context (main), and contexts with the mass that the lower order gets (left)."""
    how_many = {f"n{i}": F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double") for i in (1, 2, 3, 4)}
    levels = grams.groupBy("m").agg(*(v.alias(k) for k, v in how_many.items()))
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    values = [1 - 2 * y * F.try_divide("n2", "n1"), 2 - 3 * y * F.try_divide("n3", "n2"), 3 - 4 * y * F.try_divide("n4", "n3")]
    bounded = [F.least(F.greatest(F.coalesce(v, F.lit(0.5 * i)), F.lit(0.1 * i)), F.lit(0.9 * i)) for i, v in enumerate(values, 1)]
    levels = levels.select("m", *(v.alias(f"d{i}") for i, v in enumerate(bounded, 1)))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut_grams = grams.join(F.broadcast(levels), "m").withColumn("cut", cut)  # a row for each model
    totals = cut_grams.groupBy("m", *context).agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("left"))
    main = ((F.col("n") - F.col("cut")) / F.col("total")).alias("main")
    joined = cut_grams.join(totals, ["m", *context])
    return joined.select(*(c for c in grams.columns if c != "n"), main), totals.select("m", *context, "left")


class Model:
    """Dense natural log-probabilities over the symbols that trusted text has, and one symbol for all others."""

    def __init__(self, code: np.ndarray, logs: np.ndarray):
        self.code, self.size, self.logs = code, int(code.max()) + 1, logs

    def perplexity(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of symbols and perplexity per symbol of each text (without words: 0 and 1)."""
        syms, upto = symbols(*text_bytes(column))
        keys, at = trigrams(self.code[syms], upto, self.size)
        sums = np.concatenate([[0.0], np.cumsum(self.logs[keys], dtype=np.float64)])
        n = np.diff(at)
        return n, np.exp(-(sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1))


def kneser_ney(counts: DataFrame, scratch: Scratch, folds: int = FOLDS) -> list[Model]:
    """Models from trigram counts by fold: one without each fold, and last that of all, by joins of count tables sharded by context."""
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))).alias("m")
    grams = counts.select(models, "a", "b", "c", "n").groupBy("m", "a", "b", "c").agg(F.sum("n").alias("n"))
    grams = scratch.save(grams, "grams")
    three, left3 = _discounted(grams, ["a", "b"])
    pairs = scratch.save(grams.groupBy("m", "b", "c").agg(F.count("*").alias("n")), "pairs")  # contexts before each bigram
    two, left2 = _discounted(pairs, ["b"])
    one = pairs.groupBy("m", "c").agg(F.count("*").alias("n"))
    shares = one.join(F.broadcast(one.groupBy("m").agg(F.sum("n").alias("total"))), "m")  # a row for each model
    # Each table below is bounded by the symbols, not by the corpus.
    read = lambda df, *names: [c.to_numpy() for c in df.select(*names).toArrow().columns]
    m1, c1, p = read(shares.withColumn("p", F.col("n") / F.col("total")), "m", "c", "p")
    code = np.zeros(SYMBOLS, np.int64)  # symbols that trusted text lacks share 0
    seen = np.unique(np.append(c1, BLANK))
    code[seen] = 1 + np.arange(len(seen))
    k = len(seen) + 1
    tables3 = read(three, "m", "a", "b", "c", "main"), read(left3, "m", "a", "b", "left")
    tables2 = read(two, "m", "b", "c", "main"), read(left2, "m", "b", "left")
    out = []
    for m in range(folds + 1):
        p1 = np.full(k, SPREAD / k)
        p1[code[c1[m1 == m]]] += (1 - SPREAD) * p[m1 == m]
        p2 = np.ones((k, 1)) * np.ones((1, k))
        mm, b, left = tables2[1]
        p2[code[b[mm == m]]] = left[mm == m][:, None]
        p2 *= p1 / p1.sum()
        mm, b, c, main = tables2[0]
        p2[code[b[mm == m]], code[c[mm == m]]] += main[mm == m]
        left3_ = np.ones((k, k))
        mm, a, b, left = tables3[1]
        left3_[code[a[mm == m]], code[b[mm == m]]] = left[mm == m]
        p3 = left3_[:, :, None] * p2[None, :, :]
        mm, a, b, c, main = tables3[0]
        p3[code[a[mm == m]], code[b[mm == m]], code[c[mm == m]]] += main[mm == m]
        out.append(Model(code, np.log(p3).astype(np.float32).ravel()))
    scratch.drop(grams, pairs)
    return out


def joined_model(counts: DataFrame, order: int, scratch: Scratch, folds: int = FOLDS) -> tuple[DataFrame, list[float]]:
    """Models from counts of n-grams by fold, as for :func:`kneser_ney`, but as one table, by joins of count tables sharded by context.

    A row for each n-gram of 1 to ``order`` symbols (key) and in p0, p1, ... its log-probability by each
    model, in w0, w1, ... the log-weight that a longer n-gram, unseen after it, gives to the shorter one.
    The list has each model's log-probability of a symbol it hasn't seen.
    """
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))).alias("m")
    grams = scratch.save(counts.select(models, "key", "n").groupBy("m", "key").agg(F.sum("n").alias("n")), f"grams{order}")
    levels = {order: grams}
    for k in range(order - 1, 0, -1):  # how many symbols stand before each shorter n-gram
        shorter = levels[k + 1].groupBy("m", suffix(F.col("key"), k).alias("key")).agg(F.count("*").alias("n"))
        levels[k] = scratch.save(shorter, f"grams{k}")
    totals = {r["m"]: r["n"] for r in levels[1].groupBy("m").agg(F.sum("n").alias("n")).collect()}  # a row for each model
    seen = levels[1].select("key").union(grams.sparkSession.range(BLANK + 1, BLANK + 2)).distinct().count()
    size = seen + 1  # symbols that trusted text lacks count as one
    unseen = [math.log((SPREAD if totals.get(m) else 1) / size) for m in range(folds + 1)]
    share = levels[1].join(F.broadcast(levels[1].groupBy("m").agg(F.sum("n").alias("total"))), "m")
    probability = scratch.save(share.select("m", "key", (SPREAD / size + (1 - SPREAD) * F.col("n") / F.col("total")).alias("p")), "p1")
    tables, weights = [probability], []
    for k in range(2, order + 1):
        context = F.expr(f"key div {BASE}L").alias("context")
        main, left = _discounted(levels[k].select("m", context, "key", "n"), ["context"])
        left = scratch.save(left, f"left{k}")
        lower = probability.select("m", F.col("key").alias("suffix"), F.col("p").alias("lower"))
        main = main.join(left, ["m", "context"]).withColumn("suffix", suffix(F.col("key"), k - 1)).join(lower, ["m", "suffix"])
        probability = scratch.save(main.select("m", "key", (F.col("main") + F.col("left") * F.col("lower")).alias("p")), f"p{k}")
        tables.append(probability)
        weights.append(left.select("m", F.col("context").alias("key"), F.lit(None).cast("double").alias("p"), F.col("left").alias("w")))
    rows = [t.withColumn("w", F.lit(None).cast("double")) for t in tables] + weights
    of = lambda c, m: F.max(F.when(F.col("m") == m, F.log(c))).cast("float").alias(f"{c}{m}")
    wide = functools.reduce(DataFrame.union, rows).groupBy("key").agg(*(of(c, m) for m in range(folds + 1) for c in "pw"))
    wide = scratch.save(wide, "model")
    scratch.drop(*levels.values(), *tables)
    return wide, unseen


def block_grams(docs: DataFrame, order: int) -> DataFrame:
    """(block, key) of all n-grams, and of the shorter ones and contexts they may fall back on, once for each block and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, list[np.ndarray]] = {}
        sizes: dict[int, int] = {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks).tolist():
                for part in slices(batch.filter(pa.array(blocks == block)), "text"):
                    keys = np.unique(ngrams(part.column("text"), order)[0])
                    gathered.setdefault(block, []).append(keys)
                    sizes[block] = sizes.get(block, 0) + len(keys)
                    if sizes[block] > 2 * GATHERED:
                        gathered[block] = [np.unique(np.concatenate(gathered[block]))]
                        sizes[block] = len(gathered[block][0]) // 2  # what is merged may double before it is merged again
        for block, parts in gathered.items():
            keys = np.unique(np.concatenate(parts))
            before = keys // BASE  # contexts: at the start of a text no n-gram ends in them
            for k in range(order, 0, -1):
                ends = np.unique(np.concatenate([suffix(keys, k), suffix(before, k)])) if k < order else keys
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), block, np.int64)), pa.array(ends)], ["block", "key"])

    return docs.select("block", "text").mapInArrow(run, "block long, key long")


def log_probabilities(keys: np.ndarray, order: int, known: np.ndarray, p: np.ndarray, w: np.ndarray, unseen: float) -> np.ndarray:
    """Of each n-gram, by what a block has found: sorted ``known`` with log-probabilities and weights (NaN: none)."""
    out = np.zeros(len(keys))
    if not len(known):
        return out + unseen
    left = np.arange(len(keys))

    def found(wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, values[at], np.nan)

    for k in range(order, 0, -1):
        value = found(suffix(keys[left], k), p)
        missing = np.isnan(value)
        out[left[~missing]] += value[~missing]
        left = left[missing]
        if k > 1 and len(left):
            weight = found(suffix(keys[left] // BASE, k - 1), w)
            out[left] += np.where(np.isnan(weight), 0.0, weight)  # a context that the model lacks leaves all to the shorter one
    out[left] += unseen
    return out


def block_scores(rows: DataFrame, order: int, unseen: list[float], likely: np.ndarray) -> DataFrame:
    """(id, id2, symbols, perplexity, held_out) of each text; rows come by block, what the block has found before its texts."""
    shared = rows.sparkSession.sparkContext.broadcast(likely)  # BITS bits
    per_symbol = lambda logs, at: np.exp(-np.diff(np.concatenate([[0.0], np.cumsum(logs)])[at]) / np.maximum(np.diff(at), 1))

    def texts(part: pa.RecordBatch, fold: int, known: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        keys, at = ngrams(part.column("text"), order)
        n = np.diff(at)
        trusted = in_set(part.column("bit"), shared.value).to_numpy(zero_copy_only=False)
        held = np.zeros(len(n))
        own = keys[np.repeat(trusted, n)]
        held[trusted] = per_symbol(log_probabilities(own, order, known, *values[2:], unseen[fold]), np.concatenate([[0], np.cumsum(n[trusted])]))
        full = per_symbol(log_probabilities(keys, order, known, *values[:2], unseen[FOLDS]), at)
        columns = [part.column("id"), part.column("id2"), pa.array(n, pa.int64()), pa.array(full, mask=n == 0), pa.array(held, mask=(n == 0) | ~trusted)]
        return pa.RecordBatch.from_arrays(columns, ["id", "id2", "symbols", "perplexity", "held_out"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, gathered, table = None, [], None
        for batch in batches:
            blocks, is_text = batch.column("block").to_numpy(), batch.column("is_text").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(is_text.astype(np.int8)) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == end:
                    continue
                if blocks[start] != last:
                    last, gathered, table = blocks[start], [], None
                piece = batch.slice(start, end - start)
                if not is_text[start]:
                    gathered.append([piece.column(c).to_numpy(zero_copy_only=False) for c in ("id", "p", "w", "held_p", "held_w")])
                    continue
                if table is None:
                    columns = [np.concatenate(c) for c in zip(*gathered)] if gathered else [np.zeros(0, t) for t in (np.int64, *[np.float32] * 4)]
                    by_key = np.argsort(columns[0])
                    table, gathered = [c[by_key] for c in columns], []
                fold = int(piece.column("fold")[0].as_py())
                for part in slices(piece, "text"):
                    yield texts(part, fold, table[0], table[1:])

    return rows.mapInArrow(run, "id long, id2 long, symbols long, perplexity double, held_out double")


def row_ids() -> list[Column]:
    """128 bits that tell rows of (doc_id, text) apart."""
    return [F.xxhash64("doc_id", "text").alias("id"), F.xxhash64("text", "doc_id").alias("id2")]


def joined_scores(docs: DataFrame, fold: Column, model: DataFrame, unseen: list[float], order: int, likely: np.ndarray, scratch: Scratch) -> DataFrame:
    """(id, id2, symbols, perplexity, held_out): each (doc_id, text) by the model of all folds, and by that without its own
    fold where its bit is in the set of trusted ids (null: not in it, or no words).

    A block has documents of one fold, so its distinct n-grams are looked up by two models
    in one join.  A block's texts are shuffled to it twice, and no more than one share of
    the blocks at a time; a long or a repeated text makes its block longer, but nothing
    holds a block's texts at once.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    per_fold = max(1, math.ceil(size / FOLDS / BLOCK))
    rounds = min(ROUNDS, per_fold)
    block = F.col("fold").cast("long") * per_fold + F.pmod("id", F.lit(per_fold))
    rows = docs.select(*row_ids(), fold, bit_of("doc_id"), "text").withColumn("block", block)
    count = math.ceil(FOLDS * per_fold / rounds)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    looked_up = ["p", "w", "held_p", "held_w"]
    own = lambda c: F.element_at(F.array(*(f"{c}{m}" for m in range(FOLDS))), F.floor(F.col("block") / per_fold).cast("int") + 1)
    out = []
    for turn in range(rounds):
        share = rows.where(F.col("block") % rounds == turn)
        to = F.floor(F.col("block") / rounds).cast("int")  # a task for each block
        wanted = block_grams(share.repartitionById(count, to), order)
        found = wanted.join(model.hint("merge"), "key").select("block", F.col("key").alias("id"), f"p{FOLDS}", f"w{FOLDS}", own("p"), own("w"))
        found = scratch.save(found.toDF("block", "id", *looked_up), "found")
        keys = found.select("block", F.lit(False).alias("is_text"), "id", *none("long", "id2", "bit"), *none("int", "fold"), *none("string", "text"), *looked_up)
        texts = share.select("block", F.lit(True).alias("is_text"), "id", "id2", "bit", "fold", "text", *none("float", *looked_up))
        by_block = keys.union(texts).repartitionById(count, to).sortWithinPartitions("block", "is_text")
        scores = block_scores(by_block, order, unseen, likely).dropDuplicates(["id", "id2"])
        out.append(scratch.save(scores, "scores"))
        scratch.drop(found)
    return functools.reduce(DataFrame.union, out)


def scored(docs: DataFrame, models: list[Model], likely: np.ndarray | None = None) -> DataFrame:
    """``docs`` with ``symbols`` and ``perplexity`` (null without words) by the model that its column ``fold`` names.

    With a bit set, only the rows whose column ``bit`` is in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((models, likely))  # at most SYMBOLS ** 3 numbers each, and BITS bits
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, likely = shared.value
        for batch in batches:
            if likely is not None:
                batch = batch.filter(in_set(batch.column("bit"), likely))
            folds = batch.column("fold").to_numpy()
            for fold in np.unique(folds).tolist():
                for part in slices(batch.filter(pa.array(folds == fold)), "text", 1 << 18):
                    n, value = models[fold].perplexity(part.column("text"))
                    columns = [*part.columns, pa.array(n, pa.int64()), pa.array(value, pa.float64(), mask=n == 0)]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "symbols", "perplexity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, symbols long, perplexity double")


def bit_of(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BITS)).alias("bit")


def bit_set(ids: DataFrame) -> np.ndarray:
    """The bits of all doc_ids as 32-bit words: 8 MB, whatever their number.  It keeps most other rows, and their texts, from a join."""
    found = ids.select(bit_of("doc_id")).groupBy(F.floor(F.col("bit") / 32).alias("at"))
    found = found.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits")).toArrow()
    words = np.zeros(BITS // 32, np.uint32)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return words


def in_set(bits: pa.Array, words: np.ndarray) -> pa.Array:
    at = bits.to_numpy()
    return pa.array((words[at // 32] >> (at % 32).astype(np.uint32) & np.uint32(1)) > 0)


def likely_rows(docs: DataFrame, likely: np.ndarray) -> DataFrame:
    """Rows of (doc_id, bit, text) whose bit is in the set."""
    shared = docs.sparkSession.sparkContext.broadcast(likely)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(in_set(batch.column("bit"), shared.value))

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "bit", "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, bit long, text string")


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, prior: int = 50, pull: int = 5, order: int = 3) -> DataFrame:
    """``docs`` with symbols, perplexity, adjusted and threshold double, and rejected boolean.

    Trusted text: all rows whose doc_id has a quality label of 1 (of several labels
    one is enough).  All of it is counted.  For the thresholds every trusted row is
    scored by a model of the other folds; a language's threshold is the ``quantile``
    of its rows, pulled up towards that of all languages as by ``pull`` rows where that
    one is higher (a language without trusted rows, and null, take that one).  A short text says little, so
    what is compared is the perplexity adjusted by ``prior`` symbols of median
    trusted text.  Null, empty and wordless texts have no perplexity and are
    rejected; with no trusted text nothing else is.  ``docs`` needs doc_id, text and
    lang; other columns stay, but one with the name of a new column gives way to it.
    Repeated rows count and are returned each; an empty table gives no rows.  ``order``
    is the number of symbols in an n-gram, 3 to ``LONGEST``.
    """
    if not 3 <= order <= LONGEST:
        raise ValueError(f"order must be 3 to {LONGEST}, not {order}")
    scratch = Scratch(docs.sparkSession, "quality")
    own, back = set_aside(docs, ["doc_id", "text", "lang"])
    known = scratch.save(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct(), "trusted")
    fold = F.pmod(F.floor(part_of(F.col("doc_id")) / 7), F.lit(FOLDS)).cast("int").alias("fold")
    likely = bit_set(known)
    with_id = own.where("doc_id is not null").select("doc_id", "text", "lang", fold, bit_of("doc_id"))
    texts = likely_rows(with_id, likely).join(known.hint("merge"), "doc_id", "left_semi")
    if order == 3:
        models = kneser_ney(scratch.save(fold_counts(texts.select(fold, "text")), "counts"), scratch)
        held_out = scored(with_id, models[:FOLDS], likely)
    else:
        model, unseen = joined_model(gram_counts(texts.select(fold, "text"), order), order, scratch)
        scores = joined_scores(own, fold, model, unseen, order, likely, scratch)
        scratch.drop(model)
        held = scores.where("held_out is not null").select("id", "id2", "symbols", F.col("held_out").alias("perplexity"))
        held_out = with_id.select("doc_id", "lang", *row_ids()).hint("merge").join(held, ["id", "id2"])
    held_out = held_out.where("perplexity is not null").select("doc_id", "lang", "symbols", "perplexity").join(known, "doc_id", "left_semi")
    held_out = scratch.save(held_out, "held_out")
    # Ranks to one in 100,000: the memory of an exact quantile would grow with the trusted rows.
    at = lambda column, share: F.percentile_approx(column, share, 100_000)
    usual = held_out.agg(at(F.log("perplexity"), 0.5).alias("m")).first()["m"] or 0.0
    adjusted = F.exp((F.log("perplexity") * F.col("symbols") + prior * usual) / (F.col("symbols") + prior))
    rows = held_out.withColumn("adjusted", adjusted)
    pooled = rows.agg(at("adjusted", quantile).alias("q")).first()["q"]
    pooled = float("inf") if pooled is None else pooled
    pulled = F.greatest("q", F.exp((F.col("n") * F.log("q") + pull * F.log(F.lit(pooled))) / (F.col("n") + pull)))
    limits = rows.where("lang is not null").groupBy("lang").agg(at("adjusted", quantile).alias("q"), F.count("*").alias("n"))
    limits = scratch.save(limits.select("lang", pulled.alias("threshold")), "limits")  # a row for each language
    scratch.drop(known, held_out)
    if order == 3:
        out = scored(own.withColumn("fold", F.lit(0)), models[FOLDS:])
    else:
        out = own.select("*", *row_ids()).hint("merge").join(scores.drop("held_out"), ["id", "id2"], "left")
    out = out.withColumn("adjusted", adjusted)
    out = out.join(limits, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(pooled)))
    out = out.withColumn("rejected", F.col("perplexity").isNull() | (F.col("adjusted") > F.col("threshold")))
    return back(out, "symbols", "perplexity", "adjusted", "threshold", "rejected")
