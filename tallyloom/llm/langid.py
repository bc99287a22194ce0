"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1; one binary classifier per bit tells
the languages with +1 from those with -1 by hashed letter n-grams.  A text's bits
are real margins; decoding adds, for each codeword, the logistic loss of all its
bits and takes the codeword with the least loss, so a sure bit outweighs doubtful
ones and a few wrong bits are corrected.  A text whose two best codewords are
close is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, slices, text_bytes
from .bpe import LETTER, classes
from .columns import set_aside
from .samples import reservoir
from .scratch import Scratch

BITS = 14
FEATURES = 1 << BITS
ORDERS = (2, 3, 4)


def features(data: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
    """For each order, the hashed n-gram that starts at each byte; all but letters is one blank."""
    data = np.where(letters, LOWER[data], 0x20).astype(np.uint32)
    out = []
    for n in ORDERS:
        if len(data) < n:
            out.append(np.zeros(0, np.int32))
            continue
        h = np.full(len(data) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Sums of the n-gram values that lie inside each row; values start at each byte but the last n - 1."""
    begin, end = offsets[:-1], np.maximum(offsets[1:] - n + 1, offsets[:-1])
    has = np.flatnonzero(end > begin)
    out = np.zeros(len(begin))
    if len(has):
        pairs = np.empty(2 * len(has), np.int64)
        pairs[::2], pairs[1::2] = begin[has], end[has]
        out[has] = np.add.reduceat(np.append(values, values[:1] * 0), pairs)[::2]
    return out


def code_bits(languages: int) -> int:
    return max(7, 4 * math.ceil(math.log2(max(languages, 2))) + 3) if languages > 1 else 1


def codewords(languages: int, bits: int) -> np.ndarray:
    """A code of +1 and -1 with distinct rows far apart; every bit splits the languages.

    The best of some random codes, fewer of them for very many languages.
    """
    if languages < 2:
        return np.ones((languages, bits), int)
    best, found = 0, None
    for seed in range(10_000):
        if found is not None and seed * languages**2 > 200 * 1000**2 or seed >= 200 and found is not None:
            break
        rng = np.random.default_rng(seed)
        code = rng.choice([-1, 1], size=(languages, bits))
        for j in np.flatnonzero(np.abs(code.sum(0)) == languages):
            code[rng.integers(languages), j] *= -1
        apart = min(int((bits - code[i + 1 :] @ code[i]).min()) // 2 for i in range(languages - 1))
        if apart > best:
            best, found = apart, code
    return found


class LanguageModel:
    """Languages, their codewords, and for each order of n-gram and each bit the weight of each feature."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's margins per bit, and whether it has a letter."""
        letters = classes(data) == LETTER
        total, n_grams = np.zeros((len(offsets) - 1, self.code.shape[1])), np.zeros(len(offsets) - 1)
        for grams, n, w in zip(features(data, letters), ORDERS, self.weights):
            for j in range(total.shape[1] if len(grams) else 0):
                total[:, j] += row_sums(w[j][grams], offsets, n)
            n_grams += np.maximum(np.diff(offsets) - n + 1, 0)
        has = np.concatenate([[0], np.cumsum(letters)])
        # Overlapping n-grams aren't independent: evidence grows with the root of their number.
        return total / np.sqrt(np.maximum(n_grams, 1))[:, None], has[offsets[1:]] > has[offsets[:-1]]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of certainty in 0..1, and whether the second best is close."""
        loss = np.logaddexp(0, -self.code[None, :, :] * margins[:, None, :]).sum(-1)
        best = loss.argmin(1)
        weight = np.exp(-(loss - loss.min(1, keepdims=True)))
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + 10
        return best, 1 / weight.sum(1), second - loss.min(1) < 1.0


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(l, f, n): how often each feature occurs in the sampled texts of each language (l, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                langs = part.column("l").to_numpy()
                for lang in np.unique(langs).tolist():
                    count = np.zeros(len(ORDERS) * FEATURES, np.int64)
                    for i in np.flatnonzero(langs == lang).tolist():
                        data, _ = text_bytes(part.column("text").slice(i, 1))
                        for k, grams in enumerate(features(data, classes(data) == LETTER) if len(data) else []):
                            count[k * FEATURES : (k + 1) * FEATURES] += np.bincount(grams, minlength=FEATURES)
                    at = np.flatnonzero(count)
                    columns = [pa.array(np.full(len(at), lang, np.int32)), pa.array(at, pa.int32()), pa.array(count[at])]
                    yield pa.RecordBatch.from_arrays(columns, ["l", "f", "n"])

    return sample.mapInArrow(run, "l int, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n"))


def _weights(counts: DataFrame, code: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Each bit's log-ratio of the mean feature rates of its two sides.

    The sums over languages are formed in Spark, so the driver gets one row for each
    feature whatever the number of languages.
    """
    spark, (m, bits) = counts.sparkSession, code.shape
    order = F.floor(F.col("f") / FEATURES).cast("int").alias("o")
    totals = scratch.save(counts.groupBy("l", order).agg(F.sum("n").alias("total")), "totals")
    by_order = np.zeros((m, len(ORDERS)))
    for r in totals.collect():  # a row for each language and order
        by_order[r["l"], r["o"]] = r["total"]
    smooth = by_order + 0.5 * FEATURES
    words = spark.createDataFrame([(i, [int(v) for v in code[i]]) for i in range(m)], "l int, code array<int>")
    share = counts.withColumn("o", order).join(totals, ["l", "o"]).join(words, "l")
    share = share.withColumn("x", F.col("n") / (F.col("total") + 0.5 * FEATURES))
    sides = [F.sum(F.when(F.col("code")[j] > 0, F.col("x")).otherwise(0.0)).alias(f"plus{j}") for j in range(bits)]
    found = share.groupBy("f").agg(F.sum("x").alias("all"), *sides).toArrow()  # at most len(ORDERS) * FEATURES rows
    at = found["f"].to_numpy()
    every, out = found["all"].to_numpy(), np.zeros((len(ORDERS) * FEATURES, bits), np.float32)
    for j in range(bits):
        plus = code[:, j] > 0
        if plus.all() or not plus.any():
            continue
        base = [np.repeat((0.5 / smooth[side]).mean(0), FEATURES) for side in (plus, ~plus)]
        sums = found[f"plus{j}"].to_numpy()
        base[0][at] += sums / plus.sum()
        base[1][at] += np.maximum(every - sums, 0) / (~plus).sum()
        out[:, j] = np.clip(np.log(base[0]) - np.log(base[1]), -4, 4)
    return np.ascontiguousarray(out.reshape(len(ORDERS), FEATURES, bits).transpose(0, 2, 1))


def fit_languages(docs: DataFrame, per_language: int = 3000) -> LanguageModel:
    """From texts with a non-null lang: at most ``per_language`` distinct rows of each, chosen by a hash of the row.

    Every value of lang is learned; the driver holds a name and a codeword for each.
    Null texts count for nothing; repeated rows count once; other columns are
    ignored.  Without any language the model knows none.
    """
    scratch = Scratch(docs.sparkSession, "languages")
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sample = scratch.save(reservoir(labelled, "lang", ["lang", "doc_id", "text"], per_language, scratch), "sample")
    languages = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    code = codewords(len(languages), code_bits(len(languages)))
    if not languages:
        return LanguageModel([], code, np.zeros((len(ORDERS), 1, FEATURES), np.float32))
    numbered = docs.sparkSession.createDataFrame(list(zip(languages, range(len(languages)))), "lang string, l int")
    sample = sample.join(F.broadcast(numbered), "lang").select("l", "text")  # the driver's own list of languages
    counts = scratch.save(_gram_counts(sample), "grams")
    weights = _weights(counts, code, scratch)
    return LanguageModel(languages, code, weights)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous.

    A text that is null or has no letter, and any text under a model without
    languages, is ``und`` with score 0; of codewords equally near the first language's wins.  ``docs`` needs a text; a column with the
    name of a new one gives way to it.  Repeated rows get a row each; an empty table
    gives none.
    """
    own, back = set_aside(docs, ["text"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # len(ORDERS) * FEATURES numbers for each bit
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        labels = np.array([*model.languages, "und"], object)
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                best, score, close, has = np.zeros(part.num_rows, int), np.zeros(part.num_rows), *(np.zeros(part.num_rows, bool) for _ in "ab")
                if model.languages:
                    margins, has = model.margins(*text_bytes(part.column("text")))
                    best, score, close = model.decode(margins)
                best, score = np.where(has, best, len(model.languages)), np.where(has, score, 0.0)
                columns = [*part.columns, pa.array(labels[best].tolist(), pa.string()), pa.array(score), pa.array(close & has)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return back(own.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean"), "lang_pred", "score", "ambiguous")
