"""Quality: Kneser-Ney, folds, thresholds and decisions against plain Python; labelled rows; odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import BASE, documents, empty, labels, odd_rows
from pyspark.sql import functions as F

from tallyloom.llm import quality, queries
from tallyloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def plain_symbols(text):
    """Bytes of the words with a blank after each, REPEAT for a repeated word, two blanks before all."""
    out, last = [32, 32], None
    for word in (text or "").encode().split():
        out += [quality.REPEAT] if word == last else [*word, 32]
        last = word
    return out


def plain_trigrams(text):
    s = plain_symbols(text)
    return list(zip(s, s[1:], s[2:]))


class PlainModel:
    """Interpolated modified Kneser-Ney by its formulas, over ``alphabet`` and one more symbol."""

    def __init__(self, texts, alphabet):
        self.size = len(alphabet) + 1
        three = Counter(g for t in texts for g in plain_trigrams(t))
        two = Counter((b, c) for _, b, c in three)
        self.one = Counter(c for _, c in two)
        self.levels = [self.level(three), self.level(two)]

    @staticmethod
    def level(counts):
        n = [sum(v == i for v in counts.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = []
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i
            d.append(min(max(raw, 0.1 * i), 0.9 * i))
        total, left = defaultdict(int), defaultdict(float)
        for g, v in counts.items():
            total[g[:-1]] += v
            left[g[:-1]] += d[min(v, 3) - 1]
        return counts, d, total, left

    def p(self, a, b, c):
        value = quality.SPREAD / self.size + ((1 - quality.SPREAD) * self.one[c] / sum(self.one.values()) if self.one else 0)
        if not self.one:
            value = 1 / self.size
        for gram, (counts, d, total, left) in (((b, c), self.levels[1]), ((a, b, c), self.levels[0])):
            context, n = gram[:-1], counts.get(gram, 0)
            if context in total:
                value = (n - d[min(n, 3) - 1] if n else 0) / total[context] + left[context] / total[context] * value
        return value

    def perplexity(self, text):
        grams = plain_trigrams(text)
        return math.exp(-sum(math.log(self.p(*g)) for g in grams) / len(grams)) if grams else None


def plain_decisions(rows, trusted, folds, quantile=0.99, prior=50, pull=5):
    """(perplexity, symbols, adjusted, threshold, rejected) of each (doc_id, text, lang); folds: by doc_id."""
    of_trusted = [r for r in rows if r[0] in trusted]
    alphabet = {c for _, t, _ in of_trusted for c in plain_symbols(t)[2:]} | {32}
    held = []
    for f in range(quality.FOLDS):
        model = PlainModel([t for i, t, _ in of_trusted if folds[i] != f], alphabet)
        held += [(lang, len(plain_trigrams(t)), model.perplexity(t)) for i, t, lang in of_trusted if folds[i] == f and plain_trigrams(t)]
    rank = lambda values, share: sorted(values)[max(math.ceil(share * len(values)), 1) - 1]
    usual = rank([math.log(p) for _, _, p in held], 0.5)
    adjust = lambda n, p: math.exp((math.log(p) * n + prior * usual) / (n + prior))
    pooled = rank([adjust(n, p) for _, n, p in held], quantile)
    limits = {}
    for lang in {g for g, _, _ in held if g}:
        own = [adjust(n, p) for g, n, p in held if g == lang]
        q = rank(own, quantile)
        limits[lang] = max(q, math.exp((len(own) * math.log(q) + pull * math.log(pooled)) / (len(own) + pull)))
    model, out = PlainModel([t for _, t, _ in of_trusted], alphabet), []
    for _, t, lang in rows:
        p, n, limit = model.perplexity(t), len(plain_trigrams(t)), limits.get(lang, pooled)
        adjusted = None if p is None else adjust(n, p)
        out.append((p, n, adjusted, limit, p is None or adjusted > limit))
    return out


def folds_of(docs):
    fold = F.pmod(F.floor(quality.part_of(F.col("doc_id")) / 7), F.lit(quality.FOLDS)).alias("f")
    return {r.doc_id: r.f for r in docs.select("doc_id", fold).collect()}


def small_corpus():
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))
    rows = []
    for i in range(60):
        letters, lang = ("abcde", "x") if i % 3 else ("fghij", "y")
        words = [word(letters) for _ in range(rng.randint(3, 25))]
        rows.append((i, " ".join(words) + (" " + words[-1]) * (i % 4), lang))
    rows += [(60, "!!! ### é @@@", "x"), (61, "a a a a a a a a a", "x"), (62, "fgh jig", None), (63, "", "x"), (64, None, "y"), (5, rows[5][1], "x")]
    return rows


def test_perplexities_and_decisions_are_those_of_the_definition(spark):
    rows = small_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = set(range(0, 50)) | {63}
    known = labels(spark, [(i, 1, 0) for i in trusted] + [(i, 0, 0) for i in (50, 60, 3)])
    got = quality.score_quality(docs, known, quantile=0.9, prior=5, pull=5).collect()
    key = lambda i, t, lang: (i, t or "", lang or "")
    want = {key(*r): w for r, w in zip(rows, plain_decisions(rows, trusted, folds_of(docs), 0.9, 5, 5))}
    assert len(got) == len(rows)
    for r in got:
        p, n, adjusted, limit, rejected = want[key(r.doc_id, r.text, r.lang)]
        assert math.isclose(r.threshold, limit, rel_tol=1e-4) and r.rejected == rejected
        if p is None:
            assert r.perplexity is None
        else:
            assert math.isclose(r.perplexity, p, rel_tol=1e-4) and r.symbols == n and math.isclose(r.adjusted, adjusted, rel_tol=1e-4)
    assert {r.doc_id for r in got if r.rejected} >= {60, 63, 64}


def test_probabilities_sum_to_one(spark):
    text = spark.createDataFrame([(0, "the cat sat on the mat the the the end"), (1, "a cat and a rat")], "fold int, text string")
    scratch = Scratch(spark, "t")
    for model in quality.kneser_ney(scratch.save(quality.fold_counts(text), "counts"), scratch):
        assert np.allclose(np.exp(model.logs).reshape(model.size, model.size, -1).sum(-1), 1, atol=1e-4)
        n, p = model.perplexity(pa.array(["the cat", None, "", "quite other"]))
        assert n.tolist() == [8, 0, 0, 12] and p[3] > p[0] > 1


def test_quality_on_labelled_rows(spark):
    got = queries.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    bad, good = got.where("quality = 0"), got.where("quality = 1")
    assert bad.where("rejected").count() / bad.count() > 0.95
    assert good.where("rejected").count() / good.count() < 0.02


def test_threshold_of_a_rare_language(spark):
    """Forty trusted documents of a rare language set a threshold of their own."""
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(40))
    rows = [(i, text("abcde"), "common") for i in range(6000)] + [(i, text("fghijklmnopqrstuvwxyz"), "rare") for i in range(6000, 6050)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = quality.score_quality(docs, labels(spark, [(i, 1, 0) for i in range(6040)]))
    assert got.where("lang = 'rare' and rejected").count() <= 2
    limits = {r.lang: r.threshold for r in got.select("lang", "threshold").distinct().collect()}
    assert limits["rare"] > 1.5 * limits["common"]


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())  # has columns named perplexity, rejected and score
    out = quality.score_quality(docs, labels(spark, [(3, 1, 0), (4, 1, 1), (8, 0, 0)]))
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert {r.doc_id for r in out.where("rejected").collect()} >= {0, 1, 2} and out.count() == docs.count()
    assert quality.score_quality(docs, labels(spark)).where("rejected").count() == 3
    assert quality.score_quality(empty(spark), labels(spark)).count() == 0


def plain_longer(rows, trusted, folds, order):
    """(perplexity, symbols, perplexity without the own fold) of each (doc_id, text, lang), by models of ``order`` symbols."""

    def grams(text):
        s = [32] * (order - 1) + plain_symbols(text)[2:]
        return [tuple(s[i : i + order]) for i in range(len(s) - order + 1)]

    class Longer:
        def __init__(self, texts):
            counts = Counter(g for t in texts for g in grams(t))
            self.levels = [PlainModel.level(counts)]
            while len(next(iter(counts), ())) > 2:
                counts = Counter(g[1:] for g in counts)
                self.levels.append(PlainModel.level(counts))
            self.one = Counter(g[1:] for g in counts)

        def p(self, gram):
            value = quality.SPREAD / size + (1 - quality.SPREAD) * self.one[gram[-1:]] / sum(self.one.values()) if self.one else 1 / size
            for counts, d, total, left in reversed(self.levels):
                g = gram[len(gram) - len(next(iter(counts), gram)) :]
                if g[:-1] in total:
                    n = counts.get(g, 0)
                    value = ((n - d[min(n, 3) - 1] if n else 0) + left[g[:-1]] * value) / total[g[:-1]]
            return value

        def perplexity(self, text):
            found = grams(text)
            return math.exp(-sum(math.log(self.p(g)) for g in found) / len(found)) if found else None

    of_trusted = [r for r in rows if r[0] in trusted]
    size = len({c for _, t, _ in of_trusted for c in plain_symbols(t)[2:]} | {32}) + 1
    models = [Longer([t for i, t, _ in of_trusted if folds[i] != f]) for f in range(quality.FOLDS)]
    full = Longer([t for _, t, _ in of_trusted])
    return [(full.perplexity(t), len(grams(t)), models[folds[i]].perplexity(t) if i in trusted else None) for i, t, _ in rows]


@pytest.mark.parametrize("order", [4, 5, 7])
def test_longer_ngrams_are_counted_joined_and_scored_by_the_definition(spark, monkeypatch, order):
    monkeypatch.setattr(quality, "BLOCK", 200)  # several blocks of a fold, and rounds
    rows = small_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    trusted = set(range(0, 50)) | {63}
    folds = folds_of(docs)
    want = {(i, t): w for (i, t, _), w in zip(rows, plain_longer(rows, trusted, folds, order))}
    known = labels(spark, [(i, 1, 0) for i in trusted] + [(i, 0, 0) for i in (50, 60, 3)])
    got = quality.score_quality(docs, known, quantile=0.9, prior=5, pull=5, order=order).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, t or "") for i, t, _ in rows)
    rank = lambda values, share: sorted(values)[max(math.ceil(share * len(values)), 1) - 1]
    held = [(g, want[i, t][1], want[i, t][2]) for i, t, g in rows if want[i, t][2]]
    usual = rank([math.log(p) for _, _, p in held], 0.5)
    adjust = lambda n, p: math.exp((math.log(p) * n + 5 * usual) / (n + 5))
    pooled = rank([adjust(n, p) for _, n, p in held], 0.9)
    for r in got:
        p, n, _ = want[r.doc_id, r.text]
        assert r.symbols == n and (r.perplexity is None) == (p is None)
        assert p is None or math.isclose(r.perplexity, p, rel_tol=1e-4) and math.isclose(r.adjusted, adjust(n, p), rel_tol=1e-4)
        own = [adjust(m, q) for g, m, q in held if g == r.lang]
        limit = max(rank(own, 0.9), math.exp((len(own) * math.log(rank(own, 0.9)) + 5 * math.log(pooled)) / (len(own) + 5))) if r.lang else pooled
        assert math.isclose(r.threshold, limit, rel_tol=1e-4) and r.rejected == (p is None or adjust(n, p) > limit)


def test_the_query_joins_ngrams_of_four_symbols(spark):
    """What a context of two bytes can't see: perplexities differ from those of trigrams, and bad rows stand out more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op10_quality(spark, SF).select("doc_id", "perplexity").join(known, "doc_id")
    old = quality.score_quality(docs, known).select("doc_id", F.col("perplexity").alias("old"))
    of = {r.quality: r.d for r in got.join(old, "doc_id").groupBy("quality").agg(F.median(F.log(F.col("perplexity") / F.col("old"))).alias("d")).collect()}
    assert of[1] < -0.1 and of[0] > of[1]


def test_longer_ngrams_of_odd_rows(spark):
    docs = documents(spark, odd_rows())
    out = quality.score_quality(docs, labels(spark, [(3, 1, 0), (4, 1, 1), (8, 0, 0)]), order=5)
    assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert {r.doc_id for r in out.where("rejected").collect()} >= {0, 1, 2} and out.count() == docs.count()
    assert quality.score_quality(docs, labels(spark), order=5).where("rejected").count() == 3
    assert quality.score_quality(empty(spark), labels(spark), order=5).count() == 0
    nulls = spark.createDataFrame([(None, BASE, "en"), (None, BASE, None), (1, BASE, "en"), (1, BASE, "en")], "doc_id long, text string, lang string")
    assert quality.score_quality(nulls, labels(spark, [(1, 1, 0)]), order=5).count() == 4
