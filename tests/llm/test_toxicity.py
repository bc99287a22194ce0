"""Toxicity: segments, odds, extreme values and calibration against plain Python; recall and precision on held-out rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents, empty, labels, odd_rows

from tallyloom.llm import queries, toxicity
from tallyloom.llm.arrays import hash_runs, signed
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.toxicity import fit_toxicity

SF = "/root/testdata/sf0.01"


def test_maximal_segments_are_those_of_the_definition():
    """Recursive definition: the best-scoring stretch, then the same on either side of it."""

    def brute(scores, a, b):
        best = max(((round(sum(scores[i:j]), 9), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, _, i, j = best
        return brute(scores, a, i) + [(i, j - 1, best[0])] + brute(scores, j, b)

    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([rng.random() * 3 + 0.1, -0.3]) if rng.random() < 0.4 else -rng.random() for _ in range(14)]
        got = toxicity.maximal_segments(np.array(scores))
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute(scores, 0, 14)]


def plain_odds(t, c, share, owned):
    """By the integrals of the two beta priors, numerically."""
    p = (np.arange(200_000) + 0.5) / 200_000
    tight, own = (toxicity.TIGHT * share, toxicity.TIGHT * (1 - share)), toxicity.OWNED
    masses, means = [], []
    for a, b in (tight, own):
        prior = p ** (a - 1) * (1 - p) ** (b - 1)
        post = prior * p**t * (1 - p) ** c
        masses.append(post.sum() / prior.sum())
        means.append((post * p).sum() / post.sum())
    w = owned * masses[1] / (owned * masses[1] + (1 - owned) * masses[0])
    rate = w * means[1] + (1 - w) * means[0]
    return math.log(rate / (1 - rate)) - math.log(share / (1 - share)), w


def test_odds_are_those_of_the_mixture():
    counts = [(0, 0), (1, 0), (0, 1), (5, 0), (5, 1), (3, 40), (0, 60), (20, 2)]
    t, c = np.array(counts).T
    for share, owned in ((0.12, 0.01), (0.4, 0.3)):
        scores, weights = toxicity.log_odds(t, c, share, np.full(len(t), owned))
        for i, (x, y) in enumerate(counts):
            want, w = plain_odds(x, y, share, owned)
            assert math.isclose(scores[i], want, abs_tol=0.02) and math.isclose(weights[i], w, abs_tol=0.01)


def plain_tokens(text):
    out, word = [], b""
    for byte in (text or "").encode().lower() + b" ":
        if chr(byte).isascii() and not chr(byte).isalpha():
            if word:
                out.append(word)
            word = b""
        else:
            word += bytes([byte])
    return out


def key(word):
    return int(signed(hash_runs(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])))[0])


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(6)
    words = ["plain", "house", "tree", "walk", "sing", "cloud", "river"]
    rows, known = [], []
    for i in range(150):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            text[5:7] = [rng.choice(["vilest", "vilely", "grubby"]), "vile"]
        rows.append((i, " ".join(text), "en", "s", 1))
        known.append((i, 1, int(toxic)))
    return documents(spark, rows), labels(spark, known), rows, known


def test_model_counts_and_scale(spark, small):
    docs, known, rows, _ = small
    model = toxicity.fit_toxicity(docs, known)
    from pyspark.sql import functions as F

    held = {r.doc_id for r in docs.where(F.pmod(F.floor(toxicity.part_of(F.col("doc_id")) / 7), F.lit(5)) == 0).collect()}
    train = [(plain_tokens(t), i % 4 == 0) for i, t, *_ in rows if i not in held]
    share = (sum(y for _, y in train) + 1) / (len(train) + 2)
    count = lambda y, cut: Counter(w for ws, z in train if z == y for w in {x[:cut] for x in ws})
    toxic, clean = count(True, None), count(False, None)
    stem_counts = [Counter(), Counter()]
    for side, c in zip(stem_counts, (toxic, clean)):
        for w, n in c.items():
            side[w[:4]] += n
    got = dict(zip(model.token_keys.tolist(), model.token_scores.tolist()))
    assert len(got) == len(set(toxic) | set(clean))
    for w in set(toxic) | set(clean):
        _, owned = plain_odds(stem_counts[0][w[:4]], stem_counts[1][w[:4]], share, toxicity.RARE)
        owned = min(max(owned, toxicity.RARE / 10), 1 - toxicity.RARE)
        assert math.isclose(got[key(w)], plain_odds(toxic[w], clean[w], share, owned)[0], abs_tol=0.05)
    background = np.array([sum(n for w, n in clean.items() if key(w) == k) for k in model.token_keys.tolist()], float)
    mean = float(np.exp(model.scale * (model.token_scores - model.drift)) @ (background / background.sum()))
    assert model.scale >= 7.9 or math.isclose(mean, 1, abs_tol=1e-6)


def test_passages_cover_the_toxic_words(spark, small):
    docs, known, rows, _ = small
    out = toxicity.toxic_passages(docs, toxicity.fit_toxicity(docs, known)).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out)
    for r in out:
        if r.doc_id % 4 == 0:
            assert any(p["first"] <= 6 and p["last"] >= 5 for p in r.passages) and len(r.passages) <= 2


def test_surprise_and_calibration():
    model = toxicity.Model((np.array([1]), np.array([2.0])), (np.array([1]), np.array([2.0])), np.array([0.0]))
    model.scale, model.rate = 1.0, 0.01
    for n, scores in ((100, [3.0]), (100, [3.0, 2.5]), (1000, [9.0, 8.0, 0.1]), (50, [])):
        best, normal = 0.0, sorted((s - math.log(0.01 * n) for s in scores), reverse=True)
        for r in range(1, len(normal) + 1):
            t = sum(normal[:r])
            if t <= 0:
                break
            tail = math.exp(-t) * max(t, 1) ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) * 2**r
            best = max(best, -math.log(tail))
        assert math.isclose(model.surprise(scores, n), best, abs_tol=1e-9)
    rng = np.random.default_rng(0)
    x = rng.random(2000) * 20
    y = rng.random(2000) < 1 / (1 + np.exp(-(2 * np.log1p(x) - 4)))
    slope, shift = toxicity.calibrated(x, y)
    p = 1 / (1 + np.exp(-(slope * np.log1p(x) + shift)))
    assert abs((p - y).mean()) < 1e-3 and abs(slope - 2) < 0.3
    assert toxicity.calibrated(x, np.ones(2000)) is None


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.8), ("sf0.1", 0.9)])
def test_recall_and_precision_on_held_out_rows(spark, sf, least):
    got = queries.op3_toxicity(spark, f"/root/testdata/{sf}")
    held = got.where("held_out").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted and r.toxic for r in held)
    assert right / sum(r.toxic for r in held) > least and right / sum(r.predicted for r in held) > 0.95
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())  # has a column named score
    for known in ((), [(3, 1, 0), (4, 1, 1), (4, 1, 0), (7, None, None)]):
        out = toxicity.toxic_passages(docs, toxicity.fit_toxicity(docs, labels(spark, known)))
        assert len(set(out.columns)) == len(out.columns) == len(docs.columns) + 2
        assert out.where("score between 0 and 1").count() == docs.count()
    assert toxicity.toxic_passages(empty(spark), toxicity.fit_toxicity(empty(spark), labels(spark))).count() == 0


def test_one_labelled_id_on_many_documents_stays_within_the_sample(spark, monkeypatch):
    written, save = {}, Scratch.save

    def counted(self, df, name, **more):
        written[name] = (out := save(self, df, name, **more)).count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    many = spark.range(20_000).selectExpr("7L as doc_id", "concat('some words ', id) as text")
    same = spark.range(20_000).selectExpr("8L as doc_id", "'always the same text' as text")
    others = spark.range(100, 160).selectExpr("id as doc_id", "concat(if(id % 2 = 0, 'vile slur ', 'kind note '), id) as text")
    marks = [(7, 1, 0), (8, 1, 0), *((i, 1, 1 - i % 2) for i in range(100, 160))]
    fit_toxicity(many.union(same).union(others), labels(spark, marks), most=100)
    assert 0 < written["labelled"] <= 100
    # Repeats alone don't fill it: with the 20,000 equal rows every other document is used.
    fit_toxicity(same.union(others), labels(spark, marks), most=100)
    assert written["labelled"] == 61
