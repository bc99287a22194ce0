"""Language identification: accuracy on held-out rows, and odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, empty, odd_rows

from tallyloom.llm import langid, queries
from tallyloom.llm.arrays import text_bytes
from tallyloom.llm.samples import reservoir
from tallyloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    got = queries.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert got.count() == 1000 and held.where("lang_pred = lang").count() / held.count() > 0.97


def test_language_of_odd_rows(spark):
    docs = documents(spark, odd_rows()).withColumnRenamed("key", "lang_pred")  # has a score, too
    for source in (docs, docs.where("lang is null"), empty(spark)):
        out = langid.identify(docs, langid.fit_languages(source)).collect()
        assert {r.doc_id for r in out if r.lang_pred == "und"} >= {0, 1, 2}
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)


def plain_margins(text, counts, code):
    """Margins from whole count vectors of each language, n-gram by n-gram."""
    total, n = np.zeros(code.shape[1]), 0
    data = text.encode()
    for k, order in enumerate(langid.ORDERS):
        rates = [(counts[i][k] + 0.5) / (counts[i][k] + 0.5).sum() for i in range(len(code))]
        for at in range(len(data) - order + 1):
            piece = np.frombuffer(data[at : at + order], np.uint8)
            grams = langid.features(piece, langid.classes(piece) == langid.LETTER)[k]
            for j in range(code.shape[1]):
                plus = np.mean([rates[i][grams[0]] for i in range(len(code)) if code[i, j] > 0])
                minus = np.mean([rates[i][grams[0]] for i in range(len(code)) if code[i, j] < 0])
                total[j] += min(max(math.log(plus) - math.log(minus), -4), 4)
            n += 1
    return total / math.sqrt(n)


def test_margins_and_decoding_are_those_of_the_definition(spark):
    texts = {"a": ["the cat sat", "on the mat"], "b": ["der hund lief", "in das haus"], "c": ["le chat noir", "est sur le toit"]}
    rows = [(10 * i + j, t, lang) for i, (lang, ts) in enumerate(texts.items()) for j, t in enumerate(ts)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == ["a", "b", "c"]
    counts = []
    for lang in model.languages:
        count = np.zeros((len(langid.ORDERS), langid.FEATURES))
        for t in texts[lang]:
            data = np.frombuffer(t.encode(), np.uint8)
            for k, grams in enumerate(langid.features(data, langid.classes(data) == langid.LETTER)):
                np.add.at(count[k], grams, 1)
        counts.append(count)
    queries_ = ["the hund", "chat sur", "mat mat mat"]
    margins, has = model.margins(*text_bytes(pa.array(queries_)))
    best, score, close = model.decode(margins)
    assert has.all()
    for i, text in enumerate(queries_):
        want = plain_margins(text, counts, model.code)
        assert np.allclose(margins[i], want, atol=1e-3)
        losses = [sum(math.log1p(math.exp(-c * x)) for c, x in zip(word, want)) for word in model.code]
        low = sorted(losses)
        assert losses[best[i]] == low[0] and close[i] == (low[1] - low[0] < 1.0)
        assert math.isclose(score[i], 1 / sum(math.exp(low[0] - v) for v in losses), rel_tol=1e-3)


def test_every_language_is_learned(spark):
    """More languages than any list would hold, a few documents each, and one that has nearly all rows."""
    rng = np.random.default_rng(5)
    rows = [(i, "common words all over again", "zz") for i in range(2000)]
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    for lang in range(230):
        letters = rng.choice(alphabet, 5, replace=False)
        rows += [(5000 + 10 * lang + j, " ".join("".join(rng.choice(letters, 4)) for _ in range(25)), f"l{lang}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, per_language=100)
    assert len(model.languages) == 231
    got = langid.identify(docs, model).where("lang <> 'zz'")
    assert got.where("lang_pred = lang").count() / got.count() > 0.8


@pytest.mark.parametrize("languages", [2, 3, 9])
def test_codewords_are_apart(languages):
    code = langid.codewords(languages, 15)
    assert len({tuple(c) for c in code}) == languages and all(abs(c.sum()) < languages for c in code.T)


def test_a_language_of_one_repeated_text_is_learned(spark):
    same = spark.range(20_000).selectExpr("1L as doc_id", "'zwölf größere Vögel über den Dächern' as text", "'de' as lang")
    other = spark.range(200).selectExpr("id as doc_id", "concat('twelve of the bigger birds over the roofs ', id) as text", "'en' as lang")
    model = langid.fit_languages(same.union(other), per_language=50)
    asked = spark.createDataFrame([(1, "größere Vögel über"), (2, "the bigger birds over")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()} == {1: "de", 2: "en"}


def test_reservoir_is_bounded_exact_and_the_same_in_any_partitions(spark):
    rows = spark.range(3000).selectExpr("if(id < 2900, 'a', 'b') as k", "if(id < 1000, 0, id) as v")
    got = []
    for parts in (1, 7):
        taken = [tuple(r) for r in reservoir(rows.repartition(parts), "k", ["k", "v"], 150, Scratch(spark, "t")).collect()]
        assert len(taken) == len(set(taken)) == 250 and sum(k == "b" for k, _ in taken) == 100
        got.append(set(taken))
    assert got[0] == got[1]
    assert reservoir(rows.where("false"), "k", ["k", "v"], 5, Scratch(spark, "t")).count() == 0
