"""Each stage of the pipeline against a plain version on the same input, and odd rows through all of them."""

import math

import public_tokenizers
import pyarrow as pa
import pytest
import test_minhash
import test_quality
import test_substring
import test_toxicity
from helpers import documents, empty, labels, odd_rows
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import toxicity
from tallyloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, by name."""
    docs, scratch, out = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, SF), name)
        out[name] = docs, after
        docs = after
    return out


@pytest.fixture(scope="module")
def known(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_in_order_keep_columns(stages):
    assert list(stages) == ["quality", "toxicity", "near_dedup", "substring_dedup", "packing"]
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns


def test_long_texts_reach_a_task_in_small_batches(spark, stages, tmp_path):
    """an executor held batches of 64 MB, in its own memory and in that of its Python workers."""
    spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1 << 20) as text").write.parquet(f"{tmp_path}/long")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    got = spark.read.parquet(f"{tmp_path}/long").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 40 and max(r.bytes for r in got) < 6 << 20


def test_limits_of_the_session_stay(spark, stages):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    other.conf.set(key, "2m")
    seen = corpus_pipeline.in_small_batches(lambda s, docs, sf_dir: {k: s.conf.get(k) for k in corpus_pipeline.BATCHES})(other, None, SF)
    assert seen == corpus_pipeline.BATCHES | {key: "2m"} and {k: spark.conf.get(k) for k in seen} == corpus_pipeline.BATCHES


def test_quality_drops_what_the_plain_model_rejects(stages, known):
    before, after = stages["quality"]
    rows = [(r.doc_id, r.text, r.lang) for r in before.collect()]
    trusted = {i for i, r in known.items() if r.quality == 1}
    decided = test_quality.plain_decisions(rows, trusted, test_quality.folds_of(before))
    sure = [abs(w[2] / w[3] - 1) > 1e-4 if w[2] else True for w in decided]  # not at the limit itself
    kept = set(ids(after))
    assert all((r[0] in kept) != w[4] for r, w, s in zip(rows, decided, sure) if s)
    gone = [known[r[0]] for r in rows if r[0] not in kept and r[0] in known]
    assert gone and sum(r.quality == 0 for r in gone) >= 0.8 * len(gone)


def best_stretch(scores, a, b):
    """(score, begin, end) of the best-scoring stretch within a to b; 0 where no score is positive."""
    best, total, begin = (0.0, a, a), 0.0, a
    for i in range(a, b):
        if total <= 0:
            total, begin = 0.0, i
        total += scores[i]
        if total > best[0]:
            best = total, begin, i + 1
    return best


def test_toxicity_drops_what_the_plain_scan_rejects(stages, spark):
    before, after = stages["toxicity"]
    model = toxicity.fit_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    own, stem = (dict(zip(k.tolist(), v.tolist())) for k, v in ((model.token_keys, model.token_scores), (model.stem_keys, model.stem_scores)))
    first_four = lambda w: w.decode("utf-8", "replace")[: toxicity.STEM].encode()
    kept = set(ids(after))
    for r in before.collect():
        words = test_toxicity.plain_tokens(r.text)
        scores = [own.get(test_toxicity.key(w), stem.get(test_toxicity.key(first_four(w)), 0.0)) - model.drift for w in words]
        segments, todo = [], [(0, len(scores))]
        while todo:  # by definition: the best stretch, then the same on either side of it
            a, b = todo.pop()
            best, i, j = best_stretch(scores, a, b)
            if best > 0:
                segments.append(best)
                todo += [(a, i), (j, b)]
        score = 1 / (1 + math.exp(-(model.slope * math.log1p(model.surprise(segments, len(words))) + model.shift)))
        if abs(score - 0.5) > 0.02:
            assert (r.doc_id in kept) == (score < 0.5)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted(i for i, (_, _, kept) in test_minhash.brute(rows, 5, 80).items() if kept)


def test_substring_dedup_cuts_what_brute_force_cuts(stages):
    before, after = stages["substring_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = test_substring.brute(rows, 50)
    texts = {i: want[i, t][2].decode() if want[i, t][1] else t for i, t in rows}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in texts.items()}


def test_packing_fills_the_fewest_sequences(stages):
    before, after = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    rows = after.collect()
    held, rooms = {}, []
    for r in rows:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert held == n
    for length in sorted((r.length for r in rows), reverse=True):  # best-fit decreasing, piece by piece
        fits = [room for room in rooms if room >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 1024) - length)
    assert len({r.sequence_id for r in rows}) == len(rooms)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    labels(spark, [(3, 1, 0), (4, 1, 0), (9, 0, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    for source in (documents(spark, odd_rows() + [(None, "no id here at all", "en", "s", 3)]), empty(spark)):
        docs, scratch = source.withColumnRenamed("source", "a.b"), Scratch(spark, "t")
        for name, stage in corpus_pipeline.STAGES:
            out = scratch.save(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
