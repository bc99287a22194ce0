"""Masked pseudo-likelihood: gradient, a plain score, independence of partitions, odd rows."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from helpers import documents, empty, odd_rows

from tallyloom.llm import masked_lm
from tallyloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


def test_gradient():
    rng = np.random.default_rng(0)
    parts = rng.integers(1, 100, masked_lm.RARE * masked_lm.STARTS)
    flat = masked_lm.start_weights(rng.integers(1, 100, masked_lm.PAD), parts).astype(np.float64)
    flat += rng.standard_normal(len(flat)) * 0.05
    ids, at = rng.integers(0, masked_lm.FREQUENT, 40), np.array([0, 3, 3, 4, 40])
    ids[::2] = masked_lm.COMPOSED + rng.integers(0, len(parts), 20)
    seq, _ = masked_lm.padded(ids, at)

    def loss(f):
        w = masked_lm.views(f)
        return -sum(masked_lm.Pass(w, seq, a, b).log_probabilities().sum() for a, b in masked_lm.batches_of(seq))

    g = np.zeros(masked_lm.SIZE)
    masked_lm.summed_gradient(masked_lm.views(flat), ids, at, g)
    for part in masked_lm.views(np.arange(masked_lm.SIZE)).values():
        place = part.ravel()
        place = place[np.abs(g[place]) > 1e-4]
        for i in rng.choice(place, 8):
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert math.isclose((loss(up) - loss(down)) / 2e-5, g[i], rel_tol=1e-3, abs_tol=1e-6)


def random_pass(scale, lengths):
    """Weights, a padded sequence with words put together, and the ids and offsets it was made of."""
    rng = np.random.default_rng(1)
    parts = rng.integers(1, 100, masked_lm.RARE * masked_lm.STARTS)
    flat = masked_lm.start_weights(rng.integers(1, 100, masked_lm.PAD), parts).astype(np.float64)
    flat = flat * scale + rng.standard_normal(len(flat)) * 0.05
    at = np.cumsum([0, *lengths])
    ids = rng.integers(0, masked_lm.FREQUENT, at[-1])
    ids[::2] = masked_lm.COMPOSED + rng.integers(0, len(parts), len(ids[::2]))
    return flat, masked_lm.padded(ids, at)[0], ids, at


@pytest.mark.parametrize("scale", [1, 300])
def test_blocks_dont_change_a_pass(monkeypatch, scale):
    """Also where logits lie beyond 60."""
    flat, seq, ids, at = random_pass(scale, [0, 1, 60, 0, 239])
    w, most = masked_lm.views(flat), 0
    outputs, begins = masked_lm.composed(seq)
    want = []
    for i in range(masked_lm.SIDE, len(seq) - masked_lm.SIDE):
        if seq[i] == masked_lm.PAD:
            want.append(0.0)
            continue
        h = np.tanh(np.concatenate([w["table"][outputs[i + d]] + w["starts"][begins[i + d]] for d in masked_lm.SHIFTS]) @ w["w1"] + w["b1"])
        c, m = divmod(outputs[i], masked_lm.MEMBERS)
        levels = [(h @ w["wc"] + w["bc"], c), (h @ w["wm"][c] + w["bm"][c], m)]
        if begins[i] < masked_lm.STARTS:
            levels.append((h @ w["ws"] + w["bs"][m], begins[i]))
        most = max(most, max(np.abs(logits).max() for logits, _ in levels))
        levels = [(np.clip(logits, -60, 60), j) for logits, j in levels]
        want.append(sum(logits[j] - math.log(np.exp(logits).sum()) for logits, j in levels))
    assert (most > 60) == (scale > 1)
    sums = []
    for block in (1, 7, 448):
        monkeypatch.setattr(masked_lm, "BLOCK", block)
        got = np.concatenate([masked_lm.Pass(w, seq, a, b).log_probabilities() for a, b in masked_lm.batches_of(seq)])
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
        sums.append(np.zeros(masked_lm.SIZE))
        masked_lm.summed_gradient(w, ids, at, sums[-1])
        np.testing.assert_allclose(sums[-1], sums[0], rtol=1e-9, atol=1e-9)


def test_a_pass_holds_nothing_as_wide_as_a_softmax():
    """Rows of a softmax exist for a block of tokens, which stays in cache; all that a pass holds for each token is less than two of them."""
    n = 50_000
    flat, seq, _, _ = random_pass(1, [n])
    w, into = masked_lm.views(flat.astype(np.float32)), masked_lm.views(np.zeros(masked_lm.SIZE, np.float32))
    for use in (lambda p: p.log_probabilities(), lambda p: p.gradient(into)):
        tracemalloc.start()
        use(masked_lm.Pass(w, seq, masked_lm.SIDE, len(seq) - masked_lm.SIDE))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < n * 4 * 2 * masked_lm.MEMBERS


def plain_scores(texts, known, counts, flat):
    """Log-likelihoods by loops, from the words themselves."""
    from tallyloom.llm.arrays import hash_runs, signed

    w = masked_lm.views(flat.astype(np.float64))
    hashes = lambda word: np.frombuffer(word, np.uint8)
    key = lambda word: int(signed(hash_runs(hashes(word), np.array([0]), np.array([len(word)])))[0])
    rank = {int(x): i for i, x in enumerate(known.words[: masked_lm.FREQUENT])}

    def parts(word):
        one = lambda x: int(hash_runs(hashes(x), np.array([0]), np.array([len(x)]))[0])
        return one(word[-2:]) % masked_lm.RARE, one(word[:3]) % masked_lm.STARTS

    def output(word):
        """The word's output, and its beginning if it is put together."""
        if key(word) in rank:
            return rank[key(word)], masked_lm.STARTS
        return masked_lm.FREQUENT + parts(word)[0], parts(word)[1]

    totals = Counter()
    for word, n in counts.items():
        totals[output(word)] += n
    out = []
    for text in texts:
        words = text.lower().encode().split()
        ids, pad = [output(x) for x in words], (masked_lm.PAD, masked_lm.STARTS)
        total = 0.0
        for i, (t, begin) in enumerate(ids):
            near = [ids[i + d] if 0 <= i + d < len(ids) else pad for d in masked_lm.SHIFTS]
            x = np.concatenate([w["table"][o] + w["starts"][s] for o, s in near])
            h = np.tanh(x @ w["w1"] + w["b1"])
            c, m = divmod(t, masked_lm.MEMBERS)
            levels = [(h @ w["wc"] + w["bc"], c), (h @ w["wm"][c] + w["bm"][c], m)]
            if t >= masked_lm.FREQUENT:
                levels.append((h @ w["ws"] + w["bs"][m], begin))
                total += math.log(counts[words[i]] / totals[t, begin])
            for logits, j in levels:
                total += logits[j] - math.log(np.exp(logits).sum())
        out.append(total)
    return out


def test_scores_are_those_of_the_definition(spark, monkeypatch):
    """Words beyond the frequent ones, some known to every task and some joined, against loops."""
    monkeypatch.setattr(masked_lm, "KNOWN", 7000)
    rng = np.random.default_rng(3)
    numbers = [v for v in range(6000) for _ in range(2 + v % 3)] + list(range(6000, 8000))
    rng.shuffle(numbers)
    texts = [" ".join(f"w{v}" for v in numbers[i : i + 250]) for i in range(0, len(numbers), 250)]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).select("doc_id", "text")
    kept = {}
    train = masked_lm.train

    def remembered(*args):
        kept["known"], kept["flat"] = args[1], train(*args)
        return kept["flat"]

    monkeypatch.setattr(masked_lm, "train", remembered)
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score_documents(docs, steps=3).collect()}
    assert masked_lm.FREQUENT < len(kept["known"].words) <= 7000
    counts = Counter(x for t in texts for x in t.encode().split())
    want = plain_scores(texts, kept["known"], counts, kept["flat"])
    assert all(math.isclose(got[i], v, rel_tol=1e-4, abs_tol=1e-3) for i, v in enumerate(want))


def test_word_counts_are_of_all_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counts = Scratch(spark, "t").save(masked_lm.word_counts(docs), "counts")
    want = Counter(x for r in docs.collect() for x in r.text.encode().lower().split())
    assert sorted(r.n for r in counts.collect()) == sorted(want.values())
    known = masked_lm.vocabulary(counts)
    assert known.output_counts().sum() == sum(want.values())


@pytest.fixture(scope="module")
def by_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = {}
    for n in (1, 4, 16, 64):
        rows = masked_lm.score_documents(docs.repartition(n), steps=16).collect()
        out[n] = {r.doc_id: (r.n_tokens, r.log_likelihood) for r in rows}
    return docs, out


def test_partitions_dont_change_the_scores(by_partitions):
    _, scores = by_partitions
    for n in (4, 16, 64):
        assert scores[n].keys() == scores[1].keys()
        for i, (tokens, value) in scores[n].items():
            assert tokens == scores[1][i][0]
            assert abs(value - scores[1][i][1]) <= 0.01 * max(tokens, 1)


def test_neighbours_tell_more_than_frequencies(by_partitions):
    docs, scores = by_partitions
    words = Counter(x for r in docs.collect() for x in r.text.encode().lower().split())
    total = sum(words.values())
    unigram = sum(n * math.log(n / total) for n in words.values()) / total
    for rows in scores.values():
        assert sum(v for _, v in rows.values()) / total > unigram + 0.3


def test_odd_rows(spark):
    rows = {r.doc_id: r for r in masked_lm.score_documents(documents(spark, odd_rows()), steps=4).collect()}
    assert all(rows[i].n_tokens == 0 and rows[i].log_likelihood == 0 and rows[i].mean_log_likelihood is None for i in (0, 1, 2))
    assert rows[7].n_tokens == 60_000 and rows[7].log_likelihood < 0
    assert masked_lm.score_documents(empty(spark), steps=2).count() == 0


def test_a_vocabulary_of_one_level_is_cut_inside_it(spark):
    counts = spark.range(140_000).selectExpr("xxhash64(id) as w", "cast(id % 4096 as int) as part", "1L as n")
    known = masked_lm.vocabulary(Scratch(spark, "t").save(counts, "counts"))
    assert 0.95 * masked_lm.KNOWN < len(known.words) <= masked_lm.KNOWN
    assert known.output_counts().sum() == 140_000


def test_tasks_are_bounded_and_steps_grow():
    for tokens in (0, 10**6, 10**9, 10**14):
        steps = masked_lm.steps_for(tokens)
        assert 32 <= steps <= 64 and 1 <= masked_lm.tasks_for(tokens, steps, 8) <= 16
        assert masked_lm.tasks_for(tokens, steps, 100_000) <= 1024
    assert masked_lm.steps_for(10**9) > masked_lm.steps_for(10**6)
