import hashlib
import random

from helpers import BASE, documents, empty, odd_rows

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.substring import SuffixAutomaton, remove_repeats, substring_digests


def brute(rows, length):
    """By (doc_id, text): n_words, n_removed, kept text."""
    starts = {}
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            starts[key] = min(starts.get(key, i), i)
    out = {}
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        gone = set()
        for j in range(len(w) - length + 1):
            if starts[tuple(w[j : j + length])] < i:
                gone.update(range(j, j + length))
        out[i, text] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def check(spark, rows, length, gram):
    docs, want = documents(spark, rows), brute(rows, length)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_digests(docs, length, gram).collect())
    assert got == sorted((i, *want[i, t][:2], hashlib.sha256(want[i, t][2]).hexdigest()) for i, t, *_ in rows)
    kept = remove_repeats(docs, length, gram)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, want[i, t][2].decode() if want[i, t][1] else t or "") for i, t, *_ in rows)


def test_odd_rows(spark):
    check(spark, odd_rows(), 50, 20)
    assert substring_digests(empty(spark)).count() == 0
    alone = documents(spark, [(None, BASE, "en", "s", 1), (1, BASE, "en", "s", 1)])
    assert sorted(r.text for r in remove_repeats(alone).collect()) == [BASE, BASE]
    assert [r.n_removed for r in substring_digests(alone).collect()] == [0, 0]


def test_passages_copies_and_repeats(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(50)}" for _ in range(n)]
    shared = [words(rng.randrange(8, 40)) for _ in range(6)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(1, 4)):
            text += words(rng.randrange(0, 20)) + (rng.choice(shared) if rng.random() < 0.8 else []) * rng.randrange(1, 3)
        rows.append((i, " ".join(text), "en", "s", 1))
    rows += [(i + 100, rows[i][1], "en", "s", 1) for i in range(0, 80, 7)]
    rows += [(3, " ".join(shared[0] + shared[1]), "en", "s", 1)]  # one id, two texts
    rng.shuffle(rows)
    check(spark, rows, 10, 4)


def test_automaton_finds_what_search_finds():
    rng = random.Random(1)
    for _ in range(100):
        passages = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 25))], rng.randrange(5)) for _ in range(4)]
        text = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(40)]
        machine = SuffixAutomaton()
        for words, owner in passages:
            machine.add(words, owner)
        machine.finish()
        for below in (0, 2, 9):
            want = [e for e in range(2, 40) if any(p[j : j + 3] == text[e - 2 : e + 1] for p, o in passages if o < below for j in range(len(p) - 2))]
            assert machine.matches(text, 3, below) == want


def test_repeated_rows_stay_linear(spark, monkeypatch):
    """Two documents that share a passage, each repeated 50 times: the tables inside don't grow with the repeats squared."""
    written, save = [], Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    rows = [(1, "one " + BASE, "en", "s", 1)] * 50 + [(2, BASE + " two", "en", "s", 1)] * 50
    check(spark, rows, 50, 20)
    assert all(n <= 100 for _, n in written), written


def test_columns_with_odd_names_stay(spark):
    docs = documents(spark, [(1, BASE, "en", "s", 1), (2, BASE + " x", "en", "s", 1)])
    docs = docs.withColumnRenamed("source", "a.b").withColumnRenamed("found", "name").withColumnRenamed("ids", "__new").withColumnRenamed("key", "__id")
    out = remove_repeats(docs)
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == sorted([BASE, "x"])
