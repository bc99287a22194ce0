import random
import re
import zlib

import numpy as np
from helpers import documents, empty, odd_rows

from tallyloom.llm.arrays import words_of
from tallyloom.llm.periodic import collapse, find_runs, periodic_runs
from tallyloom.llm.queries import periodic_tail


def plain(words, least):
    """Every stretch of every period, the smallest period of each."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5, 30])
    words = [rng.randint(1, k) for _ in range(n)]
    if n > 10 and rng.random() < 0.6:  # a tail with a period, as in texts that repeat themselves
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(1, 6)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words + words[: rng.randint(0, n)] * (rng.random() < 0.2)


def test_runs_are_those_of_the_definition():
    rng = random.Random(4)
    for _ in range(1500):
        rows, least = [some_words(rng) for _ in range(rng.randint(1, 4))], rng.choice([12, 12, 2, 5])
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        got = find_runs(np.array(sum(rows, []), np.uint64), at, least)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, w in enumerate(rows) for r in plain(w, least)], (rows, least)


def test_one_word_and_fibonacci_words():
    a, b = [1], [1, 2]
    while len(b) < 2000:
        a, b = b, b + a
    for words in ([7] * 3000, b, [1, 2] * 700 + [3] + [1, 2] * 700):
        got = find_runs(np.array(words, np.uint64), np.array([0, len(words)]), 12)
        assert [tuple(r[1:]) for r in got.tolist()] == plain(words, 12)


def test_collapse_joins_what_is_left():
    texts = [b"", b" a  b\tc ", b"x x x x", b"\n", b"last"]
    data, at_bytes = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, at = words_of(data, at_bytes)
    assert collapse(data, starts, ends, at, np.zeros((0, 4), np.int64)).to_pylist() == [b"", b"a b c", b"x x x x", b"", b"last"]
    assert collapse(data, starts, ends, at, np.array([[2, 0, 4, 1], [4, 0, 1, 0]])).to_pylist() == [b"", b"a b c", b"x", b"", b""]


def test_whole_texts_and_odd_rows(spark):
    line = "one two three four five six seven"
    rows = [*odd_rows(), (50, f"a b {line} {line}\n{line} {line} c d", "en", "s", 0), (51, "z " * 40_000, "en", "s", 0)]
    docs = documents(spark, rows)
    out = periodic_runs(docs.withColumnRenamed("found", "runs"))
    assert out.columns == [*[("runs" if c == "found" else c) for c in docs.columns if c != "found"], "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = [tuple(x) for x in r.runs]
        if len(words) < 1000:
            assert runs == plain(words, 12)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert [tuple(x) for x in {r.doc_id: r for r in got}[50].runs] == [(2, 28, 7)]
    assert [tuple(x) for x in {r.doc_id: r for r in got}[51].runs] == [(0, 40_000, 1)]
    assert periodic_runs(empty(spark)).count() == 0


def test_planted_tails(spark):
    texts = [None, "", " ", "one", "a  b\tc d\ne f g h i j k l m n o p q r s t u v w x y z é 日本"]
    rows = [(i, texts[i % 5], "en", "s", 0) for i in range(400)] + [(None, texts[4], "en", "s", 0)]
    planted = 0
    for r in periodic_tail(documents(spark, rows)).collect():
        text = texts[4] if r.doc_id is None else texts[r.doc_id % 5]
        words, h = (text or "").split(), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not words:
            assert r.text == text
            continue
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text == " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        planted += 1
    assert planted > 10
