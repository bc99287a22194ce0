import random
import string

import pytest
from helpers import BASE, documents, empty, odd_rows

from tallyloom.llm.components import components
from tallyloom.llm.minhash import SET_BITS, centred, drop_near_duplicates, near_duplicates, prefixes, within_reach
from tallyloom.llm.scratch import Scratch


def brute(rows, k, percent):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def alternating(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def check(spark, rows, k=4):
    got = near_duplicates(documents(spark, rows), k=k).collect()
    want = brute(rows, k, 80)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_odd_rows(spark):
    check(spark, odd_rows())
    assert near_duplicates(empty(spark)).count() == 0
    alone = documents(spark, [(None, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1)])
    assert sorted((tuple(r)[:4] for r in near_duplicates(alone).collect()), key=repr) == [(3, 2, 3, True), (None, 2, None, True)]


def test_chains_and_groups_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(40):
            words = list(words) if rng.random() < 0.5 else [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in words]
            rows.append((n, " ".join(words), "en", "s", 1))
            n += 1
    for _ in range(60):  # a shared passage, not near copies
        rows.append((n, BASE + " " + " ".join(rng.choice(vocabulary) for _ in range(40)), "en", "s", 1))
        n += 1
    rng.shuffle(rows)
    check(spark, rows)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(500, 600)] + [(3, 3), (None, 4), (7, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(500, 600)]}


def test_repeated_rows_stay_linear(spark, monkeypatch):
    """A row repeated 50 times beside a near copy, also repeated: the tables inside don't grow with the repeats."""
    near = BASE.replace("wizards", "witches", 1) + " and so it was"
    rows = [(1, BASE, "en", "s", 1)] * 50 + [(2, near, "en", "s", 1)] * 50 + [(3, "something else that nobody repeats", "en", "s", 1)]
    written, save = [], Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    check(spark, rows)
    assert all(n <= 101 for name, n in written if name in ("signatures", "classes"))
    assert all(n <= 160 for name, n in written if name not in ("signatures", "classes")), written


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    other = " ".join(f"unique{i}" for i in range(40))
    got = near_duplicates(documents(spark, [(1, BASE, "en", "s", 1), (2, BASE, "en", "s", 1), (2, other, "en", "s", 1)]), k=4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (2, 2, True)]


def test_texts_that_a_polynomial_hash_confuses_stay_apart(spark):
    first, second = alternating(1024)
    check(spark, [(1, f"{first} one two three four", "en", "s", 1), (2, f"{second} one two three four", "en", "s", 1), (3, first, "en", "s", 1), (4, second, "en", "s", 1)])


def test_one_row_of_each_group_stays(spark):
    other = " ".join(f"unique{i}" for i in range(40))
    rows = [(1, BASE), (2, BASE), (2, other), (3, "q r s t u v"), (3, "q r s t u v"), (4, None), (4, None), (None, BASE), (None, BASE)]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows]).withColumnRenamed("source", "a.b").withColumnRenamed("found", "name")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    want = [(1, BASE), (2, other), (3, "q r s t u v"), (4, None), (None, BASE), (None, BASE)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def templated(n, shared, own, seed):
    """Texts of ``shared`` common words with ``own`` words of their own in the middle: no two are near copies at these numbers."""
    rng = random.Random(seed)
    head, tail = ([rng.choice(string.ascii_letters) + str(rng.random()) for _ in range(shared // 2)] for _ in range(2))
    return [(i, " ".join([*head, *(f"own{i}x{j}" for j in range(own)), *tail]), "en", "s", 1) for i in range(n)]


@pytest.mark.parametrize(("n", "shared", "own"), [(100, 400, 52), (400, 400, 52), (80, 5000, 1250)])
def test_templated_texts_that_do_not_link_are_not_all_confirmed(spark, monkeypatch, n, shared, own):
    confirmed, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        confirmed[name] = out.count() if name in ("stars", "pairs") else 0
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    got = near_duplicates(documents(spark, templated(n, shared, own, n)), k=4).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == n
    assert confirmed["stars"] <= 8 * n and confirmed.get("pairs", 0) <= n, confirmed


def test_prefixes_keep_every_pair_that_reaches_the_threshold(spark):
    rng = random.Random(8)
    sets, n = {}, 0
    for size in (1, 2, 5, 20, 60, 61, 90):
        for _ in range(6):
            base = rng.sample(range(400), size)
            for _ in range(5):
                noise = rng.choice([0.0, 0.05, 0.1, 0.3])
                sets[n] = {x if rng.random() > noise else rng.randrange(400, 3000) for x in base} | set(rng.sample(range(5), rng.randint(0, 2)))
                n += 1
    part = {i: rng.randrange(60) for i in sets}
    tokens = [(i, part[i], len(s), h) for i, s in sets.items() for h in s]
    parity = {i: [0] * (SET_BITS // 64) for i in sets}
    for i, _, _, h in tokens:
        bit = h * 7919 % SET_BITS
        parity[i][bit // 64] ^= 1 << bit % 64
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    sketches = spark.createDataFrame([(i, list(map(signed, p))) for i, p in parity.items()], "node long, parity array<long>")
    shape = spark.createDataFrame([(i, part[i], len(s)) for i, s in sets.items()], "node long, c long, n long")
    for percent in (80, 60):
        short = prefixes(spark.createDataFrame(tokens, "node long, component long, n long, h long"), percent).join(sketches, "node")
        ends = [short.join(shape, "node").selectExpr("0 key", "0 block", f"node as {x}", f"c as c_{x}", f"-1 as m_{x}", f"n as n_{x}", f"parity as p_{x}", f"index as index_{x}", f"probe as probe_{x}") for x in "ab"]
        got = {(r.a, r.b) for r in within_reach(*ends, percent).collect()}
        far = [(a, b) for a in sets for b in sets if a < b and part[a] != part[b]]
        want = {(a, b) for a, b in far if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert len(want) > 80 and want <= got and len(got) < len(far) / 10


def test_a_centre_stands_once_for_a_block_of_partners(spark, monkeypatch):
    monkeypatch.setattr("tallyloom.llm.minhash.BLOCK", 16)
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "node long, text string")
    pairs = spark.createDataFrame([(7, i) for i in range(8, 88)] + [(1, 2)], "a long, b long")
    rows = centred(pairs, texts).collect()
    partners = [r for r in rows if r.b is not None]
    assert sorted((r.a, r.b) for r in partners) == sorted(map(tuple, pairs.collect())) and all(r.text == f"text {r.b}" for r in partners)
    centres = sorted((r.a, r.block) for r in rows if r.b is None)
    assert centres == [(1, 0)] + [(7, i) for i in range(5)] and {(r.a, r.block) for r in partners} <= set(centres)
