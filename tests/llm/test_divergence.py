import re
from collections import Counter, defaultdict

import numpy as np
from helpers import documents, empty, odd_rows

from tallyloom.llm import divergence
from tallyloom.llm.divergence import shares, source_divergence


def plain(rows, least, smoothing=5, top=50):
    """The definition, over Python's own numbers; rows: (text, lang, source)."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}

        def share(c):
            return {t: 1 + 10**9 * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in own.items()}, share({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]}
            parts["term"] = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "ÉTÉ", "été", "naïve-bayes", "x1y", "日本", "a", "zebra_crossing", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for i in range(n):
        text = " ".join(words[j] for j in rng.zipf(1.3, rng.integers(0, 40)) % len(words))
        rows.append((i, text if i % 17 else None, ["en", "de", None, ""][i % 4], ["a", "b", "hot", None, "hot", "B"][rng.integers(6)], 0))
    return rows


def test_agrees_with_the_definition(spark, monkeypatch):
    rows = corpus()
    want = plain([r[1:4] for r in rows], 3, top=4)
    docs = documents(spark, rows)
    assert found(source_divergence(docs, least=3, top=4)) == want
    # Spilled after every few documents, in many partitions, in blocks of a few terms: the same.
    monkeypatch.setattr(divergence, "SHARES", 10)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    assert found(source_divergence(docs.repartition(7), least=3, top=4)) == want


def test_groups_without_terms_and_lonely_sources(spark):
    rows = [(1, "one two", "en", "a", 0), (2, None, "en", "b", 0), (3, "", "fr", "a", 0), (4, "word word", "fr", "b", 0), (5, "word", "es", "only", 0)]
    docs = documents(spark, rows)
    for least in (1, 2):
        assert found(source_divergence(docs, least=least)) == plain([r[1:4] for r in rows], least)


def test_odd_rows_and_empty_table(spark):
    rows = odd_rows()
    assert found(source_divergence(documents(spark, rows), least=2)) == plain([r[1:4] for r in rows], 2)
    assert source_divergence(empty(spark)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 1, 7, 10**12 + 3, 2**52, 2**53 - 2], np.int64)
    total = np.int64(2**53 - 1)
    assert shares(counts, total).tolist() == [1 + 10**9 * int(c) // int(total) for c in counts]
    assert shares(np.array([5]), np.array([5])).tolist() == [1 + 10**9]
