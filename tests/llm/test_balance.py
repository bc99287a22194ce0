import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, empty, odd_rows
from tokenizers import Tokenizer

from tallyloom.llm.balance import balanced, differenced, filled, pack_balanced
from tallyloom.llm.wordbpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_differencing(lengths, windows):
    """Sums of the windows, with all windows of every partition written out."""
    parts = [(n, [(x, [n])] + [(0, [])] * (windows - 1)) for n, x in enumerate(lengths)]
    for n in range(len(lengths), 2 * len(lengths) - 1):
        parts.sort(key=lambda p: (p[1][0][0] - p[1][-1][0], -p[0]))  # of equal ones the older first
        (_, a), (_, b) = parts.pop(), parts.pop()
        both = sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b))), key=lambda w: -w[0])
        parts.append((n, [(x - both[-1][0], i) for x, i in both]))
    return sorted(sum(lengths[i] for i in items) for _, items in parts[0][1])


def test_windows_are_those_of_plain_differencing():
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array(rng.sample(range(1, 10_000), rng.randint(1, 40)))
        windows = rng.randint(1, 12)
        got = np.bincount(differenced(lengths, windows), lengths, windows).astype(int)
        want = plain_differencing(lengths.tolist(), windows)
        assert sorted(got.tolist()) == want


def test_known_partitions():
    assert sorted(np.bincount(differenced(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4]).tolist()) == [14, 16]
    assert sorted(np.bincount(differenced(np.array([4, 5, 6, 7, 8]), 3), [4, 5, 6, 7, 8]).tolist()) == [8, 11, 11]


def test_count_rises_until_nothing_exceeds():
    window, sums = balanced(np.array([6, 6, 6]), 10)  # two windows would hold the tokens but not the items
    assert len(sums) == 3 and sorted(window.tolist()) == [0, 1, 2]
    for seed in range(50):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, 65, rng.integers(1, 200))
        window, sums = balanced(lengths, 64)
        assert sums.max() <= 64 and np.array_equal(np.bincount(window, lengths, len(sums)), sums)


def test_many_items_make_near_equal_windows():
    lengths = np.random.default_rng(1).lognormal(5, 1, 3000).astype(np.int64) % 4095 + 1
    window, sums = balanced(lengths, 4096)
    assert len(sums) <= -(-lengths.sum() // 4096) + 1 and np.ptp(sums) <= 40


def whole(pieces, lengths, capacity):
    """Every item once, every sequence gapless, and no padding."""
    items, sequences = {}, {}
    for item, begin, size, sequence, offset in zip(*(x.tolist() for x in pieces)):
        items.setdefault(item, []).append((begin, size))
        sequences.setdefault(sequence, []).append((offset, size))
    for i, n in enumerate(lengths.tolist()):
        assert gapless(items[i]) == n
    for s in sequences.values():
        n = gapless(s)
        assert n == capacity or n < capacity and n & (n - 1) == 0


def gapless(stretches):
    end = 0
    for at, size in sorted(stretches):
        assert at == end and size > 0
        end += size
    return end


def test_filled_sequences_need_no_padding():
    for seed in range(80):
        rng = np.random.default_rng(seed)
        capacity = int(rng.choice([8, 64, 256]))
        lengths = rng.integers(1, capacity, rng.integers(1, 120))
        whole(filled(lengths, *balanced(lengths, capacity), capacity), lengths, capacity)
    for lengths in ([1] * 64, [63], [32, 32], [33, 33, 33]):
        lengths = np.array(lengths)
        whole(filled(lengths, *balanced(lengths, 64), 64), lengths, 64)


def test_words_are_encoded_as_the_library_does():
    library, own = Tokenizer.from_file(PATH), WordEncoder(PATH)
    rng = random.Random(5)
    alphabet = list("aAbBstmdlrev'’!?.,-_<|>endoftxt019 \t\n\x0b\x1f\x01\x85 éÉèßñÑ日本😀½²Ⅷ́̈İıſΣσς")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["don't we'LL 'twas ''s it's's", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "a b c　d", "ÿ", "", "x" * 5000 + "!" * 300]
    for _ in range(2):  # the second time from what the worker remembers
        ids, at = own.encode(pa.array([*texts, None]))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert at[-2] == at[-1]


@pytest.mark.parametrize("fill", [True, False])
def test_every_token_once(spark, fill):
    docs = documents(spark, [r for r in odd_rows() if r[0] != 4])
    library = Tokenizer.from_file(PATH)
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in pack_balanced(docs, PATH, 128, fill=fill).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and len(r.ids) == 4 * r.length
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: gapless(p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    for s in sequences.values():
        n = gapless(s)
        assert n == 128 or n < 128 and (not fill or n & (n - 1) == 0)


def test_repeated_rows_rows_without_id_and_empty_table(spark):
    rows = pack_balanced(documents(spark, [(None, "a b c", "en", "s", 5)] * 5), PATH).collect()
    assert sum(r.length for r in rows) == 20 and all(r.doc_id is None for r in rows)
    assert pack_balanced(empty(spark), PATH).count() == 0


def test_blocks_are_separate(spark, monkeypatch):
    monkeypatch.setattr("tallyloom.llm.balance.ITEMS", 7)
    rows = pack_balanced(documents(spark, [(i, "word " * (i % 40), "en", "s", 5) for i in range(200)]), PATH, 64).collect()
    assert sum(r.length for r in rows) == sum(i % 40 + 1 for i in range(200)) and len({r.sequence_id >> 32 for r in rows}) > 5
