import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, empty, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm.arrays import text_bytes
from tallyloom.llm.bpe import decode_documents, encode_documents, load, round_trip_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BITS = st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "'", "'s", "'re", "'LL", "é", "ß", "1", "22", "½", "!", "...", " ", " ", "\x1c", "\x85", "ing", "<|endoftext|>", "日本", "😀", "x" * 30, "-" * 40, "\r\n", "́"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(BITS, max_size=25).map("".join) | st.text(max_size=40), min_size=1, max_size=5))
def test_same_ids_as_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    bpe = load(PATH)
    ids, at = bpe.encode(*text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    data, upto = bpe.decode(ids, at)
    assert [data[a:b].tobytes().decode() for a, b in zip(upto[:-1], upto[1:])] == texts


def test_digests_of_odd_rows(spark):
    docs = documents(spark, odd_rows())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = round_trip_digests(docs, PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert round_trip_digests(empty(spark), PATH).count() == 0


def test_tables_round_trip(spark):
    docs = documents(spark, odd_rows())
    back = decode_documents(encode_documents(docs, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "-" * 4000, "zqxj" * 2000])
def test_long_pieces(text):
    ids, at = load(PATH).encode(*text_bytes(pa.array([text])))
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def alternating(n):
    """The Thue-Morse word of n letters (n a power of two) and its complement."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [16, 1024, 2048, 4096, 8192])
def test_pieces_that_a_polynomial_hash_confuses(n):
    first, second = alternating(n)
    text = f"x {first} {second} {first}"
    bpe = load(PATH)
    for _ in range(2):  # the second time with pieces kept from the first
        ids, at = bpe.encode(*text_bytes(pa.array([text])))
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids, at)[0].tobytes().decode() == text


def test_equal_hashes_dont_make_equal_pieces(monkeypatch):
    import tallyloom.llm.bpe as module

    monkeypatch.setattr(module, "hash_runs", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    text = "one two three onerous twofold threefold " * 3 + "internationalisation internationalisations " * 2
    ids, _ = module.Bpe(PATH).encode(*text_bytes(pa.array([text])))
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
