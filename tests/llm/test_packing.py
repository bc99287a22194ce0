import random
import zlib

import numpy as np
import public_tokenizers
from helpers import documents, empty, odd_rows
from tokenizers import Tokenizer

from tallyloom.llm.packing import pack, pack_documents, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([7, 16, 50, 100])
        counts = {n: rng.randint(0, 9) for n in range(1, capacity + 1) if rng.random() < 0.6}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [r for r in rooms if r >= length]
                if fits:
                    rooms.remove(min(fits))
                    rooms.append(min(fits) - length)
                else:
                    rooms.append(capacity - length)
        bins = {}
        for length, n in counts.items():
            slabs = [s for s in plan(counts, capacity) if s[0] == length]
            for rank in range(n):
                _, first, each, at, offset = [s for s in slabs if s[1] <= rank][-1]
                bins.setdefault(at + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
        left = []
        for items in bins.values():
            end = 0
            for offset, length in sorted(items):
                assert offset == end
                end += length
            left.append(capacity - end)
        assert sorted(left) == sorted(rooms)


def test_every_token_once(spark):
    docs = documents(spark, [r for r in odd_rows() if r[0] != 4])
    library = Tokenizer.from_file(PATH)
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in pack_documents(docs, PATH, 128).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, rows in pieces.items():
        end = 0
        for k, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, end) and (k == 0 or r.length == 128)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][end : end + r.length], "<u4").tobytes())
            end += r.length
        assert end == len(ids[i])
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 128


def test_repeated_rows_and_empty_table(spark):
    assert pack_documents(documents(spark, [(1, "a b c", "en", "s", 5)] * 3), PATH).count() == 3
    assert pack_documents(empty(spark), PATH).count() == 0


def test_equal_rows_and_clashing_columns(spark):
    """Rows without any id, all equal, go into several blocks and still fill the fewest sequences."""
    rows = spark.createDataFrame([(None, 3, "x", 7, 1)] * 1000, "doc_id long, length int, `a.b` string, offset int, __row int")
    out = pack(rows, 10, block_rows=100)
    assert out.columns == ["doc_id", "length", "a.b", "__row", "sequence_id", "offset"]
    found = sorted((r.sequence_id, r.offset) for r in out.collect())
    assert len(set(found)) == 1000 and len({s for s, _ in found}) == 334
