"""Byte-level BPE by backtracking over longest token matches.

A text is cut into pieces by the vocabulary's pattern.  Within a piece the
encoder takes the longest token at each place (the goto table of an
Aho-Corasick automaton over the vocabulary) and keeps it if BPE would leave the
border to the token before it unmerged, which a table of merge pairs decides.
Otherwise it tries the next shorter token, and with none left it steps back and
marks the place as a dead end; every place dies at most once, so time is
linear.  The result is what merging by rank gives.  All distinct pieces of a
slice of documents advance together in numpy arrays.  Decoding gathers bytes
through a table of token offsets.

Edge cases: null and empty texts have no ids; a special token's own string
inside a text becomes that token, as in the tokenizers library.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import IntTable, blocks8, hash_runs, slices, text_bytes

LETTER, NUMBER, WHITE, OTHER, BEFORE = 0, 1, 2, 3, 9
#: Code points beyond ASCII with the Unicode property White_Space (fixed values).
WIDE_SPACES = frozenset([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Endings that the pattern splits off after an apostrophe (fixed values).
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: The byte, never part of UTF-8, that ends a word where the vocabulary has tokens for word ends.
WORD_END = b"\xff"
#: Bytes of text handled at once; bounds a Python worker's memory.
SLICE = 1 << 20
#: Slots of a worker's table of pieces already encoded, and the most bytes and tokens in one.
CACHE_BITS, CACHE_BYTES, CACHE_TOKENS = 18, 16, 6


@functools.lru_cache(maxsize=1 << 16)
def char_class(code: int) -> int:
    if code in WIDE_SPACES or code == 0x20 or 0x09 <= code <= 0x0D:
        return WHITE
    kind = unicodedata.category(chr(code))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


ASCII_CLASS = np.array([char_class(i) for i in range(128)] + [OTHER] * 128, np.uint8)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = ASCII_CLASS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        first = padded[lead]
        size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        rest = [padded[lead + i] & 0x3F for i in (1, 2, 3)]
        two = (first & 0x1F) << 6 | rest[0]
        three = (first & 0x0F) << 12 | rest[0] << 6 | rest[1]
        four = (first & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
        code = np.where(size == 2, two, np.where(size == 3, three, four))
        distinct, which = np.unique(np.minimum(code, 0x10FFFF), return_inverse=True)
        kind = np.array([char_class(int(c)) for c in distinct], np.uint8)[which]
        for i in range(4):
            take = (size > i) & (lead + i < len(data))
            out[lead[take] + i] = kind[take]
    return out


def piece_starts(data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin; breaks: where segments begin, and the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(data)
    fresh = np.zeros(n + 1, bool)
    fresh[breaks] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = BEFORE, kind[:-1]
    before[fresh[:n]] = BEFORE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = data[:-1] == 0x20
    after_blank &= before != BEFORE
    edge = kind != before
    white = kind == WHITE
    start = edge & (white | ~after_blank)
    # The last white character before another one stands alone or leads the next piece.
    edge_after_white = np.flatnonzero(edge & ~white & (before == WHITE))
    last = edge_after_white - 1
    for _ in range(3):
        back = (data[last] & 0xC0) == 0x80
        if not back.any():
            break
        last = last - back
    start[last] = True
    # Endings after an apostrophe that begins a piece.
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        limit = breaks[np.searchsorted(breaks, quote, "right")]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        length = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            hit = (one == ending[0]) & (True if len(ending) == 1 else two == ending[1]) & (quote + len(ending) < limit) & (length == 0)
            length[hit] = len(ending)
        quote, limit, length = quote[length > 0], limit[length > 0], length[length > 0]
        start[quote + 1] = False
        end = quote + 1 + length
        start[end[end < limit]] = True
    return np.flatnonzero(start)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _same_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lead: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether piece a[i] has the same bytes as piece b[i]; ``lead`` holds each piece's first 16 bytes."""
    same = (lengths[a] == lengths[b]) & (lead[:, a] == lead[:, b]).all(0)
    longer = np.flatnonzero(same & (lengths[a] > CACHE_BYTES) & (a != b))
    if len(longer):
        size = lengths[a[longer]]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        equal = data[within + np.repeat(starts[a[longer]], size)] == data[within + np.repeat(starts[b[longer]], size)]
        same[longer] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return same


class Bpe:
    """Tables of one vocabulary file.  Inside, a token is its rank: bytes 0-255, then merges in order.

    A vocabulary with a suffix for word ends is one in which WORD_END follows each word
    (:meth:`encode_pieces` gets it with the word) and merges with the word's last byte first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        suffix = spec["model"].get("end_of_word_suffix") or ""

        def spelled(token: str) -> bytes | None:
            ends = bool(suffix) and token.endswith(suffix)
            body = token.removesuffix(suffix) if ends else token
            return bytes(letters[c] for c in body) + WORD_END * ends if all(c in letters for c in body) else None

        raw = {t: b for t in vocab if (b := spelled(t)) is not None}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        by_byte = {raw[t]: t for t in raw if len(raw[t]) == 1}
        names = [by_byte[bytes([b])] for b in range(256)]
        rank = {t: i for i, t in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        pairs: dict[tuple[int, int], int] = {}
        if suffix:  # a letter and the end of its word merge before all else
            for b in range(256):
                pairs[b, WORD_END[0]] = rank[names[b] + suffix] = len(names)
                names.append(names[b] + suffix)
                left.append(b)
                right.append(WORD_END[0])
        for a, b in merges:
            r = rank.setdefault(a + b, len(names))
            if r == len(names):
                names.append(a + b)
                left.append(rank[a])
                right.append(rank[b])
                pairs[rank[a], rank[b]] = r
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.ids = np.array([vocab[t] for t in names], np.int64)
        tokens = [raw[t] for t in names]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.pairs = IntTable(np.array([a << 20 | b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int32))
        self._automaton(tokens)
        self.specials = [(t["content"].encode(), t["id"]) for t in spec.get("added_tokens", [])]
        size = max([*vocab.values(), *(i for _, i in self.specials)]) + 1
        blobs = [b""] * size
        for t, i in vocab.items():
            blobs[i] = raw.get(t, t.encode())
        for t, i in self.specials:
            blobs[i] = t
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        self._memo_key = np.full(1 << 20, -1, np.int64)
        self._memo = np.zeros(1 << 20, bool)
        #: Tokens of frequent short pieces: a fixed number of slots, one piece each, known by its length and bytes.
        self._cache_length = np.full(1 << CACHE_BITS, -1, np.int64)
        self._cache_bytes = np.zeros((2, 1 << CACHE_BITS), np.uint64)
        self._cache_n = np.zeros(1 << CACHE_BITS, np.int64)
        self._cache = np.zeros((1 << CACHE_BITS, CACHE_TOKENS), np.int64)

    def _automaton(self, tokens: list[bytes]) -> None:
        """Goto edges, the token at each state, and each token's longest proper prefix that is a token."""
        goto: dict[int, int] = {}
        token_at = [-1]
        for t, word in enumerate(tokens):
            state = 0
            for byte in word:
                key = state << 8 | byte
                state = goto.get(key, -1)
                if state < 0:
                    state = goto[key] = len(token_at)
                    token_at.append(-1)
            token_at[state] = t
        self.token_at = np.array(token_at, np.int64)
        prefix = np.full(len(tokens), -1, np.int64)
        for t, word in enumerate(tokens):
            state, seen = 0, -1
            for byte in word[:-1]:
                state = goto[state << 8 | byte]
                seen = token_at[state] if token_at[state] >= 0 else seen
            prefix[t] = seen
        self.prefix = prefix
        self.first = np.array([goto.get(b, 0) for b in range(256)], np.int64)
        second = np.zeros(1 << 16, np.int64)
        deep = {}
        at_first = {int(s): b for b, s in enumerate(self.first)}
        for key, state in goto.items():
            if key >> 8 in at_first and key >> 8:
                second[at_first[key >> 8] << 8 | key & 255] = state
            elif key >> 8:
                deep[key] = state
        self.second = second
        self.goto = IntTable(np.array(list(deep), np.int64), np.array(list(deep.values()), np.int32), 0)

    def longest(self, data: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The longest token at each byte; left: bytes from there to the end of its piece."""
        best = self.token_at[self.first[data]]
        at = np.flatnonzero(left > 1)
        state = self.second[data[at].astype(np.int64) << 8 | data[at + 1]]
        depth = 2
        while True:
            go = state > 0
            at, state = at[go], state[go]
            if not len(at):
                return best
            token = self.token_at[state]
            hit = token >= 0
            best[at[hit]] = token[hit]
            go = left[at] > depth
            at, state = at[go], state[go]
            state = self.goto.get(state << 8 | data[at + depth]).astype(np.int64)
            depth += 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves token a before token b: no merge across the border comes before theirs."""
        key = a << 20 | b
        slot = ((key * 0x9E3779B1) >> 12) & (len(self._memo) - 1)
        out = self._memo[slot]
        new = np.flatnonzero(self._memo_key[slot] != key)
        if len(new):
            out[new] = self._decide(a[new], b[new])
            self._memo_key[slot[new]] = key[new]
            self._memo[slot[new]] = out[new]
            # Two pairs may share a slot: neither keeps it.
            lost = new[self._memo_key[slot[new]] != key[new]]
            self._memo_key[slot[lost]] = -1
        return out

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        which = np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(which):
            merged = self.pairs.get(a << 20 | b)
            bad = (merged >= 0) & (merged < limit)
            out[which[bad]] = False
            # Undo the later of the two tokens' own merges; a base token has none.
            base_a, base_b = a < 256, b < 256
            undo_a = ((a > b) & ~base_a) | ((a <= b) & base_b & ~base_a)
            undo_b = ~undo_a & ~base_b
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = ~bad & (undo_a | undo_b)
            which, limit, a, b = which[go], limit[go], a[go], b[go]
        return out

    def encode_pieces(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces that lie end to end in data; the tokens, and how many each piece has."""
        ends = np.cumsum(lengths)
        begins = ends - lengths
        n = len(data)
        end_of = np.repeat(ends, lengths)
        match = self.longest(data, end_of - np.arange(n))
        chosen = np.full(n, -1, np.int64)
        came = np.zeros(n, np.int64)
        alive = np.ones(n + 1, bool)
        # A piece: its begin and end, the place, the token tried there, and the token before it.
        begin, end = begins[lengths > 0], ends[lengths > 0]
        place, token, last = begin.copy(), match[begin], np.full(len(begin), -1, np.int64)
        while len(place):
            to = place + self.length[token]
            ok = alive[to] | (to == end)
            check = np.flatnonzero(ok & (last >= 0))
            ok[check] = self.compatible(last[check], token[check])
            took = np.flatnonzero(ok)
            chosen[place[took]] = token[took]
            done = np.zeros(len(place), bool)
            done[took] = to[took] == end[took]
            on = took[~done[took]]
            came[to[on]] = place[on]
            last[on], place[on] = token[on], to[on]
            token[on] = match[place[on]]
            not_ok = np.flatnonzero(~ok)
            shorter = self.prefix[token[not_ok]]
            token[not_ok] = shorter
            back = not_ok[shorter < 0]
            if len(back):
                alive[place[back]] = False
                chosen[place[back]] = -1
                place[back] = came[place[back]]
                token[back] = last[back]
                first = place[back] == begin[back]
                last[back] = np.where(first, -1, chosen[came[place[back]]])
                chosen[place[back]] = -1
            if done.any():
                go = ~done
                begin, end, place, token, last = begin[go], end[go], place[go], token[go], last[go]
        on_path = chosen >= 0
        upto = np.concatenate([[0], np.cumsum(on_path)])
        return chosen[on_path], upto[ends] - upto[begins]

    def piece_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has; a piece seen before is looked up.

        Hashes only bring pieces together: whether two are the same is decided by their lengths and bytes.
        """
        hashes, lengths, at8 = hash_runs(data, starts, ends), ends - starts, blocks8(data)
        bits = np.stack([np.minimum(lengths, 8), np.clip(lengths - 8, 0, 8)]).astype(np.uint64) << np.uint64(3)
        lead = np.stack([at8[starts], at8[np.minimum(starts + 8, len(data))]])
        lead = np.where(bits > 0, lead << (np.uint64(64) - np.maximum(bits, np.uint64(8))), np.uint64(0))
        slot = (hashes & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64)
        miss = np.flatnonzero((self._cache_length[slot] != lengths) | (self._cache_bytes[:, slot] != lead).any(0))
        begin, n = slot * CACHE_TOKENS, self._cache_n[slot]
        fresh, index, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
        index = miss[index]
        other = np.flatnonzero(~_same_pieces(data, starts, lengths, lead, miss, index[which]))
        which[other] = len(index) + np.arange(len(other))
        fresh, index = np.concatenate([fresh, hashes[miss[other]]]), np.concatenate([index, miss[other]])
        size = lengths[index]
        gather = np.repeat(starts[index] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        tokens, counts = self.encode_pieces(data[gather], size)
        begins = np.cumsum(counts) - counts
        begin[miss], n[miss] = begins[which] + self._cache.size, counts[which]
        pool = np.concatenate([self._cache.ravel(), self.ids[tokens]])
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])]
        # An empty slot takes a piece; a full one changes hands for one new piece in four.
        home = slot[index]
        room = (self._cache_length[home] < 0) | (fresh >> np.uint64(62) == 0)
        put = np.flatnonzero((counts <= CACHE_TOKENS) & (size <= CACHE_BYTES) & room)
        put = put[np.unique(home[put], return_index=True)[1]]
        home = home[put]
        self._cache_length[home], self._cache_bytes[:, home], self._cache_n[home] = size[put], lead[:, index[put]], counts[put]
        for i in range(CACHE_TOKENS):
            has = counts[put] > i
            self._cache[home[has], i] = self.ids[tokens[begins[put[has]] + i]]
        return ids, n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of bytes (UTF-8), one after another, and each row's offsets into them."""
        breaks, special_at, special_len, special_id = offsets, [], [], []
        blob = None
        for text, i in self.specials:
            blob = data.tobytes() if blob is None else blob
            at = blob.find(text)
            while at >= 0:
                row_end = offsets[np.searchsorted(offsets, at, "right")]
                if at + len(text) <= row_end:
                    special_at.append(at)
                    special_len.append(len(text))
                    special_id.append(i)
                at = blob.find(text, at + (len(text) if at + len(text) <= row_end else 1))
        if special_at:
            order = np.argsort(special_at)
            special_at, special_len, special_id = (np.array(x, np.int64)[order] for x in (special_at, special_len, special_id))
            breaks = np.unique(np.concatenate([offsets, special_at, special_at + special_len]))
        starts = piece_starts(data, np.unique(breaks))
        if len(special_at):
            inside = np.searchsorted(special_at, starts, "right") - 1
            keep = (inside < 0) | (starts == special_at[inside]) | (starts >= special_at[inside] + special_len[inside])
            starts = starts[keep]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        ids, n = self.piece_ids(data, starts, ends)
        upto = np.concatenate([[0], np.cumsum(n)])
        if len(special_at):  # each stands alone as a piece: its ordinary ids give way to its own
            piece = np.searchsorted(starts, special_at)
            keep = np.ones(len(ids), bool)
            for p, i in zip(piece, special_id):
                keep[upto[p] + 1 : upto[p + 1]] = False
                ids[upto[p]] = i
            ids, n = ids[keep], n.copy()
            n[piece] = 1
            upto = np.concatenate([[0], np.cumsum(n)])
        return ids, upto[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of ids, and each row's offsets into them."""
        lengths = self.blob_at[ids + 1] - self.blob_at[ids]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.blob[np.repeat(self.blob_at[ids] - upto[:-1], lengths) + np.arange(upto[-1])], upto[offsets]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One table set for each Python worker."""
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids and texts to (id, ids array<int>): general form, for further work on the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                ids, at = bpe.encode(*text_bytes(part.column("__text")))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("__id"), lists], ["__id", "ids"])

    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = source.schema["__id"].dataType.simpleString()
    return source.mapInArrow(run, f"__id {kind}, ids array<int>").withColumnRenamed("__id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) back to (id, text); null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            column = batch.column("ids")
            if column.null_count:
                column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, upto = bpe.decode(flat, np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]))
            blob = data.tobytes()
            texts = [blob[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(texts, pa.string())], ["__id", "text"])

    source = encoded.select(F.col(id_col).alias("__id"), "ids")
    kind = source.schema["__id"].dataType.simpleString()
    return source.mapInArrow(run, f"__id {kind}, text string").withColumnRenamed("__id", id_col)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Each document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row for each row of ``docs``, also for repeated rows and null ids.  Null
    and empty texts have 0 tokens and the digests of no bytes.  Other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = bpe.encode(*text_bytes(part.column("text")))
                data, upto = bpe.decode(ids, at)
                flat, blob = memoryview(ids.astype("<u4")).cast("B"), memoryview(np.ascontiguousarray(data))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(flat[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])]),
                        pa.array([hashlib.sha256(blob[a:b]).hexdigest() for a, b in zip(upto[:-1], upto[1:])]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
