"""BPE over lower-cased words, for vocabularies whose tokens know the end of a word.

Text is put in composed form, lower-cased, cut into pieces (endings after an
apostrophe, runs of letters, single numbers, runs of anything else) and each piece is
encoded with its end.  White space separates words and leaves no token, so a word's
ids don't depend on its neighbours: a slice of texts is reduced to its distinct words,
whose pieces are encoded together (or looked up, if the worker has met them), and the
ids of all words are gathered from theirs.

Edge cases: null and empty texts have no ids; a special token's own string becomes
that token, as in the tokenizers library, and such words, like those with white
space other than ``\\x20`` and ``\\x09-\\x0D`` inside, are encoded by it.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa

from .arrays import LOWER, SPACE, text_bytes, words_of
from .bpe import ENDINGS, NUMBER, WIDE_SPACES, WORD_END, Bpe, classes


def word_piece_starts(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where pieces begin in words that lie end to end; ``words``: where each begins, and the end."""
    n = len(data)
    kind = classes(data)
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[words] = True
    start[:n] |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
    start = start[:n]
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        limit = words[np.searchsorted(words, quote, "right")]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        length = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            fits = (padded[quote + 1] == ending[0]) & (quote + len(ending) < limit) & (length == 0)
            fits &= True if len(ending) == 1 else padded[quote + 2] == ending[1]
            length[fits] = len(ending)
        quote, limit, length = quote[length > 0], limit[length > 0], length[length > 0]
        start[quote + 1] = False
        end = quote + 1 + length
        start[end[end < limit]] = True
    return np.flatnonzero(start)


def word_column(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words of a slice as a binary column (words hold all bytes that aren't white space)."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~SPACE[data]])])


class WordEncoder:
    """One vocabulary, with the pieces lately seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task for each core
        from tokenizers import Tokenizer

        self.bpe, self.library = Bpe(path), Tokenizer.from_file(path)
        self.largest = len(self.bpe.blob_at) - 2
        self.apart = re.compile("|".join([*(re.escape(t.decode()) for t, _ in self.bpe.specials), "[" + "".join(map(chr, sorted(WIDE_SPACES))) + "]"]))

    def _normal(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normal forms of words without white space, end to end, and their lengths."""
        data = np.frombuffer(self.library.normalizer.normalize_str(" ".join(words)).encode(), np.uint8)
        space = np.flatnonzero(SPACE[data])
        return data[~SPACE[data]], np.diff(np.concatenate([[-1], space, [len(data)]])) - 1

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each word's ids begin in it and how many they are."""
        data, offsets = text_bytes(words)
        size = np.diff(offsets)
        wide = np.maximum.reduceat(data, offsets[:-1]) >= 0x80
        texts = dict(zip(np.flatnonzero(wide).tolist(), words.filter(pa.array(wide)).cast(pa.string()).to_pylist()))
        odd = [i for i, t in texts.items() if self.apart.search(t)]
        plain = data.tobytes().decode()
        if any(t.decode() in plain for t, _ in self.bpe.specials):
            odd = [i for i, w in enumerate(words.to_pylist()) if self.apart.search(w.decode())]
        alone = np.zeros(len(words), bool)
        alone[odd] = True
        narrow, wide = np.flatnonzero(~wide & ~alone), np.flatnonzero(wide & ~alone)
        taken = np.zeros(len(words), bool)
        taken[narrow] = True
        lowered = LOWER[data[np.repeat(taken, size)]]
        more, more_size = self._normal([texts[i] for i in wide.tolist()]) if len(wide) else (data[:0], size[:0])
        order = np.concatenate([narrow, wide])
        data = np.concatenate([lowered, more])
        at = np.concatenate([[0], np.cumsum(np.concatenate([size[narrow], more_size]))])
        begin, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pool = np.zeros(0, np.int64)
        if len(data):
            starts = word_piece_starts(data, at)
            ends = np.append(starts[1:], len(data))
            moved = np.arange(len(starts))
            pool, n = self.bpe.piece_ids(np.insert(data, ends, WORD_END[0]), starts + moved, ends + moved + 1)
            upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, at)]
            begin[order], count[order] = upto[:-1], np.diff(upto)
        for i in odd:
            own = self.library.encode(words[i].as_py().decode(), add_special_tokens=False).ids
            begin[i], count[i] = len(pool), len(own)
            pool = np.concatenate([pool, np.array(own, np.int64)])
        return pool, begin, count

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column, one row after another, and each row's offsets into them."""
        data, offsets = text_bytes(column)
        starts, ends, at = words_of(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        coded = word_column(data, starts, ends).dictionary_encode()
        pool, begin, count = self.encode_words(coded.dictionary)
        word = coded.indices.to_numpy()
        n = count[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        return pool[np.repeat(begin[word] - upto[:-1], n) + np.arange(upto[-1])], upto[at]


@functools.lru_cache(maxsize=2)
def load_words(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
