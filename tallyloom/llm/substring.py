"""Removal of word windows that an earlier document already holds, by suffix automata.

Windows of ``length`` words that occur in several documents are found through
winnowing: among the ``length - gram + 1`` grams of a window the one with the
least hash is its anchor, so equal windows have equal anchors wherever they
stand.  Only windows whose anchor occurs in two documents are named by hash and
counted; of those that do repeat, the first document's text is the reference,
each repeated window once.  So a join of hashes does the search, because automata
of all documents would have to meet all documents (the README has figures), and
the automata decide on words: reference passages are cut into shards of bounded
size, a shard's suffix automaton is built in each task that needs it, and the
repeated passages of later documents stream through it; matching statistics of
at least ``length`` words that reach a smaller document mark a window.  A shard
wanted by very many documents is handed to several tasks, each with a share of
those documents.

Documents are told apart by doc_id and text.  A repeated row goes through all of
this once, and its result is joined back to each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import gram_hashes, hash_runs, signed, slices, text_bytes, words_of
from .columns import set_aside
from .scratch import Scratch

#: Words of reference in one automaton, words of later documents for one task, and
#: windows of one document that go to one shard (all about).
SHARD_WORDS, TASK_WORDS, CHUNK = 100_000, 500_000, 20_000


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` consecutive values, the leftmost of equals."""
    place = np.arange(len(values))
    if width > len(values):
        return place[:0]
    size = 1
    while size < width:
        step = min(size, width - size)
        left = values[:-step] <= values[step:]
        values, place = np.where(left, values[:-step], values[step:]), np.where(left, place[:-step], place[step:])
        size += step
    return place


def row_windows(word_offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of each window of ``length`` words that stays inside its row."""
    counts = np.maximum(np.diff(word_offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + word_offsets[:-1][row], row


class Words:
    """Words, windows and anchors of a slice of documents."""

    def __init__(self, column: pa.Array, length: int, gram: int):
        self.data, offsets = text_bytes(column)
        self.starts, self.ends, self.at = words_of(self.data, offsets)
        self.hashes = hash_runs(self.data, self.starts, self.ends)
        grams = gram_hashes(self.hashes, gram)
        least = sliding_least(grams, length - gram + 1)
        self.first, self.row = row_windows(self.at, length)
        self.anchor = least[self.first]
        self.anchor_hash = grams[self.anchor] if len(grams) else grams
        self.window_hash = gram_hashes(self.hashes, length)[self.first] if len(self.first) else np.zeros(0, np.uint64)
        self.row_at = np.searchsorted(self.row, np.arange(len(offsets)))

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b, joined by one space."""
        data, starts, ends = self.data, self.starts, self.ends
        return b" ".join(data[starts[a] : ends[b - 1]].tobytes().split()) if b > a else b""


class SuffixAutomaton:
    """Suffix automaton of passages of words; each state knows the smallest owner of its strings."""

    def __init__(self) -> None:
        self.length, self.link, self.goto, self.owner, self.last = [0], [-1], [{}], [1 << 62], 0
        self.words: dict[bytes, int] = {}
        self.passages = 0

    def _extend(self, word: int, owner: int) -> None:
        length, link, goto = self.length, self.link, self.goto
        state = len(length)
        length.append(length[self.last] + 1)
        goto.append({})
        self.owner.append(owner)
        at = self.last
        while at >= 0 and word not in goto[at]:
            goto[at][word] = state
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            to = goto[at][word]
            if length[to] == length[at] + 1:
                link.append(to)
            else:
                clone = len(length)
                link.append(clone)
                length.append(length[at] + 1)
                link.append(link[to])
                goto.append(dict(goto[to]))
                self.owner.append(1 << 62)
                while at >= 0 and goto[at].get(word) == to:
                    goto[at][word] = clone
                    at = link[at]
                link[to] = clone
        self.last = state

    def add(self, passage: list[bytes], owner: int) -> None:
        words = self.words
        for word in passage:
            self._extend(words.setdefault(word, len(words)), owner)
        self.passages += 1
        self._extend(-self.passages, owner)  # no text has this word: matches stay inside a passage

    def finish(self) -> None:
        owner, link = self.owner, self.link
        for state in sorted(range(1, len(owner)), key=self.length.__getitem__, reverse=True):
            if owner[state] < owner[link[state]]:
                owner[link[state]] = owner[state]

    def matches(self, text: list[bytes], least: int, below: int) -> list[int]:
        """Places where ``least`` words end that also stand in a passage of an owner under ``below``."""
        length, link, goto, owner, ids = self.length, self.link, self.goto, self.owner, self.words
        state, size, out = 0, 0, []
        for i, word in enumerate(text):
            w = ids.get(word)
            if w is None:
                state, size = 0, 0
                continue
            while state and w not in goto[state]:
                state = link[state]
                size = length[state]
            to = goto[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= least:
                while length[link[state]] >= least:
                    state = link[state]
                    size = length[state]
                if owner[state] < below:
                    out.append(i)
        return out


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, name, n_words, sha (of the words joined by one space), anchors (distinct) from (doc_id, name, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), length, gram)
                shas = [hashlib.sha256(w.joined(a, b)).hexdigest() for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist())]
                change = np.ones(len(w.anchor), bool)
                change[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.row[1:] != w.row[:-1])
                found, rows = w.anchor_hash[change], w.row[change]
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                lists = [np.unique(signed(found[a:b])) for a, b in zip(at[:-1], at[1:])]
                columns = [part.column("doc_id"), part.column("name"), pa.array(np.diff(w.at), pa.int64())]
                columns += [pa.array(shas), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n_words", "sha", "anchors"])

    return docs.select("doc_id", "name", "text").mapInArrow(run, "doc_id long, name long, n_words long, sha string, anchors array<long>")


def candidate_windows(candidates: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc_id, row, s): windows of the candidates whose anchor another document shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), length, gram)
                lists = part.column("anchors")
                keep = np.zeros(len(w.first), bool)
                for i in range(part.num_rows):
                    a, b = w.row_at[i], w.row_at[i + 1]
                    keep[a:b] = np.isin(signed(w.anchor_hash[a:b]), lists[i].values.to_numpy())
                row = w.row[keep]
                start = (w.first - w.at[w.row])[keep]
                of_row = [pa.array(part.column(c).to_numpy()[row]) for c in ("doc_id", "row")]
                columns = [pa.array(signed(w.window_hash[keep])), *of_row, pa.array(start.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "row", "s"])

    return candidates.select("doc_id", "row", "text", "anchors").mapInArrow(run, "h long, doc_id long, row long, s int")


def passages(candidates: DataFrame, length: int, gram: int) -> DataFrame:
    """Maximal runs of repeated windows with one owner and chunk: the owner's own (reference) and later documents'.

    owner, chunk, reference, doc_id, row, start, n (words), words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), length, gram)
                out: list[list] = [[] for _ in range(8)]
                for i in range(part.num_rows):
                    a, b = int(w.row_at[i]), int(w.row_at[i + 1])
                    found = part.column("found")[i].values
                    known = found.field("h").to_numpy()
                    order = np.argsort(known)
                    known = known[order]
                    owner, chunk = found.field("owner").to_numpy()[order], found.field("chunk").to_numpy()[order]
                    mine = signed(w.window_hash[a:b])
                    if not len(mine):
                        continue
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    hit = known[at] == mine
                    own, part_of = np.where(hit, owner[at], -1), np.where(hit, chunk[at], -1)
                    cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(part_of) != 0) | (np.diff(hit.astype(np.int8)) != 0)) + 1
                    doc, number, base = part.column("doc_id")[i].as_py(), part.column("row")[i].as_py(), int(w.at[i])
                    for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(mine)]):
                        if hit[x]:
                            n = y - x + length - 1
                            row = (int(own[x]), int(part_of[x]), bool(own[x] == doc), doc, number, x, n, w.joined(base + x, base + x + n))
                            for values, value in zip(out, row):
                                values.append(value)
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                names = ["owner", "chunk", "reference", "doc_id", "row", "start", "n", "words"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    schema = "owner long, chunk int, reference boolean, doc_id long, row long, start int, n int, words binary"
    return candidates.mapInArrow(run, schema)


def matched_windows(regions: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(row, spans): starts and ends of the removable stretches of each later passage."""
    sized = regions.where("reference").agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-sized // SHARD_WORDS))
    placed = regions.withColumn("shard", F.pmod(F.xxhash64("owner", "chunk"), F.lit(shards)))
    loads = scratch.save(placed.where("not reference").groupBy("shard").agg(F.ceil(F.sum("n") / TASK_WORDS).alias("tasks")), "loads")
    placed = placed.join(loads, "shard")
    copies = placed.where("reference").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
    later = placed.where("not reference").withColumn("task", F.pmod(F.xxhash64("row", "start"), "tasks"))
    names = ["shard", "task", "reference", "owner", "doc_id", "row", "start", "words"]
    both = copies.select(*names).unionByName(later.select(*names))
    sorted_ = both.repartition("shard", "task").sortWithinPartitions("shard", "task", F.desc("reference"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, open_ = None, SuffixAutomaton(), True
        for batch in batches:
            out: list[list] = [[], []]
            for shard, task, reference, owner, doc, row, start, words in zip(*(batch.column(c).to_pylist() for c in names)):
                if key != (shard, task):
                    key, automaton, open_ = (shard, task), SuffixAutomaton(), True
                if reference:
                    automaton.add(words.split(b" "), owner)
                    continue
                if open_:
                    automaton.finish()
                    open_ = False
                spans: list[int] = []
                for end in automaton.matches(words.split(b" "), length, doc):
                    if spans and spans[-1] >= start + end - length + 1:
                        spans[-1] = start + end + 1
                    else:
                        spans += (start + end - length + 1, start + end + 1)
                if spans:
                    out[0].append(row)
                    out[1].append(spans)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32()))], ["row", "spans"])

    return sorted_.mapInArrow(run, "row long, spans array<int>")


def cut(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Documents (doc_id, name, text, found: lists of spans) to doc_id, name, n_removed and the words kept, in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), length, gram)
                removed, kept = [], []
                for i in range(part.num_rows):
                    n = int(w.at[i + 1] - w.at[i])
                    gone = np.zeros(n, bool)
                    for spans in part.column("found")[i].as_py():
                        for a, b in zip(spans[::2], spans[1::2]):
                            gone[a:b] = True
                    words = w.joined(int(w.at[i]), int(w.at[i + 1])).split(b" ") if n else []
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()]))
                columns = [part.column("doc_id"), part.column("name"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n_removed", "kept"])

    return docs.select("doc_id", "name", "text", "found").mapInArrow(run, "doc_id long, name long, n_removed long, kept binary")


def repeated_words(docs: DataFrame, scratch: Scratch, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """What each row of (doc_id, name, text) loses: (all rows with n_words, sha and ``copy``, whether an
    earlier document has the same words; doc_id, name, n_removed and kept of the others that lose words)."""
    base = scratch.save(anchors(docs, length, gram), "anchors")
    long_ = base.where((F.col("n_words") >= length) & F.col("doc_id").isNotNull())
    # Written first, so that Spark can split the join of a large group of copies.
    same = long_.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    same = scratch.save(same.select("sha", "first"), "same")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("copy")
    rows = scratch.save(base.join(same, "sha", "left").select("doc_id", "name", "n_words", "sha", copy, "anchors"), "rows")
    scratch.drop(base, same)
    by_anchor = rows.where((F.col("n_words") >= length) & F.col("doc_id").isNotNull() & ~F.col("copy"))
    by_anchor = by_anchor.select("doc_id", "name", F.explode("anchors").alias("anchor"))
    shared = by_anchor.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = scratch.save(shared, "shared")
    wanted = by_anchor.join(shared, "anchor").groupBy("doc_id", "name").agg(F.collect_set("anchor").alias("anchors"))
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id", "name"])
    candidates = once.join(wanted, ["doc_id", "name"]).withColumn("row", F.monotonically_increasing_id())
    candidates = scratch.save(candidates, "candidates")
    windows = scratch.save(candidate_windows(candidates, length, gram), "windows")
    firsts = windows.groupBy("h").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.max("doc_id").alias("hi")).where("first.doc_id < hi")
    firsts = firsts.select("h", F.col("first.doc_id").alias("owner"), F.floor(F.col("first.s") / CHUNK).cast("int").alias("chunk"))
    firsts = scratch.save(firsts, "firsts")
    found = windows.select("h", "row").join(firsts, "h").groupBy("row").agg(F.collect_list(F.struct("h", "owner", "chunk")).alias("found"))
    regions = scratch.save(passages(candidates.select("doc_id", "row", "text").join(found, "row"), length, gram), "passages")
    scratch.drop(shared, windows, firsts)
    spans = matched_windows(regions, length, scratch).groupBy("row").agg(F.collect_list("spans").alias("found"))
    changed = cut(candidates.join(spans, "row"), length, gram).where("n_removed > 0")
    changed = scratch.save(changed, "changed")
    scratch.drop(candidates, regions)
    return rows, changed


def substring_digests(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of
    ``length`` words that covers it also starts in a document with a smaller
    doc_id.  Null and empty texts have no words; rows that share a doc_id don't
    count as earlier than each other; a row without a doc_id is earlier than none,
    has none before it and loses nothing.  Other columns are ignored; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows, changed = repeated_words(docs.select("doc_id", "text", F.xxhash64("text").alias("name")), scratch, length, gram)
    out = rows.join(changed.select("doc_id", "name", "n_removed", F.sha2("kept", 256).alias("cut_sha")), ["doc_id", "name"], "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    sha = F.when(F.col("copy"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha", "sha"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """``docs`` (any columns besides doc_id and text) with repeated windows cut out of ``text``.

    A text that loses words becomes its kept words joined by one space (perhaps
    empty); all other rows, also those without a doc_id, stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    own, back = set_aside(docs, ["doc_id", "text"])
    own = own.withColumn("name", F.xxhash64("text"))
    rows, changed = repeated_words(own.select("doc_id", "text", "name"), scratch, length, gram)
    copies = rows.where("copy").select("doc_id", "name").distinct().withColumn("kept", F.lit(b""))
    new = scratch.save(changed.select("doc_id", "name", "kept").unionByName(copies), "new")
    text = F.when(F.col("kept").isNotNull(), F.col("kept").cast("string")).otherwise(F.col("text"))
    return back(own.join(new, ["doc_id", "name"], "left").withColumn("text", text))
