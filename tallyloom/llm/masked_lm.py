"""Masked pseudo-likelihood of documents.

A small network sees ``SIDE`` words on either side of a masked word and predicts
it; the sum of the log-probabilities of all a document's words, each given its
neighbours, scores the document.  Every word of the corpus is in the vocabulary.
The ``FREQUENT`` most frequent words are outputs of the network, a softmax of two
levels, class and member.  Each other word is put together from its parts: its ending
is one of ``RARE`` further outputs, and a third softmax predicts its beginning, one of
``STARTS``, from the neighbours and the ending.  What is left of it is its share of the
count of all words with that ending and beginning, from word counts over all documents
that are kept and joined in Spark.  As a neighbour it is the sum of its parts, too.

Training is synchronous: a hash of doc_id and text deals all documents into
mini-batches (more of them for more tokens, up to a bound); for each, tasks sum the gradient over their documents, the
sums meet in a tree, and one Adam step follows.  All positions train once, and the
weights don't depend on how the documents lie in partitions (but for rounding).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, IntTable, hash_runs, signed, slices, text_bytes, words_of
from .scratch import Scratch

CLASSES, MEMBERS, RARE, STARTS = 64, 64, 64, 64
FREQUENT = CLASSES * MEMBERS - RARE
#: The token beyond either end of a document.
PAD = CLASSES * MEMBERS
#: The token of a word with ending e and beginning b is COMPOSED + e * STARTS + b.
COMPOSED = PAD + 1
SIDE, WIDTH, HIDDEN = 2, 16, 32
SHIFTS = [d for d in range(-SIDE, SIDE + 1) if d]
SHAPES = {
    "table": (PAD + 1, WIDTH),
    "l1": (len(SHIFTS) * WIDTH + 1, HIDDEN),
    "lc": (HIDDEN + 1, CLASSES),
    "lm": (CLASSES, HIDDEN + 1, MEMBERS),
    "starts": (STARTS + 1, WIDTH),
    "ws": (HIDDEN, STARTS),
    "bs": (RARE, STARTS),
}
#: Layers that hold weights and, in a last row, their biases.
LAYERS = {"l1": ("w1", "b1"), "lc": ("wc", "bc"), "lm": ("wm", "bm")}
SIZE = sum(math.prod(s) for s in SHAPES.values())
#: Words whose counts every task holds (the rest are joined), tokens in one go and of them in cache, tokens for a task of a step, sums that meet at once.
KNOWN, BATCH, BLOCK, TASK_TOKENS, FAN = 1 << 17, 60_000, 448, 100_000, 32
#: Steps for up to STEP_TOKENS tokens, steps at most, and tasks of a step at most (of them two for each core).
STEPS, STEP_TOKENS, MOST_STEPS, MOST_TASKS = 32, 5_000_000, 64, 1024


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, part, n): each word (by hash), its ending and beginning (as one number), and how often it occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words, part, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            distinct, at, which = np.unique(words, return_index=True, return_inverse=True)
            return distinct, part[at], np.bincount(which, n, len(distinct)).astype(np.int64)

        def row(words: np.ndarray, part: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(part), pa.array(n)], ["w", "part", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                data = LOWER[data]
                starts, ends, _ = words_of(data, offsets)
                words, at, n = np.unique(hash_runs(data, starts, ends), return_index=True, return_counts=True)
                held.append((words, word_parts(data, starts[at], ends[at]), n))
                if len(held) == 16:
                    held[:] = [merged()]
                    if len(held[0][0]) > 500_000:  # bounds the task's memory
                        yield row(*held.pop())
        if held:
            yield row(*merged())

    parts = docs.select("text").mapInArrow(run, "w long, part int, n long")
    return parts.groupBy("w").agg(F.first("part").alias("part"), F.sum("n").alias("n"))


def word_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's ending, by its last two bytes, and beginning, by its first three: ending * STARTS + beginning."""
    ending = hash_runs(data, np.maximum(starts, ends - 2), ends) % np.uint64(RARE)
    beginning = hash_runs(data, starts, np.minimum(starts + 3, ends)) % np.uint64(STARTS)
    return (ending * np.uint64(STARTS) + beginning).astype(np.int32)


class Vocabulary:
    """The words that every task knows: hashes by falling count, their counts, and the count of other than frequent words by ending and beginning."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, part_totals: np.ndarray):
        self.words, self.logs = words, np.log(np.maximum(counts, 1))
        self.counts = counts[:FREQUENT]
        self.part_logs = np.log(np.maximum(part_totals, 1))
        self.part_totals = part_totals

    def table(self) -> IntTable:
        return IntTable(self.words, np.arange(len(self.words), dtype=np.int32))

    def output_counts(self) -> np.ndarray:
        out = np.zeros(PAD)
        out[: len(self.counts)] = self.counts
        out[FREQUENT:] = self.part_totals.reshape(RARE, STARTS).sum(1)
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a written table of word counts.  Words come in levels by the logarithm of their count; the highest
    are known to every task while they hold at most KNOWN words together, and of the next level the share by hash that fits."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["level"])  # under 512 rows
    total, lowest, rest = 0, 1 << 30, F.lit(False)
    for r in sizes:
        if total + r["k"] > KNOWN:
            rest = (level == r["level"]) & (F.pmod(F.xxhash64("w"), F.lit(1 << 30)) < int((1 << 30) * (KNOWN - total) / r["k"]))
            break
        total, lowest = total + r["k"], r["level"]
    top = counts.where((level >= lowest) | rest).select("w", "part", "n").toArrow()  # about KNOWN rows
    words, n = top["w"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((words, -n))[:KNOWN]
    totals = np.zeros(RARE * STARTS)
    for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect():  # RARE * STARTS rows
        totals[r["part"]] = r["n"]
    frequent = order[:FREQUENT]
    totals -= np.bincount(top["part"].to_numpy()[frequent], n[frequent], RARE * STARTS)
    return Vocabulary(words[order], n[order], totals)


def tokens(data: np.ndarray, offsets: np.ndarray, table: IntTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token of each word, its place among the known words (-1: not known), its hash, and each row's offsets into them."""
    data = LOWER[data]
    starts, ends, at = words_of(data, offsets)
    hashes = hash_runs(data, starts, ends)
    known = table.get(signed(hashes))
    out = known.astype(np.int64)
    rare = np.flatnonzero((known < 0) | (known >= FREQUENT))
    out[rare] = COMPOSED + word_parts(data, starts[rare], ends[rare])
    return out, known, hashes, at


def padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sequence with SIDE pads before, between and after the rows, and the place of each token in it."""
    place = np.arange(len(ids)) + SIDE * (1 + np.repeat(np.arange(len(at) - 1), np.diff(at)))
    out = np.full(len(ids) + SIDE * len(at), PAD, np.int64)
    out[place] = ids
    return out, place


def start_weights(output_counts: np.ndarray, part_totals: np.ndarray) -> np.ndarray:
    """Random inner weights; the biases are the outputs' own frequencies, so training starts from the unigram model."""
    rng = np.random.default_rng(11)
    flat = np.zeros(SIZE)
    w = views(flat)
    w["table"][:] = rng.standard_normal(w["table"].shape) * 0.3
    w["w1"][:] = rng.standard_normal(w["w1"].shape) / math.sqrt(len(w["w1"]))
    w["wc"][:], w["wm"][:] = rng.standard_normal(w["wc"].shape) * 0.02, rng.standard_normal(w["wm"].shape) * 0.02
    share = (output_counts + 0.1).reshape(CLASSES, MEMBERS)
    w["bc"][:] = np.log(share.sum(1) / share.sum())
    w["bm"][:] = np.log(share / share.sum(1, keepdims=True))
    share = (part_totals + 0.1).reshape(RARE, STARTS)
    w["bs"][:] = np.log(share / share.sum(1, keepdims=True))
    w["ws"][:], w["starts"][:] = rng.standard_normal(w["ws"].shape) * 0.02, rng.standard_normal(w["starts"].shape) * 0.1
    return flat.astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Each part of the flat vector by its name, and weights and biases of each layer by theirs."""
    out, at = {}, 0
    for name, s in SHAPES.items():
        out[name] = flat[at : at + math.prod(s)].reshape(s)
        at += math.prod(s)
    for name, (weights, biases) in LAYERS.items():
        out[weights], out[biases] = out[name][..., :-1, :], out[name][..., -1, :]
    return out


def composed(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The output of each token, and the beginning of those put together (of others STARTS)."""
    part = seq - COMPOSED
    return np.where(part >= 0, FREQUENT + part // STARTS, seq), np.where(part >= 0, part % STARTS, STARTS)


class Pass:
    """The network over tokens a to b of a padded sequence.

    Only the hidden layer is held for all of them, with a last column of ones for the biases.
    Everything wider exists for BLOCK tokens at a time, small enough to stay in a core's cache,
    with a row for each output, so that what is done to a token runs along long rows.
    """

    def __init__(self, w: dict[str, np.ndarray], seq: np.ndarray, a: int, b: int):
        self.w, self.n, self.near = w, b - a, seq[a - SIDE : b + SIDE]
        self.outputs, self.begins = composed(self.near)
        self.hidden = np.ones((self.n, HIDDEN + 1), w["l1"].dtype)
        for i in range(0, self.n, BLOCK):
            out = self.hidden[i : i + BLOCK, :HIDDEN]
            np.tanh(self.inputs(i, i + len(out)).T @ w["l1"], out=out)
        # Each block holds tokens of one class, in the order of members; pads, behind the last class, predict nothing.
        target = self.outputs[SIDE : SIDE + self.n]
        self.order = np.argsort(target.astype(np.uint16), kind="stable")
        self.target, self.begin = target.take(self.order), self.begins[SIDE : SIDE + self.n].take(self.order)
        cuts = np.searchsorted(self.target, np.arange(CLASSES + 1) * MEMBERS).tolist()
        self.pads = self.order[cuts[CLASSES] :]
        self.blocks = [(c, i, min(i + BLOCK, to)) for c, (at, to) in enumerate(zip(cuts, cuts[1:])) for i in range(at, to, BLOCK)]

    def inputs(self, i: int, j: int) -> np.ndarray:
        """The neighbours' vectors of tokens i to j, one above the other, and a row of ones."""
        at = slice(i, j + 2 * SIDE)
        vectors = self.w["table"].take(self.outputs[at], axis=0) + self.w["starts"].take(self.begins[at], axis=0)
        vectors = np.ascontiguousarray(vectors.T)
        x = np.empty((len(SHIFTS) * WIDTH + 1, j - i), vectors.dtype)
        for k, d in enumerate(SHIFTS):
            x[k * WIDTH : (k + 1) * WIDTH] = vectors[:, SIDE + d : SIDE + d + j - i]
        x[-1] = 1
        return x

    def far(self) -> np.ndarray:
        """Whether a logit of each class's softmaxes may lie beyond +-60, with hidden values within +-1."""
        w = self.w
        most = np.maximum(np.abs(w["lc"]).sum(0).max(), np.abs(w["lm"]).sum(1).max(1))
        most[-1] = max(most[-1], (np.abs(w["ws"]).sum(0) + np.abs(w["bs"])).max())
        return most > 60

    def softmaxes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], list[tuple], np.ndarray, np.ndarray]]:
        """For each block its class, places, hidden rows, the layers of its softmaxes (class, member, and of words put together,
        all of the last class, beginning), where each has the tokens' own outputs, the exponentials and their sums."""
        w = self.w
        room = np.empty(3 * MEMBERS * BLOCK, self.hidden.dtype)
        starts = np.vstack([w["ws"], np.zeros(STARTS, w["ws"].dtype)])
        far = self.far()
        for c, i, j in self.blocks:
            place, member, column = self.order[i:j], self.target[i:j] - c * MEMBERS, np.arange(j - i)
            rows = self.hidden.take(place, axis=0)
            layers, own = [w["lc"], w["lm"][c]], [c, (member, column)]
            if c == CLASSES - 1:
                layers, own = [*layers, starts], [*own, (self.begin[i:j], column)]
            e = room[: len(layers) * MEMBERS * (j - i)].reshape(len(layers), MEMBERS, j - i)
            for logits, layer in zip(e, layers):
                np.matmul(layer.T, rows.T, out=logits)
            if c == CLASSES - 1:
                e[2] += w["bs"].T.take(member, axis=1)
            if far[c]:
                np.clip(e, -60, 60, out=e)  # so that nothing overflows or vanishes
            np.exp(e, out=e)
            yield c, place, rows, layers, own, e, e.sum(1)

    def log_probabilities(self) -> np.ndarray:
        """log p(token | neighbours) for each token, 0 for pads, in their order."""
        out = np.zeros(self.n)
        for _, place, _, _, own, e, sums in self.softmaxes():
            share = np.ones(len(place))
            for part, at, total in zip(e, own, sums):
                share *= part[at]
                share /= total
            out[place] = np.log(share)
        return out

    def gradient(self, into: dict[str, np.ndarray]) -> None:
        """Add the gradient of the summed loss; the hidden layer is used up."""
        for c, place, rows, layers, own, e, sums in self.softmaxes():
            e *= 1 / sums[:, None]
            for part, at in zip(e, own):
                part[at] -= 1
            into["lc"] += (e[0] @ rows).T
            into["lm"][c] += (e[1] @ rows).T
            back = e[0].T @ layers[0].T
            back += e[1].T @ layers[1].T
            if c == CLASSES - 1:
                into["ws"] += (e[2] @ rows)[:, :HIDDEN].T
                member = own[1][0]
                first = np.flatnonzero(np.diff(member, prepend=-1))
                into["bs"][member[first]] += np.add.reduceat(e[2], first, axis=1).T
                back += e[2].T @ layers[2].T
            rows *= rows
            back *= np.subtract(1, rows, out=rows)
            self.hidden[place] = back
        inner, self.hidden = self.hidden[:, :HIDDEN], None
        inner[self.pads] = 0
        # Token j is neighbour d of token j - d: one vector for each token gathers what all its roles send back.
        to_token = np.zeros((WIDTH, self.n + 2 * SIDE), inner.dtype)
        for i in range(0, self.n, BLOCK):
            part = inner[i : i + BLOCK]
            j = i + len(part)
            into["l1"] += self.inputs(i, j) @ part
            x = self.w["w1"] @ part.T
            for k, d in enumerate(SHIFTS):
                to_token[:, SIDE + d + i : SIDE + d + j] += x[k * WIDTH : (k + 1) * WIDTH]
        for i, row in enumerate(to_token):
            g = np.bincount(self.near, row, COMPOSED + RARE * STARTS)
            parts = g[COMPOSED:].reshape(RARE, STARTS)
            into["table"][:, i] += g[:COMPOSED]
            into["table"][FREQUENT:PAD, i] += parts.sum(1)
            into["starts"][:STARTS, i] += parts.sum(0)
            into["starts"][STARTS, i] += g[:COMPOSED].sum()


def batches_of(seq: np.ndarray) -> Iterator[tuple[int, int]]:
    for a in range(SIDE, len(seq) - SIDE, BATCH):
        yield a, min(a + BATCH, len(seq) - SIDE)


def summed_gradient(w: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray, into: np.ndarray) -> None:
    """Add the gradient over rows of tokens to the flat vector ``into``."""
    seq, _ = padded(ids, at)
    parts = views(into)
    for a, b in batches_of(seq):
        Pass(w, seq, a, b).gradient(parts)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t = rate, 0
        self.m = self.v = np.zeros(SIZE)

    def step(self, flat: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.98 * self.v + 0.02 * g * g
        move = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.98**self.t)) + 1e-7)
        return (flat - self.rate * rate * move).astype(np.float32)


def token_batches(docs: DataFrame, known: Vocabulary, steps: int, slots: int) -> DataFrame:
    """(step, slot, ids): tokens of each document, its mini-batch, and a slot within it in turn."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # KNOWN words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, turn = shared.value.table(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, _, _, at = tokens(*text_bytes(part.column("text")), table)
                flat = ids.astype("<u2").tobytes()
                slot = (turn + np.arange(part.num_rows)) % slots
                turn += part.num_rows
                lists = pa.array([flat[2 * a : 2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("step"), pa.array(slot.astype(np.int32)), lists], ["step", "slot", "ids"])

    dealt = docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)).cast("int").alias("step"))
    return dealt.mapInArrow(run, "step int, slot int, ids binary").where("length(ids) > 0")


def _gradients(part: DataFrame, flat: np.ndarray) -> DataFrame:
    """(n, g): the number of tokens and the summed gradient of each task."""
    shared = part.sparkSession.sparkContext.broadcast(flat)  # SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, n = views(shared.value), np.zeros(SIZE, np.float32), 0
        for batch in batches:
            for rows in slices(batch, "ids"):
                data, offsets = text_bytes(rows.column("ids"))
                summed_gradient(w, data.view("<u2").astype(np.int64), offsets // 2, total)
                n += len(data) // 2
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "g"])

    return part.select("ids").mapInArrow(run, "n long, g binary")


def _sum_of(parts: Iterator[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    n, total = 0, np.zeros(SIZE)
    for k, g in parts:
        n, total = n + k, total + np.frombuffer(g, np.float32)
    return n, total


def _summed(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = _sum_of((k, g) for batch in batches for k, g in zip(batch.column("n").to_pylist(), batch.column("g").to_pylist()))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["n", "g"])

    return parts.mapInArrow(run, "n long, g binary")


def steps_for(tokens_: int) -> int:
    """Mini-batches for so many tokens: they grow with the root, up to a bound."""
    return max(STEPS, min(MOST_STEPS, round(STEPS * math.sqrt(tokens_ / STEP_TOKENS))))


def tasks_for(tokens_: int, steps: int, cores: int) -> int:
    """Tasks of one step; each streams its documents, so a task may have any number of tokens."""
    return max(1, min(math.ceil(tokens_ / (steps * TASK_TOKENS)), 2 * cores, MOST_TASKS))


def train(docs: DataFrame, known: Vocabulary, scratch: Scratch, steps: int | None, rate: float) -> np.ndarray:
    """One Adam step for each of ``steps`` mini-batches of (doc_id, text); each reads its own part of a written table."""
    total = int(known.output_counts().sum())
    steps = steps or steps_for(total)
    slots = tasks_for(total, steps, docs.sparkSession.sparkContext.defaultParallelism)
    dealt = token_batches(docs, known, steps, slots).repartition(steps * slots, "step", "slot")
    dealt = scratch.save(dealt, "tokens", partition_by="step")
    flat, adam = start_weights(known.output_counts(), known.part_totals), Adam(rate)
    for i in range(steps):
        parts, left = _gradients(dealt.where(F.col("step") == i).select("ids"), flat), slots
        while left > FAN:
            left = math.ceil(left / FAN)
            parts = _summed(parts.repartition(left))
        n, g = _sum_of((r["n"], r["g"]) for r in parts.coalesce(FAN).collect())  # about FAN sums of SIZE numbers
        if n:
            flat = adam.step(flat, g / n, 1 - 0.9 * i / steps)
    scratch.drop(dealt)
    return flat


def score_documents(docs: DataFrame, steps: int | None = None, rate: float = 0.06) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row of (doc_id, text).

    log_likelihood sums the natural log-probabilities of all words (lower case)
    given their neighbours.  Null, empty and wordless texts have 0 tokens, 0.0 and
    null.  Repeated rows and null ids get a row each.  Other columns are ignored;
    an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "masked_lm")
    docs = docs.select("doc_id", "text")
    counts = scratch.save(word_counts(docs), "counts")
    known = vocabulary(counts)
    flat = train(docs, known, scratch, steps, rate)
    shared = docs.sparkSession.sparkContext.broadcast((known, flat))  # KNOWN words and SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        table, w = known.table(), views(flat)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, place_known, hashes, at = tokens(*text_bytes(part.column("text")), table)
                logs = np.zeros(len(ids) + 1)
                seq, place = padded(ids, at)
                every = np.zeros(len(seq))
                for a, b in batches_of(seq):
                    every[a:b] = Pass(w, seq, a, b).log_probabilities()
                logs[1:] = every[place]
                rare = np.flatnonzero(ids >= COMPOSED)
                logs[1 + rare] -= known.part_logs[ids[rare] - COMPOSED]
                local = rare[place_known[rare] >= 0]
                logs[1 + local] += known.logs[place_known[local]]
                rest = rare[place_known[rare] < 0]
                upto = np.cumsum(logs)
                words = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, at), pa.int32()), pa.array(signed(hashes[rest]), pa.int64()))
                columns = [part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(upto[at[1:]] - upto[at[:-1]]), words]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "known", "words"])

    scored = docs.mapInArrow(run, "doc_id long, n long, known double, words array<long>").withColumn("row", F.monotonically_increasing_id())
    scored = scratch.save(scored, "scored")
    # The counts of all other words are joined; none of them is frequent, so no key is hot.
    rest = scored.select("row", F.explode("words").alias("w")).join(counts.select("w", F.log("n").alias("log_n")), "w")
    rest = rest.groupBy("row").agg(F.sum("log_n").alias("rest"))
    total = F.when(F.col("n") > 0, F.col("known") + F.coalesce("rest", F.lit(0.0))).otherwise(0.0)
    out = scored.select("row", "doc_id", "n", "known").join(rest, "row", "left").select("doc_id", F.col("n").alias("n_tokens"), total.alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.withColumn("mean_log_likelihood", mean)
