"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are lower-case runs of letters.  From labelled documents every token gets
the log-odds of toxic against other text under a mixture of two Dirichlet priors,
one tight about the share of toxic documents (most tokens say nothing) and one of
tokens that toxic documents own.  How likely the second is a priori for a token is
what the counts of its stem (its first four characters) make it, so an inflection
never seen before takes its stem's evidence, and a token seen once says little.  A
constant is taken off each score, so that other text drifts downwards.  A
linear scan finds all maximal-scoring segments of a document (those that no longer
or shorter segment beats).  Their scores are put on a scale of chance by
extreme-value theory: with the background's scale lambda, at which the mean of
exp(lambda * score) over other text is 1, the best segment of n tokens exceeds S
with probability 1 - exp(-K n exp(-lambda S)), and several segments count together
by the sum statistic.  A logistic curve, fitted on labelled documents that gave no
counts, turns the surprise into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, IntTable, hash_runs, runs, signed, slices, text_bytes
from .columns import set_aside
from .samples import bounded_sample, part_of, reservoir
from .scratch import Scratch

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
STEM = 4
#: The two priors: documents that the tight one counts for, and (toxic, other) documents of the second; and how likely the second is.
TIGHT, OWNED, RARE = 50.0, (1.5, 0.5), 0.01
#: What is taken off each token's log-odds, at least.
DRIFT = 0.5
RIDGE = 0.01


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token and of its stem, and each row's offsets into them."""
    data = LOWER[data]
    starts, ends, at = runs(LETTERS[data], offsets)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    fifth = np.searchsorted(lead, starts) + STEM
    limits = np.append(lead, len(data))  # where each character begins, and the end
    stem_end = limits[np.minimum(fifth, len(lead))]
    return hash_runs(data, starts, ends), hash_runs(data, starts, np.minimum(stem_end, ends)), at


def _counts(texts: DataFrame) -> DataFrame:
    """(token, stem, toxic, clean): documents of each class with the token; texts: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                token, stem, at = tokens(*text_bytes(part.column("text")))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                order = np.lexsort((row, token))
                token, stem, row = token[order], stem[order], row[order]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
                token, stem, row = token[new], stem[new], row[new]
                label = part.column("toxic").to_numpy()[row]
                distinct, first = np.unique(token, return_index=True)
                sums = np.add.reduceat(label, first) if len(first) else label[:0]
                n = np.diff(np.append(first, len(token)))
                columns = [pa.array(signed(distinct)), pa.array(signed(stem[first])), pa.array(sums, pa.int64()), pa.array(n - sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["token", "stem", "toxic", "clean"])

    partial = texts.mapInArrow(run, "token long, stem long, toxic long, clean long")
    return partial.groupBy("token", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Model:
    """Scores by token and stem hash (sorted keys), the drift, the extreme-value scale and rate, and the calibration.

    ``background``: how often each token stands in other text.
    """

    def __init__(self, tokens_: tuple[np.ndarray, np.ndarray], stems: tuple[np.ndarray, np.ndarray], background: np.ndarray):
        self.token_keys, self.token_scores = tokens_
        self.stem_keys, self.stem_scores = stems
        total = background.sum()
        mean = float(self.token_scores @ background / total) if total else 0.0
        self.drift = max(DRIFT, mean + DRIFT)
        share = background / total if total else background
        self.rate = max(float(share[self.token_scores > self.drift].sum()), 1 / (total + 1))
        self.scale = self._scale(self.token_scores - self.drift, share)
        self.slope, self.shift = 1.0, -3.0
        self._tables = None

    @staticmethod
    def _scale(scores: np.ndarray, share: np.ndarray) -> float:
        """lambda > 0 at which the mean of exp(lambda * score) is 1 (its largest value, 8, if no score is positive)."""
        lo, hi = 1e-6, 8.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if float(np.exp(np.minimum(mid * scores, 700)) @ share) < 1 else (lo, mid)
        return lo

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def scores(self, token: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """Each token's score: its own log-odds, or else its stem's, or else 0, less the drift."""
        if self._tables is None:
            number = lambda keys: IntTable(keys, np.arange(len(keys), dtype=np.int32))
            self._tables = number(self.token_keys), number(self.stem_keys)
            self._padded = np.append(self.token_scores, 0.0), np.append(self.stem_scores, 0.0)  # entry -1: none
        own = self._tables[0].get(signed(token))
        out = self._padded[0][own]
        new = np.flatnonzero(own < 0)
        out[new] = self._padded[1][self._tables[1].get(signed(stem[new]))]
        return out - self.drift

    def surprise(self, scores: list[float], n: int) -> float:
        """-log of the chance of segments like these among n tokens, the best number of them counted together."""
        normal = sorted((self.scale * s - math.log(max(self.rate * n, 1e-6)) for s in scores), reverse=True)
        best, total = 0.0, 0.0
        for r, value in enumerate(normal, 1):
            total += value
            if total <= 0:
                break
            # exp(-T) T^(r-1) / (r! (r-1)!), halved for each further segment tried.
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return min(best, 200.0)

    def probability(self, surprise: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(surprise) + self.shift)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence of scores.

    Linear time: a list of candidate segments with the cumulative scores at
    their ends is merged from the right as each positive item arrives.
    """
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    places = np.flatnonzero(scores > 0)
    kept: list[tuple[int, int, float, float]] = []  # first, last, cumulative before, cumulative after
    for place, before, after in zip(places.tolist(), upto[places].tolist(), upto[places + 1].tolist()):
        first, last = place, place
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j -= 1
            if j < 0 or kept[j][3] >= after:
                kept.append((first, last, before, after))
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, y - x) for a, b, x, y in kept]


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    distinct, which = np.unique(np.asarray(x, np.float64), return_inverse=True)
    return np.array([math.lgamma(v) for v in distinct])[which]


def log_odds(toxic: np.ndarray, clean: np.ndarray, share: float, owned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of toxic documents with a token less those of all documents, and how likely the token is owned by toxic ones.

    ``toxic`` and ``clean`` count documents with the token, ``share`` is the toxic
    share of all documents, ``owned`` how likely the second prior is a priori.
    """
    priors = np.array([[TIGHT * share, TIGHT * (1 - share)], OWNED])
    evidence = [_log_beta(toxic + a, clean + b) - _log_beta(np.array([a]), np.array([b]))[0] for a, b in priors]
    weight = 1 / (1 + (1 - owned) / owned * np.exp(np.clip(evidence[0] - evidence[1], -700, 700)))
    tight, own = ((toxic + a) / (toxic + clean + a + b) for a, b in priors)
    rate = weight * own + (1 - weight) * tight
    return np.log(rate / (1 - rate)) - math.log(share / (1 - share)), weight


def _train_counts(texts: DataFrame) -> Model:
    # Bounded by the sample: the tokens of at most ``most`` labelled texts.
    counts = _counts(texts).toArrow()
    token, stem, toxic, clean = (counts[c].to_numpy() for c in ("token", "stem", "toxic", "clean"))
    sizes = texts.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    share = ((sizes["t"] or 0) + 1) / ((sizes["n"] or 0) + 2)
    stems, which = np.unique(stem, return_inverse=True)
    of_stem = [np.bincount(which, n, len(stems)) for n in (toxic, clean)]
    stem_scores, owned = log_odds(*of_stem, share, np.full(len(stems), RARE))
    scores, _ = log_odds(toxic, clean, share, np.clip(owned, RARE / 10, 1 - RARE)[which])
    order = np.argsort(token)
    return Model((token[order], scores[order]), (stems, stem_scores), clean[order].astype(np.float64))


def toxic_passages(docs: DataFrame, model: Model, passages: bool = True) -> DataFrame:
    """``docs`` with surprise double, score double and (on request) passages: (first, last, score) of significant segments in tokens.

    ``docs`` needs a text.  Null, empty and letterless texts have no passages and
    the score of no surprise.  Repeated rows get a row each, an empty table gives
    none; a column with the name of a new one gives way to it.
    """
    own, back = set_aside(docs, ["text"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample
    names = own.columns
    extra = ["surprise", "score"] + ["passages"] * passages
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                token, stem, at = tokens(*text_bytes(part.column("text")))
                score = model.scores(token, stem)
                upto = np.searchsorted(np.flatnonzero(score > 0), at)
                surprise = np.zeros(part.num_rows)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(np.diff(upto)).tolist():
                    n = int(at[i + 1] - at[i])
                    segments = maximal_segments(score[at[i] : at[i + 1]])
                    surprise[i] = model.surprise([s for _, _, s in segments], n)
                    if passages:
                        found[i] = [{"first": x, "last": y, "score": s} for x, y, s in segments if model.surprise([s], n) > 3]
                columns = [*part.columns, pa.array(surprise), pa.array(model.probability(surprise))]
                if passages:
                    columns.append(pa.array(found, kind))
                yield pa.RecordBatch.from_arrays(columns, [*names, *extra])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    more = ", passages array<struct<first:int,last:int,score:double>>" * passages
    return back(own.mapInArrow(run, f"{schema}, surprise double, score double{more}"), *extra)


def calibrated(surprise: np.ndarray, toxic: np.ndarray) -> tuple[float, float] | None:
    """Slope and shift of the logistic curve over log1p(surprise) by Newton steps with a small ridge; None with one class."""
    x, y = np.log1p(surprise), toxic.astype(float)
    if not 0 < y.sum() < len(y):
        return None
    spread = max(float(x.std()), 1e-3)
    z, a, b = x / spread, 0.0, math.log(y.mean() / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + RIDGE, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((y - p) * z).sum() - RIDGE * a, (y - p).sum()])
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return max(a, 0.0) / spread, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """A model from documents labelled toxic 0 or 1: at most ``most`` of them, a fifth for calibration.

    Repeated labels count once, the larger one; null labels and ids are left out; a
    repeated document counts once, and documents that share a labelled id are bounded
    like any others.  Without labels nothing is toxic; with labels of
    one class the curve keeps its defaults.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = bounded_sample(labels, "doc_id", "toxic", most)
    held = F.pmod(F.floor(part_of(F.col("doc_id")) / 7), F.lit(5)) == 0
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about ``most`` ids, and any number of rows
    texts = reservoir(labelled.withColumn("all", F.lit(0)), "all", ["all", "doc_id", "text", "toxic"], most, scratch)
    texts = scratch.save(texts.select("text", F.col("toxic").cast("long").alias("toxic"), held.alias("held")), "labelled")
    model = _train_counts(texts.where("not held").select("text", "toxic"))
    seen = toxic_passages(texts.where("held").select("text", "toxic"), model, passages=False)
    seen = seen.select("surprise", "toxic").toArrow()  # bounded by `most`
    curve = calibrated(seen["surprise"].to_numpy(), seen["toxic"].to_numpy())
    if curve:
        model.slope, model.shift = curve
    scratch.drop(texts)
    return model
