"""Toxic passages as segments of maximal score.

Every token (a run of letters and digits, ASCII letters lowered) has a score: how much likelier it is in a
toxic than in another text, as log-odds with an informative Dirichlet prior, whose
pseudo-counts follow the frequency of the token in the whole corpus. Counts are of different
surroundings (the words before and after), so that copies of a text tell no more than the text; they are
estimated from bitmaps (linear counting). Log-odds are drawn towards zero by ``DOUBT`` of their standard
errors. A token is known by its forms, the word and its beginnings; the one that then lies farthest from
zero speaks for it. A drift is taken off every token, so that plain text falls.

A scan in linear time (Ruzzo and Tompa) finds all maximal segments of a text: passages that
gain nothing by being longer or shorter. How high a passage would come by chance is known
from the other texts it was learned from: maximal scores of falling sums follow an
extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)) for n tokens, where lambda solves
E[exp(lambda s)] = 1 and K is fitted. A passage is reported if fewer than ``EXPECTED`` as high are
expected in its text. The passages of a text are joined by the law of sums of the r highest ones, the
best r counts, and the result is turned into a probability by a logistic curve.

What is counted (tokens by class, corpus frequencies, scores by chance, the curve's bins) is counted over all
rows; only the list of scored forms is bounded (``FORMS``, those that tell most).

Defined results: null and empty texts have no passages and the score of a text without any. A
label counts as toxic if any label of the document says so; labels without a value count as none.
Without labels of both kinds every score is 0.5. Repeated rows give repeated results, and count as often
as they stand in the learning rows. Other columns are kept unless they bear the name of an output column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import U64, RollingHash, Scratch, all_but, groups_of_rows, mapped, mix, schema_with, signed, string_column
from plumbline.llm.quality import sigmoid
from plumbline.llm.shingles import FACTORS

#: Lengths in bytes of the beginnings of a word that are forms of it, besides the word itself.
BEGINNINGS = (3, 4, 5, 6, 8)
#: Forms that may be scored; errors taken off a log-odds; fewest texts with a form.
FORMS, DOUBT, LEAST = 65_536, 2.5, 3
#: Pseudo-counts of the prior: of every form, and in all by the corpus.
ATOM, PRIOR = 0.1, 1_000.0
#: Bits of a form's bitmap of surroundings, for each class.
BITS = 256
#: Taken off each token, and the most that a token may score either way.
DRIFT, HIGHEST = 0.5, 6.0
#: Passages as high that may be expected by chance in a text for one to be reported.
EXPECTED = 0.05
#: Parts of a unit in which scores are counted for the law of chance, and bins of the curve.
LATTICE, BINS = 10, 400
SLICE_BYTES = 1 << 20
COUNTED = 1 << 19
ROLL = RollingHash(12)
OUTPUT = ("passages", "log_p", "score")
PASSAGE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("begin", "end", "tokens")] + [T.StructField(n, T.DoubleType()) for n in ("score", "expected")]))

#: Bytes of tokens: letters, digits and all of UTF-8 beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every token, and the number of tokens of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | cut[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A column of hashes for the word and each beginning (0 where the word is not longer)."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    sums = ROLL.sums(low)
    columns = [ROLL.stretch(sums, starts, ends)]
    for n in BEGINNINGS:
        longer = ends - starts > n
        cut = np.minimum(starts + n, ends)
        # A beginning is no word: told apart by its length below zero.
        columns.append(np.where(longer, ~ROLL.stretch(sums, starts, cut), U64(0)))
    return signed(np.column_stack(columns).astype(U64))


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    plain = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text)).cast(pa.string())], names=["text"])
    data, offsets = string_column(plain, "text")
    for first, last in groups_of_rows(offsets, SLICE_BYTES):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


class _Sums:
    """Counts by key, kept in order and let go when there are many."""

    def __init__(self, width: int):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)

    def full(self) -> bool:
        if self.held > COUNTED:
            self.merge()
        return len(self.keys) > COUNTED

    def merge(self) -> None:
        keys, of = np.unique(np.concatenate([self.keys, *[k for k, _ in self.waiting]]), return_inverse=True)
        counts = np.zeros((len(keys), self.counts.shape[1]), np.int64)
        rows = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        for i in range(counts.shape[1]):
            counts[:, i] = np.bincount(of, rows[:, i], len(keys)).astype(np.int64)
        self.keys, self.counts, self.waiting, self.held = keys, counts, [], 0

    def let_go(self, names: list[str]) -> pa.RecordBatch:
        self.merge()
        out = pa.RecordBatch.from_arrays([pa.array(self.keys), *[pa.array(np.ascontiguousarray(c)) for c in self.counts.T]], names=names)
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out


_CLASSES = ["form", "toxic", "other", "toxic_texts", "other_texts"]


def _class_counts(rows: DataFrame) -> DataFrame:
    """(form, toxic, other, toxic_texts, other_texts) of rows (toxic boolean, text): how often, and in how many texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(4)
        for batch in stream:
            toxic = np.array(batch.column("toxic").to_pylist(), bool)
            for first, last, data, offsets in _slices(batch, "text"):
                starts, ends, n = tokens(data, offsets)
                if not len(starts):
                    continue
                found = forms(data, starts, ends)
                row = np.repeat(np.arange(last - first), n)
                key, of = found.ravel(), np.repeat(row, found.shape[1])
                order = np.lexsort((of, key))
                key, of = key[order], of[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
                times = np.diff(np.append(np.flatnonzero(new), len(key)))
                key, kind = key[new], toxic[first:last][of[new]]
                keep = key != 0
                one = np.ones(len(key), np.int64)
                sums.add(key[keep], np.column_stack([times * kind, times * ~kind, one * kind, one * ~kind])[keep])
            if sums.full():
                yield sums.let_go(_CLASSES)
        yield sums.let_go(_CLASSES)

    found = mapped(rows, run, ", ".join(f"{c} long" for c in _CLASSES))
    return found.groupBy("form").agg(*[F.sum(c).alias(c) for c in _CLASSES[1:]])


def _surroundings(rows: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the surroundings in which each of the ``wanted`` forms (sorted) stands, in toxic and in other texts."""
    words = BITS // 64

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(wanted) * 2, BITS), bool)
        for batch in stream:
            toxic = np.array(batch.column("toxic").to_pylist(), bool)
            for first, last, data, offsets in _slices(batch, "text"):
                starts, ends, n = tokens(data, offsets)
                if not len(starts):
                    continue
                found = forms(data, starts, ends)
                word, row = found[:, 0].view(U64), np.repeat(np.arange(last - first), n)
                same = row[1:] == row[:-1]
                around = word * FACTORS[0]
                around[1:] += np.where(same, word[:-1] * FACTORS[1], U64(0))
                around[:-1] += np.where(same, word[1:] * FACTORS[2], U64(0))
                bit = (mix(around) % U64(BITS)).astype(np.int64)
                place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                at, form = np.nonzero(wanted[place] == found)
                seen[place[at, form] * 2 + ~toxic[first:last][row[at]], bit[at]] = True
        packed = np.packbits(seen, axis=1).view(np.int64).reshape(len(wanted), 2 * words)
        at = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(c)) for c in packed[at].T]], names=["place", *[f"w{i}" for i in range(2 * words)]])

    names = [f"w{i}" for i in range(2 * words)]
    packed = np.zeros((len(wanted), 2 * words), np.int64)
    maps = mapped(rows, run, "place long, " + ", ".join(f"{n} long" for n in names))
    for r in maps.groupBy("place").agg(*[F.bit_or(n).alias(n) for n in names]).collect():
        packed[r["place"]] = r[1:]
    filled = np.unpackbits(packed.view(np.uint8), axis=1).reshape(len(wanted), 2, BITS).sum(axis=2)
    return filled[:, 0], filled[:, 1]


def _different(counted: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """How many different surroundings: by linear counting, never more than all; a full bitmap says nothing."""
    estimate = -BITS * np.log(np.maximum(BITS - filled, 1) / BITS)
    return np.where(filled >= BITS - 2, counted, np.minimum(counted, estimate))


def _corpus_counts(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each of the ``wanted`` forms (sorted) stands in all texts."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in stream:
            for _, _, data, offsets in _slices(batch, "text"):
                starts, ends, _ = tokens(data, offsets)
                found = forms(data, starts, ends).ravel()
                place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                total += np.bincount(place[wanted[place] == found], minlength=len(wanted))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros(len(wanted), np.int64)
    for r in mapped(docs, run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


@dataclass
class Table:
    """Scores of forms, sorted by hash."""

    forms: np.ndarray
    score: np.ndarray

    def scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts) or not len(self.forms):
            return np.full(len(starts), -DRIFT)
        found = forms(data, starts, ends)
        place = np.minimum(np.searchsorted(self.forms, found), len(self.forms) - 1)
        score = np.where(self.forms[place] == found, self.score[place], 0.0)
        return score[np.arange(len(found)), np.argmax(np.abs(score), axis=1)] - DRIFT


def _table(toxic: np.ndarray, other: np.ndarray, corpus: np.ndarray, totals: tuple[int, int, int], found: np.ndarray) -> Table:
    """Log-odds of toxic against other texts, less their doubt; the prior follows ``corpus``."""
    n_toxic, n_other, n_corpus = (max(n, 1) for n in totals)
    ratio = n_other / n_toxic
    prior = ATOM + PRIOR * np.maximum(corpus, 1) / n_corpus
    # The prior of a class grows with it, so that a form without a count has even odds.
    up, down = toxic + prior, other + prior * ratio
    odds = np.log(up / down * ratio)
    error = np.sqrt(1 / up + 1 / down)
    score = np.clip(np.sign(odds) * np.maximum(np.abs(odds) - DOUBT * error, 0), -HIGHEST, HIGHEST)
    keep = score != 0
    return Table(found[keep], score[keep])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (first, end, score) of a row of scores, in time linear in its length."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum at the end
    nearest: list[int] = []  # for each kept one the last before it with a smaller sum before, or -1
    for i in np.flatnonzero(scores > 0).tolist():
        first, end, low, high = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = nearest[j]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, end, low, high))
                nearest.append(j)
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:], nearest[j:]
    return [(first, end, float(high - low)) for first, end, low, high in kept]


@dataclass
class Chance:
    """The extreme-value law of the highest segment of a text without toxic passages."""

    rate: float
    log_k: float

    def normal(self, score: float, size: int) -> float:
        return self.rate * score - self.log_k - math.log(max(size, 1))

    def expected(self, score: float, size: int) -> float:
        return math.exp(min(-self.normal(score, size), 700.0))

    def log_p(self, found: list[float], size: int) -> float:
        """-ln of the chance of segments of such scores in a text of ``size`` tokens, by the best number of the highest."""
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted(found, reverse=True), 1):
            total += self.normal(score, size)
            if total <= 0:
                break
            # P(sum of r highest >= x) is about exp(-x) x**(r-1) / (r! (r-1)!); the choice of r costs a factor 2**r.
            value = total - (r - 1) * math.log(max(total, 1e-9)) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2)
            best = max(best, value)
        return best


def _rate(lattice: np.ndarray, counts: np.ndarray) -> float:
    """lambda of E[exp(lambda s)] = 1, for scores that fall on average."""
    share = counts / counts.sum()
    if share @ lattice >= 0:
        raise ValueError("Scores do not fall on average; raise the drift.")
    if lattice[counts > 0].max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while share @ np.exp(np.minimum(high * lattice, 700)) < 1:
        low, high = high, 2 * high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if share @ np.exp(middle * lattice) < 1 else (low, middle)
    return max((low + high) / 2, 1e-3)


@dataclass
class Model:
    table: Table
    chance: Chance
    slope: float
    level: float

    def probability(self, log_p: float) -> float:
        return float(sigmoid(np.float64(self.level + self.slope * log_p)))


def _row_segments(table: Table, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """(starts, ends, scores, segments) of each row."""
    starts, ends, counts = tokens(data, offsets)
    scores = table.scores(data, starts, ends)
    upto = np.concatenate([[0], np.cumsum(counts)]).tolist()
    for a, b, base in zip(upto[:-1], upto[1:], offsets[:-1].tolist(), strict=True):
        mine = scores[a:b]
        yield starts[a:b] - base, ends[a:b] - base, mine, segments(mine) if b > a else []


def _chance(other: DataFrame, table: Table) -> Chance:
    """The law of chance from texts that are not toxic: all their tokens, then the highest segment of each."""
    width = int((2 * HIGHEST + DRIFT + 1) * LATTICE) + 1
    lowest = -HIGHEST - DRIFT

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in stream:
            for _, _, data, offsets in _slices(batch, "text"):
                starts, ends, _ = tokens(data, offsets)
                total += np.bincount(np.rint((table.scores(data, starts, ends) - lowest) * LATTICE).astype(np.int64), minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["place", "n"])

    counts = np.zeros(width, np.int64)
    for r in mapped(other, count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[r["place"]] = r["n"]
    if not counts.sum():
        return Chance(1.0, 0.0)
    rate = _rate(np.arange(width) / LATTICE + lowest, counts)

    def highest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = texts = 0.0
        for batch in stream:
            for _, _, data, offsets in _slices(batch, "text"):
                for _, _, scores, found in _row_segments(table, data, offsets):
                    if len(scores):
                        total += len(scores) * math.exp(-rate * max((s for _, _, s in found), default=0.0))
                        texts += 1
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([texts])], names=["total", "texts"])

    # K n exp(-lambda S) of the highest segment has mean 1.
    total, texts = mapped(other, highest, "total double, texts double").agg(F.sum("total"), F.sum("texts")).first()
    return Chance(rate, math.log(texts / total) if texts and total else 0.0)


def _curve(bins: list[tuple[int, bool, int]]) -> tuple[float, float]:
    """Slope and level of the logistic curve over -ln p, by Newton's method; the slope is positive."""
    x = np.array([b[0] for b in bins], float) * (100 / BINS)
    y, w = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    design = np.column_stack([np.ones(len(x)), x])
    pull = np.array([1e-3, 1e-2])

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float(w @ (np.logaddexp(0, z) - y * z) + pull @ at**2 / 2)

    at = np.array([math.log((w @ y + 1) / (w @ (1 - y) + 1)), 0.0])
    for _ in range(100):
        p = sigmoid(design @ at)
        slope = design.T @ (w * (p - y)) + pull * at
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.diag(pull), slope)
        # Halved until the loss falls, as the curve is flat far from its middle.
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[1]), 1e-3), float(at[0])


def learn(docs: DataFrame, labels: DataFrame, corpus: DataFrame, scratch: Scratch) -> Model | None:
    """A model from ``docs`` (doc_id, text), their ``labels`` (doc_id, toxic), and the texts of the whole ``corpus``."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).where("toxic is not null")
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # Merged at every size: labels are never few for long.
    rows = scratch.written(docs.select("doc_id", "text").join(known.hint("merge"), "doc_id").select("toxic", "text"), "labelled")
    sizes = {kind: n for kind, n in rows.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return None
    counts = scratch.written(_class_counts(rows), "forms")
    totals = counts.agg(F.sum("toxic"), F.sum("other")).first()
    # Those that tell most by their texts, before the prior is known.
    share = (F.col("toxic_texts") + 0.5) / (sizes[True] + 1), (F.col("other_texts") + 0.5) / (sizes[False] + 1)
    error = F.sqrt(1 / (F.col("toxic_texts") + 0.5) + 1 / (F.col("other_texts") + 0.5))
    least = F.col("toxic_texts") + F.col("other_texts") >= LEAST
    best = counts.where(least).withColumn("z", F.abs(F.log(share[0]) - F.log(share[1])) / error).orderBy(F.desc("z"), "form").limit(FORMS)
    found = sorted(tuple(r) for r in best.select("form", "toxic", "other").collect())
    wanted = np.array([r[0] for r in found], np.int64)
    if not len(wanted):
        return None
    in_corpus = _corpus_counts(corpus.select("text"), wanted)
    # Prior and classes are measured by the same tokens: all forms of all learning texts.
    size = max(int(in_corpus.sum() * (totals[0] + totals[1]) / max(sum(r[1] + r[2] for r in found), 1)), 1)
    filled = _surroundings(rows, wanted)
    different = [_different(np.array([r[k + 1] for r in found], float), filled[k]) for k in (0, 1)]
    table = _table(*different, in_corpus, (totals[0], totals[1], size), wanted)
    chance = _chance(rows.where("not toxic").select("text"), table)
    raw = Model(table, chance, 1.0, 0.0)
    bins = passages(rows, raw).select(F.least(F.floor(F.col("log_p") * (BINS / 100)), F.lit(BINS)).alias("bin"), "toxic").groupBy("bin", "toxic").count()
    slope, level = _curve([tuple(r) for r in bins.collect()])
    return Model(table, chance, slope, level)


def passages(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``passages`` (begin and end in bytes of UTF-8, tokens, score, how many as high chance would
    bring), ``log_p`` (-ln of the chance of all of them) and ``score`` (0 to 1) to each row."""
    source = all_but(docs, OUTPUT)
    if model is None:
        return source.select("*", F.lit(None).cast(PASSAGE).alias("passages"), F.lit(0.0).alias("log_p"), F.lit(0.5).alias("score"))
    fields = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            reported, logs = [], []
            for _, _, data, offsets in _slices(batch, text):
                for starts, ends, scores, found in _row_segments(model.table, data, offsets):
                    size = len(scores)
                    logs.append(model.chance.log_p([s for _, _, s in found], size))
                    rows = [(a, b, s, model.chance.expected(s, size)) for a, b, s in found]
                    reported.append([
                        {"begin": int(starts[a]), "end": int(ends[b - 1]), "tokens": b - a, "score": s, "expected": e}
                        for a, b, s, e in rows if e < EXPECTED
                    ])
            scores = [model.probability(x) for x in logs]
            columns = [pa.array(reported, fields), pa.array(logs, pa.float64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *OUTPUT])

    return mapped(source, run, schema_with(source, passages=PASSAGE, log_p=T.DoubleType(), score=T.DoubleType()))
