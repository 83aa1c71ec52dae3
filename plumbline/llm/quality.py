"""A quality classifier learned from trusted positives and unlabelled text.

Every text is described by numbers of its whole length: shares of kinds of characters,
lengths, and how often words and runs of words repeat. A small network is fitted to the
non-negative unbiased risk of positive-unlabelled learning: the loss of the positives
weighted by the class prior, plus the loss of the unlabelled as negatives less what the
positives among them account for, which is held at zero or above (where it would fall
below, a step is made against it). The prior is estimated before: a classifier of positives
against unlabelled ranks a held-back half, and the prior is the smallest ratio of the
unlabelled to the positives above a rank, with allowance for chance (best bin).

All documents are the unlabelled text, whatever their label, since labels are of a part of
them that nobody drew by chance; only quality 1 is looked at. So a table of which every row is
labelled teaches as well. The network is fitted on a bounded sample of ``POSITIVES`` and
``UNLABELLED`` rows, chosen by the hash of text and id so that neither a text nor an id that
fills a third of the table comes as a whole; scores are given to all rows.

Defined results: null and empty texts are scored like any other. Labels without a quality
count as none; of several labels of a document the largest counts. With fewer than two
positives or two rows every score is 0.5. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, all_but, groups_of_rows, mapped, mix, schema_with, string_column
from plumbline.llm.shingles import FACTORS, word_hashes

POSITIVES, UNLABELLED = 6_000, 12_000
HIDDEN, EPOCHS, STEP, BATCH = 16, 60, 0.01, 512
SLICE_BYTES = 1 << 20
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789",
    "stop": ".,;:'\"()-?", "shout": "!", "bar": "|", "sign": "#$%&*+/<=>@[\\]^_`{}~", "line": "\n", "blank": " \t\r",
}
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _number, _members in enumerate(CLASSES.values()):
    CLASS_OF[[ord(c) for c in _members]] = _number
FEATURES = len(CLASSES) + 1 + 7


def _distinct(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Different values of each row."""
    if not len(values):
        return np.zeros(count)
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    new = np.ones(len(v), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=count).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets)
    at = np.repeat(np.arange(rows), size)
    kinds = len(CLASSES) + 1
    shares = np.bincount(at * kinds + CLASS_OF[data], minlength=rows * kinds).reshape(rows, kinds).astype(float)
    letters = shares[:, 0] + shares[:, 1]
    lines = shares[:, list(CLASSES).index("line")] + 1
    words, counts = word_hashes(data, offsets)
    of = np.repeat(np.arange(rows), counts)
    triples = mix(words[:-2] * FACTORS[0] + words[1:-1] * FACTORS[1] + words[2:] * FACTORS[2]) if len(words) > 2 else words[:0]
    inside = of[:-2] == of[2:] if len(words) > 2 else np.zeros(0, bool)
    same = (words[1:] == words[:-1]) & (of[1:] == of[:-1]) if len(words) > 1 else np.zeros(0, bool)
    of_triple = of[:-2][inside] if len(words) > 2 else of[:0]
    n, n3 = np.maximum(counts, 1), np.maximum(np.bincount(of_triple, minlength=rows), 1)
    extra = [
        np.log1p(size), shares[:, 0] / np.maximum(letters, 1), np.log1p(size / n), _distinct(of, words, rows) / n,
        np.bincount(of[1:][same] if len(words) > 1 else of[:0], minlength=rows) / n,
        _distinct(of_triple, triples[inside], rows) / n3, np.log1p(counts / lines),
    ]
    return np.column_stack([np.sqrt(shares / np.maximum(size, 1)[:, None]), *extra])


def batch_features(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = string_column(batch, "text")
    parts = [
        features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for a, b in groups_of_rows(offsets, SLICE_BYTES)
    ]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


class Network:
    """One hidden layer; ``output`` is the log-odds of a positive."""

    def __init__(self, x: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.weights = [random.normal(size=(x.shape[1], HIDDEN)) / x.shape[1] ** 0.5, np.zeros(HIDDEN), random.normal(size=HIDDEN) / HIDDEN**0.5, np.zeros(1)]
        self.first, self.second, self.steps = [0 * w for w in self.weights], [0 * w for w in self.weights], 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def hidden(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.weights[0] + self.weights[1])

    def output(self, z: np.ndarray) -> np.ndarray:
        return self.hidden(z) @ self.weights[2] + self.weights[3]

    def step(self, z: np.ndarray, slope: np.ndarray) -> None:
        """A step of Adam, given the slope of the risk in each output."""
        h = self.hidden(z)
        back = slope[:, None] * self.weights[2] * (1 - h**2)
        slopes = [z.T @ back, back.sum(axis=0), h.T @ slope, slope.sum(keepdims=True)]
        self.steps += 1
        for i, g in enumerate(slopes):
            g = g + 1e-4 * self.weights[i]
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g**2
            a, b = self.first[i] / (1 - 0.9**self.steps), self.second[i] / (1 - 0.999**self.steps)
            self.weights[i] = self.weights[i] - STEP * a / (np.sqrt(b) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> Network:
    """Minimises the non-negative risk under the prior; without one, plainly tells one from the other."""
    network = Network(np.concatenate([positive, unlabelled]), seed)
    p_all, u_all = network.standard(positive), network.standard(unlabelled)
    random = np.random.default_rng(seed + 1)
    rounds = max(1, len(u_all) // BATCH)
    for _ in range(EPOCHS):
        for _ in range(rounds):
            p = p_all[random.integers(0, len(p_all), BATCH)]
            u = u_all[random.integers(0, len(u_all), BATCH)]
            of_p, of_u = network.output(p), network.output(u)
            slope_u, slope_p = sigmoid(of_u) / BATCH, sigmoid(of_p) / BATCH
            if prior is None:
                network.step(np.concatenate([p, u]), np.concatenate([slope_p - 1 / BATCH, slope_u]))
                continue
            negative = softplus(of_u).mean() - prior * softplus(of_p).mean()
            if negative >= 0:
                network.step(np.concatenate([p, u]), np.concatenate([prior * (slope_p - 1 / BATCH) - prior * slope_p, slope_u]))
            else:
                network.step(np.concatenate([p, u]), np.concatenate([prior * slope_p, -slope_u]))
    return network


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, by the best bin."""
    network = fit(positive[::2], unlabelled[::2], None, 11)
    p = np.sort(network.output(network.standard(positive[1::2])))
    u = np.sort(network.output(network.standard(unlabelled[1::2])))
    cuts = np.quantile(p, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    chance = np.sqrt(np.log(40) / 2 / len(p)) + np.sqrt(np.log(40) / 2 / len(u))
    best = np.argmin((above_u + 1.01 * chance) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.02, 0.98))


@dataclass
class Model:
    network: Network
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.network.output(self.network.standard(x)))


def _sampled_features(texts: DataFrame) -> np.ndarray:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = pa.array([x.tobytes() for x in batch_features(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("positive"), rows], names=["positive", "x"])

    rows = mapped(texts.select("positive", "text"), run, "positive boolean, x binary").collect()
    found = sorted((r[0], bytes(r[1])) for r in rows)
    split = [np.array([np.frombuffer(x) for kind, x in found if kind == wanted]).reshape(-1, FEATURES) for wanted in (True, False)]
    # Sorted, so that the fit is the same each time; shuffled, as the order must not mean anything.
    return [x[np.random.default_rng(3).permutation(len(x))] for x in split]


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("quality")).where("quality is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", F.xxhash64("text", "doc_id").alias("hash"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(
        rows.join(known, "doc_id", "left").select("doc_id", "hash", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good")).distinct(),
        "quality-rows",
    )
    size, good = rows.agg(F.count(F.lit(1)), F.count_if("good")).first()
    # Few more than wanted are sorted.
    draw = lambda seed: F.pmod(F.xxhash64("hash", F.lit(seed)), F.lit(1_000_003))
    near = lambda seed, share: rows.withColumn("draw", draw(seed)).where(F.col("draw") < min(1.0, 1.5 * share) * 1_000_003)
    chosen = [
        near(seed, wanted / max(n, 1)).where(kept).orderBy("draw", "hash").limit(wanted).select("doc_id", "hash", F.lit(positive).alias("positive"))
        for seed, wanted, n, kept, positive in ((5, positives, good, "good", True), (6, unlabelled, size, "true", False))
    ]
    sample = scratch.written(chosen[0].union(chosen[1]), "quality-sample")
    texts = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text", "doc_id"))
    # Copies of a row with its id were drawn as one.
    texts = texts.join(F.broadcast(sample.select("hash").distinct()), "hash", "left_semi").dropDuplicates(["hash"])
    p, u = _sampled_features(texts.join(sample.select("hash", "positive"), "hash"))
    scratch.remove()
    if len(p) < 2 or len(u) < 2:
        return None
    prior = class_prior(p, u)
    return Model(fit(p, u, prior, 17), prior)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``score`` to each row; a column of that name is replaced."""
    source = all_but(docs, ("score",))
    if model is None:
        return source.withColumn("score", F.lit(0.5))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            x = batch_features(pa.RecordBatch.from_arrays([column], names=["text"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, "score"])

    return mapped(source, run, schema_with(source, score=T.DoubleType()))
