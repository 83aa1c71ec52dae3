"""Language identification by the nearest of several centroids per language.

A text becomes a vector of the byte n-grams of its words (one to three bytes of the
lower-cased text, word ends included, digits and punctuation left out), hashed into ``BUCKETS`` cells, weighted by 1 + log of the count times the inverse document
frequency, and scaled to length 1. Document frequencies are counted over all rows to
learn from. The vectors of each language in a bounded sample (``PER_LANGUAGE`` different
texts, chosen by their hash, however often each occurs) are clustered into ``CLUSTERS``
centroids by spherical k-means, each language in a task of its own: its sample never comes
to the driver, which gets the centroids and two numbers for each held-back text. A text gets
the language of the centroid of the largest cosine; the score is that cosine. More than
``LANGUAGES`` languages are refused, as the centroids of each take their part of the
driver's memory.

Rejection is by distance. Every fourth sampled text is held back, whole and as a piece of
``PIECES`` bytes from somewhere in it, and compared with centroids of the others. Sorted by
length, each group of these has a usual cosine (its first percentile); between groups it is
a line over the logarithm of the length, and beyond the shortest and longest it stays as it
is there. So every length has a limit: ``REJECT`` of the usual cosine. A table with fewer than
two texts of every language has none to hold back, and rejects nothing by distance.

Defined results: a text that is null or has no letter is ``und`` with score 0 and
rejected. Without rows to learn from everything is ``und``. Ties go to the language that
sorts first. Rows without a language teach nothing. Repeated rows give repeated results.
Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, all_but, groups_of_rows, mapped, schema_with, string_column

BUCKETS, CLUSTERS, ROUNDS = 8192, 4, 12
PER_LANGUAGE, LANGUAGES = 1_200, 1_000
REJECT, GROUP, GROUPS = 0.5, 40, 24
PIECES = (6, 16, 64, 256, 1024, 4096)
SLICE_BYTES, SLICE_ROWS = 1 << 20, 128
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    idf: np.ndarray
    lengths: np.ndarray
    least: np.ndarray

    def limit(self, total: np.ndarray) -> np.ndarray:
        """The least cosine of a text with so many n-grams."""
        return np.interp(log_length(total), self.lengths, self.least)


#: ASCII characters but letters all part words alike.
SEPARATOR = 32
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = SEPARATOR


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by buckets: how often the n-grams of each row's words occur, separators at either end included."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * BUCKETS, np.float32)
    at = np.repeat(np.arange(rows), np.diff(offsets))
    data = PLAIN[data]
    solid = data != SEPARATOR
    code = np.zeros(len(data), np.uint32)
    for n in range(1, 4):
        size = len(data) - n + 1
        if size < 1:
            break
        code = (code[:size] << np.uint32(8)) | data[n - 1 :]
        inside = at[:size] == at[n - 1 :]
        inside &= solid[1 : size + 1] if n == 3 else solid[:size] | solid[n - 1 :]
        bucket = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(19)
        counts += np.bincount((at[:size] * BUCKETS + bucket)[inside], minlength=len(counts)).astype(np.float32)
    return counts.reshape(rows, BUCKETS)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, counts) of parts of a batch."""
    lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column("text"))], names=["text"])
    data, offsets = string_column(lowered, "text")
    for first, last in groups_of_rows(offsets, SLICE_BYTES):
        for start in range(first, last, SLICE_ROWS):
            end = min(start + SLICE_ROWS, last)
            cuts = offsets[start : end + 1]
            yield start, end, gram_counts(data[cuts[0] : cuts[-1]], cuts - cuts[0])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vectors of counts, in one new array."""
    x = np.log1p(counts)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.maximum(norm, 1e-12)[:, None]
    return x


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in stream:
            rows += len(batch)
            for _, _, counts in slices(batch):
                total += np.count_nonzero(counts, axis=0)
        names = ["bucket", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[rows], total]))], names=names)

    found = mapped(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequencies = np.zeros(BUCKETS + 1)
    for bucket, n in found.collect():
        frequencies[bucket + 1] = n
    return int(frequencies[0]), frequencies[1:]


def sparse(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a row that are not zero, and what they hold."""
    cells = np.flatnonzero(row).astype(np.int16)
    return cells, row[cells]


def blocks(rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """``SLICE_ROWS`` sparse rows at a time, with their zeros; a sample is never held so as a whole."""
    for first in range(0, len(rows), SLICE_ROWS):
        part = rows[first : first + SLICE_ROWS]
        dense = np.zeros((len(part), BUCKETS), np.float32)
        for row, (cells, values) in zip(dense, part, strict=True):
            row[cells] = values
        yield dense


def products(rows: list[tuple[np.ndarray, np.ndarray]], vectors: np.ndarray) -> np.ndarray:
    """The product of each row with each vector."""
    return np.concatenate([np.zeros((0, len(vectors)), np.float32), *[block @ vectors.T for block in blocks(rows)]])


def sums(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, clusters: int) -> np.ndarray:
    """The sum of the rows of each label."""
    found = np.zeros((clusters, BUCKETS), np.float32)
    for (cells, values), k in zip(rows, label, strict=True):
        found[k][cells] += values
    return found


def sample_counts(sample: DataFrame) -> DataFrame:
    """Language, hash, whether a piece, cells and counts of each different text, whole and a piece of it."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, int]] = set()
        for batch in stream:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist(), strict=True))
            new = [i for i, key in enumerate(keys) if key not in done and not done.add(key)]
            fresh = batch.take(pa.array(new, pa.int64()))
            rows = [(new[first + i], False, *sparse(row)) for first, _, counts in slices(fresh) for i, row in enumerate(counts)]
            data, offsets = string_column(pa.RecordBatch.from_arrays([pc.utf8_lower(fresh.column("text"))], names=["text"]), "text")
            for i, (begin, end) in enumerate(zip(offsets, offsets[1:], strict=False)):
                draw = keys[new[i]][1] % (1 << 31)
                size = PIECES[draw % len(PIECES)]
                if end - begin > size:
                    begin += draw // len(PIECES) % (end - begin - size + 1)
                    rows.append((new[i], True, *sparse(gram_counts(data[begin : begin + size], np.array([0, size]))[0])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[r[0]][0] for r in rows], pa.string()), pa.array([keys[r[0]][1] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2].tobytes() for r in rows], pa.binary()),
                    pa.array([r[3].tobytes() for r in rows], pa.binary()),
                ],
                names=["lang", "hash", "piece", "cells", "counts"],
            )

    found = mapped(sample.select("lang", "hash", "text"), run, "lang string, hash long, piece boolean, cells binary, counts binary")
    # The same text may have come from several tasks.
    return found.dropDuplicates(["lang", "hash", "piece"])


def k_means(rows: list[tuple[np.ndarray, np.ndarray]], clusters: int) -> np.ndarray:
    """Centroids of length 1; the first are far from each other, so that the result is the same each time."""
    centre = sums(rows, np.zeros(len(rows), np.int64), 1) / np.float32(len(rows))
    chosen = [int(np.argmax(products(rows, centre)))]
    while len(chosen) < min(clusters, len(rows)):
        nearest = products(rows, next(blocks([rows[i] for i in chosen]))).max(axis=1)
        chosen.append(int(np.argmin(nearest)))
    centroids = next(blocks([rows[i] for i in chosen]))
    for _ in range(ROUNDS):
        label = np.argmax(products(rows, centroids), axis=1)
        filled = np.isin(np.arange(len(centroids)), label)
        totals = np.where(filled[:, None], sums(rows, label, len(centroids)), centroids)
        centroids = totals / np.maximum(np.linalg.norm(totals, axis=1), 1e-12)[:, None]
    return centroids


def log_length(total: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(total, 1))


def drawn(texts: DataFrame, sizes: dict[str, int], per_language: int) -> list[tuple[str, int]]:
    """(language, hash) of the ``per_language`` texts of each language with the smallest draws."""
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, per_language / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("hash", F.lit(4)), F.lit(1_000_003))
    # Few more than wanted are sorted.
    found = texts.select("lang", "hash", draw.alias("draw")).where(F.col("draw") < 1_000_003 * share * 1.2)
    kept: dict[str, list[tuple[int, int]]] = {}
    for lang, code, place in found.collect():
        kept.setdefault(lang, []).append((place, code))
    return [(lang, code) for lang, codes in kept.items() for _, code in sorted(codes)[:per_language]]


def usual(lengths: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the usual cosine over the logarithm of the length, from held-back texts."""
    if not len(lengths):
        return np.zeros(1), np.zeros(1)
    order = np.argsort(lengths, kind="stable")
    groups = np.array_split(order, max(1, min(GROUPS, len(order) // GROUP)))
    return np.array([np.median(lengths[g]) for g in groups]), np.array([np.quantile(cosines[g], 0.01) for g in groups])


def fitted(rows: pa.Table, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centroids of one language, and lengths and cosines of its held-back texts."""
    codes = np.unique(rows["hash"].to_numpy())
    # Pieces are needed of held-back texts only.
    held = pc.is_in(rows["hash"], pa.array(codes[1::4], pa.int64()))
    rows = rows.append_column("held", held).filter(pc.or_(held, pc.invert(rows["piece"]))).sort_by([("hash", "ascending"), ("piece", "ascending")])
    counts = [
        (np.frombuffer(cells.as_buffer(), np.int16), np.frombuffer(values.as_buffer(), np.float32))
        for cells, values in zip(rows["cells"], rows["counts"], strict=True)
    ]
    size = np.concatenate([block.sum(axis=1) for block in blocks(counts)])
    vectors = [sparse(row) for block in blocks(counts) for row in weighted(block, idf)]
    held, whole = rows["held"].to_numpy(), ~rows["piece"].to_numpy()
    lengths = cosines = np.zeros(0, np.float32)
    own = k_means(list(compress(vectors, whole)), CLUSTERS)
    if held.any():
        others = k_means(list(compress(vectors, whole & ~held)), CLUSTERS)
        compared = held & (size > 0)
        cosines = products(list(compress(vectors, compared)), others).max(axis=1)
        lengths = log_length(size[compared])
    return own, lengths, cosines


def clustered(sample: DataFrame, idf: np.ndarray) -> DataFrame:
    """What ``fitted`` finds for each language; a task has one bounded sample at a time."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        columns = dict(zip(("centroids", "lengths", "cosines"), fitted(rows, idf), strict=True))
        return pa.table({"lang": [key[0]], **{name: [found.tobytes()] for name, found in columns.items()}})

    return sample.groupBy("lang").applyInArrow(run, "lang string, centroids binary, lengths binary, cosines binary")


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = LANGUAGES) -> Model | None:
    """A model from columns ``text`` and ``lang``; None without rows to learn from."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", F.col("lang").cast("string").alias("lang"))
    known = known.withColumn("hash", F.xxhash64("text"))
    scratch = Scratch(known.sparkSession)
    # A text that is repeated very often is one.
    texts = scratch.written(known.select("lang", "hash").distinct(), "language-texts")
    sizes = {lang: n for lang, n in texts.groupBy("lang").count().limit(most_languages + 1).collect()}
    if not sizes:
        scratch.remove()
        return None
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} different languages; give most_languages if they are meant")
    total, frequencies = document_frequencies(known)
    idf = (np.log((1 + total) / (1 + frequencies)) + 1).astype(np.float32)
    wanted = known.sparkSession.createDataFrame(drawn(texts, sizes, per_language), "lang string, hash long")
    scratch.remove()
    sample = known.join(F.broadcast(wanted), ["lang", "hash"], "left_semi")
    found = sorted(clustered(sample_counts(sample), idf).collect())
    languages = sorted(sizes)
    centroids, of, lengths, cosines = [], [], [], []
    for language, *columns in found:
        own, apart, close = (np.frombuffer(bytes(c), np.float32) for c in columns)
        centroids.append(own.reshape(-1, BUCKETS))
        of += [languages.index(language)] * len(centroids[-1])
        lengths.append(apart)
        cosines.append(close)
    knots = usual(np.concatenate(lengths), np.concatenate(cosines))
    return Model(languages, np.concatenate(centroids), np.array(of), idf, knots[0], (REJECT * knots[1]).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` to each row; columns of these names are replaced."""
    added = ("lang_pred", "score", "rejected")
    source = all_but(docs, added)
    if model is None:
        return source.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            size = len(batch)
            best, score, rejected = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, bool)
            for first, last, counts in slices(pa.RecordBatch.from_arrays([column], names=["text"])):
                cosines = weighted(counts, model.idf) @ model.centroids.T
                chosen = np.argmax(cosines, axis=1)
                best[first:last] = model.of[chosen]
                score[first:last] = np.clip(cosines[np.arange(len(chosen)), chosen], 0, 1)
                rejected[first:last] = score[first:last] < model.limit(counts.sum(axis=1))
            without = np.array([x is None or LETTER.search(x) is None for x in column.to_pylist()], bool)
            best[without], score[without], rejected[without] = len(model.languages), 0, True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)],
                names=[*batch.schema.names, *added],
            )

    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    return mapped(source, run, schema_with(source, **kinds))
