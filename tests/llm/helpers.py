"""Small inputs with every awkward row, and plain versions of what the operators compute."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *[T.StructField(n, T.StringType()) for n in ("score", "spans", "decoded", "token_ids", "text_key", "kept", "a.b")],
    ]
)


def documents(spark, texts):
    """Rows of (id, text) as documents with clashing columns."""
    rows = [(i, t, "en" if t else None, None, None if t is None else len(t), "x", "y", "z", "w", "v", "u", "t") for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


class Classes:
    def __init__(self, ids):
        self.above = {i: i for i in ids}

    def find(self, i):
        while self.above[i] != i:
            i = self.above[i]
        return i

    def join(self, i, j):
        i, j = sorted((self.find(i), self.find(j)))
        self.above[j] = i


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_classes(texts, size):
    """The class of each id, by comparing all pairs that have a shingle in common."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, items in sets.items():
        for item in items:
            holders[item].append(i)
    classes = Classes(texts)
    for i, items in sets.items():
        for j in {j for item in items for j in holders[item] if j < i}:
            both = len(items & sets[j])
            if 100 * both >= 80 * (len(items) + len(sets[j]) - both):
                classes.join(i, j)
    return {i: classes.find(i) for i in texts}, sets


def without_repeats(texts, length):
    """(bytes, spans, kept bytes) of each text, from a table of all strings of that length."""
    data = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for d, b in enumerate(data):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((d, p))
    gone = [bytearray(len(b)) for b in data]
    for found in places.values():
        if len(found) > 1:
            for d, p in found:
                gone[d][p : p + length] = b"\1" * length
    out = []
    for b, g in zip(data, gone, strict=True):
        spans = [m.span() for m in re.finditer(b"\1+", bytes(g))]
        out.append((len(b), spans, bytes(x for x, y in zip(b, g, strict=True) if not y)))
    return out
