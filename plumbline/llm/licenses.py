"""License scans: fingerprints choose candidates, alignment reports what matches.

The words of the templates (letters and digits, A-Z lowered) give k-grams, of whose hashes the
smallest in each stretch of ``STRETCH`` is kept. These winnowed fingerprints form an inverted index
from hash to template and place. All k-grams of a text are looked up in it, and hits of a template on neighbouring diagonals are a candidate,
unless the text there holds too few of the template's words. A
banded local alignment of the template with the text around the candidate gives the
matched words. Reported are the share of the template's words that match (coverage) and the
span in the text from the first matched word to the last, from ``COVERAGE`` on. Any
k + stretch - 1 = 3 words in common make a hit. A template of n words of which c are changed keeps
a run of 3 when n > 3c + 2, which holds for all that a coverage of 0.7 allows from ``SHORT`` words on.

Templates below ``SHORT`` words are found by single words instead: a match of m of n words
holds one of any n - m + 1, so the words that are rarest in the templates are their fingerprints. Around each, a text with
enough of the template's words is aligned whole. So every match from ``coverage`` on is a candidate,
wherever words are changed and with up to ``EXTRA`` more between them.

The index lives in each task. It is cut into shards of at most ``SHARD_WORDS`` words, each of
which is a pass over the texts, so its size is bounded however many templates there are; a
template is never cut.

Defined results: null and empty texts, and templates without words, match nothing. Of overlapping spans of a
template the one with more matches stays, then the first. Repeated rows give repeated
results, and texts are scanned whole. Offsets are code points, ends not included.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, groups_of_rows, mapped, mix, string_column
from plumbline.llm.shingles import FACTORS, word_hashes, word_places
from plumbline.llm.suffixes import least_of_windows

GRAM, STRETCH = 2, 2
SHORT, EXTRA = 21, 8
COVERAGE = 0.7
SHARD_WORDS = 200_000
SLICE_BYTES = 1 << 20
#: Bytes that part words: all of ASCII but letters and digits.
PARTING = np.arange(256, dtype=np.uint8)
PARTING[[b for b in range(128) if not chr(b).isalnum()]] = 32

#: Notices as their licenses ask for them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        'required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS '
        'IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    total = max(len(words) - size + 1, 0)
    joined = np.zeros(total, U64)
    for i in range(size):
        joined += words[i : i + total] * FACTORS[i]
    return mix(joined + U64(size))


def winnowed(hashes: np.ndarray, stretch: int) -> np.ndarray:
    """Places of the smallest hash of each stretch; all of fewer hashes are one stretch."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = U64((1 << 24) - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=U64)
    return np.unique((least_of_windows(ranked, min(stretch, len(hashes))) & low).astype(np.int64))


def text_words(text: str) -> np.ndarray:
    data = PARTING[np.frombuffer(text.encode(), np.uint8)]
    return word_hashes(data, np.array([0, len(data)]))[0]


def needed(template: np.ndarray, coverage: float) -> int:
    """The least number of matched words that is enough; one at least."""
    return next((m for m in range(1, len(template)) if m >= coverage * len(template)), len(template))


class Index:
    """The fingerprints of some templates, sorted by hash, with the places where they stand."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        found = [(name, text_words(text)) for name, text in templates]
        self.names = [name for name, words in found if len(words)]
        self.words = [words for _, words in found if len(words)]
        hashes, of, place, sizes = [], [], [], set()
        known, often = np.unique(np.concatenate(self.words), return_counts=True) if self.words else (np.zeros(0, U64), np.zeros(0, np.int64))
        for number, words in enumerate(self.words):
            size = 1 if len(words) < SHORT else GRAM
            grams = gram_hashes(words, size)
            if size == 1:
                rarest = np.argsort(often[np.searchsorted(known, words)], kind="stable")
                kept = np.sort(rarest[: len(words) - needed(words, coverage) + 1])
            else:
                kept = winnowed(grams, STRETCH)
            sizes.add(size)
            hashes.append(grams[kept])
            of.append(np.full(len(kept), number))
            place.append(kept)
        hashed = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.argsort(hashed, kind="stable")
        self.hashes = hashed[order]
        self.of = (np.concatenate(of) if of else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.sizes = sorted(sizes)

    def hits(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the words, template, place in it) of all shared fingerprints inside rows."""
        places, postings = [], []
        row = np.searchsorted(ends, np.arange(len(words)), side="right")
        for size in self.sizes:
            grams = gram_hashes(words, size)
            inside = np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
            first = np.searchsorted(self.hashes, grams[inside], side="left")
            known = np.flatnonzero(self.hashes[np.minimum(first, len(self.hashes) - 1)] == grams[inside])
            count = np.searchsorted(self.hashes, grams[inside[known]], side="right") - first[known]
            places.append(np.repeat(inside[known], count))
            starts = np.repeat(first[known], count)
            postings.append(starts + np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count))
        if not places:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        posting = np.concatenate(postings)
        return np.concatenate(places), self.of[posting], self.place[posting]


def aligned(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first matched word, last) of the best local alignment within ``band`` of a diagonal.

    A match gives 2; a changed word, or one more or less, costs 1.
    """
    width = 2 * band + 1
    shift = np.arange(width) - band + diagonal
    score = np.zeros((len(template) + 1, width), np.int32)
    steps = np.arange(width, dtype=np.int32)
    for i, word in enumerate(template, 1):
        at = shift + i - 1
        inside = (at >= 0) & (at < len(text))
        equal = inside & (text[np.clip(at, 0, max(len(text) - 1, 0))] == word)
        now = score[i - 1] + np.where(equal, 2, -1)
        now[:-1] = np.maximum(now[:-1], score[i - 1, 1:] - 1)
        now = np.maximum(np.where(inside, now, 0), 0)
        score[i] = np.maximum(np.maximum.accumulate(now + steps) - steps, 0)
    i, d = np.unravel_index(np.argmax(score), score.shape)
    matched, first, last = 0, -1, -1
    while i > 0 and score[i, d] > 0:
        at = i - 1 + shift[d]
        same = 0 <= at < len(text) and text[at] == template[i - 1]
        if same and score[i, d] == score[i - 1, d] + 2:
            matched, first, last = matched + 1, at, at if last < 0 else last
            i -= 1
        elif score[i, d] == score[i - 1, d] - 1:
            i -= 1
        elif d + 1 < width and score[i, d] == score[i - 1, d + 1] - 1:
            i, d = i - 1, d + 1
        elif d > 0:
            d -= 1
        else:
            break
    return matched, int(first), int(last)


def may_match(template: np.ndarray, part: np.ndarray, need: int) -> bool:
    """Whether the text holds enough of the template's words; what it refuses cannot match."""
    different = np.unique(template)
    # Words that the template repeats may be one in the text.
    return np.isin(part, different).sum() >= need and np.isin(different, part).sum() >= need - (len(template) - len(different))


def within(template: np.ndarray, words: np.ndarray, span: tuple[int, int], diagonals: tuple[int, int], need: int) -> list[tuple[int, int, int]]:
    """(matched words, first word, last word) of all matches inside a span of the text, on these diagonals."""
    found, parts = [], [(max(0, span[0]), min(len(words), span[1]))]
    low, high = diagonals
    while parts:
        a, b = parts.pop()
        part = words[a:b]
        if not may_match(template, part, need):
            continue
        matched, first, last = aligned(template, part, (low + high) // 2 - a, (high - low + 1) // 2)
        if matched >= need:
            found.append((matched, a + first, a + last))
            parts += [(a, a + first), (a + last + 1, b)]
    return found


def matches(index: Index, words: np.ndarray, hits: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) of one text, given its hits (template, diagonal, place)."""
    found = []
    short = [h for h in hits if len(index.words[h[0]]) < SHORT]
    hits = sorted(h for h in hits if len(index.words[h[0]]) >= SHORT)
    for t, _, at in sorted(short, key=lambda h: (h[0], h[2])):
        template = index.words[t]
        reach = len(template) - 1 + EXTRA
        span = at - reach, at + reach + 1
        # All diagonals of the span.
        found += [(t, *m) for m in within(template, words, span, (span[0] - len(template), span[1]), needed(template, least))]
    start = 0
    for i in range(1, len(hits) + 1):
        t, low, _ = hits[start]
        template, high = index.words[t], hits[i - 1][1]
        band = max(4, len(template) // 10)
        # A notice whose hits are parted here is found from either part.
        if i < len(hits) and hits[i][0] == t and hits[i][1] - high <= band and hits[i][1] - low <= 4 * band:
            continue
        span = low - band, high + len(template) + band
        found += [(t, *m) for m in within(template, words, span, (low - band, high + band), needed(template, least))]
        start = i
    found = sorted(set(found), key=lambda m: (m[0], -m[1], m[2], m[3]))
    # What is kept of a template does not overlap, so only its neighbours in order can meet a new one.
    kept: dict[int, list[tuple[int, int, tuple[int, int, int, int]]]] = {}
    for m in found:
        spans = kept.setdefault(m[0], [])
        at = bisect_left(spans, (m[2], m[3]))
        if (at == 0 or spans[at - 1][1] < m[2]) and (at == len(spans) or spans[at][0] > m[3]):
            spans.insert(at, (m[2], m[3], m))
    return sorted((m for spans in kept.values() for _, _, m in spans), key=lambda m: (m[2], m[0]))


def shards(templates: dict[str, str], limit: int) -> list[list[tuple[str, str]]]:
    out: list[list[tuple[str, str]]] = [[]]
    size = 0
    for name, text in sorted(templates.items()):
        words = len(text_words(text))
        if out[-1] and size + words > limit:
            out.append([])
            size = 0
        out[-1].append((name, text))
        size += words
    return out


RESULT = "license string, coverage double, matched_words long, template_words long, begin long, end long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each notice found: doc_id, license, coverage, matched_words, template_words, begin, end."""
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    parts = [
        mapped(source, _scanner(shard, coverage), f"doc_id {kind}, {RESULT}")
        for shard in shards(TEMPLATES if templates is None else templates, shard_words)
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def _scanner(shard: list[tuple[str, str]], coverage: float):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shard, coverage)
        for batch in stream:
            data, offsets = string_column(batch, "text")
            rows = []
            for a, b in groups_of_rows(offsets, SLICE_BYTES):
                if len(index.hashes):
                    rows += [(a + row, *m) for row, *m in _found(index, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], coverage)]
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), *[pa.int64()] * 4), 1)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *[x.split(" ")[0] for x in RESULT.split(", ")]])

    return run


def _found(index: Index, data: np.ndarray, offsets: np.ndarray, coverage: float) -> Iterator[tuple]:
    plain = PARTING[data]
    words, counts = word_hashes(plain, offsets)
    ends = np.cumsum(counts)
    place, template, inner = index.hits(words, ends)
    if not len(place):
        return
    starts, stops, _ = word_places(plain, offsets)
    of = np.searchsorted(ends, place, side="right")
    by_row: dict[int, list[tuple[int, int, int]]] = {}
    for row, p, t, q in zip(of.tolist(), place.tolist(), template.tolist(), inner.tolist(), strict=True):
        base = int(ends[row] - counts[row])
        by_row.setdefault(row, []).append((t, p - base - q, p - base))
    for row, hits in by_row.items():
        base = int(ends[row] - counts[row])
        for t, matched, first, last in matches(index, words[base : ends[row]], hits, coverage):
            begin, end = int(starts[base + first]), int(stops[base + last])
            letters = lambda a, b: int(np.count_nonzero((data[a:b] & 0xC0) != 0x80))
            before = letters(offsets[row], begin)
            size = len(index.words[t])
            yield row, index.names[t], matched / size, matched, size, before, before + letters(begin, end)
