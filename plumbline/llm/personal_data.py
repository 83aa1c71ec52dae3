"""Personal data in texts: fixed formats, and candidates judged by boosted trees.

Four kinds are found by their format alone: email, ip, card and phone. These base spans
always stand. Further generators propose, with high recall, overlapping candidates: values
after a word such as ``password`` or ``token``, long runs of letters and digits, groups of
digits, and spelled-out addresses. Boosted trees judge a candidate by its format and
context; where its probability reaches the threshold of its generator it becomes a span of
kind ``secret``, ``number`` or ``contact``. Of overlapping ones the likeliest stays, and none
that overlaps a base span.

Each generator has trees of its own. They are fitted without labels from outside on all
different texts of the whole table in which a generator proposes something, and on all their
candidates; a bounded number of texts is drawn only where ``learn`` is given a ``sample``. Candidates
that are base spans, phones written without plus, country code or separators (``variants``),
digits after a word such as ``tel`` or ``ssn``, or values that follow a telling word and look random, are examples;
the other candidates, and long plain words, are counter-examples, but for digits in a format
of telephone numbers, which teach nothing without such a word. Invented ones (``invented``)
are added, and count for at least a quarter, so that a generator whose candidates are rare, or a
small table, can be judged too.
Half of the examples lose their context, so that format has to speak as well. On a held-back
quarter the probabilities are calibrated (isotonic), and each generator gets the lowest threshold
whose precision reaches ``PRECISION`` there. A generator with fewer than ``ENOUGH`` held-back
examples, or for which no threshold is that precise, gets ``FALLBACK``; none is left out.

Features are put into ``BINS`` bins of a fixed grid, and equal rows of bins are counted together.
These rows stay on the executors. For each level of the trees (of all generators at once) tasks add up
the gradients by node, feature and bin, and for the calibration the held-back rows by output, to
``STEP``; only such sums, whose number does not grow with the table, come to the driver. They are
whole numbers, so the model does not depend on how the table is dealt to tasks.

Candidates have no greatest length, and features are of the whole candidate and of what stands
before and after it. Values that lie in one another, as in ``token=a:token=b``, end at the same
place and are counted together from there, so that a long one is read once.

Defined results: a null text is empty; empty texts have no spans. Offsets are code points,
ends not included. Spans are ordered by kind (email, ip, card, phone, contact, number,
secret), then by start. Texts without candidates to learn from leave the base spans only.
Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect, bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.boosting import BoostedTrees
from plumbline.llm.common import U64, all_but, crc, mapped, mix, schema_with, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "contact", "number", "secret")
PRECISION, ENOUGH, FALLBACK = 0.98, 10, 0.9
#: Bins of features: below 0 (hidden), about 0, then 16 an octave, so that counts up to 32 are exact.
GRID = np.array([0, *(2.0**e * (1 + k / 16) for e in range(-6, 10) for k in range(16))][:255])
BINS = len(GRID) + 1
#: Outputs of the trees are calibrated in steps. Each level of a tree is a job, so few trees take long steps.
STEP, TREES, RATE = 1 / 64, 20, 0.4

LOCAL_PART = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only; from within, it would fail or match the same.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

SIGN = re.compile(r"[:=]")
TELLING = re.compile(r"(?i)(pass\w{0,12}|pwd|secret\w{0,12}|token\w{0,12}|api.?key|access.?key|credential\w{0,3}|auth\w{0,12})[\"']?\s{0,2}$")
# Possessive and without a limit: a span covers the whole of a value, however long.
VALUE = re.compile(r"\s{0,2}[\"']?([^\s\"',;<>]{6,}+)")
# Of these, those with digits and letters both; digits alone are the next generator's.
RANDOM = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{12,}+")
LETTER = re.compile("[A-Za-z]")
# From 8 characters on.
DIGITS = re.compile(r"\(?[0-9](?:[().\x20-]*+[0-9]++)*+")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[(](?:at|AT)[\])]\s?[A-Za-z0-9-]++(?:\s?[\[(](?:dot|DOT)[\])]\s?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+")
WORDS = re.compile(r"[^\W\d_]{12,}+")
#: Stretches of one kind of characters: blanks, digits, letters, quotes, others.
STRETCH = re.compile(r"\s+|\d+|[^\W\d_]+|[\"']+|(?:[^\w\s\"']|_)+")
GROUP = re.compile("[0-9]+")
#: No number of a person is longer than this, in any format.
LONGEST_NUMBER, LONGEST_CARD = 40, 19
#: Words before a number of a person, and how such numbers are often written.
CALLED = re.compile(
    r"(?i)\b(?:tel|telephone|phone|mobile|cell|fax|ssn|social security|account|acct|passport)\.?\s?(?:no\.?|number|nr\.?|#)?\s?(?:is|was)?\s?[:=#]?\s{0,2}\(?$"
)
NATIONAL = re.compile(r"(?:[01][ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
#: Part of a run of digit groups.
PIECE = re.compile(NATIONAL.pattern + r"|\(?[0-9](?:[().-]*+[0-9]++)*+")
GENERATORS = ("value", "random", "digits", "spelled")
KIND_OF = {"value": "secret", "random": "secret", "digits": "number", "spelled": "contact"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from each @, since all starts in a run lead to the same one."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_PART:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            floor = match.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text) is None:
        return found
    for m in IP.finditer(text):
        # More than three digits can still be small, after zeros.
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    found, stop = [], 0
    for sign in SIGN.finditer(text):
        if TELLING.search(text, max(0, sign.start() - 32), sign.start()):
            if stop - sign.end() >= 6:
                # Within the last value, whose end is known.
                found.append(("value", sign.end(), stop))
                continue
            value = VALUE.match(text, sign.end())
            if value:
                stop = value.end(1)
                found.append(("value", value.start(1), stop))
    if DIGIT.search(text) is not None:
        values = [a for _, a, _ in found]
        for m in RANDOM.finditer(text):
            a, b = m.span()
            told = bisect(values, a)
            if told < len(values) and values[told] < b and DIGIT.search(text, a, values[told]) is None:
                # A plain word and sign before a value are not of it.
                a = values[told]
            if b - a >= 12 and DIGIT.search(text, a, b) and LETTER.search(text, a, b):
                found.append(("random", a, b))
        for m in DIGITS.finditer(text):
            if m.end() - m.start() >= 8:
                found.append(("digits", *m.span()))
                # One number may stand beside another.
                found += [("digits", *p.span()) for p in PIECE.finditer(text, *m.span()) if p.end() - p.start() >= 8 and p.span() != m.span()]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        found += [("spelled", m.start(), m.end()) for m in SPELLED.finditer(text)]
    return found


def _kind_of_letter(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "\"'" else 5


class Shape:
    """What is counted of a value; it can be continued to the left, up to a character that is not a digit."""

    def __init__(self, text: str, end: int):
        self.text, self.start, self.end = text, end, end
        self.counts: Counter[str] = Counter()
        self.stretches = self.groups = self.longest = self.last = 0
        self.small, self.heads, self.digits = True, [], ""

    def extend(self, start: int) -> Shape:
        if start == self.start:
            return self
        part = self.text[start : self.start]
        self.counts.update(part)
        self.stretches += len(STRETCH.findall(part))
        if self.start < self.end and len(STRETCH.findall(self.text, self.start - 1, self.start + 1)) == 1:
            # One stretch goes on.
            self.stretches -= 1
        groups = GROUP.findall(part)
        if groups:
            self.last = self.last or len(groups[-1])
            self.groups += len(groups)
            self.longest = max(self.longest, *map(len, groups))
            self.small = self.small and all(int(g[:6]) <= 255 for g in groups)
            self.heads = [*map(len, groups[:4]), *self.heads][:4]
            if len(self.digits) <= LONGEST_CARD:
                self.digits = "".join(groups) + self.digits
        self.start = start
        return self

    def of(self, letters: str) -> int:
        return sum(self.counts[c] for c in letters)

    @property
    def looks_random(self) -> bool:
        return self.end - self.start >= 8 and self.of("0123456789") > 0 and any(c.isalpha() for c in self.counts)


def shapes(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, Shape]]:
    """(place in ``spans``, shape) of each; a shape holds until the next is asked for."""
    shape = Shape(text, -1)
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][1], -spans[i][0])):
        start, end = spans[i]
        if shape.end != end or text[shape.start - 1 : shape.start].isdigit():
            shape = Shape(text, end)
        yield i, shape.extend(start)


#: The last of a candidate's features are of its context.
CONTEXT = 5


def features(text: str, generator: str, start: int, end: int, shape: Shape | None = None) -> list[float]:
    shape = shape or Shape(text, end).extend(start)
    size, counts = end - start, shape.counts
    digits = shape.of("0123456789")
    number = text[start:end] if size <= LONGEST_NUMBER else ""
    card = 16 <= digits <= LONGEST_CARD and luhn(shape.digits)
    lower, upper = sum(n for c, n in counts.items() if c.islower()), sum(n for c, n in counts.items() if c.isupper())
    called = generator == "digits" and CALLED.search(text[max(0, start - 40) : start]) is not None
    return [
        GENERATORS.index(generator) if generator in GENERATORS else 1, size, digits, digits / size, lower / size, upper / size,
        shape.of("0123456789abcdefABCDEF") / size, len(counts) / size,
        -sum(n / size * math.log2(n / size) for n in counts.values()), (shape.stretches - 1) / size,
        shape.of("aeiouAEIOU") / size, shape.groups, shape.longest, counts["."], counts["-"],
        counts[" "], float(text.startswith("(", start)), float(card), float(8 <= digits <= 15), float(shape.small),
        *(shape.heads[i] if i < len(shape.heads) else 0 for i in range(4)), shape.last,
        float(NATIONAL.fullmatch(number) is not None),
        _kind_of_letter(text[start - 1 : start]), _kind_of_letter(text[end : end + 1]),
        float(TELLING.search(text[max(0, start - 40) : start].rstrip("\"' :=")) is not None), float(text[max(0, start - 1) : start] == "+"), float(called),
    ]


class Taken:
    """Stretches of a text that do not overlap."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def variants(phone: str) -> Iterator[str]:
    """Other ways to write a number that a plus begins: without it, its country code, or its separators."""
    yield phone[1:]
    country, *groups = re.findall("[0-9]+", phone)
    if len(groups) >= 3 and sum(map(len, groups)) >= 8:
        yield from (sign.join(groups) for sign in " -.")
        yield f"({groups[0]}) {'-'.join(groups[1:])}"
        yield f"{country}-{'-'.join(groups)}"


def examples(text: str) -> list[tuple[str, bool, list[float]]]:
    """(generator, whether an example, features) of a text's candidates, and of long plain words."""
    bases = base_spans(text)
    base = {(a, b) for _, a, b in bases}
    covered = Taken(list(base))
    found = []
    proposed = candidates(text)
    for i, shape in shapes(text, [(a, b) for _, a, b in proposed]):
        generator, a, b = proposed[i]
        telling = generator in ("value", "random") and shape.looks_random
        told = TELLING.search(text[max(0, a - 40) : a].rstrip("\"' :=")) is not None
        # The plus of a phone is not in the candidate.
        known = (a, b) in base or (a - 1, b) in base
        overlap = not known and covered.overlaps(a, b)
        called = generator == "digits" and CALLED.search(text[max(0, a - 40) : a]) is not None
        # The format of a telephone number without a word before it tells neither.
        unclear = generator == "digits" and not known and not called and NATIONAL.fullmatch(text, a, b) is not None
        if not overlap and not unclear:
            example = known or called or (telling and told) or generator == "spelled"
            found.append((i, (generator, example, features(text, generator, a, b, shape))))
    found = [e for _, e in sorted(found, key=lambda f: f[0])]
    for kind, a, b in bases:
        if kind == "phone":
            for variant in variants(text[a:b]):
                found.append(("digits", True, features(text[max(0, a - 40) : a] + variant + text[b : b + 1], "digits", min(a, 40), min(a, 40) + len(variant))))
    found += [("random", False, features(text, "random", m.start(), m.end())) for m in WORDS.finditer(text)]
    return found


#: Ways to write what each generator is after, and what only looks like it.
DECIMAL, LETTERS, HEX, ALPHA = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
LEADS = ("password=", "token = \"", "api_key: ", "secret: \"", "pwd=", "access_key=", "auth_token=")
TAME = ("required", "expired", "disabled", "changeme", "undefined", "optional", "hidden", "renewed")
SLUGS = ("section-{}-introduction", "covid-{}-pandemic", "item_number_{}", "file_v{}_final_draft", "/docs/v{}/getting-started", "chapter{}overview")
COUNTS = (
    "{year}-{year}", "{year} - {year}", "{year}-04-15", "15.04.{year}", "{year}-11-28 10", "1.24.1{0}", "10.0.19{0}", "3.14{0}{1}",
    "10 {0} {1}", "1.{0}.{1}", "{0}{1}{2}", "12{0}{1}", "1{0}{1}{2}{3}", "{0}{1}{2}{3}1234", "978-3-16-{0}{1}-0", "1 2 3 4 5 6", "{0} {1} {2}",
)
PHONES = ("({0}) {1}-{2}", "{0}-{1}-{2}", "{0} {1} {2}", "{0}.{1}.{2}", "1-{0}-{1}-{2}", "1 ({0}) {1}-{2}", "0{3} {1} {2}", "{0}-{3}-{2}")
CALLS = ("tel ", "tel. ", "Tel: ", "phone: ", "Phone ", "call my mobile ", "fax ", "ssn ", "SSN: ", "account ", "account number ", "acct ")
INVENTED = 400


def _invented(pick: random.Random) -> Iterator[tuple[str, bool, str, str, str]]:
    """(generator, whether an example, text before, value, text after) of made-up candidates."""
    some = lambda letters, low, high: "".join(pick.choice(letters) for _ in range(pick.randint(low, high)))
    for _ in range(INVENTED):
        word, lead = some(ALPHA, 2, 9) + " ", pick.choice(LEADS)
        secret = some(pick.choice((LETTERS, HEX)), 8, 64) + pick.choice("0123456789") + pick.choice("abcdef")
        after = '"' if lead.endswith('"') else pick.choice((" ", "\n", ""))
        yield "value", True, word + lead, secret, after
        yield "value", False, word + lead, pick.choice((*TAME, some(ALPHA, 6, 14))), after
        yield "random", True, word + lead, some(pick.choice((LETTERS, HEX)), 10, 300) + pick.choice("0123456789") + pick.choice("abcdef"), after
        yield "random", False, word, pick.choice(SLUGS).format(pick.randint(1, 2030)), " "
        yield "digits", True, word + "+", "1 ({}) 555-{}".format(some(DECIMAL, 3, 3), some(DECIMAL, 4, 4)), " "
        phone = pick.choice(PHONES).format(some(DECIMAL, 3, 3), some(DECIMAL, 3, 3), some(DECIMAL, 4, 4), some(DECIMAL, 2, 2))
        yield "digits", True, pick.choice((word, word, word + pick.choice(CALLS))), phone, pick.choice((" ", ".", ",", ""))
        yield "digits", True, word + pick.choice(CALLS), pick.choice((some(DECIMAL, 8, 12), some(DECIMAL, 3, 4) + " " + some(DECIMAL, 5, 8))), " "
        yield "digits", False, word, pick.choice(COUNTS).format(*(some(DECIMAL, 3, 3) for _ in range(4)), year=pick.randint(1800, 2040)), " "
        dot = pick.choice((" (dot) ", " [dot] ", "[dot]", "."))
        yield "spelled", True, word, some(ALPHA, 2, 12) + pick.choice((" (at) ", " [at] ", "[at]", " (AT) ")) + some(ALPHA, 2, 12) + dot + some(ALPHA, 2, 4), " "


def invented() -> list[tuple[int, str, bool, list[float]]]:
    """Rows as those of the sample: (number of the text, generator, whether an example, features)."""
    made = _invented(random.Random(11))
    return [(i, g, good, features(a + v + b, g, len(a), len(a) + len(v))) for i, (g, good, a, v, b) in enumerate(made)]


@dataclass
class Judge:
    """What one generator's candidates are judged by."""

    trees: BoostedTrees
    steps: np.ndarray
    levels: np.ndarray
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(np.rint(self.trees.output(self.trees.binned(x)) / STEP) * STEP)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return self.levels[np.clip(np.searchsorted(self.steps, raw, side="right") - 1, 0, len(self.levels) - 1)]


@dataclass
class Model:
    judges: dict[str, Judge]

    def probability(self, generators: list[str], x: np.ndarray) -> np.ndarray:
        out, of = np.zeros(len(x)), np.array(generators)
        for generator, judge in self.judges.items():
            out[of == generator] = judge.probability(x[of == generator])
        return out


def isotonic(scores: np.ndarray, good: np.ndarray, all_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing function nearest to the share of ``good`` among ``all_rows``: (where a level begins, level)."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, t, n in zip(scores[order], good[order], all_rows[order], strict=True):
        blocks.append([s, float(t), float(n)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _drawn(content: DataFrame, sample: int) -> list[int]:
    """Hashes of the different texts to learn from: of each generator's, those of the smallest draws."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = {(g, h) for t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for g, _, _ in candidates(t)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.string()), pa.array([h for _, h in found], pa.int64())], names=["generator", "hash"]
            )

    draw = F.pmod(F.xxhash64("hash", F.lit(6)), F.lit(1_000_003))
    found = written(mapped(content, run, "generator string, hash long").distinct().withColumn("draw", draw), "personal-data-texts")
    drawn: set[int] = set()
    for generator, size in found.groupBy("generator").count().collect():
        # Few more than wanted are sorted.
        near = found.where((F.col("generator") == generator) & (F.col("draw") < min(1.0, 2 * sample / size) * 1_000_003))
        drawn.update(r.hash for r in near.orderBy("draw", "hash").limit(sample).collect())
    return sorted(drawn)


def _rows(text: str) -> tuple[list[int], list[bool], np.ndarray]:
    """(generator, whether an example, bins) of what a text teaches; some without context, but for held-back ones."""
    found = examples(text)
    if not found:
        return [], [], np.zeros((0, 0), np.uint8)
    x = np.array([e[2] for e in found])
    if not _held(np.array([crc(text)], U64))[0]:
        x[mix(np.arange(len(x), dtype=U64) + U64(crc(text))) % U64(2) == 0, -CONTEXT:] = -1
    return [GENERATORS.index(e[0]) for e in found], [e[1] for e in found], _bins(x)


def _bins(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(GRID, x, side="right").astype(np.uint8)


def _held(number: np.ndarray) -> np.ndarray:
    return mix(number) % U64(4) == 0


def _taught(content: DataFrame) -> DataFrame:
    """What the different texts teach: generator, example, held, bins, and how many such rows there are (n)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [(t, h) for t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) if candidates(t)]
            rows = [_rows(t) for t, _ in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for _, h in texts], pa.int64()), pa.array(_held(np.array([crc(t) for t, _ in texts], U64)), pa.bool_()),
                    pa.array([bytes(g) for g, _, _ in rows], pa.binary()), pa.array([bytes(e) for _, e, _ in rows], pa.binary()),
                    pa.array([x.tobytes() for _, _, x in rows], pa.binary()),
                ],
                names=["hash", "held", "generators", "examples", "bins"],
            )

    def listed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            generators, marks, bins = (batch.column(c).to_pylist() for c in ("generators", "examples", "bins"))
            held = np.repeat(batch.column("held").to_numpy(zero_copy_only=False).astype(bool), [len(g) for g in generators])
            joined = b"".join(bins)
            size = len(joined) // max(len(held), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(generators), np.uint8).astype(np.int32)), pa.array(np.frombuffer(b"".join(marks), np.uint8) == 1),
                    pa.array(held), pa.array([joined[i : i + size] for i in range(0, len(joined), size or 1)], pa.binary()),
                ],
                names=["generator", "example", "held", "bins"],
            )

    # The same text, wherever it comes from, teaches the same.
    texts = mapped(content, run, "hash long, held boolean, generators binary, examples binary, bins binary").dropDuplicates(["hash"])
    rows = mapped(texts, listed, "generator int, example boolean, held boolean, bins binary")
    return rows.groupBy("generator", "example", "held", "bins").agg(F.count(F.lit(1)).alias("n"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(generator, bins, whether an example, how often) of the rows of a batch."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(batch), -1).astype(np.int64)
    column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    return column("generator"), bins, column("example").astype(float), column("n")


def _of(which: int, of: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [c[of == which] for c in columns]


def _summed(rows: DataFrame, sums) -> pa.Table:
    """Sums over all rows by generator and cell: ``sums`` gives (cells, one, two) of a generator's rows of a batch."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not len(batch):
                continue
            of, *columns = _arrays(batch)
            for generator in np.unique(of):
                found = [np.asarray(c, np.int64) for c in sums(generator, *_of(generator, of, *columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found[0]), generator, np.int32)), *map(pa.array, found)], names=["generator", "cell", "one", "two"]
                )

    return mapped(rows, run, "generator int, cell long, one long, two long").groupBy("generator", "cell").agg(
        F.sum("one").alias("one"), F.sum("two").alias("two")
    ).toArrow()


def _fit(forest: list[BoostedTrees], rows: DataFrame, more: tuple[np.ndarray, ...]) -> None:
    """Grows the trees of all generators, level by level, on ``rows`` and the arrays ``more``."""

    def sums(generator: int, bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        g, h = (a.ravel() for a in forest[generator].gradients(bins, y, n))
        cells = np.flatnonzero((g != 0) | (h != 0))
        return cells, g[cells], h[cells]

    while forest[0].unfinished:
        for trees in forest:
            trees.plant()
        found = _summed(rows, sums)
        of, cell, one, two = (found.column(c).to_numpy() for c in ("generator", "cell", "one", "two"))
        for generator, trees in enumerate(forest):
            g, h = trees.gradients(*_of(generator, *more))
            at, slope, curve = _of(generator, of, cell, one, two)
            g.ravel()[at] += slope
            h.ravel()[at] += curve
            trees.split(g, h)


def learn(docs: DataFrame, sample: int | None = None, text: str = "text") -> Model | None:
    """The model of all texts, or of ``sample`` texts for each generator."""
    content = docs.select(docs[text].cast("string").alias("text")).where(F.col("text").rlike(r"[0-9:=]|[\[(](at|AT)[\])]"))
    content = content.select("text", F.xxhash64("text").alias("hash"))
    if sample is not None:
        wanted = content.sparkSession.createDataFrame([(h,) for h in _drawn(content, sample)], "hash long")
        content = content.join(F.broadcast(wanted), "hash", "left_semi").select("text", "hash")
    rows = written(_taught(content), "personal-data-rows")
    positive = F.sum(F.when(F.col("example"), F.col("n")).otherwise(0))
    counts = rows.groupBy("generator", "held").agg(F.sum("n").alias("n"), positive.alias("good")).collect()
    counted = {(r.generator, r.held): (r.n, r.good) for r in counts}
    if not counted:
        return None
    number, generator, good, x = zip(*invented(), strict=True)
    of, good, x, held = np.array([GENERATORS.index(g) for g in generator]), np.array(good, float), np.array(x), _held(np.array(number, U64))
    hidden = np.random.default_rng(5).random(len(x)) < 0.5
    x[hidden & ~held, -CONTEXT:] = -1
    n = np.zeros(len(x), np.int64)
    for g in range(len(GENERATORS)):
        corpus = sum(counted.get((g, h), (0, 0))[0] for h in (False, True))
        n[of == g] = max(1, corpus // (3 * int((of == g).sum())))
    bins = _bins(x).astype(np.int64)
    more = lambda chosen: (of[chosen], bins[chosen], good[chosen], n[chosen])
    forest = []
    for g in range(len(GENERATORS)):
        total, positive = counted.get((g, False), (0, 0))
        _, y, often = _of(g, *more(~held))
        trees = BoostedTrees(TREES, bins=BINS, rate=RATE).start((positive + (y * often).sum()) / (total + often.sum()))
        trees.cuts = [GRID] * x.shape[1]
        forest.append(trees)
    _fit(forest, rows.where("not held"), more(~held))

    def outputs(generator: int, bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        step, place = np.unique(np.rint(forest[generator].output(bins) / STEP).astype(np.int64), return_inverse=True)
        return step, np.bincount(place, y * n, len(step)), np.bincount(place, n, len(step))

    found = _summed(rows.where("held"), outputs)
    at, *sums = (found.column(c).to_numpy() for c in ("generator", "cell", "one", "two"))
    judges = {}
    for g, name in enumerate(GENERATORS):
        steps = [np.concatenate(c) for c in zip(_of(g, at, *sums), outputs(g, *_of(g, *more(held))), strict=True)]
        judges[name] = _judge(forest[g], *steps)
    return Model(judges)


def _judge(trees: BoostedTrees, steps: np.ndarray, good: np.ndarray, n: np.ndarray) -> Judge:
    """Calibrated by how many held-back rows, and examples among them, have each output."""
    raw, place = np.unique(steps, return_inverse=True)
    raw, good, n = raw * STEP, np.bincount(place, good, len(raw)), np.bincount(place, n, len(raw))
    judge = Judge(trees, *isotonic(raw, good, n), FALLBACK)
    calibrated = judge.calibrated(raw)
    reached = [t for t in np.unique(calibrated[good > 0]) if t > 0 and good[calibrated >= t].sum() / n[calibrated >= t].sum() >= PRECISION]
    if reached and good.sum() >= ENOUGH:
        judge.threshold = float(max(min(reached), 0.5))
    return judge


SPANS = T.ArrayType(
    T.StructType().add("kind", "string").add("begin", "long").add("end", "long").add("probability", "double")
)


def judged(texts: list[str | None], model: Model | None) -> list[list[tuple[str, int, int, float]]]:
    """Ordered spans of each text; base spans have probability 1."""
    bases = [base_spans(t) if t else [] for t in texts]
    proposed, x = [], []
    if model is not None:
        for row, t in enumerate(texts):
            covered = Taken([(a, b) for _, a, b in bases[row]])
            apart = [c for c in candidates(t) if not covered.overlaps(*c[1:])] if t else []
            for i, shape in shapes(t or "", [(a, b) for _, a, b in apart]):
                generator, a, b = apart[i]
                proposed.append((row, generator, a, b))
                x.append(features(t, generator, a, b, shape))
    added: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
    if x:
        for (row, generator, a, b), p in zip(proposed, model.probability([c[1] for c in proposed], np.array(x)), strict=True):
            if p >= model.judges[generator].threshold:
                added[row].append((-float(p), a, b, KIND_OF[generator]))
    found = []
    for base, more in zip(bases, added, strict=True):
        spans = [(kind, a, b, 1.0) for kind, a, b in base]
        taken = Taken()
        for p, a, b, kind in sorted(more, key=lambda s: (s[0], s[1] - s[2], s[1])):
            if not taken.overlaps(a, b):
                taken.add(a, b)
                spans.append((kind, a, b, -p))
        found.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))
    return found


def find(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``spans`` (kind, begin, end, probability) to each row; a column of that name is replaced."""
    source = all_but(docs, ("spans",))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            spans = judged(batch.column(batch.schema.get_field_index(text)).to_pylist(), model)
            listed = [[dict(zip(("kind", "begin", "end", "probability"), s, strict=True)) for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, kind)], names=[*batch.schema.names, "spans"])

    return mapped(source, run, schema_with(source, spans=SPANS))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, span: Column) -> Column:
        apart = span["begin"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["begin"] - state["at"]).cast("int"))
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        parts = F.when(apart, F.concat(state["parts"], F.array(gap, mark))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind"))))
    finish = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, add, finish)).otherwise(text)
