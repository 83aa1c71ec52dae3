"""Removal of repeated byte strings by a distributed, prefix-aware merge sort of suffixes.

A byte goes when a string of ``length`` bytes that covers it starts at another place too.
Sorting every suffix of a large corpus is out of reach, so only suffixes are sorted that
can have an equal, and of these one for each anchor:

1. Each window of ``length`` bytes has an anchor: the place of its k-gram of smallest hash,
   k being half the length. Equal windows have equal anchors at equal offsets. About one
   place in a hundred is an anchor, and those whose k-gram occurs once are dropped.
2. Anchors with equal k-grams and equal surroundings (all windows that they anchor) repeat
   in full; one of them stands for all from here on. Only anchors whose k-gram stands in
   different surroundings go on, with what lies to the right (the suffix) and to the left.
3. Each task sorts its suffixes into runs, one for each range of the alphabet, and sends a
   run front-coded: for every suffix the length of the prefix that it shares with the one
   before, and the rest. Ranges are cut by a bounded sample of ``SAMPLE`` prefixes as long
   as a k-gram. Where these cannot part the bytes into ranges of about ``RANGE_BYTES``,
   suffixes are dealt first, by the hash of their k-gram, to alphabets of their own.
4. A loser tree merges the runs of a range. Each loser keeps the length of the prefix that
   it shares with the string that beat it, longer shared prefixes win without a look at the
   bytes, and equal ones are compared from there on, so no byte of a known prefix is
   compared again. The merge yields the suffixes in order with their shared prefixes.
5. A window at offset o before its anchor repeats when another anchor shares o bytes to the
   left and ``length`` - o bytes to the right. Shared prefixes of neighbours in order
   cut the suffixes, and likewise the left sides, into classes for every o.

Steps 1 and 2 tell different strings apart by 64 and 128 bits of hash. The k-gram of a group
of more than ``HOT`` different surroundings, which no single task should hold, is dealt
with window by window: 128-bit digests are counted, partly before the shuffle. Of k-grams
and surroundings, at most ``SHARE`` hold more than one in ``SHARE`` of all anchors; they
are broadcast to the anchors, so that no join deals a hot key to one task.

Defined results: null and empty texts have no bytes and lose none. Each row is a document of
its own, so repeated rows are copies of each other; rows are told apart by id and text. A
long text is worked through in overlapping pieces and nothing is cut. Without rows there
are no results. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, RollingHash, groups_of_rows, keyed, mapped, mix, signed, string_column, written

LENGTH = 400
PIECE = 1 << 20
SAMPLE, RANGE_BYTES = 4_000, 8 << 20
HOT = 50_000
SHARE = 1_000
BATCH = 40_000
PLACE_BITS = 27
ROLL, ROLL2 = RollingHash(21), RollingHash(22)


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row, from running minima of blocks."""
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, U64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - width + 1], ahead[width - 1 : len(values)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, hash of the k-gram, hash of the surroundings, first window, anchor, last window) of each anchor."""
    gram = length // 2
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = ROLL.sums(data)
    places = np.arange(len(data) - gram + 1)
    grams = ROLL.stretch(sums, places, places + gram)
    low = U64((1 << PLACE_BITS) - 1)
    # The place breaks ties, so that the leftmost of equal k-grams is the anchor.
    least = least_of_windows((grams & ~low) | places.astype(U64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    windows = np.arange(len(anchor))
    row = np.searchsorted(offsets, windows, side="right") - 1
    whole = windows + length <= offsets[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(new & whole)
    ends = np.flatnonzero(np.append(new, True) | np.append(~whole, True))
    finish = ends[np.searchsorted(ends, starts, side="right")] - 1
    at = anchor[starts]
    shape = mix(((finish - starts).astype(U64) << U64(32)) | (at - starts).astype(U64))
    around = mix(ROLL.stretch(sums, starts, finish + length) + shape)
    return row[starts], grams[at], around, starts, at, finish


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, shift, bytes, offsets) of slices of whole rows, and of overlapping pieces of longer rows."""
    for first, last in groups_of_rows(offsets, PIECE):
        begin, end = offsets[first], offsets[last]
        if last - first == 1 and end - begin > PIECE:
            for at in range(begin, max(end - length + 1, begin + 1), PIECE):
                stop = min(at + PIECE + length - 1, end)
                yield first, at - begin, data[at:stop], np.array([0, stop - at])
        else:
            yield first, 0, data[begin:end], offsets[first : last + 1] - begin


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, offsets = string_column(batch, "text")
            for first, shift, part, cuts in _pieces(data, offsets, length):
                row, gram, around, start, at, finish = anchors(part, cuts, length)
                base = shift - cuts[row]
                chosen = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(chosen), batch.column("text_key").take(chosen),
                        pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)),
                        pa.array(start + base), pa.array(at + base), pa.array(finish + base),
                    ],
                    names=["doc_id", "text_key", "gram", "around", "start", "anchor", "finish"],
                )

    return mapped(
        docs,
        run,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, gram long, around long, "
        "start long, anchor long, finish long",
    )


def same_document(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["_id"]) & (left["text_key"] == right["_key"])


def surroundings(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """The chosen anchors with the bytes to their right and, turned round, to their left."""
    entry = F.struct("start", "anchor", "finish", "gram", "single", "many")
    listed = chosen.groupBy("doc_id", "text_key").agg(F.collect_list(entry).alias("anchors"))
    listed = listed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "anchors")
    # Repeated rows bring their anchors along more than once. They are copies of each other, so none is single.
    joined = docs.join(listed, same_document(docs, listed)).select("doc_id", "text_key", "text", "anchors")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, offsets = string_column(batch, "text")
            for row, found in enumerate(batch.column("anchors").to_pylist()):
                text = data[offsets[row] : offsets[row + 1]].tobytes()
                size = len(found)
                pick = lambda name: pa.array([x[name] for x in found], pa.int64())  # noqa: B023, E731
                where = pa.array(np.full(size, row))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(where), batch.column("text_key").take(where),
                        pick("start"), pick("anchor"), pick("finish"), pick("gram"),
                        pa.array([x["single"] for x in found], pa.bool_()), pa.array([x["many"] for x in found], pa.bool_()),
                        pa.array([text[x["anchor"] : x["finish"] + length] for x in found], pa.binary()),
                        pa.array([text[x["start"] : x["anchor"]][::-1] for x in found], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "start", "anchor", "finish", "gram", "single", "many", "suffix", "left"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(
        joined,
        run,
        f"doc_id {kind}, text_key long, start long, anchor long, finish long, gram long, single boolean, "
        "many boolean, suffix binary, left binary",
    )


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in ``known`` bytes; these are not looked at."""
    limit = min(len(a), len(b))
    while known < limit:
        size = min(48, limit - known)
        x, y = a[known : known + size], b[known : known + size]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return known + size - (differ.bit_length() + 7) // 8
        known += size
    return limit


class LoserTree:
    """Merges sorted runs of (shared prefix with the string before, string, item)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.strings: list[bytes | None] = [None] * self.size
        self.items: list = [None] * self.size
        #: Prefix that each run's string shares with the one that beat it, at first with nothing.
        self.shared = [0] * self.size
        for run in range(len(runs)):
            self._advance(run)
            self.shared[run] = 0
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _advance(self, run: int) -> None:
        entry = next(self.runs[run], None)
        if entry is None:
            self.strings[run] = self.items[run] = None
        else:
            self.shared[run], self.strings[run], self.items[run] = entry

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser) of two runs; both know what they share with the same string."""
        a, b = self.strings[x], self.strings[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if self.shared[x] != self.shared[y]:
            return (x, y) if self.shared[x] > self.shared[y] else (y, x)
        both = shared_prefix(a, b, self.shared[x])
        if a[both : both + 1] <= b[both : both + 1]:
            self.shared[y] = both
            return x, y
        self.shared[x] = both
        return y, x

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(shared prefix with the string before, string, item) in order."""
        while (string := self.strings[self.winner]) is not None:
            run = self.winner
            yield self.shared[run], string, self.items[run]
            self._advance(run)
            node = (run + self.size) // 2
            while node:
                run, self.losers[node] = self._play(run, self.losers[node])
                node //= 2
            self.winner = run


RUN = (
    "text_key long, part long, run long, number long, shared int, rest binary, left_shared int, left_rest binary, "
    "start long, anchor long, finish long, single boolean"
)


def front_coded_runs(around: DataFrame, cuts: list[bytes], prefix: int, alphabets: int) -> DataFrame:
    """Each task's suffixes, sorted and front-coded, with the range of their alphabet that they belong to."""
    kind = around.schema["doc_id"].dataType.simpleString()

    def coded(table: pa.Table, run: int) -> Iterator[pa.RecordBatch]:
        suffixes, lefts = table.column("suffix").to_pylist(), table.column("left").to_pylist()
        alphabet = (np.asarray(table.column("gram")).view(U64) % U64(alphabets)).astype(np.int64) * (len(cuts) + 1)
        order = sorted(range(len(suffixes)), key=lambda i: (alphabet[i], suffixes[i]))
        part, shared, rest, left_shared, left_rest = [], [], [], [], []
        before, before_left, before_part = b"", b"", -1
        for i in order:
            suffix, left = suffixes[i], lefts[i]
            here = int(alphabet[i]) + bisect_right(cuts, suffix[:prefix])
            if here != before_part:
                before, before_left, before_part = b"", b"", here
            a, b = shared_prefix(before, suffix), shared_prefix(before_left, left)
            part.append(here)
            shared.append(a)
            rest.append(suffix[a:])
            left_shared.append(b)
            left_rest.append(left[b:])
            before, before_left = suffix, left
        size = len(order)
        taken = table.select(["doc_id", "text_key", "start", "anchor", "finish", "single"]).take(pa.array(order)).combine_chunks()
        column = lambda name: taken.column(name).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [
                column("doc_id"), column("text_key"), pa.array(part, pa.int64()), pa.array(np.full(size, run)), pa.array(np.arange(size)),
                pa.array(shared, pa.int32()), pa.array(rest, pa.binary()), pa.array(left_shared, pa.int32()), pa.array(left_rest, pa.binary()),
                column("start"), column("anchor"), column("finish"), column("single"),
            ],
            names=["doc_id", *[x.split(" ")[0] for x in RUN.split(", ")]],
        )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in stream:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size > 32 << 20:
                table = pa.Table.from_batches(held)
                yield from coded(table, _run_name(table))
                held, size = [], 0
        if held:
            table = pa.Table.from_batches(held)
            yield from coded(table, _run_name(table))

    return mapped(around, run, f"doc_id {kind}, {RUN}")


def _run_name(table: pa.Table) -> int:
    """A name that a repeated task gives again, and no other run is likely to have."""
    keys = np.asarray(table.column("text_key")).view(U64) * U64(3) + np.asarray(table.column("anchor")).astype(U64)
    return int(signed(mix(keys).sum(keepdims=True, dtype=U64))[0])


def _decoded(rows: list[tuple]) -> Iterator[tuple[int, bytes, object]]:
    before, left = b"", b""
    for shared, rest, left_shared, left_rest, item in rows:
        before, left = before[:shared] + rest, left[:left_shared] + left_rest
        yield shared, before, (left, item)


def repeats_in_order(shared: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, and each offset before its anchor, whether that window repeats.

    ``shared``: prefix shared with the suffix before, 0 where a new k-gram begins. A
    suffix has windows at the offsets ``low`` to ``high``.
    """
    size, gram = len(lefts), length // 2
    group = np.cumsum(shared < gram)
    order = sorted(range(size), key=lambda i: (group[i], lefts[i]))
    left_shared = np.zeros(size, np.int64)
    for i, (a, b) in enumerate(zip(order, order[1:], strict=False), 1):
        left_shared[i] = shared_prefix(lefts[a], lefts[b]) if group[a] == group[b] else -1
    left_shared[0] = -1
    order = np.array(order)
    repeats = np.zeros((size, length - gram + 1), bool)
    left_class = np.empty(size, np.int64)
    for offset in range(length - gram + 1):
        valid = np.flatnonzero((low <= offset) & (offset <= high))
        if len(valid) < 2:
            continue
        right_class = np.cumsum(shared < length - offset)
        left_class[order] = np.cumsum(left_shared < offset)
        keys = right_class[valid] * (size + 1) + left_class[valid]
        by_key = np.argsort(keys, kind="stable")
        ordered = keys[by_key]
        equal = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(valid), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        repeats[valid[by_key[twice]], offset] = True
    return repeats


def spans_of(repeats: np.ndarray, anchor: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, first byte, end) of what the repeated windows of each suffix cover."""
    edge = np.zeros((len(repeats), 1), bool)
    padded = np.concatenate([edge, repeats, edge], axis=1).astype(np.int8)
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    _, after = np.nonzero(change == -1)
    return row, anchor[row] - (after - 1), anchor[row] - first + length


def merged_spans(runs: DataFrame, length: int) -> DataFrame:
    """Merges the runs of each range; (doc_id, text_key, begin, end) of what repeats in single anchors."""
    kind = runs.schema["doc_id"].dataType.simpleString()

    def judged(held: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        shared = np.array([x[0] for x in held])
        items = [x[1][1] for x in held]
        start, anchor, finish = (np.array([x[i] for x in items], np.int64) for i in (2, 3, 4))
        repeats = repeats_in_order(shared, [x[1][0] for x in held], anchor - finish, anchor - start, length)
        repeats &= np.array([x[5] for x in items])[:, None]
        row, begin, end = spans_of(repeats, anchor, length)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([items[i][0] for i in row], ids), pa.array([items[i][1] for i in row], pa.int64()),
                pa.array(begin), pa.array(end),
            ],
            names=["doc_id", "text_key", "begin", "end"],
        )

    def merge(sources: dict[int, list[tuple]], ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for shared, _, item in LoserTree([_decoded(rows) for rows in sources.values()]):
            if shared < length // 2:
                shared = 0
                if len(held) >= BATCH:
                    yield judged(held, ids)
                    held = []
            held.append((shared, item))
        if held:
            yield judged(held, ids)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict[int, list[tuple]] = {}
        part, ids = None, None
        for batch in stream:
            ids = batch.column("doc_id").type
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for i in range(len(batch)):
                if columns["part"][i] != part:
                    if sources:
                        yield from merge(sources, ids)
                    part, sources = columns["part"][i], {}
                item = tuple(columns[c][i] for c in ("doc_id", "text_key", "start", "anchor", "finish", "single"))
                sources.setdefault(columns["run"][i], []).append(
                    (columns["shared"][i], columns["rest"][i], columns["left_shared"][i], columns["left_rest"][i], item)
                )
        if sources:
            yield from merge(sources, ids)

    return mapped(runs, run, f"doc_id {kind}, text_key long, begin long, end long")


def counted_spans(around: DataFrame, length: int) -> DataFrame:
    """The same spans from digests of all windows: for k-grams with very many different surroundings."""
    kind = around.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            starts = np.asarray(batch.column("start"))
            for i, (suffix, left) in enumerate(zip(batch.column("suffix").to_pylist(), batch.column("left").to_pylist(), strict=True)):
                data = np.frombuffer(left[::-1] + suffix, np.uint8)
                at = np.arange(len(data) - length + 1)
                one, two = (roll.stretch(roll.sums(data), at, at + length) for roll in (ROLL, ROLL2))
                where = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(one)), pa.array(signed(two)), batch.column("doc_id").take(where), batch.column("text_key").take(where),
                        pa.array(starts[i] + at), batch.column("single").take(where),
                    ],
                    names=["one", "two", "doc_id", "text_key", "begin", "single"],
                )

    windows = mapped(around, run, f"one long, two long, doc_id {kind}, text_key long, begin long, single boolean")
    twice = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    return windows.where("single").join(twice, ["one", "two"]).select(
        "doc_id", "text_key", "begin", (F.col("begin") + length).alias("end")
    )


def of_groups(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows whose key is among ``groups``, with the columns of these; ``n`` tells the rows of each group.

    At most ``SHARE`` groups can hold more than one in ``SHARE`` of all ``total`` rows. Their
    rows are found by a broadcast and are not shuffled, so no task is dealt a hot key.
    """
    often = F.col("n") > total // SHARE
    hot = F.broadcast(groups.where(often))
    many = rows.join(hot, on)
    few = rows.join(hot.select(*on), on, "left_anti").join(groups.where(~often), on)
    return few.union(many)


def repeated_spans(docs: DataFrame, length: int, hot: int, range_bytes: int) -> DataFrame:
    """(doc_id, text_key, begin, end): bytes of windows that occur elsewhere; spans may overlap."""
    found = written(anchor_table(docs, length), "anchors")
    several = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(of_groups(found, several, ["gram"], found.count()).drop("n"), "shared-anchors")
    place = F.struct("doc_id", "text_key", "start", "anchor", "finish")
    kinds = shared.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
    kinds = written(kinds, "surroundings")
    equal = kinds.where("n > 1").select("gram", "around", "n")
    whole = of_groups(shared, equal, ["gram", "around"], shared.count()).select(
        "doc_id", "text_key", F.col("start").alias("begin"), (F.col("finish") + length).alias("end")
    )
    different = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = kinds.select("gram", (F.col("n") == 1).alias("single"), "place.*")
    chosen = of_groups(alone, different, ["gram"], kinds.count()).withColumn("many", F.col("n") > hot).drop("n")

    around = written(surroundings(docs, chosen, length), "suffixes")
    # Cuts are as long as a k-gram, so that no range parts the suffixes of one.
    prefix = length // 2
    total, nbytes = around.agg(F.count(F.lit(1)), F.sum(F.octet_length("suffix"))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(total or 0, max(cores * 2, (nbytes or 0) // range_bytes)))
    alphabets = -(-parts // SAMPLE)
    ranges = -(-parts // alphabets)
    sample = around.where(F.rand(7) < min(1.0, SAMPLE / max(total, 1))).select(F.substring("suffix", 1, prefix)).limit(4 * SAMPLE)
    prefixes = sorted(bytes(r[0]) for r in sample.collect())
    cuts = sorted({prefixes[len(prefixes) * i // ranges] for i in range(1, ranges)}) if prefixes else []
    runs = front_coded_runs(around.where("not many"), cuts, prefix, alphabets)
    runs = runs.repartition(alphabets * (len(cuts) + 1), "part").sortWithinPartitions("part", "run", "number")
    return whole.union(merged_spans(runs, length)).union(counted_spans(around.where("many"), length))


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (of bytes removed: begin, end) and kept (the other bytes) of each row."""
    texts = keyed(docs)
    found = repeated_spans(texts, length, hot, range_bytes)
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("begin", "end")).alias("found"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "found")
    joined = texts.join(spans, same_document(texts, spans), "left").select("doc_id", "text", "found")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, offsets = string_column(batch, "text")
            lengths, removed, kept = np.diff(offsets), [], []
            for row, listed in enumerate(batch.column("found").to_pylist()):
                text = data[offsets[row] : offsets[row + 1]]
                runs: list[list[int]] = []
                for begin, end in sorted((x["begin"], x["end"]) for x in listed or []):
                    if runs and begin <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([begin, end])
                stay = np.ones(len(text), bool)
                for begin, end in runs:
                    stay[begin:end] = False
                removed.append([{"begin": b, "end": e} for b, e in runs])
                kept.append((text[stay] if runs else text).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return mapped(joined, run, f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
