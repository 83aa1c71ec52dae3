"""Repair of conversations whose turns were lost, repeated, cut off or given to the wrong speaker.

A conversation is a row of symbols, one for each turn: who speaks (system, user,
assistant, somebody else) and what is wrong with the text. A repair keeps, re-roles or
deletes every turn and may insert empty ones, so that the speakers read
``(s?(ua)+)?``. The speakers written so far are one of four states, so a symbol is a
4 x 4 matrix over (cost, edits): the cheapest edits that lead from one state to another, of
equally cheap ones the least in ASCII. Matrices multiply by adding costs and joining
edits (min-plus). No edits of one cell are the beginning of others of that cell, as an
insertion more costs more, so joining keeps their order.

The symbols of all conversations are compressed by one grammar (Re-Pair: the most
frequent neighbours become a new symbol, round by round). Every rule has one matrix,
worked out from those of its two parts; its edits are ropes that share the parts' ropes.
A conversation is then the product of the few symbols that are left of it.

Only ids, turns, roles and a SHA-256 of each text take part until the edits are known. Rows
are sorted by range and cut into pieces of at most ``PIECE`` symbols, so a conversation of
any length is spread over tasks; one matrix a piece meets at the end, and every piece
gets its part of the edits back.

Defined results: nulls in role and text are one space; a null turn sorts first; rows
without conv_id are one conversation. Turns with the same number are ordered by role,
then by the text's SHA-256. Rows repeated in full are counted before they are moved; all but the first are
duplicates. The first of these faults counts: blank (no character but space and \\t to \\r),
duplicate (role and text occur earlier in the conversation), truncated (the last such
character is none of ``.!?``). Other columns are not looked at. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import Scratch, mapped

#: What edits cost, and what a truncated turn adds when it is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols: speaker (s, u, a, other), plus 4 if truncated; turns that must be deleted are one symbol.
GONE, TERMINALS = 8, 9
#: Longest piece of a conversation, rules of a round and rounds of the grammar.
PIECE, RULES, ROUNDS = 4096, 48, 6
BLANKS = " \t\n\x0b\x0c\r"

# States: nothing written, after s, after u, after a.
STATES = 4
ACCEPTED = (0, 3)

Rope = str | tuple
Cell = tuple[int, Rope] | None
Matrix = tuple[Cell, ...]


def spelled(rope: Rope) -> str:
    parts, rest = [], [rope]
    while rest:
        x = rest.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            rest += (x[1], x[0])
    return "".join(parts)


def joined(x: Rope, y: Rope) -> Rope:
    return y if x == "" else x if y == "" else (x, y)


def before(x: Rope, y: Rope) -> bool:
    """Whether ``x`` spells an earlier string than ``y``; a part that both share is passed over."""
    left, right = [x], [y]
    while left and right:
        a, b = left.pop(), right.pop()
        if a is b:
            continue
        if not isinstance(a, str):
            left += (a[1], a[0])
            right.append(b)
        elif not isinstance(b, str):
            left.append(a)
            right += (b[1], b[0])
        else:
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a < b
            if a[n:]:
                left.append(a[n:])
            if b[n:]:
                right.append(b[n:])
    return not left and bool(right)


def least(x: Cell, y: Cell) -> Cell:
    if x is None or y is None:
        return x or y
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if before(y[1], x[1]) else x


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product; ``x`` may have any number of rows."""
    out: list[Cell] = []
    for row in range(0, len(x), STATES):
        for q in range(STATES):
            best: Cell = None
            for r in range(STATES):
                a, b = x[row + r], y[STATES * r + q]
                if a is not None and b is not None and (best is None or a[0] + b[0] <= best[0]):
                    best = least(best, (a[0] + b[0], joined(a[1], b[1])))
            out.append(best)
    return tuple(out)


def following(state: int, speaker: int) -> int | None:
    """The state after ``speaker`` (0 system, 1 user, 2 assistant) is written, if that is allowed."""
    if speaker == 0:
        return 1 if state == 0 else None
    if speaker == 1:
        return None if state == 2 else 2
    return 3 if speaker == 2 and state == 2 else None


def _edits(symbol: int) -> Matrix:
    """What may be done with one turn, without insertions."""
    cells: list[Cell] = [None] * STATES**2
    late = TRUNCATED if 4 <= symbol < GONE else 0
    for p in range(STATES):
        found = [(p, DELETE, "D")]
        if symbol != GONE:
            found += [(following(p, symbol % 4), late, "K")]
            found += [(following(p, speaker), REROLE + late, "R") for speaker in (1, 2)]
        for q, cost, letter in found:
            if q is not None:
                cells[STATES * p + q] = least(cells[STATES * p + q], (cost, letter))
    return tuple(cells)


def _insertions() -> Matrix:
    cells: list[Cell] = [None] * STATES**2
    for p in range(STATES):
        q, n = p, 0
        while q is not None and cells[STATES * p + q] is None:
            cells[STATES * p + q] = (INSERT * n, "I" * n)
            q, n = following(q, 2 if q == 2 else 1), n + 1
    return tuple(cells)


INSERTIONS = _insertions()
UNIT: Matrix = tuple((0, "") if p == q else None for p in range(STATES) for q in range(STATES))


class Grammar:
    """Rules (left, right) numbered from ``TERMINALS`` on, and the matrix of every symbol."""

    def __init__(self, rules: tuple[tuple[int, int], ...] = ()):
        self.rules = rules
        self.matrices = [times(INSERTIONS, _edits(symbol)) for symbol in range(TERMINALS)]
        for left, right in rules:
            self.matrices.append(times(self.matrices[left], self.matrices[right]))

    def compressed(self, symbols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and the rows they belong to, with the rules applied from the first to the last."""
        for number, (left, right) in enumerate(self.rules, TERMINALS):
            at = _places((symbols[:-1] == left) & (symbols[1:] == right) & (rows[:-1] == rows[1:]), left == right)
            if len(at):
                symbols = symbols.copy()
                symbols[at] = number
                stay = np.ones(len(symbols), bool)
                stay[at + 1] = False
                symbols, rows = symbols[stay], rows[stay]
        return symbols, rows

    def product(self, symbols: bytes) -> Matrix:
        found = UNIT
        for x in np.frombuffer(symbols, np.int32).tolist():
            found = times(found, self.matrices[x])
        return found


def _places(match: np.ndarray, twins: bool) -> np.ndarray:
    at = np.flatnonzero(match)
    if twins and len(at):
        # In a run of one symbol every second place.
        start = np.concatenate([[True], np.diff(at) > 1])
        run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
    return at


@lru_cache(maxsize=4)
def _grammar(rules: tuple[tuple[int, int], ...]) -> Grammar:
    return Grammar(rules)


def _joined_symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    found = [np.frombuffer(x, np.uint8) for x in batch.column("symbols").to_pylist()]
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return (np.concatenate(found) if found else np.zeros(0)).astype(np.int32), rows


def re_pair(pieces: DataFrame, rules_a_round: int = RULES, rounds: int = ROUNDS) -> tuple[tuple[int, int], ...]:
    """The rules for ``symbols`` of all pieces. Neighbours are counted over all of them each round."""
    rules: tuple[tuple[int, int], ...] = ()
    for _ in range(rounds):
        known = rules

        def count(stream: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            grammar = _grammar(known)
            for batch in stream:
                symbols, rows = grammar.compressed(*_joined_symbols(batch))
                twins = symbols[:-1] == symbols[1:]
                inside = rows[:-1] == rows[1:]
                at = np.concatenate([np.flatnonzero(inside & ~twins), _places(inside & twins, True)])
                pairs, n = np.unique(symbols[at].astype(np.int64) << 32 | symbols[at + 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

        counted = mapped(pieces.select("symbols"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(rules_a_round).collect()
        if not best:
            break
        rules += tuple((r["pair"] >> 32, r["pair"] & 0xFFFFFFFF) for r in best)
    return rules


def _last(text: Column) -> Column:
    return F.right(text, F.lit(1))


def light_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, copies, symbol, blank) of the different rows of ``turns``."""
    text = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    speaker = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    late = F.when(_last(text).isin(".", "!", "?"), 0).otherwise(4)
    one = turns.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("key"),
        F.when(text == "", GONE).otherwise(speaker + late).alias("_symbol"), (text == "").alias("_blank"), speaker.alias("_speaker"),
    )
    rows = one.groupBy("conv_id", "turn", "role", "key").agg(
        F.count(F.lit(1)).alias("copies"), F.first("_symbol").alias("_symbol"), F.first("_blank").alias("blank"), F.first("_speaker").alias("speaker")
    )
    # Where a role and text stand at several turns, all but the first are duplicates.
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = rows.where("not blank").groupBy("conv_id", "role", "key").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    again = again.where("_n > 1").select(*[F.col(c).alias("_" + c) for c in ("conv_id", "role", "key")], "_first")
    same = rows["conv_id"].eqNullSafe(again["_conv_id"]) & (rows["role"] == again["_role"]) & (rows["key"] == again["_key"])
    later = F.col("_first").isNotNull() & (order != F.col("_first"))
    return rows.join(again, same, "left").select(
        "conv_id", "turn", "role", "key", "copies", "blank", "speaker", F.when(later, GONE).otherwise(F.col("_symbol")).alias("symbol")
    )


def _piece_type(conv: T.DataType, turn: T.DataType) -> T.StructType:
    row = T.StructType([T.StructField("turn", turn), T.StructField("role", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("at", T.IntegerType())])
    numbers = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
    return T.StructType([
        T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), T.StructField("piece", T.LongType()),
        T.StructField("symbols", T.BinaryType()), T.StructField("rows", T.ArrayType(row)),
        *[T.StructField(n, T.LongType()) for n in numbers],
        T.StructField("speakers", T.BinaryType()), T.StructField("first_turn", turn), T.StructField("last_turn", turn),
    ])


class _Piece:
    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.symbols, self.rows = bytearray(), []
        self.blank = self.duplicate = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, row: dict, start: bool, n: int) -> None:
        """``n`` copies of a row; ``start``: the first of them is the row's first."""
        symbol = row["symbol"] if start else GONE
        if start:
            self.rows.append({"turn": row["turn"], "role": row["role"], "key": row["key"], "at": len(self.symbols)})
        self.symbols.append(symbol)
        self.symbols += bytes([GONE]) * (n - 1)
        if row["blank"]:
            self.blank += n
        else:
            self.duplicate += n - (symbol != GONE)
        who = row["speaker"]
        if self.last is not None:
            self.illegal += (self.last, who) not in LEGAL
        self.illegal += n - 1
        self.first = who if self.first is None else self.first
        self.last = who
        if row["turn"] is not None and row["turn"] != self.high:
            self.turns += 1
            self.low = row["turn"] if self.low is None else self.low
            self.high = row["turn"]

    def record(self, part: int, number: int) -> dict:
        return {
            "conv_id": self.conv_id, "part": part, "piece": number, "symbols": bytes(self.symbols), "rows": self.rows, "n": len(self.symbols),
            "blank": self.blank, "duplicate": self.duplicate, "truncated": sum(4 <= x < GONE for x in self.symbols),
            "illegal": self.illegal, "turns": self.turns, "speakers": bytes([self.first, self.last]), "first_turn": self.low, "last_turn": self.high,
        }


#: Speakers that may follow each other: system and user, user and assistant, assistant and user.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _pieces(rows: DataFrame, limit: int) -> DataFrame:
    """Pieces of at most ``limit`` symbols, from rows in order."""
    schema = _piece_type(rows.schema["conv_id"].dataType, rows.schema["turn"].dataType)
    order = ("conv_id", "turn", "role", "key")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = to_arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, piece = TaskContext.get().partitionId(), 0, None
        for batch in stream:
            done = []
            for row in batch.to_pylist():
                left = row["copies"]
                while left:
                    if piece is None or len(piece.symbols) >= limit or piece.conv_id != row["conv_id"]:
                        if piece is not None:
                            done.append(piece.record(part, number))
                            number += 1
                        piece = _Piece(row["conv_id"])
                    n = min(left, limit - len(piece.symbols))
                    piece.add(row, left == row["copies"], n)
                    left -= n
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if piece is not None:
            yield pa.RecordBatch.from_pylist([piece.record(part, number)], schema=arrow)

    return mapped(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order), run, schema)


_FACTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "speakers", "first_turn", "last_turn")


def _evaluated(pieces: DataFrame, rules: tuple[tuple[int, int], ...]) -> DataFrame:
    """Each piece with its matrix: ``costs`` (-1 where there is no way) and ``edits``."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = _grammar(rules)
        matrix = lru_cache(maxsize=4096)(grammar.product)
        for batch in stream:
            symbols, rows = grammar.compressed(*_joined_symbols(batch))
            ends = np.searchsorted(rows, np.arange(batch.num_rows), side="right")
            starts = np.concatenate([[0], ends[:-1]])
            found = [matrix(symbols[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            costs = pa.array([[-1 if c is None else c[0] for c in m] for m in found], pa.list_(pa.int64()))
            edits = pa.array([["" if c is None else spelled(c[1]) for c in m] for m in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, costs, edits], names=[*batch.schema.names, "costs", "edits"])

    source = pieces.drop("rows")
    schema = T.StructType([*source.schema.fields, T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("edits", T.ArrayType(T.StringType()))])
    return mapped(source, run, schema)


class _Conversation:
    """The pieces of one conversation, taken in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.best: Matrix = UNIT[:STATES]
        self.places, self.symbols = [], []
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last = self.low = self.high = None

    def add(self, row: dict) -> None:
        cells = tuple(None if c < 0 else (c, e) for c, e in zip(row["costs"], row["edits"], strict=True))
        self.best = times(self.best, cells)
        self.places.append((row["part"], row["piece"], row["n"]))
        self.symbols.append(row["symbols"])
        for k in self.sums:
            self.sums[k] += row[k]
        first, last = row["speakers"]
        if self.last is not None:
            self.sums["illegal"] += (self.last, first) not in LEGAL
        self.last = last
        if row["first_turn"] is not None:
            self.sums["turns"] -= self.high is not None and self.high == row["first_turn"]
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]

    def record(self) -> dict:
        closed = times(self.best, INSERTIONS)
        cost, rope = least(closed[ACCEPTED[0]], closed[ACCEPTED[1]])
        audit = spelled(rope)
        return {
            "conv_id": self.conv_id, "gaps": 0 if self.low is None else self.high - self.low + 1 - self.sums.pop("turns"),
            **{k: self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "slices": self._slices(audit),
        }

    def _slices(self, audit: str) -> list[dict]:
        """What is done in each piece, from which state, and how many turns are written before."""
        letters = np.frombuffer(audit.encode(), np.uint8)
        used = np.cumsum(letters != ord("I"))
        written = np.concatenate([[0], np.cumsum(letters != ord("D"))])
        ends = np.searchsorted(used, np.cumsum([n for _, _, n in self.places])) + 1
        ends[-1] = len(letters)
        first = len(audit) - len(audit.lstrip("D"))
        system = audit[first : first + 1] == "K" and b"".join(self.symbols)[first] % 4 == 0
        out, start = [], 0
        for (part, piece, _), end in zip(self.places, ends.tolist(), strict=True):
            n = int(written[start])
            state = 0 if n == 0 else 1 if system and n == 1 else 2 + (n - system + 1) % 2
            out.append({"part": part, "piece": piece, "edits": audit[start:end], "state": state, "written": n})
            start = end
        return out


def _conversations(evaluated: DataFrame) -> DataFrame:
    conv = evaluated.schema["conv_id"].dataType
    one = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("piece", T.LongType()), T.StructField("edits", T.StringType()), T.StructField("state", T.IntegerType()), T.StructField("written", T.LongType())])
    schema = T.StructType([
        T.StructField("conv_id", conv), *[T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        T.StructField("audit", T.StringType()), T.StructField("slices", T.ArrayType(one)),
    ])
    arrow = to_arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in stream:
            done = []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now.record())
                    now = _Conversation(row["conv_id"])
                now.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.record()], schema=arrow)

    return mapped(evaluated.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece"), run, schema)


def _written_turns(pieces: DataFrame, slices: DataFrame) -> DataFrame:
    """The turns of the repaired conversations, without texts."""
    turn = pieces.schema["first_turn"].dataType
    schema = T.StructType([
        T.StructField("conv_id", pieces.schema["conv_id"].dataType), T.StructField("position", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("turn", turn), T.StructField("role_before", T.StringType()), T.StructField("key", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for piece in batch.to_pylist():
                rows = {r["at"]: r for r in piece["rows"]}
                at, state, position = 0, piece["state"], piece["written"]
                for edit in piece["edits"]:
                    row = rows.get(at) if edit != "I" else None
                    at += edit != "I"
                    if edit == "D":
                        continue
                    speaker = 2 if state == 2 else 1
                    role = ("user", "assistant")[speaker - 1]
                    if edit == "K":
                        role = row["role"]
                        speaker = "sua".index(role[0])
                    state = following(state, speaker)
                    source = row or {"turn": None, "role": None, "key": None}
                    out.append({"conv_id": piece["conv_id"], "position": position, "edit": edit, "role": role, "turn": source["turn"], "role_before": source["role"], "key": source["key"]})
                    position += 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    parts = slices.select(*[F.col(c).alias("_" + c) for c in ("conv_id", "part", "piece")], "edits", "state", "written")
    same = (pieces["part"] == parts["_part"]) & (pieces["piece"] == parts["_piece"]) & pieces["conv_id"].eqNullSafe(parts["_conv_id"])
    return mapped(pieces.join(parts, same).select("conv_id", "rows", "edits", "state", "written"), run, schema)


@dataclass
class Repair:
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    conversations: DataFrame
    #: conv_id, position (from 0), edit (K, R or I), role, turn (null where inserted), text.
    turns: DataFrame


def repair(turns: DataFrame, scratch: Scratch, piece: int = PIECE) -> Repair:
    """The cheapest repair of every conversation of ``turns`` (conv_id, turn, role, text)."""
    full = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"),
        *[F.coalesce(turns[c].cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    pieces = scratch.written(_pieces(light_rows(full), piece), "pieces")
    found = scratch.written(_conversations(_evaluated(pieces, re_pair(pieces))), "conversations")
    slices = found.select("conv_id", F.explode("slices").alias("s")).select("conv_id", "s.*")
    rows = scratch.written(_written_turns(pieces, slices), "turns")
    texts = full.withColumn("key", F.unhex(F.sha2("text", 256))).groupBy("conv_id", "turn", "role", "key").agg(F.first("text").alias("text"))
    texts = texts.select(*[F.col(c).alias("_" + c) for c in ("conv_id", "turn", "role", "key")], "text")
    kept = rows.where("edit != 'I'")
    same = (
        kept["conv_id"].eqNullSafe(texts["_conv_id"]) & kept["turn"].eqNullSafe(texts["_turn"])
        & (kept["role_before"] == texts["_role"]) & (kept["key"] == texts["_key"])
    )
    columns = ("conv_id", "position", "edit", "role", "turn", "text")
    inserted = rows.where("edit = 'I'").withColumn("text", F.lit(""))
    return Repair(found.drop("slices"), kept.join(texts, same).select(*columns).union(inserted.select(*columns)))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` of all turns in order, joined by line breaks.

    A digest runs over its conversation from the first byte to the last; the turns pass
    through it one by one, so only a batch is held at a time.
    """
    conv = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in stream:
            done = []
            for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if running is None or conv_id != now:
                    if running is not None:
                        done.append({"conv_id": now, "sha256": running.hexdigest()})
                    now, running = conv_id, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if running is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "sha256": running.hexdigest()}], schema=arrow)

    ordered = turns.select("conv_id", "position", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return mapped(ordered, run, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage that depends on crc32 of ``conv_id:turn``; nulls are one space there."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    chance = F.crc32(F.concat(plain[0], F.lit(":"), plain[1]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], chance.alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where("_d != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("_copies").alias("_copy")).drop("_copy")
