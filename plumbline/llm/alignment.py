"""Alignment of two tokenizations of the same text.

Tokenizer A is byte-level BPE, B is pieces with byte fallback; both cut space + text into
tokens that spell the same bytes. Two tokens are linked where their bytes overlap, and the
components of that graph are the groups: stretches of text after which both have a cut.

Groups are found by pointer jumping over all tokens of many texts at once: every token points to
the overlapping token of the other side that ends farthest to the right (a token of B
that ends where its own farthest one ends points to itself), and all pointers are doubled
until none changes. What a token then points to is the last token of its group, which labels it.

How often a pair of ids is linked counts the documents that hold it, over the whole corpus.
Encoded texts are written in blocks of bounded bytes. A block's different pairs are counted
before they are shuffled; the corpus counts come back to blocks, not to documents, so a pair
that stands in every document is one row a block.

Defined results: null and empty texts have no tokens, nor have texts that a tokenizer does not
spell byte for byte; their groups are the empty text. Special tokens in a text are plain
text. Repeated rows give repeated results and count as documents of their own. Other
columns but the text are kept unless they bear the name of an output column. Very long texts
are encoded in stretches that end between words, where neither tokenizer can join anything.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bpe import byte_letters
from plumbline.llm.common import Scratch, all_but, mapped

#: Fixed value: the pre-split of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a block of texts; characters encoded and tokens aligned at once.
BLOCK_BYTES, SLICE, AT_ONCE = 4 << 20, 1 << 19, 1 << 19
#: Words whose tokens a worker remembers, and the longest word that it does remember.
MEMORY, LONGEST = 150_000, 64
#: Before a blank after anything but white space neither tokenizer can join anything to what follows.
BETWEEN_WORDS = re.compile(r"(?<=\S) ")
LONG_RUN = regex.compile(r"\s{2000,}|[^\s\p{L}\p{N}]{20000,}")
OUTPUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


class _Side:
    """The bytes of every token."""

    def __init__(self, labels: list[bytes]):
        self.length = np.array([len(x) for x in labels], np.int64)
        self.labels = pa.array(labels, pa.binary())
        self.kind = np.uint16 if len(labels) <= 1 << 16 else np.uint32

    def spells(self, ids: np.ndarray, data: bytes) -> bool:
        if int(self.length[ids].sum()) != len(data):
            return False
        return not data or self.labels.take(pa.array(ids)).buffers()[2].to_pybytes()[: len(data)] == data


class ByteLevel(_Side):
    """Tokenizer A, from its vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        labels = {token: bytes(letters[c] for c in written) for written, token in spec["model"]["vocab"].items() if written not in {x["content"] for x in spec["added_tokens"]}}
        super().__init__([labels.get(i, b"") for i in range(max(labels) + 1)])
        # Of this vocabulary ids are ranks: the merge made first has the smaller id.
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={v: k for k, v in labels.items()}, special_tokens={})
        self.path = path
        self.plain = None

    def encode(self, text: str) -> list[int]:
        if LONG_RUN.search(text) is None:
            return self.fast.encode_ordinary(text)
        # The split above steps back through such runs; this library takes them as they come.
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
            self.plain.encode_special_tokens = True
            self.plain.no_truncation()
            self.plain.no_padding()
        return self.plain.encode(text, add_special_tokens=False).ids


class Pieces(_Side):
    """Tokenizer B, from its model file. No piece holds a blank after another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        labels = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            labels.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        super().__init__(labels)
        self.blank = [self.model.piece_to_id("▁")]

    def encode(self, text: str) -> list[int]:
        """Of a text that begins with the blank that the model would add."""
        return self.model.encode(text[1:]) if len(text) > 1 else self.blank


class Both:
    """The two tokenizers, and the tokens of words met before."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _one(self, word: str) -> tuple[bytes, bytes]:
        return tuple(np.array(side.encode(" " + word), side.kind).tobytes() for side in (self.a, self.b))

    def _learn(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Tokens of words: of many at once, cut where their bytes end, if both tokenizers spell them."""
        plain = [w for w in words if w and len(w) <= LONGEST and not w[-1].isspace() and "▁" not in w]
        found = {}
        if plain:
            line = " " + " ".join(plain)
            size = np.cumsum([1 + len(w.encode()) for w in plain])
            cut = []
            for side in (self.a, self.b):
                ids = np.array(side.encode(line), side.kind)
                ends = np.cumsum(side.length[ids])
                at = np.searchsorted(ends, size)
                if len(ids) == 0 or ends[-1] != size[-1] or not np.array_equal(ends[at], size):
                    break
                cut.append([x.tobytes() for x in np.split(ids, at[:-1] + 1)])
            if len(cut) == 2:
                found = dict(zip(plain, zip(*cut, strict=True), strict=True))
        for word in words - found.keys():
            found[word] = self._one(word)
        return found

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of space + text; none if the text is empty or either does not spell it."""
        split = [BETWEEN_WORDS.split(t) if t else [] for t in texts]
        new = {w for words in split for w in words} - self.known.keys()
        extra = {}
        if new:
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
                new = {w for words in split for w in words}
            extra = self._learn(new)
            self.known.update((w, x) for w, x in extra.items() if len(w) <= LONGEST)
        kinds = self.a.kind, self.b.kind
        out = []
        for words in split:
            found = [self.known.get(w) or extra[w] for w in words]
            out.append(tuple(np.frombuffer(b"".join([f[k] for f in found]), kinds[k]) for k in (0, 1)))
        data = [(" " + t).encode() if t else b"" for t in texts]
        whole = b"".join(data)
        if all(side.spells(np.concatenate([x[k] for x in out]), whole) for k, side in enumerate((self.a, self.b))) if out else True:
            return out
        none = np.zeros(0, kinds[0]), np.zeros(0, kinds[1])
        return [x if self.a.spells(x[0], d) and self.b.spells(x[1], d) else none for x, d in zip(out, data, strict=True)]


def public_vocabularies() -> tuple[str, str]:
    """The files of the two public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def both(a_path: str, b_path: str) -> Both:
    return Both(a_path, b_path)


class Aligned:
    """Groups and links of many texts, whose ids follow each other."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a: _Side, b: _Side):
        self.a, self.b, self.n_a, self.n_b = ids_a, ids_b, n_a, n_b
        # Places in the texts laid end to end: no token crosses from one to the next.
        self.end_a, self.end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
        size = int(self.end_a[-1]) if len(ids_a) else 0
        self.cut = np.zeros((2, size + 1), bool)
        self.cut[0, self.end_a] = self.cut[1, self.end_b] = True
        # How many tokens end at or before a byte: the place of the token that holds the next one.
        self.ended_a, self.ended_b = np.cumsum(self.cut[0], dtype=np.int32), np.cumsum(self.cut[1], dtype=np.int32)
        self.last = self._terminals()

    def _terminals(self) -> np.ndarray:
        """For each token of A, then of B, the last token of its group."""
        size = np.int32(len(self.a))
        own = np.arange(size, size + len(self.b), dtype=np.int32)
        closes = self.cut[0, self.end_b]
        pointer = np.concatenate([self.ended_b[self.end_a - 1] + size, np.where(closes, own, self.ended_a[self.end_b - 1])])
        while True:
            doubled = pointer[pointer]
            if np.array_equal(doubled, pointer):
                return pointer
            pointer = doubled

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, and places in A and B, of every pair of overlapping tokens: one for each stretch without a cut of either."""
        cuts = np.flatnonzero(self.cut[0] | self.cut[1])
        at_a, at_b = self.ended_a[cuts - 1], self.ended_b[cuts - 1]
        return np.repeat(np.arange(len(self.n_a)), self.n_a)[at_a], at_a, at_b

    def groups(self) -> np.ndarray:
        """How many groups each text has."""
        return np.diff(np.concatenate([[0], np.cumsum(self._closing())])[np.concatenate([[0], np.cumsum(self.n_b)])])

    def _closing(self) -> np.ndarray:
        size = len(self.a)
        return self.last[size:] == np.arange(size, size + len(self.b))

    def written(self) -> pa.Array:
        """`a1,a2|b1;a3|b2` of each text: ids in order, by group."""
        closing = self._closing()
        rank = np.cumsum(closing) - closing
        terminal = np.flatnonzero(closing)
        group_a, group_b = rank[self.last[: len(self.a)] - len(self.a)], rank
        first_b = np.concatenate([[0], terminal[:-1] + 1]).astype(np.int64)
        upto_a = np.cumsum(np.bincount(group_a, minlength=len(terminal)))
        # A group's tokens of A follow all tokens of groups before it, then come those of B.
        place = np.concatenate([np.arange(len(self.a)) + first_b[group_a], np.arange(len(self.b)) + upto_a[group_b]]) if len(terminal) else np.zeros(0, np.int64)
        mark = np.zeros(len(place), np.int64)
        mark[: len(self.a)][upto_a - 1] = 1
        mark[len(self.a) :][closing] = 2
        mark[len(self.a) + np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        ids = np.concatenate([self.a, self.b]).astype(np.int64)
        width, names = _names(int(ids.max(initial=0)) + 1)
        order = np.empty(len(place), np.int64)
        order[place] = mark * width + ids
        spelled = names.take(pa.array(order))
        offsets = np.frombuffer(spelled.buffers()[1], np.int32)[: len(order) + 1] if len(order) else np.zeros(1, np.int32)
        ends = offsets[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return pa.StringArray.from_buffers(len(self.n_a), pa.py_buffer(ends.astype(np.int32).tobytes()), spelled.buffers()[2] or pa.py_buffer(b""))


@lru_cache(maxsize=2)
def _names_of(size: int) -> pa.Array:
    return pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(size)], pa.string())


def _names(vocabulary: int) -> tuple[int, pa.Array]:
    """Every id as text, before each of the marks that may follow it; and the number of ids."""
    size = 1 << max(vocabulary - 1, 1).bit_length()
    return size, _names_of(size)


def _packed(docs: DataFrame, text: str) -> DataFrame:
    rest = all_but(docs, (text,))
    quoted = ["`" + c.replace("`", "``") + "`" for c in rest.columns]
    row = F.struct(*quoted) if quoted else F.struct(F.lit(None).cast("string").alias("_nothing"))
    return docs.select(row.alias("_row"), docs[text].cast("string").alias("_text"))


BLOCK_FIELDS = ("a", "b", "n_a", "n_b")


def _pressed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _encoded_blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """A row for each block of about ``block_bytes`` of text, or of one longer text: its rows, their ids one after another, and how many."""
    rows_type = T.ArrayType(docs.schema["_row"].dataType)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("_rows", rows_type), *[T.StructField(n, T.BinaryType()) for n in BLOCK_FIELDS]])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = both(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        rows, ids, held = [], [], 0

        def block_row() -> pa.RecordBatch:
            together = pa.concat_arrays(rows)
            numbers = [np.concatenate([x[k] for x in ids]) for k in (0, 1)] + [np.array([len(x[k]) for x in ids], np.int32) for k in (0, 1)]
            columns = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together)]
            return pa.RecordBatch.from_arrays(columns + [pa.array([_pressed(x)], pa.binary()) for x in numbers], names=["block", "_rows", *BLOCK_FIELDS])

        for batch in stream:
            texts = batch.column("_text").to_pylist()
            upto = np.cumsum([len(t or "") for t in texts])
            start = 0
            while start < len(texts):
                # No more at once than SLICE characters, or one text, and no more than the block still takes.
                room = (upto[start - 1] if start else 0) + min(SLICE, max(block_bytes - held, 1))
                end = min(max(int(np.searchsorted(upto, room, side="right")), start + 1), len(texts))
                ids += sides.encoded(texts[start:end])
                rows.append(batch.column("_row").slice(start, end - start))
                held += int(upto[end - 1] - (upto[start - 1] if start else 0)) + 100 * (end - start)
                start = end
                if held >= block_bytes:
                    yield block_row()
                    block, rows, ids, held = block + 1, [], [], 0
        if rows:
            yield block_row()

    return mapped(docs, run, schema)


def _read_block(fields: dict[str, bytes], sides: Both) -> tuple[np.ndarray, ...]:
    kinds = (sides.a.kind, sides.b.kind, np.int32, np.int32)
    return tuple(np.frombuffer(zstandard.decompress(fields[n]), kind) for n, kind in zip(BLOCK_FIELDS, kinds, strict=True))


def _slices_of_block(fields: dict[str, bytes], sides: Both) -> Iterator[Aligned]:
    """The texts of a block, aligned so many at once as have ``AT_ONCE`` tokens, or one."""
    a, b, n_a, n_b = _read_block(fields, sides)
    upto_a, upto_b = (np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n in (n_a, n_b))
    upto = upto_a + upto_b
    start = 0
    while start < len(n_a):
        end = min(max(int(np.searchsorted(upto, upto[start] + AT_ONCE, side="right")) - 1, start + 1), len(n_a))
        yield Aligned(a[upto_a[start] : upto_a[end]], b[upto_b[start] : upto_b[end]], n_a[start:end], n_b[start:end], sides.a, sides.b)
        start = end


def _pairs_of_blocks(blocks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(block, pair, n): how many documents of a block hold each pair of ids linked. A pair is A's id, then 32 bits of B's."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = both(a_path, b_path)
        for batch in stream:
            for row in batch.to_pylist():
                found, width = [], len(sides.b.length)
                size = len(sides.a.length) * width
                for aligned in _slices_of_block(row, sides):
                    doc, at_a, at_b = aligned.links()
                    pairs = np.unique(doc * size + aligned.a[at_a].astype(np.int64) * width + aligned.b[at_b])
                    found.append(np.unique(pairs % size, return_counts=True))
                pairs, of = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                n = np.bincount(of, np.concatenate([c for _, c in found]), len(pairs)).astype(np.int64)
                pairs = (pairs // width) << 32 | pairs % width
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row["block"])), pa.array(pairs), pa.array(n)], names=["block", "pair", "n"])

    return mapped(blocks.select("block", *BLOCK_FIELDS), run, "block long, pair long, n long")


def pair_counts(block_pairs: DataFrame) -> DataFrame:
    """(pair, count, best): documents of the corpus that hold a pair, and whether no pair of its A id has more.

    An A id has at most as many pairs as B has ids, which bounds the window.
    """
    counts = block_pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "count", (F.col("count") == most).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, scratch: Scratch, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of ``docs`` but its text, with counts, and the groups as text: ids of A and B by group.

    ``n_best`` are the links whose pair no other pair of the same A id exceeds in the
    corpus, ``count_sum`` adds up the corpus counts of all links.
    """
    packed = _packed(docs, text)
    blocks = scratch.written(_encoded_blocks(packed, a_path, b_path, block_bytes), "encoded")
    block_pairs = scratch.written(_pairs_of_blocks(blocks, a_path, b_path), "pairs")
    counts = scratch.written(pair_counts(block_pairs), "counts")
    looked_up = block_pairs.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    row_type = packed.schema["_row"]
    schema = T.StructType([row_type, *[T.StructField("_" + n, T.StringType() if n == "groups" else T.LongType()) for n in OUTPUT]])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        sides = both(a_path, b_path)
        known = right.column("pair").to_numpy()
        order = np.argsort(known)
        known, count, best = known[order], right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        rows, done = left.column("_rows").combine_chunks().flatten(), 0
        out = []
        fields = {n: left.column(n)[0].as_py() for n in BLOCK_FIELDS}
        for aligned in _slices_of_block(fields, sides):
            doc, at_a, at_b = aligned.links()
            size = len(aligned.n_a)
            place = np.searchsorted(known, aligned.a[at_a].astype(np.int64) << 32 | aligned.b[at_b])
            # Links stand in the order of their texts.
            upto = np.searchsorted(doc, np.arange(size + 1))
            added = [np.diff(np.concatenate([[0], np.cumsum(x[place], dtype=np.int64)])[upto]) for x in (best, count)]
            numbers = [aligned.n_a, aligned.n_b, aligned.groups(), np.diff(upto), *added]
            columns = [rows.slice(done, size), *[pa.array(x.astype(np.int64)) for x in numbers], aligned.written()]
            out.append(pa.RecordBatch.from_arrays(columns, names=schema.names))
            done += size
        return pa.Table.from_batches(out)

    found = blocks.groupBy("block").cogroup(looked_up.groupBy("block")).applyInArrow(run, schema)
    names = [f.name for f in row_type.dataType.fields if f.name not in OUTPUT and f.name != "_nothing"]
    rows = [F.col("_row")[n].alias(n) for n in names]
    return found.select(*rows, *[F.col("_" + n).alias(n) for n in OUTPUT])
