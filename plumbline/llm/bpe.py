"""Byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled one after another. A state of the automaton is the token read
last; an arc from token x to token y says that y may follow x in a correct encoding. The
gadget of a merge (u, v) -> w cuts the arc from u to v, and gives w the arcs that led to
u and those that leave v at that moment, provided that the arc from u to v still stood
(otherwise w is never made). Written out, the arcs of a large vocabulary would fill
billions of cells, so a gadget is stored as what it changes: the parts of w and its
rank. A cell of the arc table is worked out from the gadgets when it is first looked at
and kept.

For every prefix of a word exactly one path leads from the start over arcs whose labels
spell the prefix. Encoding follows the byte table of the token labels from each place and
takes a token that an arc allows, the longest first; it goes back from a place that leads nowhere
and never tries it again. Decoding emits the
labels of the tokens.

Defined results: a null or empty text has no tokens and decodes to the empty text. Special
tokens in a text are tokens of their own. Bytes that are not valid UTF-8 after decoding
become U+FFFD. Repeated rows give repeated results; other columns are kept unless they
bear the name of an output column, which then replaces them. Texts are encoded whole,
in slices of bounded size of whole rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import all_but, mapped, schema_with

SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-split of byte-level tokenizers, with white space written out.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Words whose encoding a worker remembers, and the longest word that it does remember.
MEMORY, LONGEST = 250_000, 200
SLICE_BYTES = 2 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of byte-level tokenizers."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.labels: dict[int, bytes] = {
            token: bytes(letters[c] for c in written) for written, token in vocab.items()
        }
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels |= {token: content.encode() for content, token in self.specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        base = {self.labels[t]: t for t in vocab.values() if len(self.labels[t]) == 1}
        reachable = set(base.values())
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self._add_gadget(rank, vocab[left], vocab[right], vocab[left + right], reachable)
        self.table: dict[int, int] = {}
        self.accepts: list[int] = [-1]
        for token in sorted(reachable):
            self._add_label(self.labels[token], token)
        self.whole = {self.labels[token]: token for token in reachable}
        self.lengths = {token: len(label) for token, label in self.labels.items()}
        self.longest = max(map(len, self.labels.values()))
        self.words = regex.compile(SPLIT)
        names = sorted(self.specials, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, names))) if names else None
        ordered = [self.labels.get(token, b"") for token in range(max(self.labels) + 1)]
        self.label_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.label_sizes = np.array([len(label) for label in ordered], np.int64)
        self.label_starts = np.cumsum(self.label_sizes) - self.label_sizes
        self.remembered: dict[str, bytes] = {}

    def _add_gadget(self, rank: int, u: int, v: int, w: int, reachable: set[int]) -> None:
        self.rank.setdefault((u, v), rank)
        if w not in self.made and u in reachable and v in reachable and self._stands(u, v, rank):
            self.made[w] = (rank, u, v)
            reachable.add(w)

    def _stands(self, x: int, y: int, before: int) -> bool:
        """Whether the arc from x to y exists after the gadgets of rank below ``before``."""
        while True:
            if self.rank.get((x, y), before) < before:
                return False
            x_rank, _, x_right = self.made.get(x, (-1, x, x))
            y_rank, y_left, _ = self.made.get(y, (-1, y, y))
            if x_rank == y_rank == -1:
                return True
            if x_rank > y_rank:
                x, before = x_right, x_rank
            elif y_rank > x_rank:
                # A merge is made from the left, so the pair on the left comes first.
                y, before = y_left, y_rank + 1
            else:
                x, y, before = x_right, y_left, x_rank

    def arc(self, x: int, y: int) -> bool:
        found = self.arcs.get((x, y))
        if found is None:
            if len(self.arcs) >= MEMORY:
                self.arcs.clear()
            found = self.arcs[x, y] = self._stands(x, y, len(self.rank) + 1)
        return found

    def _add_label(self, label: bytes, token: int) -> None:
        node = 0
        for byte in label:
            key = node << 8 | byte
            if key not in self.table:
                self.table[key] = len(self.accepts)
                self.accepts.append(-1)
            node = self.table[key]
        self.accepts[node] = token

    def _labels_from(self, word: bytes, start: int) -> list[int]:
        """Tokens whose labels begin at ``start``, the longest last."""
        found, node = [], 0
        table, accepts = self.table, self.accepts
        for byte in word[start : start + self.longest]:
            node = table.get(node << 8 | byte)
            if node is None:
                break
            if accepts[node] >= 0:
                found.append(accepts[node])
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens on the only path that spells the word.

        Long labels are tried first. A place that leads nowhere is left for good, since
        only one path reaches it.
        """
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        size, at, path, dead = len(word), 0, [], set()
        arcs, lengths = self.arcs, self.lengths
        open_choices = [self._labels_from(word, 0)]
        while at < size:
            choices = open_choices[-1]
            while choices:
                token = choices.pop()
                end = at + lengths[token]
                if end in dead:
                    continue
                if path:
                    stands = arcs.get((path[-1], token))
                    if not (self.arc(path[-1], token) if stands is None else stands):
                        continue
                path.append(token)
                at = end
                open_choices.append(self._labels_from(word, at))
                break
            else:
                dead.add(at)
                open_choices.pop()
                at -= lengths[path.pop()]
        return path

    def _word(self, word: str) -> bytes:
        found = self.remembered.get(word)
        if found is None:
            found = np.array(self.encode_word(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()
            if len(word) <= LONGEST:
                if len(self.remembered) >= MEMORY:
                    self.remembered.clear()
                self.remembered[word] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        remembered = self.remembered
        return [remembered.get(word) or self._word(word) for word in self.words.findall(text)]

    def encode(self, text: str) -> np.ndarray:
        """Token ids of the text."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return np.frombuffer(b"".join(self._plain(text)), np.int32)
        parts, at = [], 0
        for match in self.special_pattern.finditer(text):
            parts += self._plain(text[at : match.start()])
            parts.append(np.array([self.specials[match.group()]], np.int32).tobytes())
            at = match.end()
        return np.frombuffer(b"".join(parts + self._plain(text[at:])), np.int32)

    def decode(self, tokens: np.ndarray) -> str:
        """The labels of the tokens, one after the other."""
        size = self.label_sizes[tokens]
        ends = np.cumsum(size)
        if not len(ends):
            return ""
        place = np.repeat(self.label_starts[tokens] - (ends - size), size) + np.arange(ends[-1])
        return self.label_bytes[place].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(path: str) -> TokenAutomaton:
    """Compiled once for each worker process."""
    return TokenAutomaton(path)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` (array of int) and ``decoded`` (string) to each row of ``docs``.

    ``vocabulary`` is a tokenizer file that every executor can read at the same path.
    """
    source = all_but(docs, ("token_ids", "decoded"))
    schema = schema_with(source, token_ids=T.ArrayType(T.IntegerType()), decoded=T.StringType())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary)
        for batch in stream:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            first = 0
            while first < len(batch):
                limit = (ends[first - 1] if first else 0) + SLICE_BYTES
                last = min(max(int(np.searchsorted(ends, limit, side="right")), first + 1), len(batch))
                part = batch.slice(first, last - first)
                ids, decoded = [], []
                for value in column.slice(first, last - first).to_pylist():
                    tokens = machine.encode(value) if value else np.zeros(0, np.int32)
                    ids.append(tokens)
                    decoded.append(machine.decode(tokens))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(decoded, pa.string())],
                    names=[*part.schema.names, "token_ids", "decoded"],
                )
                first = last

    return mapped(source, run, schema)
