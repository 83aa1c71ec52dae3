"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles, and equal sets are one set from the start. A
sketch keeps the smallest hash of a set under each of ``COORDINATES`` hash functions. Each
of ``TREES`` independent trees sends a set from node to node: a node chooses one
coordinate, or two for a quarter of the nodes, and the sets go on to the child that
their value there names, which makes 1.25 = 1 / 0.8 children on average. Two sets of
similarity 0.8 or more thus stay together on some path with a probability that falls
slowly with the depth, and unrelated sets part at once. Nodes of one set are dropped,
nodes of up to ``SMALL`` sets are compared exhaustively, others branch on, ``DEPTH`` times at
most and as long as that parts them. Nodes that are large even then, such as many near copies
of one text, are compared in blocks of bounded size, all of them.

A pair whose sketches agree enough is a candidate, and links are confirmed on the full sets.
No pairs of a group are ever listed: a node first proposes for each set its smallest
partner only, and what the confirmed ones put in one class needs no further proof. Sets with
candidates of another class then meet in their node with their full sets; each pair is due in
one node only, all intersections of a block come from a matrix product, and a node
returns no more links than join its classes. So no link that could join two classes is
left out.

Recall: a pair of similarity 0.8 is lost by a tree with probability 0.16 at depth 1, 0.43
at depth 4 and 0.5 at depth 6, by all twelve in 0.03 % of cases at the worst; its sketches
agree in less than ``AGREE`` coordinates in 0.03 % of cases.

Defined results: documents without words or text have an empty set, link with nothing and
are a class of their own. Repeated rows give repeated results; rows that share an id are
in one class. A null id links only through others with the same set, and is kept. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import U64, Scratch, groups_of_rows, mapped, mix, signed, string_column, written
from plumbline.llm.components import components
from plumbline.llm.shingles import shingle_sets

SIMILARITY = 80
COORDINATES, AGREE = 128, 87
TREES, DEPTH, SMALL, BLOCK = 12, 6, 48, 1024
#: A child with more than this share of its parent's sets shows that branching does not part them.
TOGETHER = 0.5
SETS = "doc_id long, n_shingles long, key1 long, key2 long, sketch binary"


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, count + 1, dtype=U64)
    return mix(base * U64(0x9FB21C651E98DF25))[:, None], (mix(base * U64(0xA0761D6478BD642F)) | U64(1))[:, None]


XOR, TIMES = _seeds(COORDINATES)


def sketch(items: np.ndarray) -> bytes:
    """The smallest hash of the set for each coordinate, as 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, U64)
    for start in range(0, len(items), 2048):
        hashed = (items[None, start : start + 2048] ^ XOR) * TIMES
        np.minimum(least, hashed.min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32).tobytes()


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """Size, key and sketch of each row's set; an empty set has no key."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, offsets = string_column(batch, "text")
            sizes, first, second, sketches = [], [], [], []
            for items in shingle_sets(data, offsets, shingle):
                sizes.append(len(items))
                if len(items):
                    one = np.sum(mix(items ^ U64(0x5851F42D4C957F2D)), dtype=U64) + U64(len(items))
                    two = np.bitwise_xor.reduce(mix(items + U64(0x14057B7EF767814F)))
                    first.append(int(one.astype(np.int64)))
                    second.append(int(two.astype(np.int64)))
                    sketches.append(sketch(items))
                else:
                    for column in (first, second, sketches):
                        column.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "key1", "key2", "sketch"],
            )

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return mapped(source, run, SETS)


def children(nodes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of the coordinates that each row's node chooses."""
    chance = mix(nodes + U64(0x2127599BF4325C37))
    one = (chance % U64(COORDINATES)).astype(np.int64)
    two = ((chance >> U64(16)) % U64(COORDINATES - 1)).astype(np.int64)
    two += two >= one
    rows = np.arange(len(nodes))
    branch = np.flatnonzero((chance >> U64(40)) % U64(4) == 0)
    rows, coordinate = np.concatenate([rows, branch]), np.concatenate([one, two[branch]])
    value = values[rows, coordinate].astype(U64)
    return rows, mix(nodes[rows] * U64(0x9E3779B97F4A7C15) + mix((coordinate.astype(U64) << U64(32)) | value))


def values_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("sketch"))
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint32)
    return flat.reshape(len(batch), COORDINATES)


def branch(rows: DataFrame, at_root: bool) -> DataFrame:
    """The next nodes of each row; at the root, of every tree."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, TREES + 1, dtype=U64) * U64(0xE7037ED1A0B428DB))
        for batch in stream:
            if not len(batch):
                continue
            values, ids = values_of(batch), np.asarray(batch.column(batch.schema.get_field_index("id")))
            if at_root:
                starts = [np.full(len(batch), root, U64) for root in roots]
                sizes = np.full(len(batch), np.iinfo(np.int64).max)
            else:
                starts = [np.asarray(batch.column(batch.schema.get_field_index("node"))).view(U64)]
                sizes = np.asarray(batch.column(batch.schema.get_field_index("size")))
            for nodes in starts:
                chosen, child = children(nodes, values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(child)), pa.array(ids[chosen]), pa.array(sizes[chosen])], names=["node", "id", "above"]
                )

    return mapped(rows, run, "node long, id long, above long")


def leaves(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, id, size) of the nodes to compare: small ones, ones that stay together, and those at the last depth."""
    found = None
    frontier = branch(sets.select("id", "sketch"), True)
    for depth in range(1, DEPTH + 1):
        frontier = scratch.written(frontier, "frontier")
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = scratch.written(frontier.join(sizes, "node"), "nodes")
        leaf = (F.col("size") <= SMALL) | (F.col("size") > TOGETHER * F.col("above")) | F.lit(depth == DEPTH)
        done = sized.where(leaf).select("node", "id", "size")
        found = done if found is None else found.unionByName(done)
        if depth < DEPTH:
            large = sized.where(~leaf).select("node", "id", "size")
            if large.isEmpty():
                break
            frontier = branch(large.join(sets.select("id", "sketch"), "id"), False)
    return found


def _grouped(stream: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a sorted stream, each whole."""
    pending = None
    for batch in stream:
        rows = pa.Table.from_batches([batch]) if pending is None else pa.concat_tables([pending, pa.Table.from_batches([batch])])
        if not len(rows):
            continue
        codes = [np.asarray(rows.column(k)) for k in keys]
        new = np.zeros(len(rows), bool)
        for code in codes:
            new[1:] |= code[1:] != code[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield rows.slice(a, b - a)
        pending = rows.slice(cuts[-1]).combine_chunks()
    if pending is not None and len(pending):
        yield pending


def dealt(rows: DataFrame, every_block: bool) -> DataFrame:
    """Members of nodes with the pair of blocks (low, high) that they are compared in.

    Blocks are compared within and with the first one, or each with each.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1) if every_block else F.array_distinct(F.array(F.lit(0), mine))
    others = F.when((mine == 0) & (blocks > 1), F.sequence(F.lit(0), blocks - 1)).otherwise(others)
    return (
        rows.withColumn("mine", mine)
        .withColumn("other", F.explode(others))
        .withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
        .drop("other", "size")
    )


KEYS = ["node", "low", "high"]


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def _similar(values: np.ndarray, blocks: np.ndarray, across: bool, i: int) -> np.ndarray:
    """Whether each member before ``i`` has a sketch like that of ``i``, and is to be compared with it here."""
    near = np.count_nonzero(values[:i] == values[i], axis=1) >= AGREE
    return near & (blocks[:i] != blocks[i]) if across else near


def smallest_partners(rows: DataFrame) -> DataFrame:
    """Pairs (a, b): each set with the smallest of a similar sketch in each node (node, id, size, sketch)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(stream, KEYS):
            ids, block = (np.asarray(group.column(c)) for c in ("id", "mine"))
            order = np.argsort(ids)
            ids, block = ids[order], block[order]
            values = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)[order]
            across = group.column("low")[0] != group.column("high")[0]
            found = []
            for i in range(1, len(ids)):
                near = _similar(values, block, across, i)
                if near.any():
                    found.append((i, int(np.argmax(near))))
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return mapped(_together(dealt(rows, False)), run, "a long, b long").distinct()


OPEN = "node long, low int, high int, mine int, id long, class long"


def open_members(rows: DataFrame) -> DataFrame:
    """Members of nodes that have a similar sketch of another class there, where that pair is due.

    ``rows`` have node, id, size, sketch, class and ``leaves``, all nodes of the set. A pair is due
    in the first of the nodes that its sets share, so trees do not repeat each other's work.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(stream, KEYS):
            ids, classes, block = (np.asarray(group.column(c)) for c in ("id", "class", "mine"))
            if len(ids) < 2 or classes.min() == classes.max():
                continue
            values = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            across = group.column("low")[0] != group.column("high")[0]
            node = group.column("node")[0].as_py()
            before = [[x for x in leaves if x < node] for leaves in group.column("leaves").to_pylist()]
            width = max(map(len, before))
            # Fillers differ from row to row, so that they never agree.
            earlier = np.array([x + [~k] * (width - len(x)) for k, x in enumerate(before)], np.int64).reshape(len(ids), width)
            real = np.arange(width) < np.array([len(x) for x in before])[:, None]
            wanted = np.zeros(len(ids), bool)
            for i in range(1, len(ids)):
                due = np.flatnonzero(_similar(values, block, across, i) & (classes[:i] != classes[i]))
                for leaf in earlier[i][real[i]]:
                    due = due[~((earlier[due] == leaf) & real[due]).any(axis=1)]
                if len(due):
                    wanted[due] = wanted[i] = True
            kept = group.filter(pa.array(wanted)).combine_chunks()
            for batch in kept.select([x.split(" ")[0] for x in OPEN.split(", ")]).to_batches():
                yield batch

    return mapped(_together(dealt(rows, True)), run, OPEN)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common. Elements of one set only are left out first."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], place[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if len(place):
        _, place = np.unique(place, return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for start in range(0, int(place[-1]) + 1, 2048):
            a, b = np.searchsorted(place, [start, start + 2048])
            held = np.zeros((len(sets), 2048), np.float32)
            held[owner[a:b], place[a:b] - start] = 1
            common += held @ held.T
    return common


def links_between_classes(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join classes in nodes, judged on the full sets ``items``; no more than join them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(stream, KEYS):
            ids, classes, block = (np.asarray(group.column(c)) for c in ("id", "class", "mine"))
            if len(ids) < 2:
                continue
            sets = [x.values.to_numpy(zero_copy_only=False) for x in group.column("items")]
            size = np.array([len(x) for x in sets], np.float64)
            common = intersections(sets).astype(np.float64)
            linked = 100 * common >= SIMILARITY * (size[:, None] + size[None, :] - common)
            linked &= classes[:, None] != classes[None, :]
            if group.column("low")[0] != group.column("high")[0]:
                linked &= block[:, None] != block[None, :]
            root = {int(c): int(c) for c in np.unique(classes)}
            found = []
            for i in np.flatnonzero(linked.any(axis=1)):
                others = np.flatnonzero(linked[i, :i])
                _, first = np.unique(classes[others], return_index=True)
                for j in others[first]:
                    x, y = root[int(classes[i])], root[int(classes[j])]
                    if x != y:
                        root = {c: min(x, y) if r in (x, y) else r for c, r in root.items()}
                        found.append((int(ids[i]), int(ids[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=["a", "b"])

    return mapped(_together(rows), run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, items) of the wanted sets, made anew from the texts of the documents that name them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            data, offsets = string_column(batch, "text")
            sets = list(shingle_sets(data, offsets, shingle))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("size"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["id", "size", "items"],
            )

    source = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    texts = source.join(wanted.select("id", F.col("n_shingles").alias("size")), "id")
    sets = mapped(texts, run, "id long, size long, items array<long>")
    # Where several texts bear the id, the one with the set's size is meant, and any such will do but one.
    return sets.where(F.size("items") == F.col("size")).groupBy("id").agg(F.first("items").alias("items"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("b_items"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    union = F.size("a_items") + F.size("b_items") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= SIMILARITY * union).select("a", "b")


def near_documents(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.written(described(docs, shingle), "sets")
    named = rows.where("key1 is not null and doc_id is not null").groupBy("key1", "key2").agg(
        F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
    )
    named = scratch.written(named, "distinct-sets")
    nodes = leaves(named, scratch)

    nodes = scratch.written(nodes, "leaves")
    sketches = named.select("id", "sketch")
    first = scratch.written(smallest_partners(nodes.join(sketches, "id")), "candidates")
    wanted = first.select(F.col("a").alias("id")).union(first.select("b")).distinct()
    links = scratch.written(confirmed(first, _sets_of(docs, named, wanted, shingle, scratch)), "links")
    classes = scratch.written(components(links, scratch), "classes")

    labelled = nodes.join(classes.withColumnRenamed("node", "id"), "id", "left").select(
        "node", "id", "size", F.coalesce("component", "id").alias("class")
    )
    labelled = scratch.written(labelled, "labelled")
    open_nodes = labelled.groupBy("node").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    lists = nodes.groupBy("id").agg(F.collect_list("node").alias("leaves"))
    still = labelled.join(open_nodes.select("node"), "node").join(sketches, "id").join(lists, "id")
    members = scratch.written(open_members(still), "open-members")
    sets = _sets_of(docs, named, members.select("id").distinct(), shingle, scratch)
    more = scratch.written(links_between_classes(members.join(sets, "id")), "links")
    if not more.isEmpty():
        classes = components(links.union(more), scratch)

    label = named.select("key1", "key2", "id").join(classes.withColumnRenamed("node", "id"), "id", "left")
    label = label.select("key1", "key2", F.coalesce("component", "id").alias("component_id"))
    linked = rows.where("key1 is not null").join(label, ["key1", "key2"], "left")
    alone = rows.where("key1 is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    both = linked.select(*columns).union(alone.select(*columns))
    judged = both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    # A narrow table; what it was made from is larger than the texts and goes at once.
    result = written(judged, "near-documents")
    scratch.remove()
    return result


def _sets_of(docs: DataFrame, named: DataFrame, wanted: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    wanted = scratch.written(named.select("id", "n_shingles").join(wanted, "id", "left_semi"), "wanted")
    return scratch.written(full_sets(docs, wanted, shingle), "full-sets")
