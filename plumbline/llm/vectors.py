"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length 1, so a cosine of at least ``c`` is a squared distance of at
most 2 - 2c. A random rotation spreads the distance over the coordinates, which are cut
into blocks. In at least one block the squared distance is within the block's share of
the budget (pigeonhole), so the union over the blocks of all pairs within their share
holds every pair sought. Each block is a range join: a grid over its first coordinates
sends a vector as probe to its own cell, and as target to those cells up to it in order
that its ball touches. Candidates are verified by the cosine of the vectors as given, in
double precision.

A pair counts in the first block that has it within its share, and in the one cell where
it meets, so neither pairs nor candidates leave a task: a task returns for each vector
how much it is linked to and one vector of its local component. Equal vectors are folded
into one before, with their number as weight. A cell that holds more than ``CHUNK``
probes or targets is cut into chunks, each pair of which is a group of its own; a group
is of bounded size, and nothing is left out. In few hundred dimensions without structure
a grid separates little, and the pairs tested then grow with the square of the different
vectors; they are tested in low dimensions, by matrix products.

Defined results: vectors that are null, empty, of length zero, or hold null or
non-finite components link with nothing; vectors of different dimensions do not link.
Repeated rows count once. Different vectors of one id are a row each and one node of the
graph. A null id links with nothing; its component is null and it is kept. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, written
from plumbline.llm.components import components

COSINE = 0.95
BLOCK_DIMS, GRID_DIMS = 16, 2
CHUNK, TILE = 16_384, 2_048
SLACK = 1e-6
ROWS = "dims int, block int, cell long, probe boolean, home boolean, id long, weight long, embedding array<float>"


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


def blocks(dims: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dims), max(1, round(dims / BLOCK_DIMS)))


def shares(dims: int, cosine: float) -> list[float]:
    """The squared distance that each block may have."""
    return [(2 - 2 * cosine) * len(b) / dims + SLACK for b in blocks(dims)]


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def cells(rotated: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, whether it is its own cell) of each vector and each touched cell up to its own."""
    width = 2 * radius
    grid = rotated[:, : min(GRID_DIMS, rotated.shape[1])]
    home = np.floor(grid / width).astype(np.int64)
    low, high = np.floor((grid - radius) / width).astype(np.int64), np.floor((grid + radius) / width).astype(np.int64)
    code = lambda c: np.sum((c + 512) * (1024 ** np.arange(c.shape[1])), axis=1)
    own = code(home)
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * grid.shape[1], indexing="ij"), -1).reshape(-1, grid.shape[1])
    for step in steps:
        at = home + step
        touched = np.all((at >= low) & (at <= high), axis=1)
        number = code(at)
        rows = np.flatnonzero(touched & (number <= own))
        yield rows, number[rows], number[rows] == own[rows]


def dealt(distinct: DataFrame, cosine: float, with_vectors: bool) -> DataFrame:
    """One row for each vector, block and cell that it is sent to."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sizes = np.asarray(batch.column("dims"))
            for dims in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                rotated = (unit(matrix(part.column("embedding"))) @ rotation(int(dims))).astype(np.float32)
                for number, (block, share) in enumerate(zip(blocks(dims), shares(dims, cosine), strict=True)):
                    for rows, cell, home in cells(rotated[:, block].astype(np.float64), share**0.5):
                        for probe in (True, False):
                            kept = np.flatnonzero(home) if probe else np.arange(len(rows))
                            chosen = part.take(pa.array(rows[kept]))
                            size = len(kept)
                            vectors = chosen.column("embedding") if with_vectors else pa.nulls(size, pa.list_(pa.float32()))
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(np.full(size, dims, np.int32)), pa.array(np.full(size, number, np.int32)),
                                    pa.array(cell[kept]), pa.array(np.full(size, probe)), pa.array(home[kept]),
                                    chosen.column("id"), chosen.column("weight"), vectors,
                                ],
                                names=[x.split(" ")[0] for x in ROWS.split(", ")],
                            )

    return mapped(distinct, run, ROWS)


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches over the links a-b."""
    root = np.arange(size)
    while True:
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def links_of_group(group: pa.Table, cosine: float) -> pa.Table:
    """For each vector of a group with links there: the weight linked to, and a vector of its local component."""
    none = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    group = group.combine_chunks()
    is_probe = np.asarray(group.column("probe").combine_chunks())
    sides = [np.flatnonzero(is_probe), np.flatnonzero(~is_probe)]
    if not len(sides[0]) or not len(sides[1]):
        return none
    dims, number = group.column("dims")[0].as_py(), group.column("block")[0].as_py()
    flat = group.column("embedding").combine_chunks()
    vectors = unit(matrix(flat))
    rotated = (vectors @ rotation(dims)).astype(np.float32)
    cut, share = blocks(dims), shares(dims, cosine)
    ids, weights = np.asarray(group.column("id").combine_chunks()), np.asarray(group.column("weight").combine_chunks())
    home = np.asarray(group.column("home").combine_chunks())
    low = np.ascontiguousarray(rotated[:, cut[number]])
    square = np.einsum("ij,ij->i", low, low)
    links, a_all, b_all = np.zeros(len(ids), np.int64), [], []
    for i in range(0, len(sides[0]), TILE):
        p = sides[0][i : i + TILE]
        for j in range(0, len(sides[1]), TILE):
            q = sides[1][j : j + TILE]
            near = low[p] @ low[q].T
            near *= -2
            near += square[p][:, None]
            near += square[q][None, :]
            r, c = np.nonzero(near <= share[number] + 1e-4)
            r, c = p[r], q[c]
            fresh = ~home[c] | (ids[r] < ids[c])
            r, c = r[fresh], c[fresh]
            for k in range(0, len(r), 65_536):
                a, b = r[k : k + 65_536], c[k : k + 65_536]
                apart = (rotated[a].astype(np.float64) - rotated[b]) ** 2
                within = np.stack([apart[:, x].sum(axis=1) <= s for x, s in zip(cut[: number + 1], share, strict=False)])
                first = within[number] & ~within[:number].any(axis=0)
                a, b = a[first], b[first]
                good = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine
                a, b = a[good], b[good]
                np.add.at(links, a, weights[b])
                np.add.at(links, b, weights[a])
                a_all.append(a)
                b_all.append(b)
    if not a_all or not sum(map(len, a_all)):
        return none
    # A vector can stand in the group as probe and as target; both are one node.
    ordered, node = np.unique(ids, return_inverse=True)
    root = local_roots(len(ordered), node[np.concatenate(a_all)], node[np.concatenate(b_all)])
    total = np.bincount(node, weights=links, minlength=len(ordered)).astype(np.int64)
    linked = np.flatnonzero(total)
    return pa.table({"id": ordered[linked], "links": total[linked], "root": ordered[root[linked]]})


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each different row of ``embeddings``."""
    rows = embeddings.select(
        embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<float>").alias("embedding")
    )
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & (norm > 0), F.lit(False))
    rows = rows.distinct().withColumn("valid", valid)
    first, second = F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")
    rows = written(rows.withColumns({"key1": first, "key2": second}), "vectors")
    usable = rows.where("valid")
    distinct = usable.groupBy("key1", "key2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")
    )
    distinct = written(distinct.withColumn("dims", F.size("embedding")), "distinct-vectors")

    counts = dealt(distinct.select("id", "weight", "embedding", "dims"), cosine, False).groupBy("dims", "block", "cell").agg(
        F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("targets")
    )
    chunks = lambda c: F.greatest(F.ceil(F.col(c) / CHUNK), F.lit(1)).cast("int")
    counts = counts.where("probes > 0").select(
        "dims", "block", "cell", chunks("probes").alias("probe_chunks"), chunks("targets").alias("target_chunks")
    )
    counts = written(counts, "cells")
    sent = dealt(distinct.select("id", "weight", "embedding", "dims"), cosine, True).join(counts, ["dims", "block", "cell"])
    mine = F.when(F.col("probe"), F.pmod(F.xxhash64("id"), "probe_chunks")).otherwise(F.pmod(F.xxhash64("id"), "target_chunks"))
    others = F.when(F.col("probe"), F.col("target_chunks")).otherwise(F.col("probe_chunks"))
    sent = sent.select("*", mine.cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    pair = [F.when(F.col("probe"), F.col(x)).otherwise(F.col(y)) for x, y in (("mine", "other"), ("other", "mine"))]
    sent = sent.select(
        "dims", "block", "cell", pair[0].alias("s"), pair[1].alias("t"), "probe", "home", "id", "weight", "embedding"
    )
    local = sent.groupBy("dims", "block", "cell", "s", "t").applyInArrow(
        lambda group: links_of_group(group, cosine), "id long, links long, root long"
    )
    local = written(local, "vector-links")
    links = local.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(local.select(F.col("id").alias("a"), F.col("root").alias("b")))

    folded = distinct.select("key1", "key2", "id", "weight", "dims").join(links, "id", "left")
    folded = folded.join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "key1", "key2", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")
    )
    keys = ["key1", "key2"]
    joined = rows.where("valid").join(folded, keys).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
