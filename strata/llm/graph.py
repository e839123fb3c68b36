"""Connected components over a table of edges, by joins and aggregates alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut

#: Edges that a task adds to its forest at a time.
AT_ONCE = 200_000
#: Edges that one task takes whole.
SMALL = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the smallest node reachable.

    Each task first hangs the nodes of its own edges on the least of those that these reach; a table that Spark has
    put into one partition, as it does with small ones, is solved by that, and so are at most SMALL edges in several,
    which one task then takes. Others alternate large-star and small-star
    steps: each hangs neighbours on the least node known, so the edges stay at most as many as given and the rounds
    grow with the logarithm of the longest chain. Every step is a partially aggregated minimum and an equi-join, which
    AQE splits where one node has very many neighbours. Nulls and self-loops are dropped; an empty table gives no rows.
    """
    given = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = cut(given.mapInArrow(_hung, given.schema))
    seen = None
    while now.rdd.getNumPartitions() > 1 and (state := _state(now)) != seen and state[0]:
        seen = state
        if state[0] <= SMALL:
            now = cut(now.coalesce(1).mapInArrow(_hung, given.schema))
            break
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v"))
    ).groupBy("node").agg(F.min("component").alias("component"))


def find(parent: np.ndarray) -> np.ndarray:
    """The root of each."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent, with the sets of each a and b united under their least member."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = find(parent)


def _forest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Each node of the edges in batches, but the least of what it reaches there, with that."""
    ends = pa.concat_arrays([b.column(c) for c in (0, 1) for b in batches])
    nodes = pc.unique(ends)
    nodes = nodes.take(pc.sort_indices(nodes))
    u, v = np.split(pc.index_in(ends, value_set=nodes).to_numpy(), 2)
    least = join(np.arange(len(nodes)), u, v)
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(least[moved]))], batches[0].schema.names)


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as a forest of stars, which span the same sets."""
    forest: list[pa.RecordBatch] = []
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rest.append(batch)
        if sum(b.num_rows for b in rest) > AT_ONCE:
            forest, rest = [_forest(forest + rest)], []
    if rest:
        forest = [_forest(forest + rest)]
    yield from forest


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least node that the node can see."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of these."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("n")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("n", "m")).distinct()
