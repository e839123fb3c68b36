import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strata.llm import common, graph, jaccard, simhash


def plain(edges):
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    return {x: root(x) for x in top}


def edges_of(rng, n):
    return [(int(a), int(b)) for a, b in rng.integers(0, n, (n // 2, 2)) if a != b] + [(n + i, n + i + 1) for i in range(300)]


def test_a_table_in_one_partition_takes_no_rounds(spark, monkeypatch):
    """A long chain and a random graph, whose edges a task adds to its forest a few at a time."""
    def fail(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(graph, "_large_star", fail)
    monkeypatch.setattr(graph, "AT_ONCE", 50)
    edges = edges_of(np.random.default_rng(1), 2000)
    got = graph.connected_components(spark.createDataFrame(edges, "u long, v long").coalesce(1))
    assert {r.node: r.component for r in got.collect()} == plain(edges)


def test_many_partitions_and_binary_nodes(spark):
    edges = [(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in edges_of(np.random.default_rng(2), 2000)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = graph.connected_components(spark.createDataFrame(edges + [(edges[0][0], None)], "u binary, v binary"))
        assert {bytes(r.node): bytes(r.component) for r in got.collect()} == plain(edges)
    finally:
        spark.conf.unset(name)


def test_copies_are_dropped_without_fingerprints(spark, monkeypatch):
    """What the near-copy stage finds comes from the tree alone, so no SimHash is worked out beside it."""
    def fail(*_):
        raise AssertionError("fingerprints")

    monkeypatch.setattr(simhash, "near_classes", fail)
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["more"])), (3, " ".join(words[::-1]))]
    kept = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_members_of_large_nodes_tell_their_parts(spark):
    """They are found where they lie, by no join of all members by token."""
    class Of:
        def __init__(self, value):
            self.value = value

    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"%016d" % i for i in range(3)], pa.binary()), pa.array([5] * 3, pa.int64()), pa.array([[1, 7], [7], [9]], pa.list_(pa.int64())), pa.array([bytes(260)] * 3, pa.binary())],
        ["digest", "n", "tokens", "point"],
    )
    every = Of(np.full(4, -1, np.int64))
    (out,) = jaccard._members(every, Of((np.array([7]), np.array([25]))), 10)(iter([batch]))
    assert out.to_pydict()["parts"] == [0, 3, 3, 0] and max(out.to_pydict()["part"]) < 3


def test_a_small_table_in_many_partitions_takes_no_rounds(spark, monkeypatch):
    """As where Spark doesn't put small partitions together; a larger one takes rounds, with the same result."""
    edges = edges_of(np.random.default_rng(3), 2000)
    name, rounds = "spark.sql.adaptive.coalescePartitions.enabled", []
    large_star = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda e: rounds.append(1) or large_star(e))
    spark.conf.set(name, "false")
    try:
        for small in (200_000, 0):
            monkeypatch.setattr(graph, "SMALL", small)
            assert not rounds
            got = graph.connected_components(spark.createDataFrame(edges, "u long, v long"))
            assert {r.node: r.component for r in got.collect()} == plain(edges)
        assert rounds
    finally:
        spark.conf.unset(name)


def test_files_of_shuffles_go_with_the_step(spark):
    """What a step has shuffled isn't kept on the executors' disks, and its rows can be read after that."""
    def files():
        return set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))

    before = files()
    rows = common.cut(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("c")))
    assert not {f for f in files() - before if "shuffle_" in f}
    assert rows.count() == 1000 and rows.agg(F.sum("c")).first()[0] == 100_000
