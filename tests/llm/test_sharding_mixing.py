import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import mixing, sharding


def check_shards(docs, shards=16):
    rows = docs.select("doc_id", "text").collect()
    got = sharding.shard(docs, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_shards_are_balanced_and_groups_stay_together(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = check_shards(docs)
    for key in ("size", "words"):
        load = np.bincount([r.shard for r in got], weights=[r[key] for r in got], minlength=16)
        assert load.max() / load.mean() < 1.05 and load.min() / load.mean() > 0.95
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_of_a_third_of_all_is_dealt_out(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 30)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    load = np.bincount([r.shard for r in check_shards(docs)], weights=[r["size"] for r in check_shards(docs)], minlength=16)
    assert load.max() / load.mean() < 1.1
    again = [sorted(map(tuple, sharding.shard(docs.repartition(n)).collect())) for n in (2, 9)]
    assert again[0] == again[1]


def test_shards_of_odd_rows(odd, none):
    check_shards(odd)
    assert sharding.shard(none).collect() == []


def check_mix(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    got = mixing.taken(docs.select("doc_id", "source", "text")).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    by_id = {r.doc_id: r.source for r in rows}
    sums = Counter()
    for r in got:
        s = by_id[r.doc_id]
        if list(by_id).count(r.doc_id) == 1:
            assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r["size"]
        sums[s] += r.taken
    return goal, sums, got


def test_mixture_meets_its_targets(documents):
    goal, sums, got = check_mix(documents)
    for s in goal:
        assert sums[s] == pytest.approx(goal[s], rel=0.01)
    again = mixing.taken(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_has_a_row_for_each_draw(documents):
    drawn = mixing.mix(documents)
    assert drawn.columns[: len(documents.columns)] == documents.columns
    counts = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    for r in mixing.taken(documents).collect():
        assert counts.get(r.doc_id, 0) * r["size"] == r.taken


def test_splits_add_up():
    rng = np.random.default_rng(1)
    quotas = np.array([5, 0, 117, 64, 1])
    parts = mixing.split_quotas(quotas, 7, rng)
    assert (parts.sum(axis=0) == quotas).all() and np.ptp(parts.sum(axis=1)) <= 1


def test_targets_share_out_what_a_cap_leaves():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([0, 10], [3, 1]) == pytest.approx([0, 15])
    assert mixing.targets([], []) == []


def test_mixture_of_odd_rows(odd, none):
    check_mix(odd)
    assert mixing.mix(odd).where("text is null or trim(text) = ''").count() == 0
    assert mixing.taken(none).collect() == [] and mixing.mix(none).collect() == []


def test_one_row_repeated_is_spread_over_the_shards(spark):
    same = spark.range(6000).selectExpr("cast(5 as long) as doc_id", "'one and the same row' as text")
    other = spark.createDataFrame([(i, f"another row {i}") for i in range(100, 160)], same.schema)
    rows = sharding.shard(same.unionByName(other).repartition(4), 16).collect()
    assert len(rows) == 6060
    loads, slots = {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(loads) == 16 and max(loads.values()) < 1.1 * sum(loads.values()) / 16
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_shards_of_the_mixture_are_shuffled_locally(spark, documents):
    """Each partition holds runs of shards in the order of their places, and no row is lost."""
    mixed = mixing.mix(documents).cache()
    got = mixing.shuffled(mixed, mixed.count()).select(F.spark_partition_id().alias("p"), "mix_shard", "mix_place", "doc_id").collect()
    assert len(got) == mixed.count()
    last = {}
    for r in got:
        assert last.get((r.p, r.mix_shard), r.mix_place) <= r.mix_place
        last[r.p, r.mix_shard] = r.mix_place
    places = {(r.doc_id, d.turn): (d.shard, d.place) for r in mixing.plan(documents).collect() for d in r.draws}
    assert {(r.doc_id, r.mix_turn): (r.mix_shard, r.mix_place) for r in mixed.collect()} == places
    mixed.unpersist()


def test_many_sources_have_fewer_blocks(spark):
    """The driver's recipe stays bounded, and every source comes near its target or is all that it can give."""
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3000}") for i in range(30_000)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = got.groupBy("source").agg(F.sum(F.col("size") * F.size("draws")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 3000 and all(abs(r.taken - r.target) <= 10 for r in got), max(abs(r.taken - r.target) for r in got)
