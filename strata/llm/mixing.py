"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of its documents, and the blocks are drawn in a permuted order until
the source's target is met, at most once in each of two passes. How many of each source's draws an output
shard gets is settled exactly by a binary tree over the shards: a node's block quotas are split between its
two halves by one multivariate-hypergeometric draw, so every shard is a fair sample and the quotas add up.
Shards then take disjoint runs of the permuted draws and shuffle their rows locally.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, fresh, needs, text_of, word_count

#: Blocks over all sources (in parts of their sizes), and the fewest in a source and in all together; with many
#: sources each has fewer.
BLOCKS, LEAST_BLOCKS, ALL_LEAST = 8192, 256, 400_000
#: Sources are named in the mixture's recipe, which is held by the driver; so many at most.
MOST_SOURCES = 100_000
#: Rows of a shard that are shuffled together, about.
RUN_ROWS = 100_000
WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Each source's part of share times all sizes, by weight; none above most times its own size.

    What a capped source leaves is dealt among the others by weight, until none is above.
    """
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in above or open_:
            out[i] = most * sizes[i] if above else left * weights[i] / weight
        open_ -= above or open_
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): the quotas of draws, dealt exactly; shards differ in draws by one at most."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    n, total = 0, int(quotas.sum())
    n = round(total * left / shards)
    drawn = rng.multivariate_hypergeometric(quotas, n, method="marginals")
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def draw_blocks(blocks: dict[int, int], target: float, rng: np.random.Generator) -> list[tuple[int, int]]:
    """(block, pass) in drawing order: whole permuted passes, then blocks that still fit the target.

    blocks: words by block. What is left at the end is less than the least block not drawn, or half of it
    if going over comes nearer.
    """
    out, need = [], target
    for turn in (1, 2):
        order = [b for b in rng.permutation(sorted(blocks)).tolist() if blocks[b]]
        rest = []
        for b in order:
            if blocks[b] <= need + 1e-9:
                out.append((b, turn))
                need -= blocks[b]
            else:
                rest.append(b)
        if rest:
            least = min(rest, key=lambda b: (blocks[b], b))
            if blocks[least] - need < need:
                out.append((least, turn))
            break
    return out


def _sized(documents: DataFrame) -> DataFrame:
    return needs(documents, "doc_id", "source", "text").select(
        "doc_id", "source", word_count(text_of()).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32")
    )


def _block(seed: int, doc_id: Column, crc: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id, crc), blocks).cast("int")


def _place(seed: int, doc_id: Column, crc: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, crc, turn)


def _recipe(rows: DataFrame, shards: int, seed: int, weights: tuple, share: float) -> tuple[DataFrame, DataFrame]:
    """The sources (_source, _at, source_size, target, _blocks) and the drawn blocks (_at, _block, draws).

    Both are bounded, see BLOCKS and MOST_SOURCES, and come with a broadcast hint.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; give the mixture's recipe for fewer, broader ones")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.size) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share)
    total = max(1, sum(sizes))
    least = max(4, min(LEAST_BLOCKS, ALL_LEAST // max(1, len(found))))
    recipe = [(r.source, i, sizes[i], float(goal[i]), least + BLOCKS * sizes[i] // total) for i, r in enumerate(found)]
    known = F.broadcast(spark.createDataFrame(recipe, "_source string, _at int, source_size long, target double, _blocks int"))
    held: list[dict[int, int]] = [{} for _ in found]  # BLOCKS + ALL_LEAST entries at most
    dealt_rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source")))
    block = _block(seed, F.col("doc_id"), F.col("text_crc32"), F.col("_blocks")).alias("_block")
    for r in dealt_rows.groupBy("_at", block).agg(F.sum("size").alias("size")).collect():
        held[r._at][r._block] = int(r.size)

    rng = np.random.default_rng(seed)
    drawn = [draw_blocks(b, goal[i], rng) for i, b in enumerate(held)]
    dealt: dict[tuple[int, int], list] = {}
    if found:
        quotas = split_quotas(np.array([len(d) for d in drawn]), shards, rng)
        for i, d in enumerate(drawn):
            to = np.repeat(np.arange(shards), quotas[:, i])
            for (b, turn), s in zip(d, to.tolist()):
                dealt.setdefault((i, b), []).append((turn, s))
    table = spark.createDataFrame([(i, b, d) for (i, b), d in dealt.items()], "_at int, _block int, draws array<struct<turn:int,shard:int>>")
    return known, F.broadcast(table)


def plan(documents: DataFrame, shards: int = 16, seed: int = 7, weights: tuple = WEIGHTS, share: float = 1.5) -> DataFrame:
    """(doc_id, text_crc32, source, size, source_size, target, draws) for every row of documents.

    size is the number of words. draws lists what the mix takes of the document: an array of
    (turn, shard, place), empty if it is left out; a shard's rows are shuffled by their place. Sources stand in the order of their code points, null last, and
    have the weights in turn. A source without words, and a document without any, has no draws.
    Rows with equal doc_id and text fall in one block, so they are drawn alike. The same rows and seed give
    the same draws, however they are partitioned. An empty table gives no rows.
    """
    rows = cut(_sized(documents))
    known, table = _recipe(rows, shards, seed, weights, share)
    none = F.array().cast("array<struct<turn:int,shard:int,place:bigint>>")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_block", _block(seed, F.col("doc_id"), F.col("text_crc32"), F.col("_blocks")))
    placed_draw = lambda d: F.struct(d.turn.alias("turn"), d.shard.alias("shard"), _place(seed, F.col("doc_id"), F.col("text_crc32"), d.turn).alias("place"))
    return placed.join(table, ["_at", "_block"], "left").select(
        "doc_id", "text_crc32", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.coalesce(F.transform("draws", placed_draw), none)).otherwise(none).alias("draws"),
    )


def mix(documents: DataFrame, shards: int = 16, seed: int = 7, weights: tuple = WEIGHTS, share: float = 1.5) -> DataFrame:
    """All columns of documents and (mix_shard, mix_turn, mix_place), a row for each draw: see plan.

    mix_place orders the rows of a shard at random: a hash of the draw, so ties are only between equal rows.
    Texts aren't shuffled, as the drawn blocks are a small table. Columns of these names are replaced.
    """
    known, table = _recipe(cut(_sized(documents)), shards, seed, weights, share)
    row = fresh(documents, "_row")
    kept = [c for c in documents.columns if c.lower() not in ("mix_shard", "mix_turn", "mix_place")]
    rows = documents.where(word_count(text_of()) > 0).select(F.struct(*kept).alias(row))
    id_, crc = F.col(f"{row}.doc_id"), F.crc32(F.coalesce(F.col(f"{row}.text"), F.lit("")).cast("binary"))
    placed = rows.join(known, F.col(f"{row}.source").eqNullSafe(F.col("_source"))).withColumn("_block", _block(seed, id_, crc, F.col("_blocks")))
    draws = placed.join(table, ["_at", "_block"]).withColumn("_draw", F.explode("draws"))
    return draws.select(
        f"{row}.*", F.col("_draw.shard").alias("mix_shard"), F.col("_draw.turn").alias("mix_turn"),
        _place(seed, id_, crc, F.col("_draw.turn")).alias("mix_place"),
    )


def shuffled(mixed: DataFrame, rows: int, shards: int = 16) -> DataFrame:
    """mixed (of mix, about so many rows) with each output shard's rows shuffled locally, by mix_place.

    A shard is dealt at random to runs of bounded size, so that a partition holds a run of one shard in random
    order; rows that repeat are dealt apart by a salt.
    """
    runs = max(1, -(-rows // (shards * RUN_ROWS)))
    run = F.pmod(F.xxhash64("mix_place", F.monotonically_increasing_id() % 64), F.lit(runs))
    return mixed.withColumn("_run", run).repartition(shards * runs, "mix_shard", "_run").sortWithinPartitions("mix_shard", "_run", "mix_place").drop("_run")


def taken(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, draws) for every row of documents: taken counts repeats."""
    return plan(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws"
    )
