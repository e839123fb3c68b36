"""Sharding by vector bin packing: bytes, words and rows of all shards balanced jointly.

Groups of equal texts are what is placed. A group is put where the dot product of its size vector with the
residual capacities is highest, large groups first. Groups that hold a notable share of any resource are
placed one by one; the many small ones are first bundled by their digest, whole groups at a time, so what the
driver places has a fixed bound at any input size. A group beyond one shard's capacity is placed in pieces,
as no placement of it whole could keep the shards' bytes near equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, if_small, needs, text_of, word_count

#: Bundles of small groups; with 16 shards each takes 512 of them, so a bundle is 0.2% of a shard.
BUNDLES = 8192
#: A group is placed on its own if it has over one part in so many of a shard's bytes, words or rows.
NOTABLE = 64
#: Pieces into which a group beyond a shard's capacity goes, for each shard that it would fill.
PIECES = 32
#: Rows that are numbered by one task at a time, and the most such runs in a shard.
RUN_ROWS, MOST_RUNS = 50_000, 4096


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each size vector (rows of sizes): largest first, to the greatest dot product with the
    residual capacity, each resource in parts of its total; of shards as good, the first."""
    total = np.maximum(sizes.sum(axis=0), 1e-12)
    share = sizes / total * shards
    left = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), int)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = int(np.argmax(np.round(left @ share[i], 12)))
        left[out[i]] -= share[i]
    return out


def shard(documents: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, words) for every row of documents.

    size: UTF-8 bytes of the text plus 1. A null text has none, so size 1, and the CRC and group of the empty
    text. Rows of equal texts share a shard, unless their group exceeds a shard's capacity in any
    resource: then its rows are dealt to pieces by doc_id, and rows that repeat id and text so often that one
    piece couldn't hold them (see _salted) are dealt singly. slot numbers the rows of a shard from 0 without gaps;
    apart from such repeats in an order that depends on nothing but the rows. Rows that are equal in doc_id
    and text get slots of their own. Law: sizes near equal (`bytes`); grown_shard is null, as this law doesn't
    fix it.
    An empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = cut(
        needs(documents, "doc_id", "text").select("doc_id", text_of().alias("text")).select(
            "doc_id",
            (F.octet_length("text").cast("long") + 1).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            word_count(F.col("text")).cast("long").alias("words"),
            F.md5(F.col("text").cast("binary")).alias("digest"),
            F.monotonically_increasing_id().alias("_n"),
        )
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows"))
    groups = cut(groups.withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("int")))
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "words", "rows"))).first()
    rows = _salted(rows, groups, total["rows"], shards)
    notable = None
    for c in ("bytes", "words", "rows"):  # at most shards * NOTABLE groups for each resource
        test = F.col(c) > F.lit(total[c] / (shards * NOTABLE))
        notable = test if notable is None else notable | test
    large = groups.where(notable).orderBy("digest").collect()
    small = groups.where(~notable).groupBy("bundle").agg(*(F.sum(c).alias(c) for c in ("bytes", "words", "rows"))).orderBy("bundle").collect()

    of: dict[str, int] = {}
    for g in large:
        load = max((g[c] / total[c] * shards for c in ("bytes", "words", "rows") if total[c]), default=0)
        of[g.digest] = 1 if load <= 1 else min(int(g.rows), int(np.ceil(load * PIECES)))
    counts = F.broadcast(spark.createDataFrame(sorted(of.items()), "_own string, _of int"))
    dealt = rows.join(counts, F.col("digest") == F.col("_own"), "left").withColumn(
        "_p", F.when(F.col("_of") > 1, F.pmod(F.xxhash64("doc_id", "digest", "_salt"), F.col("_of"))).otherwise(0).cast("int")
    )
    units = [(None, g.bundle, g.bytes, g.words, g.rows) for g in small]
    units += [(g.digest, 0, g.bytes, g.words, g.rows) for g in large if of[g.digest] == 1]
    if any(n > 1 for n in of.values()):  # at most 3 * shards * PIECES pieces, each weighed by the rows it got
        size = {g.digest: (g.bytes / g.rows, g.words / g.rows, 1) for g in large}
        for r in dealt.where("_of > 1").groupBy("digest", "_p").count().orderBy("digest", "_p").collect():
            units.append((r.digest, r._p, *(x * r["count"] for x in size[r.digest])))
    to = pack(np.array([u[2:] for u in units], float).reshape(-1, 3), shards) if units else []
    bundles = np.zeros(BUNDLES, int)
    where = []
    for (digest, n, *_), s in zip(units, to):
        if digest is None:
            bundles[n] = s
        else:
            where.append((digest, n, int(s)))
    # both tables have a fixed bound: see BUNDLES, NOTABLE and PIECES
    alone = F.broadcast(spark.createDataFrame(where, "_digest string, _piece int, _shard int"))
    placed = (
        dealt.join(alone, (F.col("_own") == F.col("_digest")) & (F.col("_p") == F.col("_piece")), "left")
        .withColumn("shard", F.coalesce("_shard", F.element_at(F.lit([int(x) for x in bundles]), F.pmod(F.xxhash64("digest"), F.lit(BUNDLES)).cast("int") + 1)))
        .select("doc_id", "size", "text_crc32", "words", "_salt", F.lit("bytes").alias("law"), "shard")
    )
    return numbered(placed, total["rows"], shards).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "words"
    )


def _salted(rows: DataFrame, groups: DataFrame, total: int, shards: int) -> DataFrame:
    """rows (doc_id, digest, _n) with _salt: 0, or the row's own number where so many rows repeat its id and
    text that they would overfill a piece of a shard or a task."""
    most = min(RUN_ROWS, total // (4 * shards * PIECES) + 1)
    large = cut(groups.where(F.col("rows") > most).select("digest"))
    repeats = rows.join(if_small(large), "digest", "left_semi").groupBy("doc_id", "digest").count().where(F.col("count") > most)
    repeats = cut(repeats.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_same")))
    found = rows.join(if_small(repeats), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_same")), "left")
    return found.withColumn("_salt", F.when(F.col("_same").isNull(), F.lit(0)).otherwise(F.col("_n"))).drop("_id", "_same", "_n")


def numbered(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """placed with slot: from 0 without gaps in each shard, each run of a shard's rows numbered by its own task."""
    spark = placed.sparkSession
    runs = max(1, min(MOST_RUNS, -(-rows // (shards * RUN_ROWS))))
    dealt = cut(placed.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_crc32", "_salt"), F.lit(runs)).cast("int")))
    counts = dealt.groupBy("shard", "_run").count().orderBy("shard", "_run").collect()  # shards * runs rows at most
    begins, last, begin = [], None, 0
    for r in counts:
        begin = begin if r.shard == last else 0
        begins.append((r.shard, r._run, begin))
        last, begin = r.shard, begin + r["count"]
    order = Window.partitionBy("shard", "_run").orderBy("doc_id", "text_crc32", "size")
    starts = F.broadcast(spark.createDataFrame(begins, "shard int, _run int, _begin long"))
    return (
        dealt.withColumn("_at", F.row_number().over(order) - 1)
        .join(starts, ["shard", "_run"])
        .withColumn("slot", (F.col("_begin") + F.col("_at")).cast("long"))
    )
