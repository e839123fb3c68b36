"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Both halves of the vectors are quantised separately, so two short codebooks make a fine grid of cells, which
grows with the number of vectors. A query walks the pairs of centroids by their summed inner product, best
first, with a heap, until the cells passed hold its share of all vectors; the sum of the last pair is its
limit, and the vectors of all cells above it are reranked exactly in double precision. The share is what a
bounded sample needs for the recall aimed at. Rows of the grid are put together to blocks of bounded size,
and queries to chunks; a block goes to those chunks alone that ask for one of its rows, and in it a query
meets only the rows that it asks for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, if_small, needs

#: Centroids of each half: a quarter of the square root of the number of vectors, within these bounds, so that
#: a cell holds some 16 vectors and a walk costs little beside the reranking.
LEAST_CENTROIDS, MOST_CENTROIDS = 16, 512
#: Vectors that the codebooks and the share are fit on, and those of them that serve as queries.
SAMPLE, TRIALS = 12_000, 300
#: Recall aimed at on the sample, and what is added to the share for safety.
AIM, MARGIN = 0.93, 1.05
#: Vectors in a block, and numbers in it; queries in a chunk, and those that are reranked at a time.
BLOCK_ROWS, BLOCK_NUMBERS, CHUNK_ROWS, AT_ONCE = 16_384, 8 << 20, 4096, 256
NEAREST = 20


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor zero and has only finite components."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Up to k centroids of the rows of x by Lloyd's rounds."""
    own = np.unique(x, axis=0)
    c = own[rng.choice(len(own), min(k, len(own)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of centroids by falling first[i] + second[j], until their cells hold enough vectors."""
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[rows].tolist(), second[columns].tolist()
    heap, passed = [(-(a[0] + b[0]), 0, 0)], 0
    while heap and passed < enough:
        _, i, j = heapq.heappop(heap)
        yield (cell := (int(rows[i]), int(columns[j])))
        passed += counts[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def centroids(total: int) -> int:
    """Centroids of each half for so many vectors."""
    return int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 2 ** round(np.log2(max(1, total) ** 0.5 / 4)))))


def fit(sample: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """Both codebooks, and the share of the vectors that a query has to see for AIM recall on the sample."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    left, right = sample[:, :half], sample[:, half:]
    one, two = codebook(left, k, rng), codebook(right, k, rng)
    a, b = nearest(left, one), nearest(right, two)
    trials = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    scores = sample[trials] @ sample.T
    scores[np.arange(len(trials)), trials] = -np.inf
    top = np.argsort(-scores, axis=1, kind="stable")[:, : min(NEAREST, len(sample) - 1)]
    if not top.size:
        return one, two, 1.0
    cell = a * len(two) + b
    seen = []
    for q in range(len(trials)):
        sums = (left[trials[q]] @ one.T)[:, None] + (right[trials[q]] @ two.T)[None, :]
        order = np.argsort(-sums.ravel(), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        held = np.cumsum(np.bincount(cell, minlength=len(order))[order])
        seen.append(held[place[cell[top[q]]]] / len(sample))
    return one, two, min(1.0, float(np.quantile(np.concatenate(seen), AIM)) * MARGIN)


def laid_out(one: np.ndarray, sizes: np.ndarray, most: int) -> list[list[int]]:
    """The blocks of each row of the grid: small rows with near first centroids share one, large ones have
    several, so that a block holds about `most` vectors at the most."""
    middle = one - one.mean(axis=0)
    order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable") if len(one) > 1 else [0]
    blocks: list[list[int]] = [[] for _ in one]
    block, held = 0, 0
    for i in order:
        n = int(sizes[i])
        if held and held + n > most:
            block, held = block + 1, 0
        parts = max(1, -(-n // most))
        blocks[i] = [*range(block, block + parts)]
        block, held = block + parts - 1, n if parts == 1 else most
    return blocks


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def rerank(q: np.ndarray, ids: np.ndarray, limit: np.ndarray, a: np.ndarray, b: np.ndarray, v: np.ndarray, vec_ids: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best of a block for each query, of the cells that it asks for.

    a and b are the queries' products with both codebooks; the vectors come in order of i, the first cell number.
    Matrix products find all that come within rounding of the k best; their scores are then each summed alone,
    so equal vectors have equal scores and the smaller vec_id goes first.
    """
    best = np.full((len(q), k), -np.inf)
    slack = 1e-9 * np.abs(q).sum(axis=1) * max(1.0, float(np.abs(v).max(initial=0)))
    most, met = b.max(axis=1), []
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, int)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
        own = a[:, i[s]]
        ask = np.flatnonzero(own + most >= limit)
        if not len(ask):
            continue
        scores = q[ask] @ v[s:e].T
        scores[(own[ask, None] + b[ask][:, j[s:e]] < limit[ask, None]) | (vec_ids[None, s:e] == ids[ask, None])] = -np.inf
        top = np.partition(scores, e - s - k, axis=1)[:, -k:] if e - s > k else scores
        best[ask] = np.partition(np.concatenate([best[ask], top], axis=1), top.shape[1], axis=1)[:, -k:]
        r, c = np.nonzero((scores >= (best[ask, :].min(axis=1) - slack[ask])[:, None]) & (scores > -np.inf))
        met.append((ask[r], c + s, scores[r, c]))
    if not met:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    r, c, near = (np.concatenate(x) for x in zip(*met))
    last = near >= best.min(axis=1)[r] - slack[r]
    r, c = r[last], c[last]
    exact = np.concatenate([(v[c[x : x + 65536]] * q[r[x : x + 65536]]).sum(axis=1) for x in range(0, max(1, len(r)), 65536)])
    order = np.lexsort((vec_ids[c], -exact, r))
    r, c, exact = r[order], c[order], exact[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k], exact[place < k]


def search(embeddings: DataFrame, every: int = 20, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose vec_id is divisible by `every`.

    embeddings has (vec_id, embedding); rows with a null id, and vectors that are null, zero or not wholly
    finite take no part. Only vectors of one length have an inner product, so each length has an index of its
    own. A query's own id is no candidate. Rows that repeat a vec_id are candidates each; queries that repeat
    id and vector are one, those with the same id and other vectors are ranked apart. Fewer candidates than k
    give as many ranks; an empty table no rows.
    """
    spark = embeddings.sparkSession
    rows = usable(needs(embeddings, "vec_id", "embedding").where("vec_id is not null")).select(F.col("vec_id").cast("long"), "embedding")
    size = F.size("embedding")
    asked = F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long"))
    found = [
        _nearest_of_length(rows.where(size == r["n"]), r["n"], r["total"], r["asked"], every, k)
        for r in rows.groupBy(size.alias("n")).agg(F.count("*").alias("total"), asked.alias("asked")).orderBy("n").collect()
        if r["asked"]
    ]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for part in found:
        out = out.unionByName(part)
    return found[0] if len(found) == 1 else out


def _nearest_of_length(rows: DataFrame, length: int, total: int, asked: int, every: int, k: int) -> DataFrame:
    """The search among rows (vec_id, embedding), so many in total and so many queries, all of one length."""
    drawn = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) / float(1 << 30)
    table = rows.where(drawn < min(1.0, 1.5 * SAMPLE / total)).orderBy(drawn, "vec_id").limit(SAMPLE).toArrow()
    if table.num_rows < 2:
        table = rows.limit(SAMPLE).toArrow()
    sample = _matrix(table["embedding"].combine_chunks())
    one, two, share = fit(sample, centroids(total))
    half = length // 2

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["embedding"])
            at = [pa.array(x.astype(np.int32)) for x in (nearest(v[:, :half], one), nearest(v[:, half:], two))]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], *at], names=["vec_id", "embedding", "i", "j"])

    kind = dict(rows.dtypes)["embedding"]
    indexed = rows.mapInArrow(cells, f"vec_id long, embedding {kind}, i int, j int")
    counts = np.zeros((len(one), len(two)), np.int64)
    for r in indexed.groupBy("i", "j").count().collect():  # MOST_CENTROIDS squared rows at most
        counts[r["i"], r["j"]] = r["count"]
    blocks = laid_out(one, counts.sum(axis=1), max(256, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, length))))
    filled = np.flatnonzero(counts.sum(axis=1))

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "embedding"])
    asking = np.zeros(len(one) * len(two), np.int64)
    for r in queries.mapInArrow(cells, f"vec_id long, embedding {kind}, i int, j int").groupBy("i", "j").count().collect():
        asking[r["i"] * len(two) + r["j"]] = r["count"]
    before = np.cumsum(asking) - asking  # queries in the cells before each: neighbours in this order share a chunk

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["embedding"])
            a, b = v[:, :half] @ one.T, v[:, half:] @ two.T
            cell = nearest(v[:, :half], one) * len(two) + nearest(v[:, half:], two)
            place = before[cell] + batch["vec_id"].to_numpy() // every % np.maximum(asking[cell], 1)
            at, into, limits = [], [], []
            for q in range(len(v)):
                *_, (i, j) = walk(a[q], b[q], counts, share * total)
                limit = a[q, i] + b[q, j]
                limit -= 1e-12 * (1 + abs(limit))
                own = {x for i in filled[a[q, filled] + b[q].max() >= limit] for x in blocks[i]}
                at += [q] * len(own)
                into += own
                limits += [limit] * len(own)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["vec_id"].take(take), batch["embedding"].take(take), pa.array(into, pa.int32()), pa.array(limits, pa.float64()), pa.array((place // at_once).astype(np.int32)).take(take)], names=["vec_id", "embedding", "block", "limit", "chunk"])

    at_once = CHUNK_ROWS
    dealt = queries.repartition(max(1, min(20_000, asked // 64)), "vec_id")
    asks = cut(dealt.mapInArrow(probed, f"vec_id long, embedding {kind}, block int, limit double, chunk int"))
    wanted = cut(asks.select(F.col("block").alias("block"), F.col("chunk").alias("chunk")).distinct())
    of = F.element_at(F.lit(blocks), F.col("i") + 1)
    placed = indexed.withColumn("block", F.element_at(of, (F.pmod(F.xxhash64("vec_id", "embedding"), F.size(of)) + 1).cast("int")))

    def found(vectors: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and asking.num_rows:
            vectors = vectors.sort_by([("i", "ascending"), ("j", "ascending")])
            v, ids = _matrix(vectors["embedding"].combine_chunks()), vectors["vec_id"].to_numpy()
            i, j = vectors["i"].to_numpy(), vectors["j"].to_numpy()
            q, own, limit, mark = _matrix(asking["embedding"].combine_chunks()), asking["vec_id"].to_numpy(), asking["limit"].to_numpy(), asking["_q"].to_numpy()
            for s in range(0, len(q), AT_ONCE):
                x = q[s : s + AT_ONCE]
                r, c, score = rerank(x, own[s : s + AT_ONCE], limit[s : s + AT_ONCE], x[:, :half] @ one.T, x[:, half:] @ two.T, v, ids, i, j, k)
                out.append((own[s + r], mark[s + r], ids[c], score))
        columns = [np.concatenate(x) for x in zip(*out)] or [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table(dict(zip(("query_id", "_q", "vec_id", "score"), columns)))

    keys = ["block", "chunk"]
    sent = placed.join(if_small(wanted), "block")
    asks = asks.withColumn("_q", F.xxhash64("embedding"))
    near = sent.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(found, "query_id long, _q long, vec_id long, score double")
    best = Window.partitionBy("query_id", "_q").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
