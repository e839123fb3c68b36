"""Quality classifier: supervised subword embeddings.

Words, their character n-grams and pairs of neighbouring words are hashed into buckets, each with a learned
vector. A document is the mean of its features' vectors; a softmax over a linear layer gives the
probability of each label. Vectors and layer are trained together by stochastic gradient descent in numpy
on a bounded sample of labelled rows. As the mean and the layer are both linear, scoring folds them into one
number a bucket. The features of many texts are hashed side by side, in a few numpy operations that cost the
same whether words are new or common; the numbers are whole multiples of a fixed unit, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ease, fresh, needs
from strata.llm.langid import remainder

BUCKETS, DIM, GRAMS = 1 << 16, 8, (2, 3, 4)
#: Bits of a bucket, the factors of the hashes, and the unit of the folded numbers.
SHIFT, FACTOR, STEP, UNIT = np.uint64(64 - 16), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 2.0**-32
#: Bound of the sample that is learnt: about so many rows of each label, each with its whole text.
LABEL_ROWS = 1200
EPOCHS, RATE = 8, 0.5
THRESHOLD = 0.7
#: Characters that are hashed at a time, and words of a longer text, whose runs each begin with the last word of
#: the one before, so that no pair is lost.
AT_ONCE, RUN_WORDS = 400_000, 50_000


def runs(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """The words of texts, by groups of bounded size: which text each run is of, its words between spaces, and
    how many characters at its front were in the run before."""
    of, held, again, size = [], [], [], 0
    for k, text in enumerate(texts):
        words = text.split()
        for i in range(0, len(words), RUN_WORDS):
            own = words[max(0, i - 1) : i + RUN_WORDS]
            of.append(k)
            held.append(f" {' '.join(own)} ")
            again.append(len(own[0]) + 1 if i else 0)
            size += len(held[-1])
            if size > AT_ONCE:
                yield of, held, again
                of, held, again, size = [], [], [], 0
    if of:
        yield of, held, again


def buckets(held: list[str], again: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, run of each) of the words, pairs of neighbouring words and character n-grams of runs of words.

    A gram may begin and end with the space beside its word. Pairs are hashed by the difference of their words,
    so that all repeats share one bucket. What begins in the first characters of a run, so many as again says,
    was given with the run before; only the pair of its words wasn't.
    """
    code = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
    run = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for t in held])
    space = code == 32
    new = np.ones(len(code), bool)
    for begin, n in zip(np.cumsum([0, *map(len, held)]).tolist(), again):
        new[begin : begin + n] = False
    mixed = (code.astype(np.uint64) + np.uint64(1)) * FACTOR
    mixed ^= mixed >> np.uint64(29)
    gram = mixed
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * STEP + mixed[n - 1 :]
        if n == 2:
            crossed = space[:-1] & space[1:]  # from one run into the next
        else:
            crossed = space[1:-1] if n == 3 else crossed[:-1] | space[n - 2 : -1]
        if n in GRAMS:
            fits = ~crossed & new[: 1 - n]
            yield ((gram * FACTOR) >> SHIFT)[fits].astype(np.int64), run[: 1 - n][fits]
    first = np.flatnonzero(~space[1:] & space[:-1]) + 1
    size = np.flatnonzero(space[1:] & ~space[:-1]) + 1 - first
    letters = np.flatnonzero(~space)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), STEP))
    word = np.add.reduceat(mixed[letters] * power[place], np.cumsum(size) - size)
    word ^= word >> np.uint64(31)
    own, fits = run[first], new[first]
    yield ((word * FACTOR) >> SHIFT)[fits].astype(np.int64), own[fits]
    near = own[1:] == own[:-1]
    yield (((word[1:] ^ word[:-1]) * STEP) >> SHIFT)[near].astype(np.int64), own[1:][near]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and each one's share of its features; empty for a text without words."""
    n = np.zeros(BUCKETS, np.int64)
    for _, held, again in runs([text]):
        for at, _ in buckets(held, again):
            n += np.bincount(at, minlength=BUCKETS)
    bucket = np.flatnonzero(n)
    return bucket.astype(np.int32), (n[bucket] / max(1, n.sum())).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float, seed: int = 5) -> dict:
    """The folded model of features: for each bucket, and alone, what it adds to the log-odds of label 1.

    prior is label 1's share of all labelled rows, which the sample may not have.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer = np.zeros((2, DIM))
    steps, done = EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            bucket, share = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[bucket]
            z = layer @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            move = p @ layer
            layer -= rate * np.outer(p, mean)
            vectors[bucket] -= rate * 20 * share[:, None] * move
    ones = float(np.mean(labels)) if len(labels) else 0.5
    odds = lambda x: float(np.log(max(x, 1e-3) / max(1 - x, 1e-3)))
    return {"weights": vectors @ (layer[1] - layer[0]), "offset": odds(prior) - odds(ones)}


def learn(documents: DataFrame, labels: DataFrame, parts: int = 4, out: int = 2) -> dict:
    """A model from labels (doc_id, quality) outside the held-out part, and the texts of documents.

    Null labels and ids aren't learnt from, nor are ids labelled both ways; of an id's several texts the one
    with the least hash is learnt. The features of whole texts are taken in Spark tasks, and the sampled rows'
    alone come to the driver. With one label alone its share decides; with none the model is even.
    """
    marked = (
        needs(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id"), parts) != out)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    )
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if not counts:
        return {"weights": np.zeros(BUCKETS), "offset": 0.0}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("quality") == label, F.lit(LABEL_ROWS / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = marked.where(drawn < share).select("doc_id", "quality")  # about LABEL_ROWS of each label
    texts = needs(documents, "doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ease()
            found = [features(t) for t in batch["text"].to_pylist()]
            taken = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*found), (np.uint16, np.float32))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], *(taken or [pa.array([], pa.binary())] * 2)], names=["doc_id", "quality", "bucket", "share"])

    kinds = dict(texts.dtypes)
    sample = texts.mapInArrow(featured, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, bucket binary, share binary").collect()
    sample.sort(key=lambda r: r["doc_id"])
    rows = [(np.frombuffer(r["bucket"], np.uint16).astype(np.int32), np.frombuffer(r["share"], np.float32)) for r in sample]
    return train(rows, [int(r["quality"]) for r in sample], counts.get(1, 0) / sum(counts.values()))


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 for each text; without words that of the labels' shares."""
    weights = np.round(model["weights"] / UNIT).astype(np.int64)
    total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for of, held, again in runs([t or "" for t in texts]):
        sums, sizes = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        for at, run in buckets(held, again):  # runs come in order, so each has one stretch
            n = np.bincount(run, minlength=len(held))
            sizes += n
            some = np.flatnonzero(n)
            if len(some):
                sums[some] += np.add.reduceat(weights[at], (np.cumsum(n) - n)[some])
        np.add.at(total, of, sums)
        np.add.at(count, of, sizes)
    mean = total * UNIT / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(mean + model["offset"], -50, 50)))


def scored(text: Column, model: Broadcast) -> Column:
    """The probability (double) of label 1 for each text, by a broadcast model; of a null text as of an empty."""

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        ease()
        return pd.Series(scores(model.value, [*texts]), dtype=float)

    return probability(text)


def qualities(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents (doc_id, text); labels (doc_id, quality).

    held_out rows, whose crc32(doc_id) mod 4 is 2, are never learnt from; a score sees the text alone. Null and
    empty texts score by label 1's share of the labels. predicted is 1 from a score of 0.7 on. Equal texts
    get equal scores. An empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))  # one number a bucket
    rows = needs(documents, "doc_id", "text").withColumn("score", scored(F.col("text"), model))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """documents, with all their columns, that score least or more."""
    model = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))
    p = fresh(documents, "_quality")
    return documents.withColumn(p, scored(F.col("text"), model)).where(F.col(p) >= least).drop(p)
