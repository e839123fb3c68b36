"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

The upper nodes of the index are masked bit patterns: with at most h differing bits and h + 2 segments of
the 64, some two segments agree wholly, so every pair within h meets in a node that shares one such pattern.
A node with many fingerprints is split the same way on its remaining bits, so nodes stay bounded however
many fingerprints share a pattern. Within a node the fingerprints are sorted by Gray rank, where neighbours
share long patterns; runs of them are put under inner nodes that hold the bits their members agree on, each
bit once on every path. A search adds up the differences on its way down and drops a whole group as soon as
they exceed h. What leaves a node is a spanning set of links, at most one for each fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import jaccard
from strata.llm.common import cut, ease, fresh, if_small, needs, text_of
from strata.llm.graph import connected_components, find, join

#: Fingerprints in an index node before it is split on further bits.
NODE_LIMIT = 4096
#: A node with so few free bits isn't split, as it can hold 2 to that power at most.
LEAST_FREE_BITS = 16
#: Children of an inner node of the tree within a node.
FAN = 8

_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.int64)
_BYTE = np.arange(8) * 256


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle: A-Z lower-cased, words between ASCII white space, joined by
    one space; fewer than n words give one shingle of them all, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(w, 42) for w in words], np.uint64)
    if len(words) <= n:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - n + 1].tolist()
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Signed 64 bits: a bit is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    at = hashes.view(np.uint8).reshape(-1, 8) + _BYTE
    seen = np.bincount(at.ravel(), minlength=2048)
    votes = np.einsum("kb,bi->ki", seen.reshape(8, 256), _BITS)
    return int(np.packbits(votes.ravel() * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, n: int = 3) -> Column:
    """The SimHash (long) of a text's n-word shingles, repeats included; a null text counts as empty."""

    @F.pandas_udf("long")
    def of_shingles(texts: pd.Series) -> pd.Series:
        ease()
        return pd.Series([simhash(shingle_hashes(t or "", n)) for t in texts], dtype="int64")

    return of_shingles(text)


def gray_rank(fp: Column) -> Column:
    """The position of a bit pattern in the reflected Gray order, as a long of the same bits."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp


# ---------------------------------------------------------------- upper nodes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _children(mask: int, h: int) -> list[int]:
    """The masks below a mask: it and any two of the h + 2 segments of the bits it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [sum(1 << int(i) for i in part) for part in np.array_split(free, h + 2)]
    return [mask | a | b for a, b in combinations(parts, 2)]


def index_nodes(fps: DataFrame, h: int) -> DataFrame:
    """(mask, pattern, fp, rep): each of fps (fp, rep) in every index node that it belongs to.

    Any two within h bits share a node. Nodes above NODE_LIMIT go down a level; their number of free bits
    shrinks each time, so there are a few levels at most, and none where no node is that large.
    """
    spark = fps.sparkSession
    masks, done, level = [0], None, fps
    while True:
        pairs = [(_signed(m), _signed(c)) for m in masks for c in _children(m, h)]
        if done is None and level is fps:
            level = level.withColumn("child", F.explode(F.lit([c for _, c in pairs])))
        else:
            level = level.join(if_small(spark.createDataFrame(pairs, "mask long, child long"), len(pairs)), "mask")  # of the masks with large nodes
        level = level.select(F.col("child").alias("mask"), F.col("fp").bitwiseAND(F.col("child")).alias("pattern"), "fp", "rep")
        free = 64 - min((c % (1 << 64)).bit_count() for _, c in pairs)
        if free <= LEAST_FREE_BITS:
            return level if done is None else done.unionByName(level)
        large = cut(level.groupBy("mask", "pattern").count().where(F.col("count") > NODE_LIMIT).select("mask", "pattern"))
        if (n := large.count()) == 0:
            return level if done is None else done.unionByName(level)
        few = if_small(large, n)
        masks = sorted(r.mask % (1 << 64) for r in large.select("mask").distinct().collect())
        kept = level.join(few, ["mask", "pattern"], "left_anti")
        done = kept if done is None else done.unionByName(kept)
        level = level.join(few, ["mask", "pattern"], "left_semi")


# ---------------------------------------------------------------- the tree within nodes


def _tree(fps: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the roots down: masks, patterns and the first child (one more at the end) of each node.

    fps are in Gray order within groups; a root stands for a group. The lowest level is the fingerprints.
    """
    levels = []
    same, value, owner = np.full(len(fps), ~np.uint64(0)), fps, group
    while True:
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        last = bool((sizes == 1).all())
        place = np.arange(len(owner)) - np.repeat(starts, sizes)
        heads = np.arange(len(owner)) if last else np.flatnonzero(place % FAN == 0)
        levels.append((same, value, np.r_[heads, len(owner)]))
        if last:
            break
        ones, zeros = np.bitwise_and.reduceat(value & same, heads), np.bitwise_and.reduceat(~value & same, heads)
        same, value, owner = ones | zeros, ones, owner[heads]
    levels.reverse()
    out, above = [], None
    for k, (mask, value, _) in enumerate(levels):
        heads = levels[k + 1][2] if k + 1 < len(levels) else None
        own = mask if above is None else mask & ~above
        out.append((own, value, heads))
        if heads is not None:
            above = np.repeat(mask, np.diff(heads))
    return out


def within(fps: np.ndarray, group: np.ndarray, h: int, at_once: int = 1 << 18) -> np.ndarray:
    """For each fingerprint the least position that links of at most h bits within its group reach."""
    levels = _tree(fps, group)
    parent = np.arange(len(fps))
    root = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    step = max(256, at_once // 256)
    for begin in range(0, len(fps), step):
        stack = [(0, np.arange(begin, min(begin + step, len(fps))), root[begin : begin + step], None)]
        while stack:
            k, asks, nodes, acc = stack.pop()
            mask, value, heads = levels[k]
            far = np.bitwise_count((fps[asks] ^ value[nodes]) & mask[nodes])
            acc = far if acc is None else acc + far
            near = acc <= h
            asks, nodes, acc = asks[near], nodes[near], acc[near]
            if heads is None:
                later = nodes > asks
                parent = join(parent, asks[later], nodes[later])
                continue
            n = heads[nodes + 1] - heads[nodes]
            first = np.cumsum(n) - n
            below = np.repeat(heads[nodes] - first, n) + np.arange(n.sum())
            asks, acc = np.repeat(asks, n), np.repeat(acc, n)
            for i in range(0, len(asks), at_once):  # bounded memory where a node is dense
                stack.append((k + 1, asks[i : i + at_once], below[i : i + at_once], acc[i : i + at_once]))
    return find(parent)


def _links(h: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            mask, pattern, fp, rep = (rows[c].to_numpy() for c in ("mask", "pattern", "fp", "rep"))
            group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
            shared = np.bincount(group)[group] > 1
            group, fp, rep = group[shared], fp[shared], rep[shared]
            if len(fp):
                least = within(fp.view(np.uint64), group, h)
                linked = least != np.arange(len(least))
                yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[least[linked]])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            if sum(b.num_rows for b in rest) < 100_000:
                continue
            rows = pa.Table.from_batches(rest)
            mask, pattern = rows["mask"].to_numpy(), rows["pattern"].to_numpy()
            last = np.flatnonzero((mask != mask[-1]) | (pattern != pattern[-1]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield from solved(rows.slice(0, end))
            rest = rows.slice(end).to_batches()
        if rest:
            yield from solved(pa.Table.from_batches(rest))

    return of


def near_links(fps: DataFrame, h: int = 2) -> DataFrame:
    """Links (u, v) between the reps of fps (fp, rep), distinct fingerprints with a non-null rep each.

    They span the same sets as all links of at most h bits, without listing the pairs within a dense group.
    """
    nodes = index_nodes(fps, h).withColumn("gray", gray_rank(F.col("fp")))
    dealt = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "gray")
    return dealt.mapInArrow(_links(h), "u long, v long").distinct()


def near_classes(docs: DataFrame, h: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for docs (doc_id, fp): one row for each row given.

    Documents link at h or fewer differing bits; component_id is the smallest doc_id reachable, itself
    included. Equal fingerprints link, whatever their texts; the fingerprint zero links like any other.
    A null doc_id is no node of the graph: such a row gets the class of its fingerprint, or null if no
    other row has that. Rows with the same doc_id are one document. Empty tables give no rows.
    """
    docs = cut(needs(docs, "doc_id", "fp"))
    fps = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    repeated = ids.where("a != b").select("doc_id")  # one document with several texts ties their classes
    own = docs.join(repeated, "doc_id", "left_semi").join(fps, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = near_links(fps.where("rep is not null"), h).unionByName(own)
    classes = connected_components(links)
    named = fps.join(classes, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return docs.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame, n: int = 3, h: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of documents (doc_id, text): see near_classes.

    fingerprint is 16 hexadecimal digits of the SimHash of the n-word shingles. Null and empty texts, and
    texts of white space alone, have the fingerprint zero. Texts of any length are hashed whole.
    """
    docs = needs(documents, "doc_id", "text").select("doc_id", fingerprint(F.col("text"), n).alias("fp"))
    return near_classes(docs, h).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- keeping one document of each group


def without_near_copies(documents: DataFrame, h: int = 3, n: int = 5, percent: int = 80) -> DataFrame:
    """documents, with all their columns, less copies: of each group of near copies one row stays.

    Two texts are linked if their n-word shingles resemble each other by percent hundredths or more, and a group is
    all that links reach. The tree of count vectors (strata.llm.jaccard) finds every group whole, of whatever size; no
    fingerprints are taken, as they could add nothing, and h is only accepted for callers that still give it. The row
    with the smallest doc_id of a group stays, of several with that id the one whose text has the least hash, and one of
    rows equal in both. Null texts count as empty; texts without words are one group.
    A null doc_id stays only if no other row of its group has an id. An empty table gives no rows.
    """
    key = F.xxhash64(text_of())
    known, classes = jaccard.linked(documents, percent, n)
    rows = known.join(if_small(classes).withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    same = rows.groupBy("component", "doc_id", "key").agg(F.count("*").alias("rows"))
    least = same.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "rows")).alias("m"))
    staying = cut(least.select(F.col("m.doc_id").alias("_stays"), F.col("m.key").alias("_key"), "m.rows"))
    mark = fresh(documents, "_key_of")
    out = documents.withColumn(mark, key).join(
        if_small(staying.select("_stays", "_key")), F.col("doc_id").eqNullSafe(F.col("_stays")) & (F.col(mark) == F.col("_key")), "left_semi"
    )
    if staying.where("rows > 1").limit(1).count():  # rows equal in id and text: one of them stays
        out = out.dropDuplicates(["doc_id", mark])
    return out.drop(mark)
