"""Near duplicates by the Jaccard resemblance of word shingles, found with an R-tree over count vectors.

A document's tokens are its distinct shingles, as 64-bit hashes. They are hashed into groups, and how many fall into
each is the document's point: two documents share at most the sum of the lesser counts of each group, so a box of
points bounds what any of its members can share with another's. The tree's upper nodes are tokens: documents that
resemble each other enough share one of the first tokens of each in any common order, so every link lies within some
node. Frequent tokens come last in that order, so that a passage that many documents share makes no large node.

Each node first hangs its members on one of them that shares the most; links found so join classes. What is left in
a node are pairs of different classes, which a tree of boxes over the points searches; large nodes are dealt to
pairs of blocks. Pairs that the bound lets pass are compared by their tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, ease, if_small, needs, remove_folder, shared_folder, small_batches, text_of
from strata.llm.graph import connected_components

#: Words of a shingle, and hundredths of resemblance from which documents are linked.
SHINGLE = 5
PERCENT = 80
#: Groups that tokens are hashed into.
GROUPS = 256
#: A token of more documents than this comes last in the order of tokens, which is by hash otherwise. Tokens are
#: counted whose hash is in this lowest share of all, so that most documents have enough of them that aren't frequent.
FREQUENT = 1
COUNTED = 0.3
#: Documents of a node above which it is dealt to parts, and of a part.
NODE = 256
PART = 1000
#: Tokens of the documents that one task compares with each other.
CLUSTER = 4_000_000
#: Members of a node that the others are compared with in a turn, and turns before all that is left is searched.
HEADS, TURNS = 4, 2
#: Most tokens of large nodes in a table that all workers get; the limit above doubles until it fits.
HANDED_OUT = 2_000_000
#: Bits of the filters that workers get: at least, for each value, and at most.
BITS, BITS_EACH, MOST_BITS = 1 << 20, 16, 1 << 30
#: Children of a node of boxes, and pairs of boxes that are opened at a time.
FAN = 16
OPENED = 2048
#: Bytes of texts whose words a task takes at a time.
AT_ONCE = 1 << 20

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: A random number for each byte of a word and its place, up to this place; A-Z count as a-z.
_PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 64, (_PLACES, 256), dtype=np.uint64)
_TABLE[:, 65:91] = _TABLE[:, 97:123]
_TABLE = _TABLE.ravel()
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie one after another, from offsets on, and the number of words of each.

    A word's hash is the sum of random numbers for its bytes at their places, mixed with its length.
    """
    begins = np.zeros(len(text) + 1, bool)
    begins[offsets] = True
    ink = ~_SPACE[text]
    start = np.flatnonzero(ink & (begins[:-1] | np.concatenate([[True], ~ink[:-1]])))
    end = np.flatnonzero(ink & (begins[1:] | np.concatenate([~ink[1:], [True]])))
    size = end - start + 1
    at = np.flatnonzero(ink)
    place = at - np.repeat(start, size)
    value = _TABLE[(np.minimum(place, _PLACES - 1) << 8) + text[at]]
    far = place >= _PLACES
    if far.any():
        value[far] = _mixed(value[far] + place[far].astype(np.uint64) * _FACTORS[0])
    total = np.add.reduceat(value, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
    return _mixed(total + size.astype(np.uint64) * _FACTORS[1]), np.diff(np.searchsorted(start, offsets))


def shingles(texts: list[bytes], n: int = SHINGLE, at_once: int = AT_ONCE) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes: A-Z lower-cased, words between ASCII white
    space; the whole sequence where it has fewer words, none where it has no word."""
    group, held = [], 0
    for text in texts:
        if len(text) > at_once:
            yield from _of_group(group, n)
            pieces, begin = [], 0
            while begin < len(text):  # a long text, in pieces that end with a word
                ahead = np.frombuffer(text, np.uint8)[begin + at_once :]
                space = int(np.argmax(_SPACE[ahead])) if len(ahead) and _SPACE[ahead].any() else len(ahead)
                stop = min(len(text), begin + at_once + space)
                pieces.append(_words(np.frombuffer(text[begin:stop], np.uint8), np.array([0, stop - begin]))[0])
                begin = stop
            each = np.concatenate(pieces)
            yield from _of_words(each, np.array([len(each)]), n)
            group, held = [], 0
            continue
        group.append(text)
        held += len(text)
        if held > at_once:
            yield from _of_group(group, n)
            group, held = [], 0
    yield from _of_group(group, n)


def _of_group(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    if texts:
        offsets = np.cumsum([0, *map(len, texts)])
        yield from _of_words(*_words(np.frombuffer(b"".join(texts), np.uint8), offsets), n)


def _of_words(each: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The shingles of texts of so many words each."""
    runs = _runs(each, n) if len(each) >= n else each[:0]
    end = 0
    for count in counts.tolist():
        begin, end = end, end + count
        if count == 0:
            yield np.zeros(0, np.uint64)
            continue
        own = np.sort(runs[begin : end - n + 1] if count >= n else _runs(each[begin:end], count))
        new = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        yield own[new]


def _runs(each: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many words."""
    total = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        total += each[i : len(each) - size + 1 + i] * (_FACTORS[i % 5] + np.uint64(2 * (i // 5)))
    return _mixed(total)


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _first(n: int, percent: int) -> int:
    """How many tokens of n, in any order, one must look at to meet every partner."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _points(tokens: np.ndarray) -> bytes:
    """A document's point: a byte for each group, and in four bytes what the counts have beyond 255 in all."""
    counts = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.uint32((counts - 255).clip(min=0).sum()).tobytes()


def _counts(column: pa.Array) -> np.ndarray:
    """Points as rows of numbers, one for each group and one for what is beyond; the sum of the lesser ones of two rows
    is at least what their documents share."""
    raw = _matrix(column, GROUPS + 4, "u1")
    return np.concatenate([raw[:, :GROUPS].astype(np.uint32), np.ascontiguousarray(raw[:, GROUPS:]).view("<u4")], axis=1)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """The values of a binary column, each of width bytes, as rows of numbers."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    flat = np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width] if len(column) else np.zeros(0, np.uint8)
    return flat.reshape(-1, width).view(kind)


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as a binary column."""
    offsets = np.arange(0, (len(rows) + 1) * 16, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _passes(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many shared tokens of sets of a and b are a resemblance of percent hundredths."""
    return (100 + percent) * shared.astype(np.int64) >= percent * (a + b)


# ---------------------------------------------------------------- reading texts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        yield batch, [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
        ease()


def _look(n: int, share: float):
    """(doc_id, text, key) -> (doc_id, n, digest, key, tokens): tokens has those of the lowest share of hashes, for the
    first of equal sets in a task."""
    limit = np.uint64(share * 2.0**64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, texts in _texts(batches):
            size, digests, first = [], [], []
            for tokens in shingles(texts, n):
                digest = _digest(tokens)
                size.append(len(tokens))
                digests.append(digest)
                first.append(tokens[: 0 if digest in seen else np.searchsorted(tokens, limit)].view(np.int64))
                seen.add(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), _binary(digests), batch.column("key"), _lists(first)],
                ["doc_id", "n", "digest", "key", "tokens"],
            )

    return look


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), pa.int64()))


def _look_again(percent: int, n: int, frequent, share: float):
    """(digest, n, tokens, point) with frequent tokens last in the order, for the first of equal sets in a task.

    Frequent ones are those of the lowest share of hashes, COUNTED, that are in the filter. What passes it by chance is
    only later in the order, which stays common to all documents. Where share isn't 0, the ones in the filter are all of
    the lowest share that a second document has, so others of it are left out.
    """
    limit, counted = np.uint64(share * 2.0**64), np.uint64(COUNTED * 2.0**64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in _texts(batches):
            digests, size, first, points = [], [], [], []
            for tokens in shingles(texts, n):
                digest = _digest(tokens)
                if digest in seen or not len(tokens):
                    continue
                seen.add(digest)
                late = np.zeros(len(tokens), bool)
                low = np.searchsorted(tokens, counted)
                late[:low] = _in_filter(tokens[:low].view(np.int64), frequent.value)
                digests.append(digest)
                size.append(len(tokens))
                order = np.concatenate([tokens[~late], tokens[late]])[: _first(len(tokens), percent)]
                alone = (~late).sum()
                first.append(order[(order >= limit) | (np.arange(len(order)) >= alone)].view(np.int64))
                points.append(_points(tokens))
            yield pa.RecordBatch.from_arrays([_binary(digests), pa.array(size, pa.int64()), _lists(first), _binary(points)], ["digest", "n", "tokens", "point"])

    return look


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.searchsorted(ordered, values).clip(max=len(ordered) - 1)] == values


def _bodies(n: int, wanted):
    """(digest, tokens) of the texts whose key is in the filter, for the first of equal sets in a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, texts in _texts(batches):
            digests, bodies = [], []
            for tokens in shingles([texts[i] for i in np.flatnonzero(_in_filter(batch.column("key").to_numpy(), wanted.value))], n):
                digest = _digest(tokens)
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    bodies.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([_binary(digests), _binary(bodies)], ["digest", "tokens"])

    return read


# ---------------------------------------------------------------- small tables for all workers


def _filter(values: DataFrame, bits: int | None = None) -> np.ndarray:
    """A filter with a bit for each value: all values pass it, and few others. Its bits grow with the values, as one
    of fixed size would let all pass once they are many; at MOST_BITS (128 MB) more pass, which costs time alone."""
    if bits is None:
        bits = max(BITS, min(MOST_BITS, 1 << (BITS_EACH * values.count()).bit_length()))
    at = F.pmod(F.col("value"), F.lit(bits))
    words = values.select((at / 64).cast("int").alias("w"), F.pmod(at, F.lit(64)).cast("int").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _in_filter(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = values % (64 * len(bits))
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _above(counted: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens counted more than least times, in order, their counts, and least, which doubles until they are few enough."""
    sizes = {r.p: r.c for r in counted.where(F.col("c") > least).groupBy(F.floor(F.log2(F.col("c") / least)).alias("p")).agg(F.count("*").alias("c")).collect()}
    while sum(sizes.values()) > HANDED_OUT:
        del sizes[min(sizes)]
        least *= 2
    rows = counted.where(F.col("c") > least).orderBy("token").toArrow()
    return rows["token"].to_numpy().astype(np.int64), rows["c"].to_numpy().astype(np.int64), least


def _counted(looked: DataFrame, least: int) -> DataFrame:
    return looked.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= least)


# ---------------------------------------------------------------- nodes


def _signed(kept):
    """(token, w0, w1, w2, w3) for each token in the filter: the words of its document's digest."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            flat, row = column.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            stay = _in_filter(flat, kept.value)
            words = _matrix(batch.column("digest"), 16, "<u4").astype(np.int64)[row[stay]]
            yield pa.RecordBatch.from_arrays([pa.array(flat[stay]), *(pa.array(words[:, i]) for i in range(4))], ["token", "w0", "w1", "w2", "w3"])

    return signed


def _nodes(again: DataFrame, kept) -> DataFrame:
    """(value): a token of each set of two or more documents that some tokens have; the others of the set add nothing."""
    words = [f"w{i}" for i in range(4)]
    sets = again.mapInArrow(_signed(kept), "token long, w0 long, w1 long, w2 long, w3 long").groupBy("token").agg(F.count("*").alias("c"), *(F.sum(w).alias(w) for w in words))
    return sets.where("c > 1").groupBy("c", *words).agg(F.min("token").alias("value")).select("value")


_NODE = "token long, part int, parts int, share double, digest binary, n long, point binary"


def _members(kept, large, size: int):
    """A row for each token of a document that another may have: (token, part, parts, share, digest, n, point).

    share is the part of the document's tokens looked at that such are; large tokens' members are dealt to parts of about
    size, and parts is how many these are, 0 for others.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, counts = large.value
        for batch in batches:
            column = batch.column("tokens")
            sizes = np.diff(column.offsets.to_numpy())
            flat, row = column.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            stay = _in_filter(flat, kept.value)
            share = np.bincount(row[stay], minlength=len(sizes)) / np.maximum(sizes, 1)
            flat, row = flat[stay], row[stay]
            low = _matrix(batch.column("digest"), 16, "<u8")[:, 0]
            part, parts = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int32)
            at = np.searchsorted(tokens_of, flat).clip(max=max(0, len(tokens_of) - 1))
            if len(tokens_of):
                hot = tokens_of[at] == flat
                parts[hot] = -(-counts[at[hot]] // size)
                part[hot] = (low[row[hot]] % parts[hot].astype(np.uint64)).astype(np.int32)
            for s in range(0, len(flat), 8192):
                r = pa.array(row[s : s + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[s : s + 8192]), pa.array(part[s : s + 8192]), pa.array(parts[s : s + 8192]), pa.array(share[row[s : s + 8192]]), *(batch.column(c).take(r) for c in ("digest", "n", "point"))],
                    ["token", "part", "parts", "share", "digest", "n", "point"],
                )

    return members


def _stars(percent: int, heads: int):
    """(a, b) for each member b of a node that may be linked with one of its first members, a, of another class; rows
    come sorted by node."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first rows of the node that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.stack([batch.column("token").to_numpy(), batch.column("part").to_numpy().astype(np.int64)], axis=1)
            rows = [node, *(_matrix(batch.column(c), 16, "<u8") for c in ("digest", "label")), batch.column("n").to_numpy(), _counts(batch.column("point"))]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            node, digest, label, n, point = rows
            start = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]).any(axis=1)]))
            size = np.diff(np.append(start, len(node)))
            a, b = [], []
            for h in range(heads):
                full = size > max(h, 1)
                member = np.repeat(full, size).nonzero()[0]
                head = np.repeat(start[full] + h, size[full])
                may = (label[member] != label[head]).any(axis=1)
                member, head = member[may], head[may]
                may = _passes(np.minimum(point[member], point[head]).sum(axis=1), n[member], n[head], percent)
                a.append(digest[head[may]])
                b.append(digest[member[may]])
            pair = np.unique(np.concatenate([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([_bytes_of(pair[:, :2]), _bytes_of(pair[:, 2:])], ["a", "b"])
            last = start[-1]
            held = [x[last : last + heads].copy() for x in rows]
        ease()

    return stars


def _boxes(point: np.ndarray, n: np.ndarray, height: int, fan: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels of a tree, points first: greatest counts and least size of each fan neighbours of the level below."""
    levels = [(point, n)]
    for _ in range(height):
        hi, low = levels[-1]
        starts = np.arange(0, len(low), fan)
        levels.append((np.maximum.reduceat(hi, starts, axis=0), np.minimum.reduceat(low, starts)))
    return levels


def tree_join(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], percent: int, fan: int = FAN, opened: int = OPENED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of points of a and b, each (counts, sizes), whose bound on what they share suffices for a link.

    Both trees are walked together from their roots; a pair of boxes is opened only if its bound suffices.
    """
    if not len(a[1]) or not len(b[1]):
        return
    height, size = 0, max(len(a[1]), len(b[1]))
    while size > fan:
        height, size = height + 1, -(-size // fan)
    left, right = _boxes(*a, height, fan), _boxes(*b, height, fan)
    top = np.indices((len(left[-1][1]), len(right[-1][1]))).reshape(2, -1)
    todo = [(height, top[0], top[1])]
    while todo:
        level, i, j = todo.pop()
        if len(i) > opened:
            todo += [(level, i[s : s + opened], j[s : s + opened]) for s in range(0, len(i), opened)]
            continue
        (hi, low), (other, least) = left[level], right[level]
        may = _passes(np.minimum(hi[i], other[j]).sum(axis=1), low[i], least[j], percent)
        i, j = i[may], j[may]
        if level == 0:
            yield i, j
        elif len(i):
            of_i, of_j = np.divmod(np.arange(fan * fan), fan)
            i, j = (i[:, None] * fan + of_i).ravel(), (j[:, None] * fan + of_j).ravel()
            there = (i < len(left[level - 1][1])) & (j < len(right[level - 1][1]))
            todo.append((level - 1, i[there], j[there]))


def _between_classes(percent: int, fan: int, opened: int):
    """(a, b) for the members of a node in different classes that may be linked; rows come sorted by node.

    side 0 and 1: pairs have one of each; side 2: any two.
    """

    def search(node: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        digest, label, n, point, side = node
        order = np.lexsort((n, label[:, 0], label[:, 1]))
        digest, label, n, point, side = (x[order] for x in (digest, label, n, point, side))
        one, other = (side != 1).nonzero()[0], (side != 0).nonzero()[0]
        for i, j in tree_join((point[one], n[one]), (point[other], n[other]), percent, fan, opened):
            i, j = one[i], other[j]
            new = (label[i] != label[j]).any(axis=1) & ((side[i] != 2) | (i < j))
            if new.any():
                yield digest[i[new]], digest[j[new]]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def done(rows: list[np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
            """Pairs of the nodes that end before upto."""
            start = np.flatnonzero(np.concatenate([[True], (rows[0][1:upto] != rows[0][: upto - 1]).any(axis=1)])) if upto else np.zeros(0, int)
            sizes = np.diff(np.append(start, upto))
            mixed = np.logical_or.reduceat((rows[2][:upto] != rows[2][np.repeat(start, sizes)]).any(axis=1), start) if upto else []
            found = []
            for s, size in zip(start[mixed].tolist(), sizes[mixed].tolist()):
                found += search([x[s : s + size] for x in rows[1:]])
            for a, b in found:
                yield pa.RecordBatch.from_arrays([_bytes_of(a), _bytes_of(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "band", "part", "other")], axis=1)
            rows = [key, *(_matrix(batch.column(c), 16, "<u8") for c in ("digest", "label")), batch.column("n").to_numpy(),
                    _counts(batch.column("point")), batch.column("side").to_numpy()]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            changed = np.flatnonzero((rows[0][1:] != rows[0][:-1]).any(axis=1))
            upto = int(changed[-1]) + 1 if len(changed) else 0
            yield from done(rows, upto)
            held = [x[upto:].copy() for x in rows]
        if held:
            yield from done(held, len(held[0]))
        ease()

    return pairs


# ---------------------------------------------------------------- comparing tokens


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return bool(_passes(_among(b, a).sum(), len(a), len(b), percent))


def _compared(percent: int):
    """(u, v) of the linked ones of a and its partners, whose rows come after it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, head, last = None, None, None
        for batch in batches:
            u, v = [], []
            for a, part, digest, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "digest", "tokens"))):
                if (a, part) != node:
                    node, head, last = (a, part), None, None
                if digest == a:
                    head = np.frombuffer(raw, np.uint64)
                elif digest != last and head is not None:
                    if _alike(head, np.frombuffer(raw, np.uint64), percent):
                        u.append(a)
                        v.append(digest)
                    last = digest
            yield pa.RecordBatch.from_arrays([_binary(u), _binary(v)], ["u", "v"])
            ease()

    return compare


def _compared_in_clusters(percent: int):
    """(u, v) of the linked pairs of each cluster's documents and their partners; what is joined already isn't compared."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, list[bytes]]] = {}
        now = None

        def links() -> pa.RecordBatch:
            top = {d: d for d in held}

            def root(x: bytes) -> bytes:
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            u, v = [], []
            for b, (tokens, partners) in held.items():
                for a in partners:
                    if a in held and root(a) != root(b) and _alike(held[a][0], tokens, percent):
                        top[root(b)] = root(a)
                        u.append(a)
                        v.append(b)
            held.clear()
            return pa.RecordBatch.from_arrays([_binary(u), _binary(v)], ["u", "v"])

        for batch in batches:
            for cluster, digest, partners, raw in zip(*(batch.column(c).to_pylist() for c in ("cluster", "digest", "partners", "tokens"))):
                if cluster != now:
                    yield links()
                    now = cluster
                held.setdefault(digest, (np.frombuffer(raw, np.uint64), partners or []))
            ease()
        yield links()
        ease()

    return compare


def _links(docs: DataFrame, known: DataFrame, pairs: DataFrame, percent: int, n: int) -> DataFrame:
    """(u, v): those of the pairs (a, b) of digests whose sets resemble each other enough.

    Pairs that hang together are a cluster, whose documents one task gets, each once; a cluster beyond CLUSTER tokens is
    dealt by the first of each pair, and that in parts. Links within a cluster that others imply may be left out.
    """
    spark = docs.sparkSession
    pairs = cut(pairs.distinct())
    clusters = cut(connected_components(pairs.toDF("u", "v")))
    ends = cut(clusters.withColumnRenamed("node", "digest").join(known.select("digest", "n", "key"), "digest").groupBy("component", "digest").agg(F.min("key").alias("value"), F.max("n").alias("n")))
    wanted = spark.sparkContext.broadcast(_filter(ends.select("value")))
    small = cut(ends.groupBy("component").agg(F.sum("n").alias("tokens")).withColumn("small", F.col("tokens") <= CLUSTER).drop("tokens"))
    placed = pairs.join(if_small(clusters.toDF("b", "component")), "b").join(if_small(small), "component")
    partners = placed.where("small").groupBy("b").agg(F.collect_list("a").alias("partners")).withColumnRenamed("b", "digest")
    together = cut(ends.join(if_small(small.where("small")), "component").join(partners, "digest", "left").select(F.col("component").alias("cluster"), "digest", "partners"))
    large = placed.where("not small").select("a", "b")
    many = large.groupBy("a").agg(F.count("*").alias("c"))
    dealt = large.join(if_small(cut(many)), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / PART)).cast("int").alias("part"))
    firsts = dealt.select("a", "part", F.col("a").alias("digest")).distinct()
    asked = cut(firsts.withColumn("own", F.lit(0)).union(dealt.select("a", "part", F.col("b"), F.lit(1))))
    with small_batches(spark):
        bodies = docs.select("text", "key").mapInArrow(_bodies(n, wanted), "digest binary, tokens binary")
        laid = bodies.join(if_small(together), "digest").repartition("cluster").sortWithinPartitions("cluster")
        found = cut(laid.mapInArrow(_compared_in_clusters(percent), "u binary, v binary"))
        if asked.isEmpty():
            return found
        laid = bodies.join(if_small(asked), "digest").repartition("a", "part").sortWithinPartitions("a", "part", "own", "digest")
        return cut(laid.mapInArrow(_compared(percent), "u binary, v binary")).union(found)


# ---------------------------------------------------------------- the join


def linked(documents: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest, key) of every row, and (node, component) of the digests of sets that are linked with another.

    Rows of equal sets have one digest; key is a hash of the text. The links found span each class; a link within a
    class may be left out.
    """
    spark = documents.sparkSession
    docs = needs(documents, "doc_id", "text").withColumn("key", F.xxhash64(text_of()))
    paths = [shared_folder(spark, f"tokens{i}") for i in range(2)]
    with small_batches(spark):
        docs.mapInArrow(_look(n, COUNTED), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n long, digest binary, key long, tokens array<long>").write.parquet(paths[0])
    first = spark.read.parquet(paths[0])
    known = cut(first.select("doc_id", "n", "digest", "key"))
    late = cut(_counted(first, FREQUENT + 1).select(F.col("token").alias("value")))
    frequent, share = spark.sparkContext.broadcast(_filter(late)), COUNTED if FREQUENT == 1 else 0.0
    remove_folder(spark, paths[0])
    with small_batches(spark):
        docs.select("text").mapInArrow(_look_again(percent, n, frequent, share), "digest binary, n long, tokens array<long>, point binary").write.parquet(paths[1])
    again = spark.read.parquet(paths[1])
    counted = cut(_counted(again, 2))
    kept = spark.sparkContext.broadcast(_filter(counted.select(F.col("token").alias("value"))))
    *hot, _ = _above(counted, NODE)
    large = spark.sparkContext.broadcast(hot)
    kept = spark.sparkContext.broadcast(_filter(cut(_nodes(again, kept))))
    links, labels = None, None
    for turn in range(TURNS):
        members = _labelled(again.mapInArrow(_members(kept, large, PART), _NODE), labels)
        if turn:
            members = members.withColumn("share", F.pmod(F.xxhash64("digest", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30))
        pairs = _leading(members).mapInArrow(_stars(percent, HEADS), "a binary, b binary")
        found = _links(docs, known, pairs, percent, n)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = cut(connected_components(links))
        mixed = _labelled(again.mapInArrow(_members(kept, large, PART), _NODE), labels).groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
        kept = spark.sparkContext.broadcast(kept.value & _filter(cut(mixed.select(F.col("token").alias("value"))), 64 * len(kept.value)))
    named = _labelled(again.mapInArrow(_members(kept, large, PART), _NODE), labels)
    zero = F.lit(0)
    light = named.where("parts = 0").withColumns({"band": zero, "part": zero, "other": zero, "side": F.lit(2)})
    pairs = light.select(*_BLOCK).union(_crowded(named.where("parts > 0"), percent)).repartition("token", "band", "part", "other")
    pairs = pairs.sortWithinPartitions("token", "band", "part", "other").mapInArrow(_between_classes(percent, FAN, OPENED), "a binary, b binary")
    more = _links(docs, known, pairs, percent, n)
    links = more if links is None else links.union(more)
    classes = connected_components(links)
    remove_folder(spark, paths[1])
    return known, cut(classes)


_BLOCK = ("token", "band", "part", "other", "digest", "label", "n", "point", "side")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the class of each digest, which is itself without a link."""
    if labels is None:
        return members.withColumn("label", F.col("digest"))
    return members.join(if_small(labels).withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("component", "digest")).drop("component")


def _leading(members: DataFrame) -> DataFrame:
    """members by node, those with the largest share first; the first ones of a large node lead each of its parts."""
    crowd = members.where("parts > 0").select("token", "parts", "share", "digest")
    row = lambda *first: F.struct(*first, "digest")
    lead = [F.max(row("share"))["digest"]] + [F.min(row(F.xxhash64("share", "digest", F.lit(i)).alias("share")))["digest"] for i in range(1, HEADS)]
    heads = cut(crowd.groupBy("token", "parts").agg(F.array_distinct(F.array(*lead)).alias("heads")).select("token", "parts", F.explode("heads").alias("digest")))
    each = members.drop("parts").join(if_small(heads), ["token", "digest"]).select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(2.0).alias("share"), "digest", "label", "n", "point")
    every = members.select("token", "part", "share", "digest", "label", "n", "point").union(each)
    return every.repartition("token", "part").sortWithinPartitions("token", "part", F.desc("share"), "digest")


def _crowded(crowd: DataFrame, percent: int) -> DataFrame:
    """The members of large nodes dealt so that any two of different classes meet: those outside of the node's largest
    class go to every part of it, and to pairs of blocks among themselves."""
    sizes = crowd.groupBy("token", "label").agg(F.count("*").alias("c"))
    base = sizes.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"))
    base = cut(base.where("all > m.c").select("token", F.col("m.label").alias("_base")))  # others have one class
    split = crowd.join(if_small(base), "token")
    inner = split.where("label = _base").withColumns({"band": F.lit(-9), "other": F.lit(0), "side": F.lit(1)})
    outside = split.where("label != _base")
    across = outside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"band": F.lit(-9), "other": F.lit(0), "side": F.lit(0)})
    return inner.select(*_BLOCK).union(across.select(*_BLOCK)).union(_blocks(outside, percent).select(*_BLOCK))


def _blocks(crowd: DataFrame, percent: int) -> DataFrame:
    """Members of large nodes dealt to pairs of blocks: by bands of sizes, as linked ones are in one band or in
    neighbouring ones, and by as many parts as they need; any two that may be linked meet in one pair of blocks."""
    counts = cut(crowd.groupBy("token").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts")))
    band = F.floor(F.log("n") / F.lit(max(math.log(100 / percent) * (1 + 1e-9), 1e-7))).cast("int") * 2
    dealt = crowd.join(if_small(counts), "token").withColumns({"_band": band, "part": F.pmod(F.xxhash64("digest"), F.col("_parts")).cast("int")})
    each = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    same = each.withColumns({
        "band": F.col("_band"), "other": F.greatest("part", "_t"), "side": F.when(F.col("part") == F.col("_t"), 2).when(F.col("part") < F.col("_t"), 0).otherwise(1),
        "part": F.least("part", "_t"),
    })
    low = each.withColumns({"band": F.col("_band") + 1, "other": F.col("_t"), "side": F.lit(0)})
    high = each.withColumns({"band": F.col("_band") - 1, "other": F.col("part"), "part": F.col("_t"), "side": F.lit(1)})
    return same.unionByName(low).unionByName(high)


def near_duplicates(documents: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents (doc_id, text), whatever columns else there are.

    n_shingles is the number of distinct n-word shingles of the whole text, those of fewer words being one shingle;
    two rows are linked if they share percent hundredths of all shingles of both. component_id is the smallest doc_id
    reachable by links, nulls aside. A null text counts as empty; a text without words has no shingle and is linked
    with nothing. Rows that repeat an id are rows of their own. An empty table gives no rows.
    """
    known, classes = linked(documents, percent, n)
    rows = known.join(if_small(classes).withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = cut(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1"))
    return rows.join(if_small(least), "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
