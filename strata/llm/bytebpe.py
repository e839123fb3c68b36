"""BPE encoding and decoding over a byte-level vocabulary, by a contiguous array of ranks for each short word.

A word's part boundaries and the merge ranks of neighbouring parts are two short lists: the least rank is
found by a scan, its boundary deleted, and the ranks on both sides looked up again. A scan of a few dozen
numbers beats any linked structure; words too long for it are merged with a heap in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ease, needs, text_of
from strata.llm.wordbpe import SPACE, byte_letters

#: Bytes of a word up to which its ranks are scanned; words that a worker keeps before it starts afresh.
SHORT, KEPT_WORDS = 128, 400_000

#: Fixed value of the tokenizer's file format: the pattern of its words.
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
NEVER = 1 << 30


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.id = {raw(t): i for t, i in data["model"]["vocab"].items()}
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(data["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: t for t, i in self.id.items()} | {i: t.encode() for t, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.kept: dict[str, bytes] = {}

    def short(self, word: bytes) -> list[bytes]:
        """Parts of a word: the boundaries, and the rank of each two neighbouring parts, in two lists."""
        get = self.rank.get
        cut = list(range(len(word) + 1))
        ranks = [get((word[i : i + 1], word[i + 1 : i + 2]), NEVER) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            del cut[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((word[cut[i] : cut[i + 1]], word[cut[i + 1] : cut[i + 2]]), NEVER)
            if i:
                ranks[i - 1] = get((word[cut[i - 1] : cut[i]], word[cut[i] : cut[i + 1]]), NEVER)
        return [word[a:b] for a, b in zip(cut, cut[1:])]

    def long(self, word: bytes) -> list[bytes]:
        """The same parts by a heap of pairs: entries of parts that have changed since are passed over."""
        end = [*range(1, len(word) + 1)]
        before = [*range(-1, len(word) - 1)]
        heap = []

        def push(i: int) -> None:
            j = end[i]
            if j < len(word) and (rank := self.rank.get((word[i:j], word[j : end[j]]))) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(len(word)):
            push(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, -1
            if k < len(word):
                before[k] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        out, i = [], 0
        while i < len(word):
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def word(self, word: str) -> bytes:
        data = word.encode()
        parts = self.short(data) if len(data) <= SHORT else self.long(data)
        return array("I", [self.id[p] for p in parts]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers, little-endian; special strings are single ids."""
        if self.split and self.split.search(text):
            pieces = self.split.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self.plain(p) for i, p in enumerate(pieces))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        words = WORDS.findall(text)
        kept = self.kept
        try:
            return b"".join([kept[w] for w in words])
        except KeyError:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for w in words:
                if w not in kept:
                    kept[w] = self.word(w)
            return b"".join([kept[w] for w in words])

    def decode(self, ids: bytes) -> str:
        """The text of such ids; bytes that are no UTF-8 become U+FFFD."""
        of = self.bytes
        return b"".join([of[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBpe:
    """One for each worker process and file."""
    return ByteBpe(path)


def encode(text: Column, path: str) -> Column:
    """array<int> of the ids of each text; empty for an empty or null one."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([memoryview(codec(path).encode(t or "")).cast("I").tolist() for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of ids; null for null."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else codec(path).decode(array("I", [int(i) for i in r]).tobytes()) for r in rows], dtype=object)

    return text(ids)


#: Characters of text that encoded() turns into ids at a time, but for a longer text.
AT_ONCE = 2_000_000


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_equals) for every row of documents (doc_id, source, text).

    ids is an array<int>; decoded_equals says whether decoding them gives the text back. A null text counts
    as empty. Ids go to Arrow as they are, a few texts at a time, so a worker holds little beside its batch.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = codec(path)
        for batch in batches:
            ease()
            at = 0
            while at < batch.num_rows:
                ids, same, size, begin = [], [], 0, at
                while at < batch.num_rows and (at == begin or size < AT_ONCE):
                    text = batch["text"][at].as_py()
                    ids.append(found.encode(text))
                    same.append(found.decode(ids[-1]) == text)
                    size += len(text)
                    at += 1
                n = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, n.cumsum()], pa.int32()), pa.array(flat))
                part = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["source"], pa.array(n), lists, pa.array(same)], names=["doc_id", "source", "n_tokens", "ids", "decoded_equals"])

    rows = needs(documents, "doc_id", "source", "text").select(F.col("doc_id").cast("long"), "source", text_of().alias("text"))
    return rows.mapInArrow(of, "doc_id long, source string, n_tokens long, ids array<int>, decoded_equals boolean")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of documents (doc_id, text).

    The ids are those of the tokenizers library for the vocabulary at path, without added special tokens; the
    text is decoded from the ids. A null text counts as empty: no ids. Texts of any length are encoded
    whole, one at a time. Equal rows give equal rows; other columns are not read.
    """

    @F.pandas_udf("n long, ids string, decoded string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        ease()
        found, rows = codec(path), []
        for t in texts:
            ids = found.encode(t)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(found.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n", "ids", "decoded"]).astype({"ids": object, "decoded": object})

    rows = needs(documents, "doc_id", "text").select("doc_id", text_of().alias("text"))
    return rows.withColumn("c", digests("text")).select(
        "doc_id", F.col("c.n").alias("n_tokens"), F.col("c.ids").alias("ids_sha256"), F.col("c.decoded").alias("decoded_sha256")
    )
