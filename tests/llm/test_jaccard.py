from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import jaccard
from strata.llm.simhash import shingle_hashes


def plain(rows, percent=80, n=5):
    """doc_id -> (n_shingles, component_id) over (doc_id, text) with ids of their own, by sets of whole shingles."""
    sets = {}
    for i, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    seen = set()
    for group in {tuple(g) for g in holders.values() if len(g) > 1}:
        for a, b in combinations(group, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    top[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def prose(rng, size, words=5000):
    return [f"w{x}" for x in rng.integers(0, words, size)]


def edited(rng, words, kind, share):
    """words with about this share of shingles changed: scattered words, an inserted passage or a cut tail."""
    words = list(words)
    if kind == 0:
        for at in rng.integers(0, len(words), max(1, int(len(words) * share / 5))):
            words[at] = f"x{rng.integers(10**9)}"
        return words
    at = int(rng.integers(len(words)))
    return words[:at] + [f"y{rng.integers(10**9)}" for _ in range(int(len(words) * share))] + words[at:] if kind == 1 else words[: int(len(words) * (1 - share))]


@pytest.fixture(scope="module")
def corpus():
    """Groups of 2 to 150 near copies around the limit of resemblance, chains, copies, passages that many share, and
    texts that consist of such passages."""
    rng = np.random.default_rng(13)
    passages, texts = [prose(rng, 30) for _ in range(12)], []
    for size in (2, 2, 2, 3, 5, 8, 25, 150):
        words = prose(rng, int(rng.integers(40, 400)))
        texts += [words] + [edited(rng, words, k % 3, rng.uniform(0.02, 0.24)) for k in range(size - 1)]
    chain = prose(rng, 200)
    for _ in range(40):
        texts.append(chain)
        chain = edited(rng, chain, 1, 0.04)[8:]
    texts += [prose(rng, int(rng.integers(5, 60))) + passages[int(rng.integers(12))] + prose(rng, int(rng.integers(0, 30))) for _ in range(250)]
    texts += [sum((passages[i] for i in rng.choice(12, 6, replace=False)), []) for _ in range(120)]
    texts += [prose(rng, k) for k in (1, 2, 4, 5, 6, 0)] + [["a"], ["A"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "a", "b", "c", "d", "e"]]
    texts += texts[:5] * 8
    rng.shuffle(order := np.arange(len(texts)))
    rows = [(int(i), " ".join(texts[k])) for i, k in enumerate(order)] + [(-1, None), (-2, " \n\t"), (-3, "A\x0bB c\n d e")]
    return rows


def test_against_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(6)
    assert result(jaccard.near_duplicates(docs)) == plain(corpus)


@pytest.mark.parametrize("percent,n", [(80, 5), (50, 2), (100, 5)])
def test_large_nodes_and_other_limits(spark, corpus, monkeypatch, percent, n):
    """Nodes dealt to blocks of few members, trees of several levels, filters that let much pass."""
    for name, value in (("FREQUENT", 4), ("COUNTED", 0.5), ("NODE", 6), ("PART", 9), ("CLUSTER", 3000), ("FAN", 3), ("OPENED", 50), ("BITS", 1 << 12), ("HANDED_OUT", 400)):
        monkeypatch.setattr(jaccard, name, value)
    some = [r for r in corpus if r[0] % 2 or r[0] < 0]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(6)
    assert result(jaccard.near_duplicates(docs, percent, n)) == plain(some, percent, n)


def test_shingles_of_long_texts_and_words():
    rng = np.random.default_rng(2)
    words = ["a" * k for k in (1, 63, 64, 65, 500, 5000)] + ["é" * 40, "b" * 64 + "c", "c" + "b" * 64, "\x00", "\x0b", "\u00a0"]
    texts = ["", " ", "\t\n", "x", *(" ".join(rng.choice(words, int(rng.integers(1, 40)))) + " " * int(rng.integers(3)) for _ in range(60))]
    raw = [t.encode() for t in texts]
    plainly = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in raw]
    got = list(jaccard.shingles(raw))
    for small in (1, 7, 300):
        assert all(np.array_equal(a, b) for a, b in zip(got, jaccard.shingles(raw, at_once=small), strict=True))
    assert [len(g) for g in got] == [len(p) for p in plainly] and all((g[1:] > g[:-1]).all() for g in got)
    for i in range(len(raw)):
        assert len(np.intersect1d(got[0 + i], got[-1])) == len(plainly[i] & plainly[-1])


def test_points_bound_what_is_shared():
    """Also where hundreds of tokens fall into one group, more than a byte counts."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    crowded = np.unique((rng.integers(0, 1 << 15, 900, dtype=np.uint64) << np.uint64(48)) | rng.integers(0, 1 << 40, 900, dtype=np.uint64))
    spread = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(crowded, k), rng.choice(spread, 300)])) for k in (0, 100, 600, 800, 900)]
    points = jaccard._counts(pa.array([jaccard._points(s) for s in sets], pa.binary()))
    assert points.sum(axis=1).tolist() == [len(s) for s in sets] and points[-1, -1] > 0
    for a in range(5):
        for b in range(5):
            assert np.minimum(points[a], points[b]).sum() >= len(np.intersect1d(sets[a], sets[b]))


def test_tree_join_is_complete_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 40, (60, 16))
    points = np.abs(centres[rng.integers(0, 60, 900)] + rng.integers(-2, 3, (900, 16))).astype(np.uint32)
    points = points[np.lexsort(points.T)]
    size = points.sum(axis=1).astype(np.int64)
    got = {(a, b) for i, j in jaccard.tree_join((points, size), (points[:500], size[:500]), 80) for a, b in zip(i.tolist(), j.tolist())}
    shared = np.minimum(points[:, None], points[None, :500]).sum(axis=2).astype(np.int64)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(180 * shared >= 80 * (size[:, None] + size[None, :500])))))


def test_documents_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(jaccard.near_duplicates(documents)) == plain(rows)


def test_odd_rows(spark, odd, odd_rows, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()), key=str)
    want = []
    least = {}
    for i, text, *_ in odd_rows:
        key = tuple(sorted(set(shingle_hashes(text or "", 5).tolist())))
        if key and i is not None:
            least[key] = min(least.get(key, i), i)
    for i, text, *_ in odd_rows:
        key = tuple(sorted(set(shingle_hashes(text or "", 5).tolist())))
        want.append((i, len(key), least.get(key, i) if key else i))
    assert got == sorted(want, key=str)
    assert jaccard.near_duplicates(none).collect() == []


def test_filters_grow_with_what_is_in_them(spark, monkeypatch):
    """Else nearly all values pass once they are many."""
    monkeypatch.setattr(jaccard, "BITS", 1 << 12)
    values = spark.range(50_000).select(F.xxhash64("id").alias("value"))
    bits = jaccard._filter(values)
    others = np.random.default_rng(6).integers(-(1 << 63), 1 << 63, 50_000)
    assert jaccard._in_filter(values.toPandas()["value"].to_numpy(), bits).all() and jaccard._in_filter(others, bits).mean() < 0.1
    monkeypatch.setattr(jaccard, "MOST_BITS", 1 << 13)
    assert len(jaccard._filter(values)) == (1 << 13) // 64


def test_the_order_does_not_change_with_many_frequent_tokens(spark, corpus, monkeypatch):
    """However many tokens several documents have, those of the lowest share that one has alone lead to no rows."""
    shares, look_again = [], jaccard._look_again
    monkeypatch.setattr(jaccard, "HANDED_OUT", 5)
    monkeypatch.setattr(jaccard, "_look_again", lambda percent, n, frequent, share: shares.append(share) or look_again(percent, n, frequent, share))
    some = [r for r in corpus if r[0] % 3]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(6)
    assert result(jaccard.near_duplicates(docs)) == plain(some)
    assert shares == [jaccard.COUNTED]
