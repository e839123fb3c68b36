import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from strata.llm import jaccard, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) > 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def close_pairs(fps, h):
    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= h):
            yield i, i + 1 + int(j)


def test_all_documents_against_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = classes(((ids[a], ids[b]) for a, b in close_pairs(fps, 2)), ids)
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    assert len(got) == len(ids)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in zip(ids, fps)}
    assert {i: r.component_id for i, r in got.items()} == want


def test_dense_random_patterns_in_small_nodes(spark, monkeypatch):
    """Chains, dense balls around a few centres and far points, in nodes that must be split several times."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(150)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)} | {(1 << i) - 1 for i in range(64)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "NODE_LIMIT", 40)
    want = classes(close_pairs(fps, 2), range(len(fps)))
    docs = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.near_classes(docs, 2).collect()} == want


def test_odd_rows(odd, odd_rows, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.component_id for r in got if r.doc_id in (1, 6, 7)} == {1}
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 5)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (2, 3, 5)} == {2}
    assert {r.component_id for r in got if r.doc_id == 4} == {4}  # one document with two texts
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [2, None]
    assert simhash.near_duplicates(none).collect() == []


def resemblances(rows, n=5):
    """Pairs of (position, position) of a resemblance of 0.8 or more."""
    sets = [frozenset(simhash.shingle_hashes(r.text or "", n).tolist()) for r in rows]
    holders, found = defaultdict(list), set()
    for i, s in enumerate(sets):
        least = sorted(s)[: len(s) - int(0.8 * len(s)) + 1] if s else [None]
        for j in {j for x in least for j in holders[x]}:
            if len(sets[j] & s) >= 0.8 * len(sets[j] | s) - 1e-9:
                found.add((j, i))
        for x in least:
            holders[x].append(i)
    return found


def check_kept(docs, kept):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    stay = {r.doc_id for r in kept.collect()}
    pairs = [(rows[a].doc_id, rows[b].doc_id) for a, b in resemblances(rows)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for r in rows:
        assert r.doc_id in stay or near[r.doc_id] & stay, "a dropped document has no near copy that stays"
    both = [p for p in pairs if p[0] in stay and p[1] in stay]
    assert len(both) <= 0.02 * len(pairs), (len(both), len(pairs))


def test_without_near_copies(documents):
    kept = simhash.without_near_copies(documents)
    assert kept.columns == documents.columns
    check_kept(documents, kept)


def test_without_near_copies_of_a_class_beyond_a_chunk(documents, monkeypatch):
    """Classes many times as large as a part: with h so great that unlike texts share a class, too."""
    monkeypatch.setattr(jaccard, "PART", 30)
    monkeypatch.setattr(jaccard, "NODE", 20)
    some = documents.where("doc_id < 120")
    check_kept(some, simhash.without_near_copies(some, h=24))


def test_without_near_copies_odd_rows(odd, none):
    kept = sorted(r.doc_id for r in simhash.without_near_copies(odd).where("doc_id is not null").collect())
    assert kept[:2] == [-5, 1] and kept.count(1) == 1 and 6 not in kept and 7 not in kept
    assert kept.count(4) == 2 and len({2, 3, 5} & set(kept)) == 1
    assert simhash.without_near_copies(odd).columns == odd.columns
    assert simhash.without_near_copies(none).collect() == []


def test_without_near_copies_of_an_inserted_block(spark, monkeypatch):
    """Copies with another passage inserted, many beyond 8 bits, and a passage that many texts share: exactly
    those go that resemble an earlier text that stays."""
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    rng = np.random.default_rng(5)
    prose = lambda k: [f"w{x}" for x in rng.integers(0, 4000, k)]
    common, texts = prose(60), []
    for i in range(80):
        words = prose(int(rng.integers(40, 400)))
        texts += [words, words[: (at := len(words) // 3)] + prose(len(words) * (6 + i % 12) // 100) + words[at:], words[: -(len(words) // 8)]]
        texts.append(prose(12) + common + prose(4))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    near = defaultdict(set)
    for a, b in resemblances(rows):
        near[max(a, b)].add(min(a, b))
    stay = set()
    for r in rows:
        if not near[r.doc_id] & stay:
            stay.add(r.doc_id)
    fps = [plain_word_fingerprint(r.text) for r in rows]
    assert sum((fps[a] ^ fps[b]).bit_count() > 8 for b in near for a in near[b]) > 10
    assert {r.doc_id for r in simhash.without_near_copies(docs).collect()} == stay


@pytest.mark.parametrize("size", [5, 25, 100, 1000])
def test_without_near_copies_finds_groups_of_any_size(spark, size):
    """Groups of copies of one text with scattered words changed, a passage inserted or the tail cut, each so far that
    most copies don't resemble each other; passages that all groups share; texts of their own among them."""
    rng = np.random.default_rng(size)
    prose = lambda k: [f"w{x}" for x in rng.integers(0, 4000, k)]
    common, rows = prose(60), []
    for g in range(max(1, 100 // size)):
        first = prose(int(rng.integers(250, 500)))
        for i in range(size):
            words, share = list(first), rng.uniform(0.1, 0.19)
            if i % 3 == 0 and i:
                for at in rng.choice(len(words), int(len(words) * share / 11), replace=False):
                    words[at] = f"x{rng.integers(10**9)}"
            elif i % 3 == 1:
                at = int(rng.integers(len(words)))
                words[at:at] = prose(int(len(words) * share))
            elif i % 3 == 2:
                words = words[: int(len(words) * (1 - share))]
            rows.append((g, words))
    rows += [(-1 - i, prose(int(rng.integers(100, 400))) + common) for i in range(200)]
    rng.shuffle(order := np.arange(len(rows)))
    docs = spark.createDataFrame([(int(i), " ".join(rows[k][1]), int(rows[k][0])) for i, k in enumerate(order)], "doc_id long, text string, g long").repartition(5)
    kept = [r.g for r in simhash.without_near_copies(docs).collect()]
    assert sum(g < 0 for g in kept) == 200
    copies = sum(g >= 0 for g, _ in rows) - max(1, 100 // size)
    stay = sum(g >= 0 for g in kept) - max(1, 100 // size)
    assert stay <= 0.01 * copies, f"{stay} of {copies} copies stay"


def plain_word_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(text.split())]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
