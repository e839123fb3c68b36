import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strata.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, least, top=50):
    """The contract, word for word, over (lang, source, text)."""
    docs, n, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        n[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for g, t in docs if g == lang and docs[g, t] >= least)
        sources = [s for g, s in groups if g == lang]
        share = lambda count, total: {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p = {s: share(n[lang, s], sum(n[lang, s][t] for t in kept)) for s in sources}
        every = sum((n[lang, s] for s in sources), Counter())
        q = share(every, sum(every[t] for t in kept))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])
            for part, ranked in (("pair", pairs), ("term", own[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    """Sources with words of their own, words of a few and words of all, in languages of one to forty sources."""
    rng = np.random.default_rng(12)
    rows = []
    for lang, sources in (("en", 40), ("de", 7), ("fr", 1), (None, 3)):
        for i in range(sources * 8):
            s = int(rng.integers(sources))
            words = [f"Common{c}" for c in "abcdefgh"[: 3 + s % 5]] + [f"own{'x' * s}"] * (1 + s % 3) + ["é" * (1 + s // 4), f"few{'y' * (s // 3)}", "Zz"]
            rows.append((lang, None if s == 2 else f"s{s}", " ".join(rng.choice(words, int(rng.integers(0, 60)))) + "1no2X_y"))
    return [*rows, ("en", "empty", None), ("en", "digits", "12 34 !!"), ("xx", "alone", ""), ("xx", "", "one two"), ("", "s", None)]


@pytest.mark.parametrize("least,top", [(3, 50), (1, 4), (10_000, 50)])
def test_against_brute_force(spark, texts, least, top):
    docs = spark.createDataFrame(texts, "lang string, source string, text string").repartition(5)
    assert rows_of(divergence.audit(docs, least, top)) == plain(texts, least, top)


@pytest.mark.parametrize("share,fewest", [(0.0, 0), (1.0, 1000), (0.2, 2)])
def test_heavy_and_light_terms_in_many_tiles(spark, texts, monkeypatch, share, fewest):
    """All terms heavy, all light, and a split; with blocks of few groups, tiles of few terms and short parts."""
    for name, value in (("HEAVY_SHARE", share), ("FEWEST", fewest), ("TILE_GROUPS", 6), ("TILE_TERMS", 5), ("POSTINGS", 20), ("HELD", 30)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(texts, "lang string, source string, text string").repartition(5)
    assert rows_of(divergence.audit(docs, 2)) == plain(texts, 2)


def test_counts_beyond_64_bits_of_a_product(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(4 * 10**12, 9 * 10**12, 77_777)], "n long, total long, terms long")
    got = row.select(divergence._smoothed(F.col("n"), F.col("total"), F.col("terms")).alias("p")).first().p
    assert got == 1 + 10**9 * (4 * 10**12 + 5) // (9 * 10**12 + 5 * 77_777)


def test_odd_rows(odd, odd_rows, none):
    want = plain([(r[2], r[3], r[1]) for r in odd_rows], 1)
    assert rows_of(divergence.audit(odd, 1)) == want
    assert rows_of(divergence.audit(odd)) == plain([(r[2], r[3], r[1]) for r in odd_rows], 30)
    assert divergence.audit(none).collect() == []


def test_documents_against_sql(documents, medium):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{medium}/documents.parquet')")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({divergence.SQL})").fetchall()
    assert {r[2] for r in want} == {"pair", "term"} and rows_of(divergence.audit(documents)) == sorted(want)
