import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strata.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, most_words=5, share=100, top=2000):
    """The contract, word for word, over (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= share * found[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, _, l, r = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    """Runs of few words, so that phrases overlap themselves, tie, hold each other and start with control characters."""
    rng = np.random.default_rng(11)
    words = np.array(["a", "A", "b", "b\x01", "\x01", "é", "É", "x-y", "\u00a0", "q" * 300, "zz", "rare"])
    rows = []
    for i in range(60):
        some = rng.choice(words, int(rng.integers(0, 120)), p=[0.2, 0.1, 0.2, 0.05, 0.05, 0.1, 0.05, 0.1, 0.05, 0.04, 0.05, 0.01])
        gaps = rng.choice([" ", "  ", "\t", ". ", "\n", "!", ";\x0b"], len(some), p=[0.7, 0.1, 0.08, 0.04, 0.03, 0.03, 0.02])
        rows.append((["en", "de", None, "und"][i % 4], "".join(w + g for w, g in zip(some, gaps))))
    return [*rows, ("en", None), (None, ""), ("xx", None), ("en", "b " * 5000), ("en", "b " * 5000)]


@pytest.mark.parametrize("least,most_words,share,top", [(3, 5, 100, 2000), (2, 4, 60, 7), (1000, 5, 100, 2000)])
def test_against_brute_force(spark, texts, least, most_words, share, top):
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(4)
    assert rows_of(phrases.collocations(docs, least, most_words, share, top)) == plain(texts, least, most_words, share, top)


def test_words_beyond_the_dictionary_and_runs_beyond_what_is_handed_out(spark, texts, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 3)
    monkeypatch.setattr(phrases, "IDS", 50)
    monkeypatch.setattr(phrases, "NUMBERED", 4)
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(4)
    want = plain(texts, 3)
    assert rows_of(phrases.collocations(docs, 3, head_words=2)) == want
    assert rows_of(phrases.collocations(docs, 3, handed_out=5)) == want


def test_products_beyond_64_bits(spark, monkeypatch):
    """As many words as a corpus of petabytes has: the counts are scaled, the score stays exact."""
    factor = 10**12 + 39
    docs = spark.createDataFrame([("en", "p q. p q. p r. s q. " * 3 + "q p q")], "lang string, text string")
    plainly = phrases.frequent_phrases

    def scaled(*args):
        grams, found, totals = plainly(*args)
        return grams.withColumn("n", grams.n * factor), found, totals.withColumn("n", totals.n * factor + 7)

    monkeypatch.setattr(phrases, "frequent_phrases", scaled)
    got = {r.phrase: r for r in phrases.collocations(docs, 3).collect()}
    a, l, r, n = 7 * factor, 10 * factor, 11 * factor, 27 * factor + 7
    assert set(got) == {"p q", "p r", "s q"} and (got["p q"].a, got["p q"].l, got["p q"].r, got["p q"].n) == (a, l, r, n)
    assert got["p q"].score == 1000 * a * n // (l * r)


def test_odd_rows(spark, odd, odd_rows, none):
    want = plain([(r[2], r[1]) for r in odd_rows], 2)
    assert rows_of(phrases.collocations(odd, 2)) == want
    assert phrases.collocations(none).collect() == []


def test_documents_against_sql(documents, medium):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{medium}/documents.parquet')")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({phrases.SQL})").fetchall()
    assert want and rows_of(phrases.collocations(documents)) == sorted(want)
