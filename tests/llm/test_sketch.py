import hashlib

import pytest
from pyspark.sql import functions as F

from strata.llm import sketch


def shingles(text, n=5):
    words = [w for w in (text or "").lower().split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) > n else {tuple(words)} if words else set()


def check(docs, got):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    texts = [r.text or "" for r in rows]
    for k, r in enumerate(rows):
        own, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        one = got[r.doc_id]
        assert one.n_chars == len(own)
        assert one.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= one.near_edited <= 1 and 0 <= one.near_next <= 1
        if one.fingerprint == one.edited_fingerprint:
            assert one.near_edited == 1
    assert len(got) == len(rows)


def test_neighbours_in_many_ranges(documents, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_ROWS", 70)
    check(documents, {r.doc_id: r for r in sketch.with_neighbours(documents).collect()})


def test_estimates_near_the_exact_likeness(spark):
    texts = [" ".join(f"w{(i * 37 + k * (i % (m + 2) == 0)) % 997}" for i in range(900)) for m in range(4) for k in (0, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sketch.with_neighbours(docs, k=128).collect()}
    for i in range(len(texts)):
        a, b = shingles(texts[i]), shingles(texts[i - 1])
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b), abs=0.13)
        assert got[i].distinct_shingles == pytest.approx(len(a), rel=0.3)


def test_merge_is_the_sketch_of_the_whole(spark):
    df = spark.createDataFrame([("a b c d e f g h i j k l m n o p q r s t", "x y z d e f g h i u v w")], "a string, b string")
    s = lambda c: sketch.sketch(F.col(c), 8, 3)
    whole = F.slice(F.sort_array(F.array_distinct(F.concat(sketch.shingle_hashes(F.col("a"), 3), sketch.shingle_hashes(F.col("b"), 3)))), 1, 8)
    row = df.select(sketch.merge(s("a"), s("b"), 8).alias("m"), whole.alias("w"), sketch.containment(s("a"), s("a"), 8).alias("c")).first()
    assert row.m == row.w and row.c == 1.0


def test_native(documents):
    plan = sketch.with_neighbours(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(odd, odd_rows, none, spark):
    got = sketch.with_neighbours(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 5)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (1, 6, 7)}) == 1
    assert sketch.with_neighbours(none).collect() == []
    alone = sketch.with_neighbours(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0
