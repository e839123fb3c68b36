import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import langid, quality


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_of_held_out_documents(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = langid.languages(documents).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (part(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_nothing_is_learnt_from_held_out_rows(documents):
    changed = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.languages(d).collect()) for d in (documents, changed.repartition(5)))
    assert a == b


def naive_phrases(sample, text):
    """Phrases by searching the sample itself, a new one at least every SEGMENT symbols; a letter that the
    sample lacks ends a phrase and goes with the next one."""
    held, n = bytes(sample), 0
    for at in range(0, len(text), langid.SEGMENT):
        phrase, n = b"", n + 1
        for c in bytes(text[at : at + langid.SEGMENT]):
            if phrase + bytes([c]) in held:
                phrase += bytes([c])
            else:
                phrase, n = bytes([c]) if c in held else b"", n + 1
    return n


def test_phrases_against_plain_search():
    rng = np.random.default_rng(2)
    samples = [rng.integers(0, k, 400).astype(np.uint8) for k in (3, 6)]
    texts = [rng.integers(0, 6, n).astype(np.uint8) for n in (0, 1, 7, 256, 257, 900)]
    got = langid.phrase_counts(texts, [langid.suffix_automaton(s) for s in samples])
    assert got.tolist() == [[naive_phrases(s, t) for s in samples] for t in texts]


def test_languages_of_odd_rows(odd, odd_rows, none):
    got = langid.languages(odd).collect()
    assert len(got) == len(odd_rows)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 5)} == {"und"}
    assert langid.languages(none).collect() == []
    kept = langid.known_languages(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert langid.known_languages(none).collect() == []


def test_languages_of_many_letters(spark):
    """Languages that share a script apart from the commonest one, over 62 letters together, and rare ones."""
    rng = np.random.default_rng(4)
    scripts = {"la": "abcdefghijklmnopqrstuvwxyz", "lb": "abcdefghijklmnopqrstuvwxyzäöü"} | {
        f"{x}{k}": "".join(map(chr, range(at, at + n))) for x, at, n in (("ru", 0x430, 32), ("el", 0x3B1, 17), ("ar", 0x628, 19), ("zh", 0x4E00, 300)) for k in "12"
    }
    rows = []
    for lang, letters in scripts.items():
        words = ["".join(rng.choice([*letters], rng.integers(2, 8))) for _ in range(150)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 80)), lang) for i in range(90 if lang[0] == "l" else 30)]
    got = {r.doc_id: r for r in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_every_language_is_learnt(spark):
    rows = [(i, f"text of {i % 230} and more", f"l{i % 230:03}") for i in range(230 * 6)]
    assert len(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["languages"]) == 230


def test_texts_in_no_learnt_language_go(spark, documents):
    """Gibberish and a language without labelled texts go; nearly all documents in the learnt ones stay."""
    rng = np.random.default_rng(6)
    known = documents.where("lang != 'fr'").select("doc_id", "text", "lang")
    other = documents.where("lang = 'fr' and length(text) > 200").select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    noise = [(-1 - i, "".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz   "], 300)), None) for i in range(40)]
    kept = langid.known_languages(known.unionByName(other).unionByName(spark.createDataFrame(noise, known.schema)))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not any(r[0] in ids for r in noise)
    strange, all_known = [r.doc_id for r in other.collect()], [r.doc_id for r in known.collect()]
    assert np.mean([i in ids for i in strange]) < 0.1
    assert 0.98 <= np.mean([i in ids for i in all_known])


def auc(scores, labels):
    one, zero = scores[labels == 1], scores[labels == 0]
    return np.mean([(one > z).mean() + 0.5 * (one == z).mean() for z in zero])


@pytest.fixture(scope="module")
def labels(spark, medium):
    return spark.read.parquet(f"{medium}/labels.parquet")


def test_quality_of_held_out_documents(documents, labels):
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    got = quality.qualities(documents, labels).collect()
    assert len(got) == documents.count()
    assert all(r.held_out == (part(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    scores, marks = np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])
    assert auc(scores, marks) > 0.9
    assert np.mean((scores >= 0.7) == marks) > 0.85


def test_quality_never_sees_held_out_labels(documents, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.qualities(documents, x).collect()) for x in (labels, flipped.repartition(3)))
    assert a == b


def test_quality_of_odd_rows(odd, odd_rows, none, labels, spark):
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (4, 0), (4, 1), (9, 0), (6, 1)], "doc_id long, quality int")
    got = quality.qualities(odd, marks).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 5)}) == 1
    assert quality.qualities(none, marks).collect() == []
    assert {r.score for r in quality.qualities(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.good_documents(odd, marks).columns == odd.columns


def test_no_pair_is_lost_between_runs(monkeypatch):
    text = " ".join(f"w{i * 7 % 11}" for i in range(400))
    whole, score = quality.features(text), quality.scores({"weights": np.arange(quality.BUCKETS) / 1e6, "offset": 0.0}, [text, "", text])
    monkeypatch.setattr(quality, "RUN_WORDS", 7)
    monkeypatch.setattr(quality, "AT_ONCE", 60)
    parts = quality.features(text)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert (quality.scores({"weights": np.arange(quality.BUCKETS) / 1e6, "offset": 0.0}, [text, "", text]) == score).all()


def test_one_repeated_row(spark):
    """A text that all rows share is learnt once, and each row is predicted."""
    same = spark.range(5000).selectExpr("cast(7 as long) as doc_id", "'the same text in every row' as text", "'en' as lang")
    other = spark.createDataFrame([(i, f"ein anderer text nummer {i} steht hier", "de") for i in range(40)], same.schema)
    docs = same.unionByName(other).repartition(6)
    model = langid.learn(docs)
    assert model["languages"] == ["de", "en"]
    got = langid.languages(docs).groupBy("doc_id", "lang_pred").count().collect()
    assert {(r.lang_pred, r["count"]) for r in got if r.doc_id == 7 and r.lang_pred == "en"} == {("en", 5000)}
    labels = spark.createDataFrame([(7, 1), *((i, 0) for i in range(40) if i != 7)], "doc_id long, quality int")
    scores = quality.qualities(docs, labels).collect()
    assert len(scores) == 5040 and len({r.score for r in scores if r.doc_id == 7}) <= 2


def test_letters_from_all_of_a_long_text(spark):
    """What only the far end of long rows has is learnt as well."""
    rows = [(i, "abc abd " * 2000 + "xyz xyw " * 2000, "a") for i in range(30)] + [(i, "klm kln " * 4000, "b") for i in range(30, 60)]
    rows = [(i, f"{t}{i}", lang) for i, t, lang in rows]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {*"xyz"} <= {*model["alphabet"]}
