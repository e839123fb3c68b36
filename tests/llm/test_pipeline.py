import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strata.llm import simhash


def staged(spark, docs, sf_dir, home):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{home}/{name}")
        out.append(spark.read.parquet(f"{home}/{name}"))
    return out


def test_stages(spark, medium, documents, tmp_path):
    docs, lang, good, distinct, mixed, ids = staged(spark, documents, medium, tmp_path)
    assert all(d.columns == documents.columns for d in (lang, good, distinct, mixed))
    sizes = [d.count() for d in (docs, lang, good, distinct)]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
    assert distinct.select("doc_id").distinct().count() == distinct.count()
    assert mixed.join(distinct, "doc_id", "left_anti").count() == 0
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in mixed.collect()}
    rows = ids.collect()
    assert len(rows) == mixed.count() and all(r.decoded_equals and r.n_tokens == len(r.ids) for r in rows)
    assert all(r.ids == t.encode(text[r.doc_id], add_special_tokens=False).ids for r in rows[::7])


def test_clean_documents_stay(spark, medium, documents, tmp_path):
    """Of documents labelled good, the language and quality stages keep nearly all."""
    marked = spark.read.parquet(f"{medium}/labels.parquet").where("quality = 1").select("doc_id")
    clean = documents.where("lang is not null").join(marked, "doc_id", "left_semi")
    kept = corpus_pipeline.language(spark, documents, medium)
    assert clean.join(kept, "doc_id", "left_semi").count() >= 0.98 * clean.count()
    good = corpus_pipeline.good(spark, kept, medium)
    assert clean.join(good, "doc_id", "left_semi").count() >= 0.85 * clean.count()


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_odd_rows(spark, small, kind, request, tmp_path):
    docs = request.getfixturevalue(kind)
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns
        if kind == "none":
            assert after.count() == 0
    got = corpus_pipeline.encoded(spark, docs, small).collect()
    assert len(got) == docs.count() and all(r.decoded_equals for r in got)
    assert np.all([r.n_tokens == 0 for r in got if r.doc_id in (2, 3)])


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_chained_stages_over_odd_rows(spark, small, kind, request, tmp_path):
    """Each stage works on what the one before wrote, extra columns included."""
    docs = request.getfixturevalue(kind)
    out = staged(spark, docs, small, tmp_path)
    sizes = [d.count() for d in out]
    assert all(d.columns == docs.columns for d in out[:-1]) and sizes[:4] == sorted(sizes[:4], reverse=True)
    assert sizes[4] <= 2 * sizes[3] and sizes[5] == sizes[4]
    assert kind == "odd" or sizes == [0] * 6


def edited(rng, words, how):
    """A near copy: scattered words changed, a passage put in, or the tail cut; it resembles the text by 0.8 or more."""
    out, n = list(words), len(words)
    if how == "words":
        for i in rng.choice(n, n // 60, replace=False):
            out[i] = f"new{i}"
    elif how == "passage":
        at = int(rng.integers(0, n))
        out[at:at] = [f"put{i}" for i in range(n // 8)]
    else:
        out = out[: n - n // 7]
    return out


def test_near_copies_are_caught_and_others_stay(spark):
    """Of each planted group one document stays, whatever the kind of edit; texts of their own all stay."""
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(3000)]
    rows, groups = [], []
    for g in range(60):
        text = [*rng.choice(common, int(rng.integers(120, 900)))]
        group = [text] + [edited(rng, text, how) for how in ("words", "passage", "tail")]
        groups.append(range(len(rows), len(rows) + len(group)))
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(group)]
    alone = range(len(rows), len(rows) + 200)
    rows += [(i, " ".join(rng.choice(common, 300))) for i in alone]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = {r.doc_id for r in simhash.without_near_copies(docs).collect()}
    assert kept >= {*alone}
    caught = sum(1 for g in groups for i in g[1:] if i not in kept)
    assert caught >= 0.9 * 3 * len(groups) and all(kept & {*g} for g in groups)


def test_near_copies_among_texts_that_share_a_passage(spark):
    """Hundreds of texts that are mostly one passage: those with little else go, those with more all stay."""
    passage = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join(passage + [f"x{i}y{k}" for k in range(8 if i % 2 else 60)])) for i in range(300)]
    kept = {r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert kept >= {i for i in range(300) if i % 2 == 0} and len([i for i in kept if i % 2]) == 1
