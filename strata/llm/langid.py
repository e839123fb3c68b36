"""Language identification by cross-parsing entropy.

Each language's labelled text is held as a suffix automaton. A text is parsed against it into the longest
phrases that occur there; each phrase costs what it takes to point into the sample, so the language whose
parse needs the fewest bits a letter wins. Texts are parsed in fixed segments, many of them side by side,
which puts the automaton's steps into a few numpy operations.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ease, fresh, needs

#: Bounds of the sample that is learnt: letters of a language and of all, rows of a language, letters of a row. A
#: longer row gives those from a place on that its hash decides, so all of it may be learnt from.
LANGUAGE_CHARS, ALL_CHARS, SAMPLE_ROWS, ROW_CHARS = 24_000, 1_200_000, 64, 3000
#: Letters in a segment. Symbols are 0 for what isn't a letter, 1 and on for the alphabet of all samples, and
#: the one after for a letter not in any sample.
SEGMENT = 256
#: Letters after which a group of texts is parsed.
AT_ONCE = 1_000_000
UNKNOWN = "und"
#: A text is in none of the languages if it needs so many times the bits a letter that SHARE of the held-back
#: texts of its language need, beyond FREE phrases. Held-back texts have so many letters, and are so many, at least.
TIMES, SHARE, FREE, LEAST_LETTERS, LEAST_TEXTS = 1.5, 0.98, 2, 32, 5
#: A text can't be told if its score is under so much of the score that SHARE of the held-back texts reach, of
#: which so many are looked at.
PART, MARGIN_TEXTS = 0.5, 200


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; -1 for a null id, which no part holds out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


@lru_cache(maxsize=2)
def _letters(alphabet: str) -> np.ndarray:
    """Code point -> symbol, capitals as small letters."""
    table = np.zeros(0x110000, np.int32)
    known = {c: i for i, c in enumerate(alphabet, 1)}
    for c in range(0x110000):
        if unicodedata.category(x := chr(c))[0] in "LM":
            table[c] = known.get(x.lower(), len(alphabet) + 1)
    return table


def symbols(text: str, alphabet: str) -> np.ndarray:
    """The text's letters as symbols, other characters as one 0 between them."""
    got = _letters(alphabet)[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return got[(got != 0) | (np.r_[np.int32(0), got[:-1]] != 0)] if len(got) else got


def suffix_automaton(sample: np.ndarray) -> tuple[np.ndarray, ...]:
    """(base, owner, target, first) int32: from a state s a symbol c leads to target[base[s] + c] if the owner
    there is s; else a new phrase begins, at first[c] (0 for symbols beyond it).

    The states are those of the smallest automaton of all the sample's substrings; 0 is the empty one. Their
    edges share one array, each state's moved to where it fits, so its size doesn't depend on the alphabet.
    """
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in sample.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    width = int(sample.max()) + 1 if len(sample) else 1
    first = np.zeros(width, np.int32)
    for c, i in step[0].items():
        first[c] = i
    base = np.zeros(len(step), np.int64)
    edges = sum(map(len, step))
    free = np.ones(2 * edges + len(step) + 4 * width + 64, bool)
    free[:width] = False  # so that no base is below 0
    low = width
    for i in sorted((i for i, nexts in enumerate(step) if len(nexts) > 1), key=lambda i: -len(step[i])):
        own = np.array([*step[i]])
        own.sort()
        tried, at = 0, low
        while True:
            if at + width + 1 > len(free):
                free = np.r_[free, np.ones(len(free), bool)]
            if free[at] and free[at - own[0] + own].all():
                break
            at, tried = at + 1, tried + 1
        base[i] = at - own[0]
        free[base[i] + own] = False
        if tried > 32:  # the space below is nearly full
            low = at - 16
    single = [i for i, nexts in enumerate(step) if len(nexts) == 1]
    if single:
        own = np.array([next(iter(step[i])) for i in single])
        base[single] = np.flatnonzero(np.r_[free, np.ones(len(single), bool)])[: len(single)] - own
    end = int(base.max()) + width + 1
    owner, target = np.full(end, -1, np.int32), np.zeros(end, np.int32)
    for i, nexts in enumerate(step):
        for c, to in nexts.items():
            owner[base[i] + c], target[base[i] + c] = i, to
    return base.astype(np.int32), owner, target, first


def learn(documents: DataFrame, parts: int = 3, out: int = 1) -> dict:
    """Languages, alphabet and automata from documents (doc_id, text, lang) not in the part held out.

    The sample is bounded: see LANGUAGE_CHARS and the constants by it; distinct texts are chosen by a hash.
    """
    rows = needs(documents, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0) & (remainder(F.col("doc_id"), parts) != out))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return {"languages": [], "alphabet": "", "automata": [], "bits": [], "limits": [], "margin": 0.0}
    most = max(1, min(LANGUAGE_CHARS, ALL_CHARS // len(counts)))
    many = max(8, min(SAMPLE_ROWS, SAMPLE_ROWS * most * 4 // LANGUAGE_CHARS))  # rows and letters of them by what is shared out
    row_chars = min(ROW_CHARS, 8 * most)
    hashed, unit = F.xxhash64("text"), float(1 << 30)
    begin = F.pmod(F.xxhash64(F.lit(1), hashed), F.greatest(F.length("text") - row_chars, F.lit(0)) + 1).cast("int") + 1
    some = rows.select(
        F.col("lang").cast("string").alias("lang"), F.substring("text", begin, F.lit(row_chars)).alias("text"),
        hashed.alias("_hash"), (F.pmod(hashed, F.lit(1 << 30)) / unit).alias("_h"),
    )
    share, parts_of = {str(r["lang"]): min(1.0, 2.0 * many / r["count"]) for r in counts}, {}
    wanted = list(share)
    while wanted:  # again for those of which most rows are alike, so that few texts were drawn
        shares = documents.sparkSession.createDataFrame([(x, share[x]) for x in wanted], "_lang string, _share double")
        drawn = some.join(F.broadcast(shares), (F.col("lang") == F.col("_lang")) & (F.col("_h") < F.col("_share")))
        got = drawn.groupBy("lang", "_hash", "_h").agg(F.min("text").alias("text")).toPandas()
        parts_of |= {x: got[got["lang"] == x] for x in wanted}
        wanted = [x for x in wanted if len(parts_of[x]) < many // 2 and share[x] < 1]
        share |= {x: min(1.0, 16 * share[x]) for x in wanted}
    sample = pd.concat([*parts_of.values()], ignore_index=True)
    sample = sample.sort_values(["_h", "text"])
    languages = sorted(sample["lang"].unique())
    texts, back = {}, {}
    for lang in languages:
        own = list(dict.fromkeys(sample["text"][sample["lang"] == lang]))
        back[lang] = own[3::4]
        texts[lang] = "\n".join(x for i, x in enumerate(own) if i % 4 != 3)[: 2 * most]
    seen = Counter(c for t in texts.values() for c in t.lower() if unicodedata.category(c)[0] in "LM")
    alphabet = "".join(sorted(seen))
    samples = [symbols(texts[lang], alphabet)[:most] for lang in languages]
    automata = [suffix_automaton(s) for s in samples]
    bits = [float(np.log2(max(2, len(s)))) for s in samples]
    limits = _limits([back[lang] for lang in languages], alphabet, automata, bits)
    model = {"languages": languages, "alphabet": alphabet, "automata": automata, "bits": bits, "limits": limits, "margin": 0.0}
    return model | {"margin": _margin(model, [back[lang] for lang in languages])}


def _margin(model: dict, back: list[list[str]]) -> float:
    """The least score of a text whose language is told, from texts that the automata haven't seen."""
    dealt = [(lang, texts[i]) for i in range(max(map(len, back))) for lang, texts in zip(model["languages"], back) if i < len(texts)]
    dealt = [(lang, t) for lang, t in dealt if len(symbols(t, model["alphabet"])) >= LEAST_LETTERS][:MARGIN_TEXTS]
    lang, score, _ = predict(model, [t for _, t in dealt])
    right = [x for x, got, (want, _) in zip(score, lang, dealt) if got == want]
    return PART * float(np.quantile(right, 1 - SHARE)) if len(right) >= LEAST_TEXTS else 0.0


def _limits(back: list[list[str]], alphabet: str, automata: list, bits: list[float]) -> list[float]:
    """The most bits a letter of a text in each language, from texts of it that its automaton hasn't seen.

    A language with too few of these has the largest limit of the others, or none where no language has enough.
    """
    out: list[float | None] = []
    for texts, automaton, b in zip(back, automata, bits):
        coded = [c for c in (symbols(t, alphabet) for t in texts) if len(c) >= LEAST_LETTERS]
        if len(coded) < LEAST_TEXTS:
            out.append(None)
            continue
        phrases = phrase_counts(coded, [automaton])[:, 0]
        rate = b * np.maximum(phrases - FREE, 1) / [len(c) for c in coded]
        out.append(TIMES * float(np.quantile(rate, SHARE)))
    most = max((x for x in out if x is not None), default=float("inf"))
    return [most if x is None else x for x in out]


def phrase_counts(texts: list[np.ndarray], automata: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """(texts, automata): phrases of each text's parse, a new one at least every SEGMENT symbols.

    A letter that an automaton's sample lacks ends a phrase and goes with the next one.
    """
    of = np.repeat(np.arange(len(texts)), [-(-len(t) // SEGMENT) for t in texts])
    whole = np.zeros((len(of), SEGMENT), np.int32)
    size = np.zeros(len(of), np.int64)
    at = 0
    for t in texts:
        n = -(-len(t) // SEGMENT)
        whole[at : at + n].ravel()[: len(t)] = t
        size[at : at + n] = SEGMENT
        if n:
            size[at + n - 1] = len(t) - SEGMENT * (n - 1)
        at += n
    order = np.argsort(-size, kind="stable")
    steps = np.ascontiguousarray(whole[order].T)
    active = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")
    out = np.zeros((len(texts), len(automata)))
    codes = int(whole.max()) + 1 if whole.size else 1
    for k, (base, owner, target, first) in enumerate(automata):
        width = len(first)
        known = steps if codes <= width else np.where(steps < width, steps, width)
        begin = np.r_[first, np.int32(0)]
        state, broken = np.zeros(len(of), np.int32), np.ones(len(of), np.int32)
        for i, n in enumerate(active.tolist()):
            if not n:
                break
            c, s = known[i, :n], state[:n]
            at = base.take(s) + c
            on = owner.take(at) == s
            broken[:n] += ~on
            state[:n] = np.where(on, target.take(at), begin.take(c))
        out[:, k] = np.bincount(of[order], weights=broken, minlength=len(texts)) if len(of) else 0
    return out


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """The language with the fewest bits a letter, how much fewer than the next one's, as a share of those, and
    whether the text is within that language's limit and far enough from the next one."""
    names, n = model["languages"], len(texts)
    lang, score, fits = [UNKNOWN] * n, [0.0] * n, [False] * n
    group: list[tuple[int, np.ndarray]] = []

    def judged() -> None:
        bits = phrase_counts([c for _, c in group], model["automata"]) * np.array(model["bits"])
        best = bits.argmin(axis=1)
        least = np.sort(bits, axis=1)
        for (i, c), b, row in zip(group, best.tolist(), least):
            lang[i] = names[b]
            score[i] = float(1 - row[0] / row[1]) if len(row) > 1 else 1.0
            fits[i] = score[i] >= model["margin"] and bool(row[0] - FREE * model["bits"][b] <= model["limits"][b] * len(c))
        group.clear()

    size = 0
    for i, text in enumerate(texts):
        if not (names and text) or not (own := symbols(text, model["alphabet"])).any() or not any(map(str.isalpha, text)):
            continue
        group.append((i, own))
        size += len(own)
        if size >= AT_ONCE:  # bounded memory, however many texts
            judged()
            size = 0
    if group:
        judged()
    return lang, score, fits


def identified(text: Column, model: Broadcast) -> Column:
    """struct<lang_pred, score, fits> for each text, by a broadcast model."""

    @F.pandas_udf("lang_pred string, score double, fits boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        ease()
        lang, score, fits = predict(model.value, [*texts])
        return pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float), "fits": pd.Series(fits, dtype=bool)})

    return guess(text)


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of documents (doc_id, text, lang).

    held_out rows, whose crc32(doc_id) mod 3 is 1, are never learnt from; the prediction sees the text alone.
    `und` with score 0 is given to a null text, one without a letter, and all texts where nothing could be
    learnt, as on an empty table. A null doc_id isn't held out. Equal texts get equal predictions; of
    languages that need as many bits the first by name wins, with score 0.
    """
    model = documents.sparkSession.sparkContext.broadcast(learn(documents))  # bounded: see ALL_CHARS
    rows = needs(documents, "doc_id", "text").withColumn("p", identified(F.col("text"), model))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "p.lang_pred", "p.score")


def known_languages(documents: DataFrame, least: float = 0.0) -> DataFrame:
    """documents without those in no language that could be learnt.

    These are `und`; those that fit two languages nearly alike (see PART) or have a score below least; and those
    beyond what texts of their language need: gibberish, or a language that isn't learnt (see TIMES).
    """
    model = documents.sparkSession.sparkContext.broadcast(learn(documents))
    p = fresh(documents, "_language")
    found = documents.withColumn(p, identified(F.col("text"), model))
    told = (F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.score") > 0) & (F.col(f"{p}.score") >= least) & F.col(f"{p}.fits")
    return found.where(told).drop(p)
