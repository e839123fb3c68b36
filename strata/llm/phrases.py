"""Phrase collocations: frequent runs of words, scored by how far their parts attract each other.

Words that are frequent enough get 32-bit ids; a piece of text breaks at any other word, as no frequent phrase
holds one. The phrases of each length are runs of ids, packed into binary keys of fixed width, counted within a
task by sorting and run lengths, dealt to ranges of keys, radix-sorted there by Spark and counted by run lengths
once more. A phrase is only counted where both phrases that are one word shorter are frequent, as far as a table of
these is small enough to hand out; above that bound all runs are counted, with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, ease, if_small, needs, remove_folder, shared_folder, small_batches

#: A phrase of MOST_WORDS words or fewer is a candidate if it occurs LEAST times.
LEAST = 100
MOST_WORDS = 5
#: A candidate goes if a longer one that holds it occurs this many hundredths as often.
SHARE = 100
#: Phrases of a language that are returned.
TOP = 2000
#: Words in the dictionary that each worker holds; rarer ones, if there are more, are joined.
HEAD_WORDS = 1_000_000
#: Phrases of a length that are handed out for counting the next length.
HANDED_OUT = 2_000_000
#: Counts that a task holds before it passes them on, and ids that it counts at a time.
HELD = 500_000
IDS = 6_000_000
#: Words whose ids are numbered by one task.
NUMBERED = 200_000

#: A-Z to a-z, a tab to a space, and what separates pieces to a line feed.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def words(raw: bytes) -> list[bytes]:
    """The lower-cased words of a text in order, with a line feed wherever a piece ends."""
    return [w for w in raw.translate(_FOLD).replace(b"\n", b" \n ").split(b" ") if w]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
            yield lang, text.as_py()
        ease()


def _plain(documents: DataFrame) -> DataFrame:
    return needs(documents, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _count_words(most: int):
    """(lang, word, n) of a task's texts, with a null word for all of a language, passed on whenever it holds so many counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        totals: Counter = Counter()

        def rows() -> pa.RecordBatch:
            langs, found, n = [], [], []
            for lang, counts in held.items():
                langs += [lang] * len(counts)
                found += counts.keys()
                n += counts.values()
            for lang, total in totals.items():
                langs.append(lang)
                found.append(None)
                n.append(total)
            held.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for lang, text in _texts(batches):
            found = words(text)
            counts = held.setdefault(lang, Counter())
            counts.update(found)
            totals[lang] += len(found) - counts.pop(b"\n", 0)
            if sum(map(len, held.values())) > most:
                yield rows()
        yield rows()

    return count


def vocabulary(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n, id, key) of the words that occur least times in a language, and (lang, n) of all words.

    An id is unique over all languages and fits 32 bits; key has its four bytes, the highest first.
    """
    with small_batches(documents.sparkSession):
        counted = _plain(documents).mapInArrow(_count_words(HELD), "lang string, word string, n long")
        kept = cut(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least)))
    totals = kept.where("word is null").select("lang", "n")
    found = kept.where("word is not null")
    shares = -(-found.count() // NUMBERED) or 1
    share = F.pmod(F.xxhash64("lang", "word"), F.lit(shares))
    place = F.row_number().over(Window.partitionBy("_share").orderBy("lang", "word")).cast("long")
    numbered = found.withColumn("_share", share).withColumn("id", (place - 1) * shares + F.col("_share") + 1).drop("_share")
    return cut(numbered.withColumn("key", F.unhex(F.lpad(F.hex("id"), 8, "0")))), totals


def _head(found: DataFrame, most: int) -> tuple[dict[str, dict[bytes, int]], bool]:
    """Ids by language and word of the most frequent words, most at the utmost, and whether these are all."""
    sizes = {r.p: r.c for r in found.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}
    least, total = 0, 0
    for power in sorted(sizes, reverse=True):  # each power of two of counts as a whole
        total += sizes[power]
        if total > most:
            least = 2 ** (power + 1)
            break
    ids: dict[str, dict[bytes, int]] = {}
    for r in found.where(F.col("n") >= least).select("lang", "word", "id").toLocalIterator():
        ids.setdefault(r.lang, {})[r.word.encode()] = r.id
    return ids, least == 0


def coded(documents: DataFrame, found: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """(ids): for each text the ids of its frequent words as unsigned 32-bit integers, with zeros where pieces end or
    another word stands."""
    head, complete = _head(found, head_words)
    given = documents.sparkSession.sparkContext.broadcast(head)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, others, langs = [], [], [], []
            for lang, text in _texts(iter([batch])):
                known, run = given.value.get(lang, {}), words(text)
                each = np.fromiter((known.get(w, 0) for w in run), np.uint32, len(run))
                unknown = [] if complete else [i for i in np.flatnonzero(each == 0).tolist() if run[i] != b"\n"]
                langs.append(lang)
                ids.append((each if unknown else _packed(each)).tobytes())
                places.append(unknown)
                others.append([run[i].decode() for i in unknown])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(ids, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.string()))],
                ["lang", "ids", "places", "others"],
            )

    rows = _plain(documents).mapInArrow(code, "lang string, ids binary, places array<int>, others array<string>")
    if complete:
        return rows.select("ids")
    keyed = cut(rows.withColumn("doc", F.monotonically_increasing_id()))
    each = keyed.select("doc", "lang", F.explode(F.arrays_zip("places", "others")).alias("o")).select("doc", "lang", F.col("o.places").alias("place"), F.col("o.others").alias("word"))
    placed = each.join(needs(found, "lang", "word", "id"), ["lang", "word"]).groupBy("doc").agg(F.collect_list(F.struct("place", "id")).alias("rest"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for raw, rest in zip(batch.column("ids").to_pylist(), batch.column("rest").to_pylist()):
                run = np.frombuffer(raw, np.uint32).copy()
                for r in rest or ():
                    run[r["place"]] = r["id"]
                ids.append(_packed(run).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return keyed.select("doc", "ids").join(placed, "doc", "left").mapInArrow(fill, "ids binary")


def _packed(ids: np.ndarray) -> np.ndarray:
    """ids with only those next to another id, and single zeros between runs."""
    there = ids > 0
    beside = np.zeros(len(ids), bool)
    beside[1:] |= there[:-1]
    beside[:-1] |= there[1:]
    run = np.where(there & beside, ids, np.uint32(0))
    keep = run > 0
    keep[1:] |= run[:-1] > 0
    return run[keep]


def _ranks(pairs: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """A number from 1 of each pair: its place in known, 0 if it isn't there; without known, any numbers of these pairs."""
    if known is None:
        return np.unique(pairs, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    if not len(known):
        return np.zeros(len(pairs), np.uint64)
    at = np.searchsorted(known, pairs).clip(max=len(known) - 1)
    return np.where(known[at] == pairs, at + 1, 0).astype(np.uint64)


def _runs(ids: np.ndarray, size: int, known: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys of the distinct runs of so many ids, a row of bytes each, and how often each occurs."""
    wide = ids.astype(np.uint64)
    rank = wide
    for k in range(2, size + 1):
        pairs = rank[:-1] << np.uint64(32) | wide[k - 1 :]
        places = np.flatnonzero((rank[:-1] > 0) & (rank[1:] > 0))
        if k == size:
            order = places[np.argsort(pairs[places], kind="stable")]
            run = pairs[order]
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)])
            counts = np.diff(np.append(first, len(run)))
            return ids[order[first][:, None] + np.arange(size)].astype(">u4").view(np.uint8).reshape(-1, 4 * size), counts
        rank = np.zeros(len(pairs), np.uint64)
        rank[places] = _ranks(pairs[places], known[k - 2])
    raise ValueError(size)


def _rows_of_keys(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    width = keys.shape[1]
    offsets = np.arange(0, (len(keys) + 1) * width, width, dtype=np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])
    return pa.RecordBatch.from_arrays([column, pa.array(counts.astype(np.int64))], ["key", "n"])


def _count_runs(size: int, given: Broadcast, at_once: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero, held, n = np.zeros(1, np.uint32), [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            keys, counts = _runs(np.concatenate([*held, zero]), size, given.value)
            for at in range(0, len(keys), 1 << 17):
                yield _rows_of_keys(keys[at : at + (1 << 17)], counts[at : at + (1 << 17)])
            held.clear()

        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                held += [np.frombuffer(raw, np.uint32), zero]
                n += len(raw) // 4
                if n > at_once:
                    yield from rows()
                    n = 0
        if held:
            yield from rows()
        ease()

    return count


def _run_lengths(size: int, least: int):
    """Sums of n over equal neighbouring keys, where they come to least."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros((0, 4 * size), np.uint8), 0  # the run that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("key")
            start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            rows = np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * 4 * size].reshape(-1, 4 * size)
            keys, counts = np.concatenate([key, rows]), np.concatenate([[n] if len(key) else [], batch.column("n").to_numpy()]).astype(np.int64)
            ids = keys.view(">u4")
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
            sums = np.add.reduceat(counts, first)
            key, n = keys[first[-1:]].copy(), int(sums[-1])
            done = sums[:-1] >= least
            yield _rows_of_keys(keys[first[:-1][done]], sums[:-1][done])
        if n >= least:
            yield _rows_of_keys(key, np.array([n]))

    return total


def frequent_runs(runs: DataFrame, size: int, known: list[np.ndarray | None], least: int = LEAST) -> DataFrame:
    """(key, n) of the runs of so many ids that occur least times in (ids); known has the frequent shorter runs."""
    spark = runs.sparkSession
    counted = runs.mapInArrow(_count_runs(size, spark.sparkContext.broadcast(known), IDS), "key binary, n long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return cut(counted.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_run_lengths(size, least), "key binary, n long"))


def _handed_out(found: DataFrame, size: int, known: list[np.ndarray | None], most: int) -> np.ndarray | None:
    """The frequent runs as sorted pairs of the shorter run's place and the last id; None if they are too many."""
    if found.count() > most or any(k is None for k in known):
        return None
    keys = b"".join(bytes(r.key) for r in found.select("key").toLocalIterator())
    ids = np.frombuffer(keys, ">u4").reshape(-1, size).astype(np.uint64)
    rank = ids[:, 0]
    for k in range(2, size):
        rank = _ranks(rank << np.uint64(32) | ids[:, k - 1], known[k - 2])
    return np.sort(rank << np.uint64(32) | ids[:, size - 1])


def frequent_phrases(
    documents: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, head_words: int = HEAD_WORDS, handed_out: int = HANDED_OUT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, size, n) of all phrases of 1 to most_words words that occur least times, the vocabulary and the totals."""
    spark = documents.sparkSession
    found, totals = vocabulary(documents, least)
    path = shared_folder(spark, "phrases")
    with small_batches(spark):
        coded(documents, found, head_words).where("octet_length(ids) > 0").write.parquet(path)
    runs = spark.read.parquet(path)
    grams, known = found.select("key", F.lit(1).alias("size"), "n"), []
    for size in range(2, most_words + 1):
        level = frequent_runs(runs, size, known, least)
        if level.isEmpty():
            break
        grams = grams.union(level.select("key", F.lit(size).alias("size"), "n"))
        known.append(_handed_out(level, size, known, handed_out))
    remove_folder(spark, path)
    return cut(grams), found, totals


def _part(first: Column, size: Column) -> Column:
    """The key of size words of key from the word at first, counted from 0."""
    return F.substring(F.col("key"), first * 4 + 1, size * 4)


def collocations(
    documents: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, share: int = SHARE, top: int = TOP,
    head_words: int = HEAD_WORDS, handed_out: int = HANDED_OUT,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, a and phrase.

    a is how often the phrase occurs within pieces, overlaps included, n the number of words of the language, l and r
    how often the two parts occur at the cut with the lowest floor(1000 a n / (l r)), the first such cut on ties.
    A phrase goes if a longer candidate that holds it occurs share hundredths as often or more. A null text counts as
    empty, a null language as und; rows that repeat count as often as they come; an empty table gives no rows.
    Products are decimals of 38 digits, so they are exact to 10 ** 19 words.
    """
    grams, found, totals = frequent_phrases(documents, least, most_words, head_words, handed_out)
    rows = grams.count()
    candidates = grams.where("size > 1")
    counts = if_small(grams.select("key", "n"), rows)
    vocabulary_rows = found.count()
    words_of = if_small(found.select("key", "lang", "word"), vocabulary_rows)
    cuts = candidates.select("key", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size").select(
        "key", "a", "k", _part(F.lit(0), F.col("k")).alias("left"), _part(F.col("k"), F.col("size") - F.col("k")).alias("right")
    )
    parts = cuts.join(counts.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    first = parts.join(words_of.select(F.col("key").alias("_first"), "lang"), F.substring("key", 1, 4) == F.col("_first")).join(
        if_small(totals), "lang"
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (wide("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * wide("n")
    scored = first.withColumn("_above", above).withColumn("_below", wide("l") * wide("r")).withColumn("score", F.expr("_above div _below"))
    lowest = scored.groupBy("lang", "key", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size > 2").select("key", "n", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k")).select(
        "key", "n", "k", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("at")
    )
    longer = inner.select(_part(F.col("at"), F.col("k")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("_longer"))
    stay = lowest.join(longer, "key", "left").where(f"_longer is null or 100 * _longer < {share} * a")
    each = stay.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), (F.octet_length("key") / 4).cast("int") - 1), lambda i: _part(i, F.lit(1)))).alias("at", "_word"))
    spelt = each.join(words_of.select(F.col("key").alias("_word"), "word"), "_word").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stay.join(spelt, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same over a table documents, in DuckDB's SQL, with the parameters as they stand above.
SQL = rf"""
    with texts as (
        select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
    ), pieces as (
        select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from texts
    ), totals as (
        select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang
    ), runs as (
        select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase from pieces, (select unnest(range(1, {MOST_WORDS + 1})) as k)
    ), counts as materialized (
        select lang, k, phrase, count(*) as f from runs group by all having count(*) >= {LEAST}
    ), cuts as materialized (
        select c.lang, c.k, c.phrase, c.f as a, j, l.f as l, r.f as r, t.n,
               (1000::hugeint * c.f * t.n) // (l.f::hugeint * r.f) as score
        from counts c cross join (select unnest(range(1, {MOST_WORDS})) as j)
        join totals t on t.lang = c.lang
        join counts l on l.lang = c.lang and l.phrase = array_to_string(string_split(c.phrase, ' ')[1:j], ' ')
        join counts r on r.lang = c.lang and r.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')
        where j < c.k
    ), lowest as (
        select *, row_number() over (partition by lang, phrase order by score, j) as o from cuts
    ), longer as (
        select lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') as phrase, max(f) as f
        from counts, (select unnest(range(1, {MOST_WORDS})) as s), (select unnest(range(2, {MOST_WORDS})) as m)
        where m < k and s + m - 1 <= k group by all
    ), ranked as (
        select w.*, row_number() over (partition by w.lang order by w.score desc, w.a desc, w.phrase) as rank
        from lowest w left join longer g on g.lang = w.lang and g.phrase = w.phrase
        where o = 1 and (g.f is null or 100 * g.f < {SHARE} * w.a)
    )
    select lang, cast(rank as bigint) as rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked where rank <= {TOP}
"""
