"""Source divergence audit: how far the term frequencies of a language's sources differ, by a heavy-light split.

A group is a (lang, source) of the corpus, and p its smoothed share of a term in billionths. The distance of two
groups is the sum of |p - p'| over all kept terms of the language, in whole numbers. Terms that many groups have are
laid out as dense numpy tiles of groups by terms. The others are a sparse matter: a group without the term has its
default share p0, so the sum is that of the defaults, changed by what each group's own terms differ from the other's
default, which depends on the group's distinct shares alone, and corrected for the pairs of groups on one posting
list. Both partial sums are of 64-bit integers and add up exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, ease, if_small, needs, small_batches, text_of

#: A term is kept if it is in so many documents of the language.
LEAST_DOCS = 30
#: Added to every count, and what shares are multiplied by.
ADDED = 5
SCALE = 1_000_000_000
#: Ranks of terms that a group reports.
TOP_TERMS = 50
#: A term in more groups than this share of a language's, or than MOST_LIGHT, is heavy; in FEWEST or fewer it is light.
HEAVY_SHARE = 1 / 8
FEWEST = 4
MOST_LIGHT = 512
#: Groups and terms to a side of a dense tile, and light postings of a task.
TILE_GROUPS = 256
TILE_TERMS = 2048
POSTINGS = 200_000
#: Counts that a task holds before it passes them on.
HELD = 400_000

#: A-Z to a-z, every other character of ASCII but a letter to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_PAIRS = "lang string, g int, h int, value long"


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in order: runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def _count(most: int):
    """(lang, source, term, n, docs) of a task's texts, passed on whenever it holds so many counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            langs, sources, found, n, docs = [], [], [], [], []
            for (lang, source), (counts, within) in held.items():
                size = len(counts) + 1
                langs += [lang] * size
                sources += [source] * size
                found += [*counts, None]  # the null term stands for the group itself
                n += [*counts.values(), 0]
                docs += [*map(within.__getitem__, counts), 0]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                counts, within = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text.as_py())
                counts.update(found)
                within.update(set(found))
            ease()
            if sum(len(c) for c, _ in held.values()) > most:
                yield rows()
        yield rows()

    return count


def kept_counts(documents: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n) for the kept terms that a group has, and a row with a null term for each group."""
    docs = needs(documents, "lang", "source", "text").select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    with small_batches(documents.sparkSession):
        counted = docs.mapInArrow(_count(HELD), "lang string, source string, term string, n long, docs long")
        sums = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        return cut(
            sums.withColumn("_docs", F.sum("docs").over(Window.partitionBy("lang", "term")))
            .where((F.col("_docs") >= least_docs) | F.col("term").isNull())
            .select("lang", "source", "term", "n")
        )


def _smoothed(count: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED terms)), exactly; null where there are no terms."""
    above = (count + ADDED).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.nullif(total + ADDED * terms_, F.lit(0).cast("long")).cast("decimal(29,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _spread(rows: DataFrame) -> DataFrame:
    """rows of (block, blocks, ...) once for each pair of blocks (i, j), i <= j, that theirs is one of."""
    each = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("_other")


def _sides(key_i: int, key_j: int, groups: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the groups of either block of side groups, the same ones where the blocks are."""
    block = groups // side
    return np.flatnonzero(block == key_i), np.flatnonzero(block == key_j)


def _pair_rows(lang: str, i: np.ndarray, j: np.ndarray, groups: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """Rows of the pairs g < h of a table value of i by j."""
    g, h = np.broadcast_arrays(groups[i][:, None], groups[j][None, :])
    once = g < h
    return pd.DataFrame({"lang": lang, "g": g[once].astype(np.int32), "h": h[once].astype(np.int32), "value": value[once]})


def _dense(key, rows: pd.DataFrame, side: int) -> pd.DataFrame:
    """Sums of |p - p'| over a tile's heavy terms, less what the defaults of either group make of them."""
    lang, _, block_i, block_j = key
    heads, cells = rows[rows.term.isnull()].sort_values("gid"), rows[rows.term.notnull()]
    groups = heads.gid.to_numpy()
    codes, names = pd.factorize(cells.term)
    table = np.repeat(heads.p0.to_numpy()[:, None], len(names), axis=1)
    table[np.searchsorted(groups, cells.gid.to_numpy()), codes] = cells.p.to_numpy()
    i, j = _sides(block_i, block_j, groups, side)
    p0 = heads.p0.to_numpy()
    value = np.array([np.abs(table[j] - table[a]).sum(axis=1) - len(names) * np.abs(p0[j] - p0[a]) for a in i], np.int64).reshape(len(i), len(j))
    return _pair_rows(lang, i, j, groups, value)


def _defaults(key, rows: pd.DataFrame, side: int) -> pd.DataFrame:
    """The defaults' difference for every term, and what either group's own light terms change of it against the
    other's default, by prefix sums over the sorted shares."""
    lang, block_i, block_j = key
    heads, shares = rows[rows.p.isnull()].sort_values("gid"), rows[rows.p.notnull()].sort_values(["gid", "p"])
    groups, p0, every = heads.gid.to_numpy(), heads.p0.to_numpy(), int(heads.n.iloc[0])
    own = {g: (s.p.to_numpy(np.int64), s.n.to_numpy(np.int64)) for g, s in shares.groupby("gid")}
    none = np.zeros(0, np.int64)

    def against(at: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), len(others)), np.int64)
        for a, place in enumerate(at):
            p, n = own.get(groups[place], (none, none))
            count, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * p))
            x = p0[others]
            below = np.searchsorted(p, x)
            out[a] = x * count[below] - total[below] + (total[-1] - total[below]) - x * (count[-1] - count[below]) - count[-1] * np.abs(p0[place] - x)
        return out

    i, j = _sides(block_i, block_j, groups, side)
    value = every * np.abs(p0[i][:, None] - p0[j][None, :]) + against(i, j) + against(j, i).T
    return _pair_rows(lang, i, j, groups, value)


def _corrections(key, rows: pd.DataFrame) -> pd.DataFrame:
    """For each two groups on one posting list of a light term, what _defaults has too much or too little."""
    rows = rows.sort_values(["term", "gid"])
    codes = pd.factorize(rows.term)[0]
    gid, p, p0 = rows.gid.to_numpy(np.int64), rows.p.to_numpy(np.int64), rows.p0.to_numpy(np.int64)
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    size = np.diff(np.append(first, len(codes)))
    sums: list[pd.DataFrame] = []
    for m in np.unique(size[size > 1]):
        a, b = np.triu_indices(m, 1)
        at_once = max(1, 1_000_000 // len(a))
        starts = first[size == m]
        for s in range(0, len(starts), at_once):
            x, y = starts[s : s + at_once, None] + a, starts[s : s + at_once, None] + b
            value = np.abs(p[x] - p[y]) - np.abs(p[x] - p0[y]) - np.abs(p[y] - p0[x]) + np.abs(p0[x] - p0[y])
            part = pd.DataFrame({"g": gid[x].ravel(), "h": gid[y].ravel(), "value": value.ravel()})
            sums.append(part.groupby(["g", "h"], as_index=False).value.sum())
    if not sums:
        return pd.DataFrame({"lang": pd.Series([], dtype=object), "g": np.zeros(0, np.int32), "h": np.zeros(0, np.int32), "value": np.zeros(0, np.int64)})
    total = pd.concat(sums).groupby(["g", "h"], as_index=False).value.sum()
    return total.assign(lang=key[0], g=total.g.astype(np.int32), h=total.h.astype(np.int32))[["lang", "g", "h", "value"]]


def _with(work, *given):
    """work as a function of a group's key and rows."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return work(key, rows, *given)

    return run


def distances(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, g, h, value) for any two groups g < h of a language.

    groups: (lang, gid, groups, p0), gid from 0 to groups - 1. cells: (lang, gid, term, p, p0) of the terms that a
    group has, every kept term at least once.
    """
    spark = cells.sparkSession
    spread = cells.groupBy("lang", "term").agg(F.count("*").alias("holders")).join(
        if_small(groups.groupBy("lang").agg(F.max("groups").alias("groups"))), "lang"
    )
    heavy = F.col("holders") > F.least(F.greatest(F.floor(F.col("groups") * HEAVY_SHARE), F.lit(FEWEST)), F.lit(MOST_LIGHT))
    split = cut(spread.select("lang", "term", heavy.alias("heavy")))
    numbers = split.groupBy("lang").agg(F.sum(F.col("heavy").cast("long")).alias("heavy_terms"), F.count("*").alias("every_term"))
    block = (F.col("gid") / TILE_GROUPS).cast("int")
    heads = cut(
        groups.join(if_small(numbers), "lang", "left").na.fill(0, ["heavy_terms", "every_term", "p0"])
        .withColumns({"block": block, "blocks": F.ceil(F.col("groups") / TILE_GROUPS).cast("int"), "tiles": F.ceil(F.col("heavy_terms") / TILE_TERMS).cast("int")})
    )
    of_lang = if_small(heads.groupBy("lang").agg(*(F.max(c).alias(c) for c in ("blocks", "tiles"))))
    parted = cut(cells.join(if_small(split), ["lang", "term"]).join(of_lang, "lang").withColumn("block", block))
    tile = F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int")
    columns = ("lang", "tile", "i", "j", "gid", "term", "p", "p0")
    laid = _spread(parted.where("heavy").withColumn("tile", tile)).select(*columns)
    headed = _spread(heads.where("tiles > 0").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))).withColumns(
        {"term": F.lit(None).cast("string"), "p": F.col("p0")}
    )
    dense = laid.union(headed.select(*columns)).groupBy("lang", "tile", "i", "j").applyInPandas(_with(_dense, TILE_GROUPS), _PAIRS)
    light = parted.where("not heavy")
    shares = _spread(light.groupBy("lang", "gid", "block", "blocks", "p").agg(F.count("*").alias("n")))
    columns = ("lang", "i", "j", "gid", "p", "p0", "n")
    sparse = shares.withColumn("p0", F.lit(0).cast("long")).select(*columns).union(
        _spread(heads).withColumns({"p": F.lit(None).cast("long"), "n": F.col("every_term")}).select(*columns)
    )
    defaults = sparse.groupBy("lang", "i", "j").applyInPandas(_with(_defaults, TILE_GROUPS), _PAIRS)
    parts = max(1, light.count() // POSTINGS)
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part")
    corrections = light.select("lang", part, "gid", "term", "p", "p0").groupBy("lang", "part").applyInPandas(_with(_corrections), _PAIRS)
    return dense.union(defaults).union(corrections).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distances and its own terms, largest first.

    Part pair has every other source of the language with the distance (0 where no term is kept), part term the first
    top_terms kept terms whose share in the group is above that in the language, with the difference. Ties go to the
    smaller item in UTF-8. Null text, lang and source count as empty; rows that repeat count as often as they come;
    a group without any term takes part; an empty table gives no rows.
    """
    kept = kept_counts(documents, least_docs)
    found = kept.where("term is not null")
    of_term = cut(found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")))
    of_lang = of_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    place = Window.partitionBy("lang").orderBy("source")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(
        sizes.join(if_small(of_lang), "lang", "left").na.fill(0, ["terms", "lang_total"])
        .withColumns({"gid": F.row_number().over(place) - 1, "groups": F.count("*").over(Window.partitionBy("lang")), "p0": _smoothed(F.lit(0).cast("long"), F.col("total"), F.col("terms"))})
    )
    cells = cut(found.join(if_small(groups), ["lang", "source"]).withColumn("p", _smoothed(F.col("n"), F.col("total"), F.col("terms"))))
    half = distances(groups.select("lang", "gid", "groups", "p0"), cells.select("lang", "gid", "term", "p", "p0"))
    both = cut(half).select("lang", "g", "h", "value")
    both = both.union(both.select("lang", F.col("h"), F.col("g"), "value"))
    names = if_small(groups.select("lang", "gid", "source"))
    pairs = both.join(names.withColumnRenamed("gid", "g"), ["lang", "g"]).join(
        names.select("lang", F.col("gid").alias("h"), F.col("source").alias("item")), ["lang", "h"]
    )
    q = _smoothed(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    own = cells.join(if_small(of_term), ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)}).select(*columns).union(
        ranked.withColumn("part", F.lit("term")).select(*columns)
    )


#: The same over a table documents, in DuckDB's SQL, with the parameters as they stand above.
SQL = rf"""
    with docs as (
        select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
    ), found as materialized (
        select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
    ), kept as materialized (
        select lang, term, count(*) as c from found group by all having count(distinct id) >= {LEAST_DOCS}
    ), langs as (
        select lang, count(*) as v, sum(c) as n from kept group by lang
    ), counted as materialized (
        select lang, source, term, count(*) as c from found semi join kept using (lang, term) group by all
    ), groups as (
        select distinct lang, source from docs
    ), filled as materialized (
        select g.lang, g.source, k.term, coalesce(c.c, 0) as c from groups g join kept k using (lang) left join counted c using (lang, source, term)
    ), sums as (
        select lang, source, sum(c) as n from filled group by all
    ), shares as materialized (
        select lang, source, term, c, 1 + ({SCALE}::hugeint * (c + {ADDED})) // (s.n::hugeint + {ADDED} * v) as p
        from filled join sums s using (lang, source) join langs using (lang)
    ), rows as (
        select g.lang, g.source, 'pair' as part, o.source as item, coalesce(d.value, 0) as value
        from groups g join groups o on g.lang = o.lang and g.source <> o.source
        left join (select a.lang, a.source as one, b.source as other, sum(abs(a.p - b.p)) as value
                   from shares a join shares b on a.lang = b.lang and a.term = b.term group by all) d on d.lang = g.lang and d.one = g.source and d.other = o.source
        union all
        select s.lang, s.source, 'term', s.term, s.p - (1 + ({SCALE}::hugeint * (k.c + {ADDED})) // (l.n::hugeint + {ADDED} * l.v))
        from shares s join kept k using (lang, term) join langs l using (lang) where s.c > 0
    ), ranked as (
        select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows where part = 'pair' or value > 0
    )
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= {TOP_TERMS}
"""
