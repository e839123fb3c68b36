"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark SQL functions alone.

A sketch is the k smallest distinct hashes of a document's word shingles, ascending. Sketches of parts merge
into the sketch of the whole, and two of them estimate resemblance, containment and how many distinct
shingles there are. Everything is a column expression, so it runs inside the JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import needs, text_of

#: Hashes kept of a document, and words in a shingle.
K = 128
SHINGLE = 5
#: Rows that a range of neighbouring documents is to hold, and the most ranges.
RANGE_ROWS = 1500
MOST_RANGES = 16_384


def words(text: Column) -> Column:
    """The lower-cased words between runs of ASCII white space; none for a text without any."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: a lambda's variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """A 64-bit hash of each n-word shingle, repeats included: of the hashes of its words, in order.

    Fewer words than n, but some, make one shingle; no words make none.
    """

    def of(each: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(each) - F.lit(n - 1)), lambda i: F.xxhash64(*(F.get(each, i + (j - 1)) for j in range(n))))
        few = F.when(F.size(each) == 0, F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(each)))
        return F.when(F.size(each) <= n, few).otherwise(runs)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The k smallest distinct shingle hashes of the whole text, ascending; empty for a text without words.

    A null text counts as empty. Equal texts have equal sketches.
    """
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, n))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together, from the sketches of each."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of shared distinct shingles over all distinct shingles, 0 to 1; two empty sketches give 1.

    It is exact where both documents together have at most k distinct shingles.
    """

    def of(both: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))

    return let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k of them."""
    share = (F.element_at(a, F.size(a)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's distinct shingles that b has too, 0 to 1; an empty a gives 1."""
    shared = resemblance(a, b, k) * let(merge(a, b, k), lambda both: distinct_shingles(both, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as a string: its hashes in 16 hexadecimal digits each."""
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def next_rows(rows: DataFrame, key: str, columns: list[str], ties: list[str]) -> DataFrame:
    """rows with next_<column> for each of columns: those of the next row by descending key, in a circle.

    Neighbouring keys are dealt to ranges whose bounds are quantiles of the keys, themselves keys that occur;
    the row at a bound is also sent to the range above, whose last row has it as its next one, so rows are
    shuffled once and no range needs another. Equal keys follow each other in the order of ties; null keys
    come last of all. Their share of the rows is meant to be small, as they make one range.
    """
    spark = rows.sparkSession
    n, top, some = rows.agg(F.count("*"), F.max(key), F.count(key)).first()
    parts = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    steps = [1 << i for i in range(max(1, parts.bit_length()) - 1, -1, -1)]
    bounds = []
    if some:
        share = [i / parts for i in range(1, parts)] + [1.0]
        bounds = sorted({*rows.agg(F.percentile_approx(key, share, 20 * parts)).first()[0]} | {top})
    full = len(bounds)  # the range above the bounds is that of null keys
    padded = F.lit(bounds + [2**63 - 1] * (2 * steps[0] - full)) if bounds else None
    if bounds:
        below = F.aggregate(  # bounds below the key, by binary search
            F.array(*map(F.lit, steps)), F.lit(0), lambda low, s: F.when(F.element_at(padded, low + s) < F.col(key), low + s).otherwise(low)
        )
        at = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(below)
        edge = F.when(F.col(key).isNotNull() & (F.element_at(padded, at + 1) == F.col(key)), F.when(at + 1 == full, F.lit(-1)).otherwise(at + 1))
    else:
        at, edge = F.lit(-1), F.lit(None).cast("int")
    if some == n and full:  # no null keys: the lowest range's last row is followed by the first of all
        edge = F.when(edge == -1, F.lit(0)).otherwise(edge)
    elif full == 0:
        edge = F.lit(-1)
    else:
        # null keys end the circle: they follow the lowest range, whose last row needs the first null row
        edge = F.when(F.col(key).isNull(), F.lit(0)).otherwise(edge)
    twice = rows.withColumns({"_range": at, "_edge": edge}).withColumn(
        "_place", F.explode(F.when(F.col("_edge").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy")))).otherwise(
            F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("copy")), F.struct(F.col("_edge").alias("r"), F.lit(True).alias("copy"))))),
    ).withColumns({"_range": F.col("_place.r"), "_copy": F.col("_place.copy")}).drop("_place", "_edge")
    order = Window.partitionBy("_range").orderBy("_copy", F.col(key).desc_nulls_last(), *ties)
    ahead = twice.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return ahead


def with_neighbours(documents: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, ...).

    One row for each row of documents (doc_id, text), whatever columns else there are. The edited text has
    the last floor(n_chars / 3) code points replaced by as many from the start of the next document's, or by
    all of it if that is shorter; documents follow each other by descending doc_id, rows of the same doc_id by
    text, null ids last, and the first follows the last, so a single document follows itself. Null texts count
    as empty; an empty text has an empty fingerprint, and two of these are alike (1.0).
    Further columns: distinct_shingles, and contained_edited, the share of the text's own shingles kept.
    """
    docs = needs(documents, "doc_id", "text").select("doc_id", text_of().alias("text"))
    after = next_rows(docs, "doc_id", ["text"], ["text"])
    own = after.withColumn("sketch", sketch(F.col("text"), k, n))
    order = Window.partitionBy("_range").orderBy("_copy", F.col("doc_id").desc_nulls_last(), "text")
    both = own.withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("_copy"))
    size = F.length("text")
    cut_off = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut_off), F.substring(F.col("next_text"), F.lit(1), cut_off))
    done = both.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k, n))
    return done.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_edited"),
    )
