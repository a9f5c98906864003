"""SpotSigs document fingerprints, in DataFrame functions only.

A spot signature is the chain of the next CHAIN content words after an occurrence of a common word (an anchor); further
anchors in between are skipped. A document's fingerprint is its set of signatures, kept as sorted 64-bit hashes and
shown as "<set length>:<128-bit digest of the set>". Only fingerprints and direct comparisons of given pairs by
Jaccard likeness are built, not a search for near-duplicates: no path deals sets by length_class, and op2 compares its
pairs without pruning. `likeness` can prune a pair whose lengths rule a likeness out.

Texts with fewer than FEW chains (no anchors, lists, junk) also take every pair of neighbouring words as a signature,
a single word is its own signature, and a text without letters or digits is its own signature, so that only empty
texts have an empty set.

Defined cases: null text = empty text; two empty sets are alike (1.0), an empty and a non-empty one are not (0.0);
equal texts have equal fingerprints; null doc_id sorts first; rows with equal doc_id follow each other by text hash;
a table of one row is followed by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, partitions

#: Common words of English, German, French and Spanish that chains start from.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "auf", "das", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "des", "du", "est", "et", "la", "le", "les", "pour", "que", "un", "une",
    "con", "de", "del", "el", "en", "las", "los", "no", "por", "se", "su", "y",
)
CHAIN = 2
FEW = 4
_A = "\u0001"


def signatures(text: Column) -> Column:
    """Sorted distinct 64-bit signature hashes of a text."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    words = F.regexp_replace(words, "  +", " ")
    marked = F.regexp_replace(words, "(?<= )(?:" + "|".join(ANCHORS) + ")(?= )", _A)
    link = f"(?: {_A})* [^ {_A}]+"
    chains = F.regexp_extract_all(marked, F.lit(f"{_A}(?=({link * CHAIN}))"), F.lit(1))
    chains = F.transform(chains, lambda c: F.xxhash64(F.replace(c, F.lit(f" {_A}"), F.lit(""))))
    pairs = F.regexp_extract_all(words, F.lit("(?<= )(?=([^ ]+ [^ ]+) )"), F.lit(1))
    whole = F.when(text == "", F.array().cast("array<bigint>")).when(F.trim(words) == "", F.array(F.xxhash64(F.lit("raw"), text))).otherwise(F.array(F.xxhash64(words)))
    pairs = F.transform(pairs, lambda p: F.xxhash64(F.lit("pair"), p))
    few = F.concat(chains, F.when(F.size(pairs) > 0, pairs).otherwise(whole))
    return F.array_sort(F.array_distinct(F.when(F.size(chains) >= FEW, chains).otherwise(few)))


def digest(sigs: Column) -> Column:
    half = lambda *x: F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), half(sigs), half(F.lit("second"), sigs))


def length_class(sigs: Column, at_least: float) -> Column:
    """Sets as alike as `at_least` lie in the same or the next class."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / F.lit(-math.log(at_least))).cast("int")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0 without intersecting them where their lengths rule out `at_least`."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    pruned = F.least(n, m) < F.greatest(n, m) * F.lit(at_least)
    exact = F.try_divide(both, n + m - both)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | pruned, F.lit(0.0)).otherwise(exact)


def _rank(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are <= x, by binary search; null counts as below all."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    held = F.array(*[F.lit(c).cast("long") for c in cuts])

    def step(at: Column, s: Column) -> Column:
        return F.when((at + s <= len(cuts)) & (F.element_at(held, F.least(at + s, F.lit(len(cuts)))) <= x), at + s).otherwise(at)

    return F.when(x.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), step))


def with_next(docs: DataFrame, key: str, columns: list[str], groups: int | None = None) -> DataFrame:
    """docs with next_<column> of the row that follows by ascending key (after the last: the first).

    Keys are cut at sampled quantiles into `groups` runs; each run's first row is also sent to the run before, so one
    shuffle suffices and no task holds more than a run.
    """
    groups = groups or 8 * partitions(docs.sparkSession)
    points = F.percentile_approx(key, [i / groups for i in range(1, groups)], 20 * groups)
    cuts, nulls, least = docs.agg(points, F.count_if(F.col(key).isNull()), F.min(key)).first()
    cuts = sorted({*(cuts or []), *([least] if nulls and least is not None else [])})
    k = F.col(key)
    run = _rank(k, cuts)
    is_first = k.isNull() if nulls else k.eqNullSafe(F.lit(least))
    place = lambda at, ghost: F.struct(at.cast("int").alias("run"), F.lit(ghost).alias("ghost"))
    starts = k.isin(cuts) if len(cuts) < 32 else F.array_contains(F.array(*[F.lit(c).cast("long") for c in cuts]), k)
    places = F.array_compact(F.array(place(run, 0), F.when(starts, place(run - 1, 1)), F.when(is_first, place(F.lit(len(cuts)), 2))))
    spread = docs.withColumn("place", F.explode(places)).select("*", "place.run", "place.ghost").drop("place")
    w = Window.partitionBy("run").orderBy(F.when(F.col("ghost") == 2, 1).otherwise(0), F.col(key).asc_nulls_first(), F.xxhash64(*columns))
    return spread.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("ghost = 0").drop("run", "ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, sigs."""
    return docs.select("doc_id", clean_text().alias("text")).withColumn("sigs", signatures(F.col("text")))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "doc_id", ["text", "sigs"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    out = docs.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited")).withColumn("edited_sigs", signatures(F.col("edited")))
    sigs, other, after = F.col("sigs"), F.col("edited_sigs"), F.col("next_sigs")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest(sigs).alias("fingerprint"),
        digest(other).alias("edited_fingerprint"), likeness(sigs, other).alias("near_edited"), likeness(sigs, after).alias("near_next"),
    )
