"""Normalisers, parsers and scalar mathematics as Column expressions. Missing values are null, never text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(x: Column) -> Column:
    t = F.trim(x.cast("string"))
    return F.when((t == "") | F.lower(t).isin("nan", "none"), None).otherwise(t)


def gene_symbol(x: Column) -> Column:
    return F.upper(blank_to_null(x))


def gene_id(x: Column, level: str = "lenient") -> Column:
    """Without version; `prefix` also asks for ENSG, `strict` for ENSG and digits."""
    out = blank_to_null(F.substring_index(blank_to_null(x), ".", 1))
    if level == "prefix":
        return F.when(out.startswith("ENSG"), out)
    if level == "strict":
        return F.when(out.rlike(r"^ENSG\d+$"), out)
    return out


def chromosome(x: Column) -> Column:
    t = F.upper(F.regexp_replace(blank_to_null(x), "(?i)^chr", ""))
    return F.when(t == "23", "X").when(t == "24", "Y").when(t.isin("25", "M"), "MT").otherwise(t)


def to_double(x: Column) -> Column:
    d = x.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def to_long(x: Column) -> Column:
    return to_double(x).try_cast("bigint")


def to_bool(x: Column) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n"), False)


def numeric_feature(x: Column, fill: float = 0.0) -> Column:
    b = to_bool(x)
    return F.coalesce(to_double(x), F.when(b, 1.0).when(~b, 0.0), F.lit(fill))


# Forms of rsIDs, variants (chromosome, position, ref, alt) and positions.
RSID = r"rs\d+"
VARIANT = r"(?i)^(?:chr)?([0-9]+|x|y|mt|m)[_: -]?([0-9]+)[_: /-]+([acgtn]+)[_: /->]+([acgtn]+)$"
POSITION = r"(?i)^(?:chr)?([0-9]+|x|y|mt|m)[_: -]?([0-9]+)$"


def rsids(x: Column) -> Column:
    """Distinct rsIDs of a text, lower-cased, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(RSID), F.lit(0)))


def rsid(x: Column) -> Column:
    """The text as one rsID, else null."""
    t = F.lower(F.trim(x))
    return F.when(t.rlike(f"^{RSID}$"), t)


def locus_chromosome(x: Column) -> Column:
    """Without "chr", upper-cased, M as MT; null for none. Numbers stay, unlike in `chromosome`."""
    t = F.upper(F.regexp_replace(F.trim(x.cast("string")), "(?i)^chr", ""))
    return F.when(t == "M", "MT").when(t != "", t)


def _place(t: Column, pattern: str) -> list[Column]:
    return [locus_chromosome(F.regexp_extract(t, pattern, 1)), F.regexp_extract(t, pattern, 2).cast("decimal(38,0)").cast("string")]


def variant_id(x: Column) -> Column:
    """chromosome_position_ref_alt from the usual separators, else null."""
    t = F.trim(x)
    return F.when(t.rlike(VARIANT), F.concat_ws("_", *_place(t, VARIANT), *[F.upper(F.regexp_extract(t, VARIANT, i)) for i in (3, 4)]))


def position_id(x: Column) -> Column:
    """chromosome_position, else null."""
    t = F.trim(x)
    return F.when(t.rlike(POSITION), F.concat_ws("_", *_place(t, POSITION)))


def gene_key(gene_id: Column, symbol: Column, row: Column) -> Column:
    """The id, else the symbol, else a name of the row's own, so that rows without both never share a key."""
    return F.coalesce(blank_to_null(gene_id), blank_to_null(symbol), F.concat(F.lit("__missing_gene_row_"), row.cast("string")))


def ordered_join(x: Column, order: Column, sep: str = "|") -> Column:
    """Aggregate: distinct non-blank values in order of first appearance, joined."""
    held = F.transform(F.array_sort(F.collect_list(F.when(F.trim(x) != "", F.struct(order.alias("o"), F.trim(x).alias("v"))))), lambda s: s["v"])
    return F.array_join(F.array_distinct(held), sep)


def attention_rescale(x: Column, most: Column, least_log: Column, most_log: Column) -> tuple[Column, Column]:
    """A weight over the largest, and its logarithm scaled between those of the smallest and largest non-zero weight."""
    linear = F.coalesce(F.try_divide(x, most), F.lit(0.0))
    return linear, F.when(x > 0, F.coalesce(F.try_divide(F.ln(x) - least_log, most_log - least_log), F.lit(1.0))).otherwise(0.0)


def unique_join(x: Column, most: int | None = None, sep: str = "|") -> Column:
    """Aggregate: distinct non-blank values, sorted, joined."""
    values = F.sort_array(F.collect_set(F.when(F.trim(x) != "", F.trim(x))))
    return F.array_join(F.slice(values, 1, most) if most else values, sep)


def first_filled(x: Column, order: Column) -> Column:
    """Aggregate: the first non-blank value by order."""
    filled = F.trim(x) != ""
    return F.min_by(F.when(filled, x), F.when(filled, order))


def interval_distance(position: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - position, position - end, F.lit(0))


def log_distance_score(distance: Column, window: float, near: float = 1000.0) -> Column:
    low, high = math.log10(near), math.log10(window)
    score = 1 - (F.log10(F.greatest(distance, F.lit(near)).cast("double")) - low) / (high - low)
    return F.when(distance <= near, 1.0).when(distance >= window, 0.0).otherwise(clip(score, 0.0, 1.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def thresholded(x: Column, at: float) -> Column:
    """0 below the threshold, above it rescaled to 0..1."""
    return F.when(x < at, 0.0).otherwise(clip((x - at) / (1 - at), 0.0, 1.0))


def squared(x: Column) -> Column:
    return F.pow(F.coalesce(x, F.lit(0.0)), 2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -50.0, 50.0)))


def soft_threshold(x: Column, by: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def standardized(x: Column, mean: Column, scale: Column) -> Column:
    """0 where the scale is missing, zero or not finite."""
    fit = scale.isNotNull() & ~F.isnan(scale) & (scale != 0) & (F.abs(scale) < float("inf"))
    return F.when(fit, F.try_divide(x - mean, scale)).otherwise(0.0)


def sign_of(x: Column, tolerance: float = 0.0) -> Column:
    return F.when(x > tolerance, "+").when(x < -tolerance, "-").otherwise("0")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def l2_normalized(a: Column, eps: float = 1e-12) -> Column:
    n = norm(a) + eps
    return F.transform(a, lambda x: x / n)
