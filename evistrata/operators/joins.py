"""Joins: intervals, fallback keys, priority cascades, null-safe and outer joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, group: str, window: int, width: int | None = None) -> DataFrame:
    """points(group, position, ...) x spans(group, start, end, ...) where the span overlaps position +- window.

    Both sides are cut into bins of `width`, so the join is an equi-join on (group, bin) that a hot group or a wide
    table can't turn into one task; a pair is emitted in the first bin that both share.
    """
    width = width or 2 * window
    low, high = F.greatest(F.col("position") - window, F.lit(1)), F.col("position") + window
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    p = points.withColumns({"p_low": low, "p_high": high}).withColumn("bin", F.explode(bins(F.col("p_low"), F.col("p_high"))))
    s = spans.withColumn("bin", F.explode(bins(F.col("start"), F.greatest("start", "end"))))
    first = F.greatest(F.floor(F.col("p_low") / width), F.floor(F.col("start") / width))
    return p.join(s, [group, "bin"]).where((F.col("end") >= F.col("p_low")) & (F.col("start") <= F.col("p_high")) & (F.col("bin") == first)).drop("bin", "p_low", "p_high")


PAIRS = 1 << 26  # pairs that a cell may hold before its points are dealt out
ROWS = 1 << 16  # of a batch handed on


def interval_ranks(points: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """points(point, group, position) x spans(span, group, start, end), ids whole numbers and points without repeats ->
    (point, span, distance, rank): the pairs of interval_join, 1..n within the point by (distance, span), null spans last.
    A column `times` of points says how often each of them is there.

    A point lies in one cell of (group, bin), and a span in every cell with points that it may be near, so the pairs are
    made and ranked where the cell is and never travel. Cells of over PAIRS pairs deal their points among pieces that
    all get the cell's spans.
    """
    width = 4 * window
    times = F.col("times") if "times" in points.columns else F.lit(1)
    p = points.where("point is not null and position is not null").select("group", F.floor(F.col("position") / width).alias("bin"), F.lit(True).alias("lead"), F.col("point").alias("id"), F.col("position").alias("a"), F.col("position").alias("b"), times.cast("long").alias("times"))
    near = F.col("start") - window <= F.col("end") + window
    bins = F.sequence(F.floor((F.col("start") - window) / width), F.floor((F.col("end") + window) / width))
    s = spans.where(near).select("group", F.explode(bins).alias("bin"), F.lit(False).alias("lead"), F.col("span").alias("id"), F.col("start").alias("a"), F.col("end").alias("b"), F.lit(1).cast("long").alias("times"))
    both = p.union(s).where("group is not null")
    pieces = F.least(F.count_if("lead"), F.ceil(F.sum(F.when(F.col("lead"), F.col("times"))).cast("double") * F.count_if(~F.col("lead")) / PAIRS))
    hot = both.groupBy("group", "bin").agg(pieces.alias("pieces")).where("pieces > 1")
    n = F.coalesce(F.col("pieces"), F.lit(1))
    piece = F.when(F.col("lead"), F.array(F.pmod(F.xxhash64("id"), n))).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))
    dealt = both.join(F.broadcast(hot), ["group", "bin"], "left").select("group", "bin", F.explode(piece).alias("piece"), "lead", "id", "a", "b", "times")
    cells = dealt.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "bin", "piece").sortWithinPartitions("group", "bin", "piece", "lead", F.col("id").asc_nulls_last())
    small = np.uint16 if window < 1 << 16 else np.int64

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        out, size = [], 0

        def made() -> pa.RecordBatch:
            n = [len(o[1]) for o in out]
            ranks = np.concatenate([np.arange(o[4] + 1, o[4] + k + 1) for k, o in zip(n, out, strict=True)])
            nameless = np.concatenate([o[3] for o in out])
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], n)), pa.array(np.concatenate([o[1] for o in out]), mask=nameless if nameless.any() else None), pa.array(np.concatenate([o[2] for o in out]).astype(np.int64)), pa.array(ranks)], names=["point", "span", "distance", "rank"])

        for b in batches:
            keys = [b[c].to_numpy(zero_copy_only=False) for c in ("group", "bin", "piece", "lead")]
            lows, highs, often = (b[c].to_numpy() for c in ("a", "b", "times"))
            ids, void = b["id"].fill_null(0).to_numpy(), b["id"].is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for i, j in zip([0, *new], [*new, b.num_rows], strict=True) if b.num_rows else ():
                cell = tuple(k[i] for k in keys[:3])
                if cell != at:
                    at, held, ready = cell, [], None
                if not keys[3][i]:
                    held.append((ids[i:j], lows[i:j], highs[i:j], void[i:j]))
                    continue
                if not held:
                    continue
                if ready is None:  # all spans of a cell come before its points, by id
                    ready = [np.concatenate(v) for v in zip(*held, strict=True)]
                span, start, end, no = ready
                for point, position, n in zip(ids[i:j].tolist(), lows[i:j].tolist(), often[i:j].tolist(), strict=True):
                    hit = np.flatnonzero((end >= max(position - window, 1)) & (start <= position + window))
                    if not len(hit):
                        continue
                    far = np.maximum(np.maximum(start[hit] - position, position - end[hit]), 0).astype(small)
                    order = np.argsort(far, kind="stable")
                    step = len(hit) if n == 1 else max(1, ROWS // n)
                    for k in range(0, len(hit), step):
                        some = order[k : k + step] if n == 1 else np.repeat(order[k : k + step], n)
                        out.append((point, span[hit[some]], far[some], no[hit[some]], k * n))
                        size += len(some)
                        if size >= ROWS:
                            yield made()
                            out, size = [], 0
        if out:
            yield made()

    return cells.mapInArrow(rank, "point long, span long, distance long, rank long")


def fallback_join(left: DataFrame, first: DataFrame, second: DataFrame, first_key: Column, second_key: Column, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """left with `columns` from `first` (keyed by k1), where it has no row from `second` (keyed by k2), and `status`."""
    a = first.select("k1", F.lit(True).alias("hit1"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = second.select("k2", F.lit(True).alias("hit2"), *[F.col(c).alias(f"b_{c}") for c in columns])
    out = left.join(a, first_key == a.k1, "left").join(b, second_key == b.k2, "left")
    status = F.when(F.col("hit1"), names[0]).when(F.col("hit2"), names[1]).otherwise("unmatched")
    return out.select(*left.columns, *[F.when(F.col("hit1"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in columns], status.alias("status"))


def priority_cascade(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """matches(query, priority, target) -> per query the target of the first priority that has any match.

    A priority with several targets is ambiguous: it stops the cascade and resolves to nothing.
    """
    per = matches.distinct().groupBy("query", "priority").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    best = per.groupBy("query").agg(F.min_by(F.struct("priority", "n", "target"), "priority").alias("m"))
    out = queries.select("query").distinct().join(best, "query", "left")
    status = F.when(F.col("m").isNull(), "unmatched").when(F.col("m.n") > 1, "ambiguous").otherwise("resolved")
    return out.select("query", F.col("m.priority").alias("priority"), F.when(F.col("m.n") == 1, F.col("m.target")).alias("target"), status.alias("status"))


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], suffix: str = "_b") -> DataFrame:
    b = b.select(*[F.col(c).alias(f"{c}{suffix}") for c in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}{suffix}"))
    return a.join(b, on).drop(*[f"{k}{suffix}" for k in keys])


def outer_methods(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer join of several tables on one key; other columns get the table's name as prefix."""
    out = None
    for name, t in tables.items():
        t = t.select(key, *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c != key])
        out = t if out is None else out.join(t, key, "outer")
    return out


def overlap_category(flags: dict[str, Column]) -> Column:
    """Names of the true flags joined by "+", or "none"."""
    names = F.concat_ws("+", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()])
    return F.when(names == "", "none").otherwise(names)


def lookup_with_fill(left: DataFrame, key: str, vectors: DataFrame, dim: int, fill: float = 0.0) -> DataFrame:
    """left with `vector` and `has_vector`; vectors(key, vector) that are missing, of another length or all null give
    a vector of `fill`."""
    v = vectors.select(F.col("key").alias("key__"), F.col("vector").alias("v__")).where(F.size("v__") == dim)
    out = left.join(v, left[key] == F.col("key__"), "left")
    has = F.col("v__").isNotNull()
    return out.select(*left.columns, F.coalesce("v__", F.array_repeat(F.lit(fill), dim)).alias("vector"), has.cast("int").alias("has_vector"))


def suffixed_join(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join in which right columns that left has too get the suffix."""
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c != key}
    r = right.select(F.col(key).alias("key__"), *[F.col(c).alias(n) for c, n in names.items()])
    return left.join(r, left[key] == F.col("key__"), "left").drop("key__")


def aligned(scores: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """scores on the reference's keys; fails at run time where a key has no score or a reference value is not positive."""
    r = reference.select(F.col(key).alias("key__"), F.col(value).alias("reference"))
    out = r.join(scores.select(key, F.col(value).alias("score")), F.col("key__") == F.col(key), "left")
    ok = F.col(key).isNotNull() & (F.col("reference") > 0)
    checked = F.when(ok, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no score, or no positive reference, for "), F.col("key__").cast("string"))).cast("double"))
    return out.select(F.col("key__").alias(key), checked.alias("score"), "reference")


def coalesced_id(left: DataFrame, choices: dict[str, Column]) -> DataFrame:
    """left with `gene_id`, the first choice that isn't null, and `id_source`, its name or "missing"."""
    name = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in choices.items()], F.lit("missing"))
    return left.withColumns({"gene_id": F.coalesce(*choices.values()), "id_source": name})


def unordered_pairs(df: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """Each pair a < b of rows (of one group), with both rows as structs. For small tables: the pairs are the result."""
    side = lambda n: df.select(*[F.col(g) for g in group or []], F.struct(*df.columns).alias(n))
    a, b = side("a"), side("b")
    pairs = a.join(b, group) if group else a.join(b, F.col("a")[key] < F.col("b")[key])
    return pairs.where(F.col("a")[key] < F.col("b")[key])


def grid(spark, **axes) -> DataFrame:
    """Every combination of the axes' values."""
    out = None
    for name, values in axes.items():
        d = spark.createDataFrame([(v,) for v in values], [name])
        out = d if out is None else out.crossJoin(d)
    return out


def mapping_report(ids: DataFrame, gene: str, nodes: DataFrame, node: str, samples: int = 10) -> DataFrame:
    """One row: how many distinct cleaned ids there are, carry a version, are nodes or aren't, with samples of the latter two."""
    raw = F.trim(gene)
    rows = ids.select(F.substring_index(raw, ".", 1).alias("id"), F.contains(raw, F.lit(".")).alias("versioned")).where("id <> ''").groupBy("id").agg(F.bool_or("versioned").alias("versioned"))
    hit = rows.join(nodes.select(F.col(node).alias("id"), F.lit(True).alias("in")).distinct(), "id", "left").withColumn("in", F.coalesce("in", F.lit(False)))
    # Samples by id; the sets are cut in each task before they meet.
    least = lambda on: F.array_join(F.slice(F.array_sort(F.collect_set(F.when((F.col("in") == on) & (F.col("r") <= samples), F.col("id")))), 1, samples), "|")
    ranked = hit.withColumn("r", F.row_number().over(Window.partitionBy("in").orderBy("id")))
    return ranked.agg(F.count("*").alias("n_ids"), F.count_if("versioned").alias("n_versioned"), F.count_if("in").alias("n_mapped"), F.count_if(~F.col("in")).alias("n_unmapped"), least(True).alias("mapped_sample"), least(False).alias("unmapped_sample"))
