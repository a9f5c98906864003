"""SimHash near-duplicate components.

Fingerprints are 64-bit majorities over the XXH64 (seed 42) of word shingles. Pairs within `max_bits` differing bits
are found with an inverted index on byte positions: two such fingerprints agree in at least 8 - max_bits of the eight
positional bytes (the guaranteed count), so among any `max_bits + KEY_BYTES` positions they share KEY_BYTES of them.
Every such combination of positional bytes is one posting key. Within a posting list the bytes shared are tallied for
each pair, pairs under the guaranteed count go, and the rest are verified bit by bit.

Posting lists over LIGHT fingerprints are not paired. Their members take the exact way: all fingerprints within
max_bits / 2 flips of each other meet in a common middle word, so every member sends itself to the words within
max_bits // 2 flips (and for odd max_bits also one flip further), and words are joined by equality. No list grows with
its square and no link is lost.

Defined cases: null text = empty text; no words = fingerprint 0, linked like any other; fewer words than a shingle =
one shingle of all words; equal texts share a fingerprint, hence a component; null doc_id is carried, a component's
id is its smallest non-null doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, components, keep, partitions, running

KEY_BYTES = 4
LIGHT = 1024
GROUP = 512
SHINGLES = 4 << 20
_BLOCK = 1 << 16
_ROWS = 128


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text as a signed 64-bit integer, every occurrence of a shingle counted."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    rows = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else iter([words])
    left = n
    while left > 0:
        h = np.fromiter((h64(join(r), 42) for r, _ in zip(rows, range(min(left, _BLOCK)), strict=False)), np.uint64, count=min(left, _BLOCK))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= _BLOCK
        if left > 0 and shingle <= len(words):
            done = n - left
            rows = zip(*(words[done + i :] for i in range(shingle)), strict=False)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t or b"", shingle) for t in (x.as_py() for x in b["text"])), np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def word_fingerprints(text: bytes, tables: int) -> list[int]:
    """`tables` independent SimHashes of a text's distinct words, as signed 64-bit integers."""
    words = set(text.lower().split())
    if not words:
        return [0] * tables
    h64, h = xxhash.xxh64_intdigest, np.empty((len(words), tables), dtype=np.uint64)
    h[:, 0] = np.fromiter((h64(w, 42) for w in words), np.uint64, count=len(words))
    for i in range(1, tables):  # the finaliser of splitmix64
        x = h[:, 0] + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h[:, i] = x ^ (x >> np.uint64(31))
    ones = np.zeros(64 * tables, dtype=np.int64)
    for at in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[at : at + _BLOCK].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64).tolist()


def _masks(max_bits: int) -> list[int]:
    """Signed 64-bit masks of the KEY_BYTES-byte combinations among max_bits + KEY_BYTES positions."""
    if max_bits + KEY_BYTES > 8:
        raise ValueError("max_bits is at most 4")
    out = []
    for c in combinations(range(max_bits + KEY_BYTES), KEY_BYTES):
        m = sum(0xFF << (8 * p) for p in c)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def _near(f: np.ndarray, start: int, end: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j and i in start..end, whose tally of shared bytes and then whose bits pass."""
    x = (f[start:end, None] ^ f[None, start:]).view(np.uint64)
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
    i, j = np.nonzero(np.triu(tally >= 8 - max_bits, 1))
    ok = np.bitwise_count(x[i, j]) <= max_bits
    return i[ok].astype(np.int32) + start, j[ok].astype(np.int32) + start


def _verify(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Posting lists (t, fps) -> verified links, as a star around the smallest member of each linked set."""
    for b in batches:
        ts, us, vs = [], [], []
        offsets, flat = np.asarray(b["fps"].offsets), np.asarray(b["fps"].values)
        for t, s, e in zip(b["t"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
            f = np.sort(flat[s:e])
            near = [_near(f, at, at + _ROWS, max_bits) for at in range(0, len(f), _ROWS)]
            i, j = (np.concatenate(x) for x in zip(*near, strict=True))
            root = np.arange(len(f))
            while len(i):
                least = root.copy()
                np.minimum.at(least, i, root[j])
                np.minimum.at(least, j, root[i])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            moved = np.flatnonzero(root != np.arange(len(f)))
            ts += [t] * len(moved)
            us += f[moved].tolist()
            vs += f[root[moved]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ts, pa.int32()), pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["t", "u", "v"])


def _flips(fp: Column, most: int) -> Column:
    masks = [0]
    for n in range(1, most + 1):
        masks += [m - (1 << 64) if (m := sum(1 << p for p in c)) >= 1 << 63 else m for c in combinations(range(64), n)]
    return F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m)))


def links(distinct: DataFrame, max_bits: int = 2, light: int = LIGHT) -> DataFrame:
    """distinct(fp, t) -> edges (t, u, v) whose components are those of all pairs of one table t within max_bits bits."""
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("m")) for i, m in enumerate(_masks(max_bits))])
    spread = distinct.repartition(partitions(distinct.sparkSession), F.xxhash64("fp"))  # few rows here, many after the explode
    posts = spread.select("t", "fp", F.explode(keys).alias("k")).select("t", "fp", "k.c", "k.m")
    at = ["t", "c", "m"]
    sizes = keep(posts.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1"))
    lists = posts.join(sizes.where(F.col("n") <= light), at).groupBy(*at).agg(F.collect_list("fp").alias("fps"))
    found = lists.select("t", "fps").mapInArrow(lambda it: _verify(it, max_bits), "t int, u long, v long")
    heavy = sizes.where(F.col("n") > light)
    if heavy.isEmpty():
        return found
    hot = keep(posts.join(heavy.select(*at), at, "left_semi").select("t", "fp").distinct())
    near = hot.select("t", "fp", _flips(F.col("fp"), max_bits // 2).alias("w"))
    if max_bits % 2 == 0:
        least = near.groupBy("t", "w").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("fps"))
        star = least.select("t", F.explode("fps").alias("u"), "v").where("u <> v")
    else:
        far = hot.select("t", F.col("fp").alias("u"), _flips(F.col("fp"), max_bits // 2 + 1).alias("w"))
        star = far.join(near.withColumnRenamed("fp", "v"), ["t", "w"]).where("u <> v").select("t", "u", "v").distinct()
    return found.union(star)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, light: int = LIGHT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text)."""
    fps = keep(fingerprints(docs, shingle))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = components(links(firsts.select("fp", F.lit(0).alias("t")), max_bits, light).select("u", "v"))
    named = firsts.join(root, firsts.fp == root.u, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def candidate_groups(texts: DataFrame, max_bits: int, tables: int, light: int = LIGHT) -> DataFrame:
    """texts(key binary, text) -> (key, group) of every text that shares a group: texts within max_bits bits of each
    other in any of `tables` word fingerprints, and all that are chained so.

    Vertices are 64-bit hashes of keys and of (table, fingerprint); a collision can only widen a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [word_fingerprints(x.as_py() or b"", tables) for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(fps, pa.list_(pa.int64()))], names=["key", "fps"])

    fps = texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key binary, fps array<long>")
    rows = keep(fps.distinct().select(F.xxhash64("key").alias("v"), "key", F.posexplode("fps").alias("t", "fp")))
    point = lambda fp: F.xxhash64(F.col("t"), F.col(fp))
    nodes = keep(rows.groupBy("t", "fp").agg(F.count("*").alias("n")))
    found = keep(links(nodes.select("fp", "t"), max_bits, light))
    shared = nodes.where("n > 1").select("t", "fp").union(found.select("t", "u")).union(found.select("t", "v")).distinct()
    members = rows.join(shared, ["t", "fp"]).select("v", point("fp").alias("u"))
    root = components(members.union(found.select(point("u"), point("v"))))
    # The smallest vertex of a component has no row in root; it may be a text.
    named = root.union(root.select("root", "root").distinct()).withColumnRenamed("u", "v")
    return rows.where("t = 0").join(named, "v").select("key", F.col("root").alias("group"))


def _with_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """texts(..., text) with `sh`, the sorted distinct hashes of the text's word shingles, and their number, for text."""
    others = [f for f in texts.schema.fields if f.name != "text"]
    schema = T.StructType([*others, T.StructField("sh", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64, join = xxhash.xxh64_intdigest, b" ".join
        for batch in batches:
            for b in byte_slices(batch, "text"):
                out = []
                for t in b["text"].cast(pa.binary()):
                    words = (t.as_py() or b"").lower().split()
                    rows = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words] * bool(words)
                    out.append(np.unique(np.fromiter((h64(join(r)) for r in rows), np.uint64)).view(np.int64))
                kept = [n for n in b.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[b[n] for n in kept], pa.array(out, pa.list_(pa.int64())), pa.array([len(x) for x in out], pa.int64())], names=[*kept, "sh", "size"])

    return texts.mapInArrow(run, schema)


def _alike(a: np.ndarray, b: np.ndarray, at_least: float) -> bool:
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < at_least * max(n, m):
        return n == m
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= at_least * (n + m - both)


def _greedy(t: pa.Table, at_least: float) -> tuple[pa.Array, pa.Array]:
    """Row numbers of a group's texts that stay, and of those that are alike to one before them that stays."""
    rows = t.select(["first", "key"]).to_pylist()
    sets = [np.asarray(x.values) if len(x.values) else np.zeros(0, np.int64) for x in t["sh"]]
    stay, gone = [], []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["first"] is None, rows[i]["first"] or 0, rows[i]["key"])):
        (gone if any(_alike(sets[i], sets[j], at_least) for j in stay) else stay).append(i)
    return pa.array(stay, pa.int64()), pa.array(gone, pa.int64())


def _unlike(t: pa.Table, others: pa.Table, at_least: float) -> pa.Table:
    """The rows of t that are alike to none of the others, by postings of the others' shingles."""
    sizes = np.fromiter((len(x.values) if x.is_valid else 0 for x in others["sh"]), np.int64, count=len(others))
    flat = np.concatenate([np.asarray(x.values, dtype=np.int64) for x in others["sh"] if len(x.values)] or [np.zeros(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    shingles, owner = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    rest = []
    for x in t["sh"]:
        own = np.asarray(x.values, dtype=np.int64)
        low, high = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        both = np.bincount(owner[at], minlength=len(sizes))
        rest.append(not (both >= at_least * (len(own) + sizes - both)).any())
    return t.filter(pa.array(rest, pa.bool_()))


def _settled(large: DataFrame, at_least: float) -> DataFrame:
    """Keys of the texts of large groups that stay by the rule of _greedy, applied to the whole group.

    A group's texts, in order, are cut into chunks of at most GROUP texts and about SHINGLES shingles. In each round the
    first chunks that still hold no more than that together are settled in one task a group, and each later chunk is
    freed, in a task of its own, from texts alike to one of those that stay. No text is passed over and no pairs are
    listed.
    """
    spark = large.sparkSession
    order = ["group", "null", "first", "key"]
    ranked = keep(running(large.select("group", F.col("first").isNull().alias("null"), "first", "key", "size"), order, {"before": "size"}))
    starts = ranked.groupBy("group").agg(F.min("row_index").alias("start"), F.min("before").alias("base"))
    chunk = F.floor((F.col("row_index") - F.col("start")) / GROUP) + F.floor((F.col("before") - F.col("base")) / SHINGLES)
    chunks = ranked.join(starts, "group").select("key", chunk.alias("chunk"))
    left = keep(large.select("group", "first", "key", "sh", "size").join(chunks.hint("merge"), "key").select("group", "chunk", "first", "key", "sh", "size"))
    stay = spark.createDataFrame([], "key binary")
    while not left.isEmpty():
        counts = left.groupBy("group", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        w = Window.partitionBy("group").orderBy("chunk")
        fits = ((F.sum("n").over(w) <= GROUP) & (F.sum("size").over(w) <= SHINGLES)) | (F.row_number().over(w) == 1)
        due = keep(counts.select("group", "chunk", fits.alias("due")))
        block = left.join(due.where("due").hint("merge"), ["group", "chunk"]).select("group", "first", "key", "sh")
        kept = keep(block.groupBy("group").applyInArrow(lambda t: t.take(_greedy(t, at_least)[0]), block.schema))
        stay = stay.union(kept.select("key"))
        later = due.where("not due").select("group", "chunk")
        heads = kept.join(later, "group").select("group", "chunk", "sh")
        waiting = left.join(later.hint("merge"), ["group", "chunk"]).select(*left.columns)
        left = keep(waiting.groupBy("group", "chunk").cogroup(heads.groupBy("group", "chunk")).applyInArrow(lambda t, others: _unlike(t, others, at_least), left.schema))
    return stay


def deduplicate(docs: DataFrame, shingle: int = 5, at_least: float = 0.8, max_bits: int = 4, tables: int = 4) -> DataFrame:
    """docs without near-copies: a row goes when its text's word shingles are at least `at_least` alike (Jaccard) to
    those of an earlier row of its candidate group, by (doc_id, text hash), that stays.

    Candidate groups are the components of texts within max_bits bits in any of `tables` SimHashes of distinct words.
    Small groups are settled in one task, larger ones by the same rule in rounds (see _settled). Exact copies, repeated
    rows included, are one text, known by its SHA-256. Joins that carry texts are sort-merge joins at every size: their
    other sides grow with the corpus. Rows travel as one struct, so no column name of docs can clash.
    """
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"), F.col("doc_id").alias("id"))
    keyed = rows.select("key", "id", F.col("row.text").alias("text"))
    ids = keep(keyed.groupBy("key", "id").agg(F.count("*").alias("n")).groupBy("key").agg(F.min("id").alias("first"), F.max("n").alias("n")))
    grouped = keep(candidate_groups(keyed.select("key", "text"), max_bits, tables))
    sizes = keep(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    many = keep(grouped.join(sizes.select("group"), "group").join(ids, "key").select("group", "key", "first"))
    texts = keyed.join(many.hint("merge"), (keyed.key == many.key) & keyed.id.eqNullSafe(many["first"])).select("group", "first", many.key, "text")
    sets = keep(_with_shingles(texts.dropDuplicates(["key"]), shingle))
    weights = sets.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    big = keep(weights.where((F.col("n") > GROUP) | ((F.col("total") > SHINGLES) & (F.col("n") > 1))).select("group"))
    small, large = sets.join(big, "group", "left_anti"), sets.join(big, "group", "left_semi")
    gone = small.groupBy("group").applyInArrow(lambda t: t.select(["key"]).take(_greedy(t, at_least)[1]), "key binary")
    if not big.isEmpty():
        gone = gone.union(large.select("key").join(_settled(large, at_least), "key", "left_anti"))
    stay = keep(ids.join(gone, "key", "left_anti"))
    chosen = stay.select(F.col("key").alias("k"), "first")
    out = rows.join(chosen.hint("merge"), (rows.key == F.col("k")) & rows.id.eqNullSafe(F.col("first")))
    if not stay.where("n > 1").isEmpty():
        out = out.dropDuplicates(["key"])
    return out.select("row.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
