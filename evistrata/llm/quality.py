"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into blocks of BLOCK bytes,
every block is compressed under both dictionaries (blocks keep the dictionaries, not the text's own history, in
charge), and the sizes are summed. The size difference, normalised by the larger size and by the text's length, and
the compressed share are turned into a probability by a logistic calibration fitted on labelled rows that the
dictionaries haven't seen.

Bounds: at most PER_CLASS texts of each class, of any length, feed a dictionary, with at most SAMPLE_BLOCKS of their
blocks, and CALIBRATION texts the calibration, chosen by hash. Only those blocks and three numbers a calibration text
reach the driver. All texts are scored, whole.

Defined cases: null text = empty text; an empty text has all features 0 and so one fixed score; null or unknown
labels aren't learned from; without both labels the score is the share of label 1 (0.5 without any); repeated rows
each get a score; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, keep

PER_CLASS = 1000
CALIBRATION = 4000
SAMPLE_BLOCKS = 8000
DICTIONARY_BYTES = 30_000
BLOCK = 400
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def build_dictionary(blocks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train from: as many blocks as a dictionary holds
        return b" ".join(blocks[: DICTIONARY_BYTES // (BLOCK + 1)]) or b" "


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text) -> (part, h, block): every block of every text, with a hash that decides which are taken."""
    for batch in batches:
        for b in byte_slices(batch, "text"):
            parts, hashes, blocks = [], [], []
            for doc_id, part, t in zip(b["doc_id"].to_pylist(), b["part"].to_pylist(), b["text"], strict=True):
                text = t.as_py() or b""
                for i in range(0, len(text), BLOCK):
                    parts.append(part)
                    hashes.append(xxhash.xxh64_intdigest(f"{doc_id}:{i}") >> 1)
                    blocks.append(text[i : i + BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(hashes, pa.int64()), pa.array(blocks, pa.binary())], names=["part", "h", "block"])


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        made = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
        for d in made:
            d.precompute_compress(level=LEVEL)
        self.under = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False) for d in made]

    def features(self, text: bytes) -> tuple[float, float, float]:
        if not text:
            return 0.0, 0.0, 0.0
        good, bad = (c.compress for c in self.under)
        g = b = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            g += len(good(block))
            b += len(bad(block))
        return (b - g) / max(b, g), (b - g) / len(text), g / len(text)


def _design(f: np.ndarray) -> np.ndarray:
    d, e, r = f.T
    r = np.minimum(r, 2.0)
    return np.stack([np.ones(len(f)), d, e, r, d * d, r * r, d * r, np.log(r + 0.02)], axis=1)


def calibrate(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method on standardised columns."""
    x, y = _design(features), labels.astype(float)
    mean, std = x.mean(0), x.std(0) + 1e-9
    mean[0], std[0] = 0.0, 1.0
    z, w = (x - mean) / std, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x))
    penalty[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    out = w / std
    out[0] = w[0] - (w * mean / std)[1:].sum()
    return out


def scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(features) @ weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> tuple[bytes, bytes, np.ndarray] | float:
    """docs(doc_id, text), labels(doc_id, quality) -> dictionaries and calibration, or a constant without both labels."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id"), folds) != 0).select("doc_id", "quality")
    texts = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    usable = keep(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).join(texts.select("doc_id").distinct(), "doc_id"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [usable.where(F.col("quality") == q).orderBy(*order).limit(PER_CLASS).withColumn("part", F.lit(q)) for q in (1, 0)]
    rest = usable.orderBy(F.xxhash64("doc_id", F.lit("calibration")), "doc_id").limit(2 * PER_CLASS + CALIBRATION).withColumn("part", F.lit(2))
    ids = [tuple(r) for part in (*chosen, rest) for r in part.collect()]
    used = {i for i, _, part in ids if part < 2}
    picked = {i: (q, part) for i, q, part in ids if part < 2} | {i: (q, part) for i, q, part in ids if part == 2 and i not in used}
    if not {0, 1} <= {q for q, _ in picked.values()}:
        return float(np.mean([q for q, _ in picked.values()])) if picked else 0.5
    held = [i for i, (_, part) in picked.items() if part == 2]
    if len({picked[i][0] for i in held}) < 2:
        held = list(picked)
    wanted = docs.sparkSession.createDataFrame([(i, part) for i, (_, part) in picked.items()], "doc_id long, part int")  # at most 4 * PER_CLASS + CALIBRATION rows
    mine = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "part", "text")
    blocks = mine.where("part < 2").mapInArrow(_blocks, "part int, h long, block binary")
    some = [[bytes(r["block"]) for r in blocks.where(F.col("part") == k).orderBy("h", "block").limit(SAMPLE_BLOCKS).collect()] for k in (1, 0)]
    good, bad = build_dictionary(some[0]), build_dictionary(some[1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized = Sizes(good, bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([sized.features(t.as_py() or b"") for t in b["text"]], pa.list_(pa.float64()))], names=["doc_id", "f"])

    asked = set(held)
    rows = {r["doc_id"]: r["f"] for r in mine.mapInArrow(measure, "doc_id long, f array<double>").collect() if r["doc_id"] in asked}
    held = sorted(rows)
    return good, bad, calibrate(np.array([rows[i] for i in held]), np.array([picked[i][0] for i in held]))


def score(docs: DataFrame, model: tuple[bytes, bytes, np.ndarray] | float, key: str = "doc_id") -> DataFrame:
    """docs(key, text) -> key, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized = None if isinstance(model, float) else Sizes(*model[:2])
        for b in batches:
            if sized is None:
                s = np.full(b.num_rows, model)
            else:
                f = np.array([sized.features(t.as_py() or b"") for t in b["text"]]).reshape(-1, 3)
                s = scores(f, model[2])
            yield pa.RecordBatch.from_arrays([b[key], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[key, "score", "predicted"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col("text").cast("binary")).mapInArrow(run, f"{key} {kind}, score double, predicted int")


def with_scores(docs: DataFrame, model: tuple[bytes, bytes, np.ndarray] | float) -> DataFrame:
    """docs with all their columns, and predicted__ from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized = None if isinstance(model, float) else Sizes(*model[:2])
        for b in batches:
            if sized is None:
                s = np.full(b.num_rows, model)
            else:
                s = scores(np.array([sized.features(t.as_py() or b"") for t in b["text"].cast(pa.binary())]).reshape(-1, 3), model[2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((s >= THRESHOLD).astype(np.int32))], names=[*b.schema.names, "predicted__"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("predicted__", T.IntegerType())]))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
