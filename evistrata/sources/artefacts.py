"""Artefacts of earlier runs: readers of vector and score files, run discovery, and writers of tables and reports."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def read_scores_npz(spark: SparkSession, path: str, score: str = "scores_topm") -> DataFrame:
    """(gene, score, ctx_counts) of an archive of arrays, the highest score of each upper-cased gene. One small file."""
    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
        counts = z["ctx_counts"] if "ctx_counts" in z else np.zeros(len(z["genes"]))
        rows = [(str(g), float(s), int(c)) for g, s, c in zip(z["genes"], z[score], counts, strict=True)]
    t = spark.createDataFrame(rows, "gene string, score double, ctx_counts long").withColumn("gene", S.gene_symbol(F.col("gene"))).where("gene is not null")
    return t.groupBy("gene").agg(F.max(F.struct("score", "ctx_counts")).alias("b")).select("gene", "b.*")


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file of vectors; a head line of two numbers is passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where("size(p) > 2")
    return rows.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, 1 << 30), lambda x: x.cast("double")).alias("vector"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) by suffix: .npz (genes, embeddings), .parquet, .json (gene -> vector or list of vectors, one
    record a line, averaged), else text."""
    low = path.lower()
    if low.endswith(".npz"):
        data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
        with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
            rows = [(str(g), v.astype(float).tolist()) for g, v in zip(z["genes"], z["embeddings"], strict=True)]
        return spark.createDataFrame(rows, "word string, vector array<double>")
    if low.endswith(".parquet"):
        return spark.read.parquet(path).select("word", "vector")
    if low.endswith((".json", ".jsonl")):
        from .records import mean_vector

        raw = spark.read.text(path)
        lists = F.coalesce(F.from_json(F.get_json_object("value", "$.embeddings"), "array<array<double>>"), F.array(F.from_json(F.get_json_object("value", "$.embeddings"), "array<double>")))
        rows = raw.select(S.gene_symbol(F.get_json_object("value", "$.gene")).alias("key"), F.explode(lists).alias("v")).where("key is not null and size(v) > 0")
        return mean_vector(rows, "key", "v").select(F.col("key").alias("word"), "vector")
    return read_text_vectors(spark, path)


def token_lists(path: str, column: str = "text", year: str = "year", first: int | None = None, last: int | None = None) -> Iterator[list[str]]:
    """Token lists of a CSV file's rows, one by one; rows whose year parses and lies outside the window are passed over.

    A fresh iterator per call makes it re-iterable. For files on the driver; corpora go through read_table.
    """
    import re

    with open(path, newline="", encoding="utf-8") as f:
        rows = csv.DictReader(f, escapechar="\\")
        if column not in (rows.fieldnames or []):
            raise ValueError(f"no column {column}")
        for r in rows:
            try:
                y = int(float(r.get(year) or "x"))
            except ValueError:
                y = None
            if y is not None and ((first is not None and y < first) or (last is not None and y > last)):
                continue
            words = re.findall(r"[A-Za-z0-9_]+", (r[column] or "").lower())
            if words:
                yield words


def node_format(nodes: DataFrame, node: str) -> str:
    """ensembl, numeric or symbol: what most of the node ids look like."""
    x = F.col(node).cast("string")
    r = nodes.agg(F.count("*").alias("n"), F.count_if(x.rlike(r"^ENSG\d+")).alias("e"), F.count_if(x.rlike(r"^\d+$")).alias("d")).first()
    return "ensembl" if 2 * r["e"] > r["n"] else "numeric" if 2 * r["d"] > r["n"] else "symbol"


def overlap_report(background: DataFrame, nodes: DataFrame) -> dict[str, int]:
    """How many ids of background(node, score) are nodes, aren't, and how many nodes have no background."""
    a, b = background.select("node").distinct().withColumn("a", F.lit(1)), nodes.select("node").distinct().withColumn("b", F.lit(1))
    r = a.join(b, "node", "outer").agg(F.count(F.col("a") + F.col("b")).alias("shared"), F.count("a").alias("x"), F.count("b").alias("y")).first()
    return {"shared": r["shared"], "only_background": r["x"] - r["shared"], "only_nodes": r["y"] - r["shared"]}


def latest_run(root: str, needed: Sequence[str]) -> Path | None:
    """The newest directory below root, by modification time, that holds all needed files."""
    runs = [d for d in Path(root).iterdir() if d.is_dir() and all((d / n).exists() for n in needed)]
    return max(runs, key=lambda d: (d.stat().st_mtime, d.name), default=None)


def select_run(runs: DataFrame, penalty: str | None = None, mode: str | None = None) -> DataFrame:
    """The run with the best mean PR-AUC, then ROC-AUC, of one penalty; or that of a forced mode."""
    if penalty:
        runs = runs.where(F.col("penalty") == penalty)
    if mode:
        runs = runs.where(F.col("mode") == mode)
    return runs.orderBy(F.desc_nulls_last("mean_pr_auc"), F.desc_nulls_last("mean_roc_auc"), "mode").limit(1)


def read_bundle(spark: SparkSession, root: str, penalty: str, mode: str, names: Sequence[str] = ("summary", "coefficients", "predictions")) -> dict[str, DataFrame]:
    """The tables of one run; those that aren't there are left out."""
    at = Path(root) / penalty / mode
    return {n: spark.read.option("header", True).option("inferSchema", True).csv(str(at / f"{n}.csv")) for n in names if (at / f"{n}.csv").exists()}


def first_readable(paths: Sequence[str], fetch=None, cache: str | None = None) -> bytes:
    """The content of the first path that is there; else of the cache; else fetched, and then cached."""
    for p in [*paths, *([cache] if cache else [])]:
        if Path(p).is_file():
            return Path(p).read_bytes()
    if fetch is None:
        raise FileNotFoundError(f"none of {list(paths)}")
    data = fetch()
    if cache:
        Path(cache).parent.mkdir(parents=True, exist_ok=True)
        Path(cache).write_bytes(data)
    return data


def seed_ids(table: DataFrame, gene: str) -> DataFrame:
    """(node): distinct, cleaned ids of a side table."""
    return table.select(S.gene_id(F.col(gene)).alias("node")).where("node is not null").distinct()


def resolve_table(given: str | None, build) -> str:
    """The given table's path, which must be there, or that of a table built now."""
    if given:
        if not Path(given).exists():
            raise FileNotFoundError(given)
        return given
    return build()


def sibling_baseline(mode_dir: str) -> Path | None:
    """The mode_none directory beside a mode's directory, if there is one."""
    at = Path(mode_dir).parent / "mode_none"
    return at if at.is_dir() else None


# Sinks


def unique_dir(root: str, stem: str) -> Path:
    """root/stem, or root/stem_2, _3 ... : the first that isn't there yet, created."""
    n = 1
    while True:
        at = Path(root) / (stem if n == 1 else f"{stem}_{n}")
        try:
            at.mkdir(parents=True)
            return at
        except FileExistsError:
            n += 1


def write_scores(scores: DataFrame, path: str) -> None:
    """(node, score) as one CSV sorted by falling score; the parts of the directory are in order."""
    scores.orderBy(F.desc("score"), "node").write.mode("overwrite").option("header", True).csv(path)


def write_json(summary: Mapping, path: str) -> None:
    """A summary as indented JSON; numbers that JSON lacks become null."""

    def plain(x):
        if isinstance(x, Mapping):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        if isinstance(x, float | np.floating):
            return float(x) if np.isfinite(x) else None
        return int(x) if isinstance(x, np.integer) else x

    Path(path).write_text(json.dumps(plain(summary), indent=2, sort_keys=True, allow_nan=False) + "\n")


def write_npz(path: str, **arrays) -> None:
    np.savez_compressed(path, **{k: np.asarray(v) for k, v in arrays.items()})


def write_model(path: str, coefficients: DataFrame, predictions: DataFrame, summary: Mapping, folds: DataFrame | None = None, scaler: DataFrame | None = None, components: np.ndarray | None = None) -> None:
    """One directory per mode: coefficients, predictions, ranks, high-ranked false positives, folds, scaler, components and
    a summary. predictions(locus, gene, label, score, rank, ...)."""
    Path(path).mkdir(parents=True, exist_ok=True)
    tables = {"coefficients": coefficients, "predictions": predictions, "top3": predictions.where("rank <= 3"), "false_positives_top3": predictions.where("rank <= 3 and label = 0"), "folds": folds, "scaler": scaler}
    for name, t in tables.items():
        if t is not None:
            t.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    if components is not None:
        write_npz(f"{path}/components.npz", components=components)
    write_json({**summary, "tables": sorted(n for n, t in tables.items() if t is not None)}, f"{path}/summary.json")


def markdown_table(df: DataFrame, digits: int = 4, most: int = 200) -> str:
    """The first `most` rows as a Markdown table; report tables are small."""

    def cell(x) -> str:
        if x is None or (isinstance(x, float) and np.isnan(x)):
            return ""
        return f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(x) for x in r) + " |" for r in df.limit(most).collect())]) + "\n"
