"""Secret scanning over an incremental blob ledger, in DataFrame functions only.

A blob is a text addressed by its SHA-256. The ledger holds every (blob, rule, version) scanned so far. A scan lists
the distinct blobs of all paths (documents), takes from each only the rules whose current version its ledger row
lacks, reads one copy of each such blob, and joins the findings back to all paths that hold the blob.

Positions: a rule's matches and the gaps between them alternate, so a running sum of their lengths gives offsets in
code points; the sum is a window over the matches of one blob and rule.

Defined cases: null text = empty text (no findings); equal texts share findings; null doc_id is carried; repeated rows
each get a result; an empty table gives an empty result; other columns are ignored. Spans of different rules may
overlap; `redact` removes their union. The pem rule finds the BEGIN line, which is what op4 lists; `covered` extends
its span over what must not stay: up to the END line, or over the base64 block where no END line follows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, keep, shared_dir

#: kind -> (version, pattern, least length, group that the length is of). Base kinds first, in their listed order.
RULES: dict[str, tuple[int, str, int, int]] = {
    "assign": (1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (1, r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (1, r"[0-9a-f]{16,}", 16, 0),
    "pem": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, 0),
}
BASE = ("assign", "access", "hex")
KINDS = list(RULES)
KEY_END = r"^-{5,}END [A-Z ]*PRIVATE KEY-{5,}"
_GAP = r"(?:\s|\\[nr])"  # line ends may be written out, as in JSON
_KEY_WORDS = (
    r"(?:Proc-Type|DEK-Info):", r"4,[A-Z-]+", r"[A-Z0-9-]+,[0-9A-Fa-f]{8,}", r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9+/]+={1,2}",
    r"(?<=[A-Za-z0-9+/]{20}(?:\r?\n|(?:\\r)?\\n))[A-Za-z0-9+/]+(?=[\r\n\\]|$)",
)
#: The first gap before a word that no key body holds.
KEY_STOP = rf"{_GAP}(?!{_GAP}|$|(?:{'|'.join(_KEY_WORDS)})(?:{_GAP}|$))"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rule_id(kind: str) -> str:
    return f"{kind}@{RULES[kind][0]}"


def _matches(text: Column, need: Column, kind: str) -> Column:
    """array of (kind, i, gap, len, ok) for one rule; null where the rule isn't needed or doesn't occur."""
    _, pattern, least, group = RULES[kind]
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sized = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else found
    rows = F.transform(
        F.arrays_zip(found.alias("len"), F.slice(gaps, 1, F.size(found)).alias("gap"), sized.alias("sized")),
        lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), x["len"].cast("long").alias("len"), x["gap"].cast("long").alias("gap"), (x["sized"] >= least).alias("ok")),
    )
    return F.when(F.array_contains(need, _rule_id(kind)) & text.rlike(pattern), rows)


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, text) -> paths(doc_id, blob), findings(blob, kind, start, end) of what the ledger lacks, and the
    ledger rows (blob, rules) that this scan adds."""
    rules = F.array(*[F.lit(_rule_id(k)) for k in KINDS])
    texts = docs.select("doc_id", clean_text().alias("text"))
    paths = keep(texts.select("doc_id", blob_id(F.col("text")).alias("blob")))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("path"))
    if ledger is None:
        due = blobs.withColumn("need", rules)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        due = blobs.join(seen, "blob", "left").select("blob", "path", F.array_except(rules, F.coalesce("seen", F.array().cast("array<string>"))).alias("need")).where(F.size("need") > 0)
    held = texts.withColumn("blob_", blob_id(F.col("text")))
    unseen = held.join(due, (held.blob_ == due.blob) & held.doc_id.eqNullSafe(due.path)).select("blob", "need", "text")
    text, need = F.col("text"), F.col("need")
    hits = unseen.select("blob", F.array_compact(F.array(*[_matches(text, need, k) for k in KINDS])).alias("hits")).where(F.size("hits") > 0)
    rows = hits.dropDuplicates(["blob"]).select("blob", F.explode(F.flatten("hits")).alias("h")).select("blob", "h.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("blob", "kind").orderBy("i"))
    findings = rows.withColumn("end", end).where("ok").select("blob", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    return paths, findings, due.select("blob", F.col("need").alias("rules"))


class Ledger:
    """A ledger and its findings, kept as tables in a folder and added to by every scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.path}/{name}")

    def scan(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """paths of docs, and the findings of all scans so far. Texts whose blob and rules the ledger has aren't read by
        any rule. The findings are written first: a scan that is cut off between the two is scanned again, and its
        repeated findings count once."""
        paths, found, added = scan(docs, self._read("ledger"))
        found.write.mode("append").parquet(f"{self.path}/findings")
        added.write.mode("append").parquet(f"{self.path}/ledger")
        return paths, self._read("findings").distinct()


def by_blob(findings: DataFrame) -> DataFrame:
    """findings -> (blob, spans): one sorted array of (start, kind, end) per blob."""
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def covered(text: Column, spans: Column) -> Column:
    """spans with those of pem reaching to the end of the key: its END line if that is the next marker, or its body."""

    def reach(s: Column) -> Column:
        rest = F.substr(text, (s["end"] + 1).cast("int"), F.char_length(text))
        marker = F.instr(rest, "-----")
        closing = F.char_length(F.regexp_extract(F.substr(rest, F.greatest(marker, F.lit(1)), F.char_length(rest)), KEY_END, 0))
        stop = F.regexp_instr(F.concat(F.lit(" "), rest), F.lit(KEY_STOP))
        body = F.when(stop == 0, F.char_length(rest)).otherwise(F.greatest(stop - 2, F.lit(0)))
        return F.when((marker > 0) & (closing > 0), marker - 1 + closing).otherwise(body)

    pem = KINDS.index("pem")
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.when(s["kind"] == pem, s["end"] + reach(s)).otherwise(s["end"]).alias("end")))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text without the union of its spans (sorted by start), each run of overlapping spans replaced by one mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.char_length(text))))


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, findings = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}").scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = paths.join(keep(by_blob(findings)), "blob", "left").withColumn("spans", F.coalesce("spans", none))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """op4 in DuckDB: every rule on every text, positions from running sums of gaps and matches."""
    q = lambda p: p.replace("'", "''")
    parts = [
        f"""SELECT doc_id, {k} AS kind, unnest(range(0, len(m))) AS i, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(z[1:len(m)], lambda x: length(x))) AS gap,
        unnest(list_transform(s, lambda x: length(x))) >= {least} AS ok FROM (SELECT doc_id, regexp_extract_all(text, '{q(p)}') AS m, string_split_regex(text, '{q(p)}') AS z, regexp_extract_all(text, '{q(p)}', {group}) AS s FROM d)"""
        for k, (_, p, least, group) in enumerate(RULES.values())
    ]
    count = ", ".join(f"count(*) FILTER (kind = {KINDS.index(k)}) AS n_{k}" for k in BASE)
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || (e - n) || ':' || e"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), u AS ({" UNION ALL ".join(parts)}),
    f AS (SELECT doc_id, kind, n, e FROM (SELECT *, (sum(n + gap) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e FROM u) WHERE ok),
    g AS (SELECT doc_id, {count}, string_agg({name}, ',' ORDER BY e - n, kind) FILTER (kind < {len(BASE)}) AS base, string_agg({name}, ',' ORDER BY e - n, kind) AS spans FROM f GROUP BY 1)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = _oracle()
