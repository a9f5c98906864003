"""Interval pairs are ranked without travelling; odd ids take the plain join."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evistrata import registry
from evistrata.operators import joins, ranking

DATA = "/root/testdata/sf0.001"


def test_interval_pairs_stay(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs of leads and spans")

    monkeypatch.setattr(joins, "interval_join", refuse)
    assert registry.QUERIES["interval_candidates"](spark, DATA).count() > 0


@pytest.mark.parametrize("pairs", [joins.PAIRS, 20])
def test_interval_ranks(spark, monkeypatch, pairs):
    """Equal distances, spans that end before they start, long spans, positions near 0, a cell in pieces."""
    monkeypatch.setattr(joins, "PAIRS", pairs)
    points = spark.range(60).select(F.col("id").alias("point"), (F.col("id") % 2).alias("group"), (F.col("id") * F.col("id") * 7 % 900).alias("position"))
    start = F.col("id") * 13 % 1000 - 30
    spans = spark.range(200).select((F.col("id") * 3).alias("span"), (F.col("id") % 3).alias("group"), start.alias("start"), (start + F.col("id") % 7 * 40 - 60).alias("end"))
    got = {tuple(r) for r in joins.interval_ranks(points, spans, 50).collect()}
    far = F.greatest(F.col("start") - F.col("position"), F.col("position") - F.col("end"), F.lit(0))
    all_pairs = points.join(spans, "group").where("end >= greatest(position - 50, 1) and start <= position + 50").select("point", "span", far.alias("distance")).withColumn("near", -F.col("distance"))
    want = {tuple(r) for r in ranking.rank_first(all_pairs, ["point"], "near", ["span"]).select("point", "span", "distance", "rank").collect()}
    assert got == want and len(want) > 500


def test_repeated_events(spark, tmp_path, monkeypatch):
    """Events that are there twice, and ids that are missing, don't send the pairs of other leads on their way."""
    con = duckdb.connect()
    path = f"{tmp_path}/events.parquet"
    con.sql(f"COPY (SELECT CASE WHEN event_id % 9 = 4 AND event_type <> 'error' THEN NULL ELSE event_id END AS event_id, * EXCLUDE event_id FROM '{DATA}/events.parquet', range(3)) TO '{path}'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    whole, joined = joins.interval_join, []
    monkeypatch.setattr(joins, "interval_join", lambda *a: joined.append(a[0].count()) or whole(*a))
    rows = lambda: sorted(map(str, (tuple(r) for r in registry.QUERIES["interval_candidates"](spark, str(tmp_path)).collect())))
    want = lambda: sorted(map(str, con.sql(registry.ORACLE["interval_candidates"]).fetchall()))
    assert rows() == want() and not joined
    # One id at two places, and leads without an id: these alone are joined.
    con.sql(f"COPY (SELECT CASE WHEN event_type = 'error' AND event_id % 50 = 7 THEN NULL WHEN event_type = 'error' AND event_id % 50 < 5 THEN 5 ELSE event_id END AS event_id, * EXCLUDE event_id FROM '{DATA}/events.parquet') TO '{path}'")
    few, all_leads = con.sql("SELECT count(*) FILTER (event_id = 5 OR event_id IS NULL), count(*) FROM events WHERE event_type = 'error'").fetchall()[0]
    assert rows() == want() and joined == [few] and few < all_leads
