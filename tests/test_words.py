"""Words that end at letters outside ASCII are cleaned as in the SQL."""

import duckdb

from evistrata import registry


def test_words_at_umlauts(spark, tmp_path):
    texts = ["erie Äals heiten", "ßals pfpf", "alsß", "ALS Ä als-linked", "Ä et al. Öet al, et alß", "als_x xals"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = {tuple(r) for r in registry.QUERIES["text_normalize"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(registry.ORACLE["text_normalize"]).fetchall())
