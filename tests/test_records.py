"""Record queries against their SQL on rows that the tables of the driver do not hold."""

import duckdb

from factloom import catalog
from factloom.operators import records


def test_prefix_duplicates_count_characters(spark, tmp_path):
    texts = ["ñ" * 60, "ñ" * 60, "ñ" * 63 + "a", "ñ" * 63 + "a", "ñ" * 63 + "ab", "a" * 63, "a" * 64, "a" * 65, "", None, None]
    docs = [(i, t, lang, "s") for i, (t, lang) in enumerate([*((t, "es") for t in texts), ("a" * 64, None), ("a" * 64, None)])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["prefix_duplicates"]).fetchall())
    assert want == [(2, 3), (2, 4), (3, 4), (6, 7)]
    assert sorted(tuple(r) for r in catalog.queries()["prefix_duplicates"](spark, str(tmp_path)).collect()) == want


def test_prefix_duplicates_of_binary_contents_count_bytes(spark):
    rows = [("a", b"\xff" * 64, "m", "f"), ("b", b"\xff" * 65, "m", "f"), ("c", b"\xff" * 63, "m", "f")]
    frame = spark.createDataFrame(rows, "record_id string, content binary, mime string, filename string")
    assert [tuple(r) for r in records.prefix_duplicates(frame).collect()] == [("a", "b")]
    assert sorted(tuple(r) for r in records.prefix_duplicates(frame, least=1).collect()) == [("a", "b"), ("c", "a"), ("c", "b")]
