"""Queries on odd rows against their own SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

ODD_LINES = [
    "éis ered", "is eredé", "is érexed", "was thed", "was thed", "waſ thed", "was ſet", "is looKed", "ıs based", "İS BASED", "ſis based",
    "\tis thed \t", " is thed　", "\x1fare  run\x1f", "is based is  based IS BASED", "übe üed be oned", "was_ thed _was thed", "is a_ed is ٣ed is 3ed", "are\trun been said", "is éd is edé",
    "\U0001f600 was thed", "", " ",
]


@pytest.mark.parametrize("name", ["passive_voice", "passive_voice_with_statives"])
def test_passive_voice_is_its_sqls(spark, tmp_path, name):
    texts = [*ODD_LINES, "\n".join(ODD_LINES), "\r\n".join(ODD_LINES), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = Counter(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert want and Counter(map(tuple, __spark_entry__.queries()[name](spark, str(tmp_path)).collect())) == want


def test_identifiers_are_resolved_without_a_broadcast_of_pages(spark, tmp_path):
    parts = spark.range(300).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "'PROMO' AS p_type", "CAST(id % 50 AS INT) AS p_size")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = __spark_entry__.queries()["resolve_identifiers"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert Counter(map(tuple, found.collect())) == Counter(con.execute(__spark_entry__.oracle_sql()["resolve_identifiers"]).fetchall())
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
