"""Which pages move before they are written to archives."""

from pyspark.sql import functions as F

from vellum.llm import warc


def test_single_pages_stay_where_they_were_read(spark):
    pages = spark.range(0, 60, 1, 3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.concat((F.col("id") % 58).cast("string"), F.lit(" ")), 1000).alias("html"))
    rows = warc.with_revisits(pages).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.page_id for r in rows) == list(range(60))
    assert {r.page_id: r.refers_to for r in rows if r.record_type == "revisit"} == {0: 58, 1: 59}
    assert {r.page_id for r in rows if r.referred} == {0, 1, 58, 59}
    assert all(r.task == r.page_id // 20 for r in rows if 2 <= r.page_id < 58)
