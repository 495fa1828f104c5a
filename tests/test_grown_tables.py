"""Queries over tables as they look when they grow: several files, keys that repeat. Each against its SQL."""

import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from loomspark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def against_sql(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for table, parts in tables.items():
            for i, part in enumerate(parts):  # a file each, in this order
                part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        same_rows(registry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(registry.oracle_sql()[name]).df())

    return check


def test_conditional_pages_with_a_url_of_several_pages(spark, against_sql):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    again = p.where("page_id < 9").withColumn("page_id", (F.col("page_id") + 100_001).cast(p.schema["page_id"].dataType))
    against_sql("conditional_pages", pages=[p, again])


def test_stream_tenants_with_ends_in_later_batches(spark, against_sql):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    against_sql("stream_tenants", documents=[d.where(f"doc_id % 3 = {i}") for i in (2, 0, 1)])
