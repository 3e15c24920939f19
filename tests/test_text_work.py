"""Text functions do the whole job, once."""

import duckdb
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.plans import registry


def test_dewrap_splits_once(spark):
    texts = ["  one \n\n two\t\n \n\tThree \n", "\nup", "", None, "a\n \n b", "x \n"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(T.dewrap(F.col("t")).alias("out"))
    assert [r.out for r in d.collect()] == ["  one  two\n\n\n\nThree\n\n", " up", "", None, "a\n\n b", "x \n\n"]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_distinct_numbers_of_few_values(spark, tmp_path):
    d = spark.createDataFrame([(1, "in 7 and 7"), (2, "3 of 1,000"), (3, "1 2 3"), (4, "none"), (5, None)], "doc_id long, text string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["distinct_numbers"](spark, str(tmp_path)).collect())
    assert got == [(1, "7"), (2, "1,000|3"), (3, "1|2|3"), (4, None), (5, None)]
    duckdb.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(registry.SQL["distinct_numbers"]).fetchall()) == got


def test_scaling_floor_of_empty_texts(spark, tmp_path):
    d = spark.createDataFrame([(1, 0), (2, 1), (3, 40_000), (4, None)], "doc_id long, n_chars long")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["scaling_floor"](spark, str(tmp_path)).collect())
    assert got[0] == (1, float("inf")) and got[3] == (4, None)
    con = duckdb.connect()
    con.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(registry.SQL["scaling_floor"]).fetchall()) == got
