from pyspark.sql import functions as F

from checks.fixtures import fixture


def test_texts_are_made_after_the_spreading(spark, tmp_path):
    lines = spark.range(40).select(
        F.col("id").alias("l_orderkey"), *[(F.col("id") % 5).alias(c) for c in ("l_partkey", "l_suppkey")], (F.col("id") % 7).cast("int").alias("l_linenumber"),
    )
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = fixture(spark, str(tmp_path), "fx_measures")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") > plan.index("SUM(t_") and plan.count("RepartitionByExpression") == 1
    assert found.count() == 40
