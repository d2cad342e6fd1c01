from pyspark.sql import functions as F

from catloom.operators import reports


def test_texts_are_parsed_only_above_their_spreading(spark):
    text = '{"visual":{"query":[{"SourceRef":{"Entity":"T_1"}},{"SourceRef":{"Entity":"t_1"}}]}}'
    parts = spark.range(3).select(
        F.lit("r").alias("report_id"), F.concat(F.lit("a/pages/p"), "id", F.lit("/visuals/v/visual.json")).alias("path"),
        F.when(F.col("id") < 2, F.lit(text)).otherwise("{}").alias("content"),
    ).repartition(2, "report_id", "path", "content")
    found = reports.page_entities(reports.report_facts(parts))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and ("arseJson" in line or "entities" in line) for line in plan.splitlines())
    assert sorted((r.page_id, r.entity) for r in found.collect()) == [("p0", "T_1"), ("p0", "t_1"), ("p1", "T_1"), ("p1", "t_1")]
