from pyspark.sql import functions as F

from catloom.functions.documents import with_json


def test_texts_that_cannot_be_json_go_to_no_reader(spark):
    texts = ["not json", "", None, "true", " null", "NaN", "-Infinity", "nullx", "\n {\"a\": 1}", '{"a": 1, "a": 2}', "{", "Infinity", "'x'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = with_json(df, "t", "v", ["a"])
    got = {r.i: r.v for r in found.select("i", F.to_json("v").alias("v")).collect()}
    assert [got[i] for i in range(len(texts))] == [None, None, None, "true", "null", "null", "null", None, '{"a":1}', '{"a":2}', None, "null", None]
    assert "RLIKE" in found._jdf.queryExecution().optimizedPlan().toString()
