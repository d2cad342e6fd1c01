from pyspark.sql import functions as F

from catloom.operators import measures


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_that_are_no_names_are_dropped_before_the_shuffle(spark):
    names = spark.range(300).select(F.concat(F.lit("t_"), "id").alias("physical_table")).unionByName(
        spark.createDataFrame([(None,)], "physical_table string")
    )
    words = spark.range(3000).select(F.lit(1).alias("k"), F.concat(F.lit("t_"), "id").alias("physical_table"))
    kept = {r.physical_table for r in measures._likely_names(words, names, 301).collect()}
    assert {f"t_{i}" for i in range(300)} <= kept and len(kept) < 700


def test_many_names_need_one_shuffle_of_the_words(spark, monkeypatch):
    monkeypatch.setattr(measures, "SENT_NAMES", 0)
    exprs = spark.createDataFrame([("d", 0, "g", "COUNTROWS(t_1) + SUM(t_2[x])"), ("d", 0, "g", "t_1"), (None, 0, None, "t_2 t_2")], "dataset_id string, source_priority int, measure_group string, expr string")
    known = spark.createDataFrame([("t_1",), ("t_2",)], "known string")
    found = measures.source_deps(exprs, known)
    assert sorted(map(str, found.collect())) == sorted(
        f"Row(dataset_id={d!r}, source_priority=0, measure_group={g!r}, physical_table={t!r})" for d, g, t in (("d", "g", "t_1"), ("d", "g", "t_2"), (None, None, "t_2"))
    )
    assert "hashpartitioning(dataset_id" not in _plan(found)


def test_rows_of_one_dataset_are_dealt(spark):
    deps = spark.createDataFrame(
        [("d", 0, "g", "a"), ("d", 0, "g", "b"), ("d", 1, "g", "c"), ("e", 1, "g", "x"), ("e", 1, "h", "y"), (None, 0, "h", "z"), ("d", 0, None, "n")],
        "dataset_id string, source_priority int, measure_group string, physical_table string",
    )
    datasets = spark.createDataFrame([("d", 2), ("e", 1), ("e", 1)], "dataset_id string, ord int")
    merged = measures.merge_deps(deps, datasets)
    assert sorted((r.measure_group, r.physical_table) for r in merged.collect()) == [("g", "a"), ("g", "b"), ("h", "y"), ("h", "y")]
    assert "_part" in _plan(merged)
