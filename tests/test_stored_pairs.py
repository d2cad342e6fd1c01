from catloom.sources import definitions


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_pairs_are_dealt_before_doubles_are_dropped(spark):
    stored = spark.createDataFrame([("G", "T_1"), ("g", "t_1"), ("g", "t_9"), (None, "t_1"), ("g", None)], "measure_group string, physical_table string")
    found = definitions.stored_measure_deps(stored, spark.createDataFrame([("t_1",)], "known string"))
    assert sorted((str(r.measure_group), r.physical_table) for r in found.collect()) == [("None", "t_1"), ("g", "t_1")]
    assert "REPARTITION_BY_NUM" in _plan(found)
