from catloom.operators import measures


def test_names_sent_or_dealt_give_the_same_rows(spark, monkeypatch):
    exprs = spark.createDataFrame(
        [("d", 0, "G", "SUM(t_1[x]) + COUNTROWS(T_2)"), ("d", 0, "g", "COUNTROWS(t_2)"), ("e", 1, "H", "CALCULATE('fact t'[x])"), (None, 1, "H", "t_1"), ("d", 0, "G", None)],
        "dataset_id string, source_priority int, measure_group string, expr string",
    )
    known = spark.createDataFrame([("t_1",), ("t_2",), ("t_3",), (None,)], "known string")
    want = [("None", "h", "t_1"), ("d", "g", "t_1"), ("d", "g", "t_2")]
    for limit in (measures.SENT_NAMES, 0):
        monkeypatch.setattr(measures, "SENT_NAMES", limit)
        got = measures.source_deps(exprs, known)
        assert sorted((str(r.dataset_id), r.measure_group, r.physical_table) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("_part" in plan) == (limit == 0)
