from catloom.operators import reports


def test_equal_visuals_give_each_table_once(spark):
    visuals = spark.createDataFrame(
        [("r", "p", "a", "Card", "card", ["T_1", "t_1", "G"]), ("r", "p", "a", "Card", "card", ["t_2"]), ("r", "p", "b", "Card (2)", "card", ["none"]), ("r", None, "c", "Card", "card", ["t_2"])],
        "report_id string, page_id string, path string, visual_name string, visual_type string, entities array<string>",
    )
    resolution = spark.createDataFrame([("t_1", "t_1"), ("t_2", "t_2"), ("g", "t_1"), ("g", "t_2")], "entity string, physical_table string")
    found = reports.visual_tables(visuals, resolution)
    assert sorted((r.path, r.physical_table) for r in found.collect()) == [("a", "t_1"), ("a", "t_2"), ("c", "t_2")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "path" in line and "entity" in line for line in plan.splitlines())


def test_names_of_a_row_are_not_shuffled_to_be_made_distinct(spark):
    visuals = spark.createDataFrame(
        [("r", "p", "a", "Card", "card", ["T_1", "t_1", None]), ("r", "p", "b", "Card (2)", "card", None)],
        "report_id string, page_id string, path string, visual_name string, visual_type string, entities array<string>",
    )
    found = reports.visual_tables(visuals, spark.createDataFrame([("t_1", "t_1")], "entity string, physical_table string"))
    assert [(r.path, r.physical_table) for r in found.collect()] == [("a", "t_1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
