import re

from catloom.operators import reports


def test_tables_found_are_dealt_by_page_once(spark):
    facts = spark.createDataFrame(
        [("r", "p", ["Sales", "SALES", "Group"], None), ("r", "p", ["sales"], None), ("r", "q", [], None), ("s", None, ["sales"], None)],
        "report_id string, page_id string, entities array<string>, page_order array<string>",
    )
    known = spark.createDataFrame([("sales",), ("lines",)], "known string")
    deps = spark.createDataFrame([("group", "lines"), ("group", "sales")], "measure_group string, physical_table string")
    found = reports.definition_page_tables(facts, known, deps)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [re.sub(r"#\d+", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    assert not [x for x in dealt if "physical_table" in x and "page_id" in x]  # such a shuffle came before one by page
    assert len([x for x in dealt if "entity" in x and "page_id" in x]) == 1  # names as written were shuffled before lower-case ones
    assert sorted(tuple(r) for r in found.collect() if r.physical_table) == [("r", "p", "lines"), ("r", "p", "sales")]
    assert [tuple(r) for r in found.where("physical_table IS NULL").collect()] == [("r", "q", None)]
