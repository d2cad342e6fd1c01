import re

from pyspark.sql import functions as F

from catloom.operators.edges import LayerEdges, expand_groups


def _layer(spark, namesake):
    own = spark.createDataFrame([], "block string, out_ord struct<lh_ord:long,table_ord:long>, writer_ord struct<a:long,b:long,c:long>, lh_id string, output_lh string, output_table string, notebook_id string, notebook_name string, input_set string, input_refs array<string>, confidence string, notes string")
    groups = spark.createDataFrame(
        [("gold", "a", 1, (0, 1, 1), "n1", "N1", "all_silver", None, False, "I", "x"), ("gold", "a", 1, (0, 1, 2), "n2", "N2", None, ["r"], False, "I", "x"), ("gold", None, 2, (0, 1, 3), "n3", "N3", None, ["r"], False, "I", "x")],
        "block string, lh_id string, lh_ord long, writer_ord struct<a:long,b:long,c:long>, notebook_id string, notebook_name string, input_set string, input_refs array<string>, own_name boolean, confidence string, notes string",
    )
    members = spark.createDataFrame(
        [("gold", "a", "A", f"T_{i}", f"t_{i}", (1, i)) for i in range(3)] + [("gold", None, "B", "T", "t", (2, 9))],
        "block string, lh_id string, output_lh string, output_table string, tname string, out_ord struct<lh_ord:long,table_ord:long>",
    )
    return LayerEdges(own, groups.withColumn("namesake", namesake), members.withColumn("namesake", namesake))


def test_groups_of_one_kind_are_dealt_once(spark):
    found = expand_groups(_layer(spark, F.lit(False)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\([^)]*_split[^)]*\), (\w+)", plan)
    assert dealt == ["REPARTITION_BY_NUM"] * 2  # a constant in the key had both sides dealt again, to few tasks
    assert sorted((r.lh_id, r.output_table, r.notebook_id) for r in found.collect()) == sorted(("a", f"T_{i}", n) for i in range(3) for n in ("n1", "n2"))


def test_groups_of_both_kinds_do_not_meet(spark):
    layer = _layer(spark, F.lit(False))
    mixed = LayerEdges(layer.own, layer.groups, layer.members.withColumn("namesake", F.col("output_table") == "T_1"))
    assert sorted({r.output_table for r in expand_groups(mixed).collect()}) == ["T_0", "T_2"]
