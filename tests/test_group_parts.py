from catloom.operators import edges
from tests.test_edges import rows, world


def test_groups_expand_in_as_many_tasks_as_asked(spark):
    inputs, _ = world(spark)
    layer = edges.silver_layer(*inputs)
    found = edges.expand_groups(layer, splits=3)
    assert "hashpartitioning(lh_id" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(edges.expand_groups(layer, splits=1)) and found.count() > 0
    wide = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in wide and ", 6)" in wide
