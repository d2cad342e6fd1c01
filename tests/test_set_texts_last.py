from pyspark.sql import functions as F

from catloom.functions import ranking
from catloom.operators import docs, edges
from tests.test_edges import world


def test_set_texts_pass_no_shuffle_and_stay_the_same(spark):
    inputs, files = world(spark)
    found = edges.gold_edges(*inputs).unionByName(edges.silver_edges(*inputs))
    texts = edges.set_texts(edges.input_sets(inputs[0], inputs[1], files))
    view = docs.lineage_view(found, texts)
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter", 0, plan.index("FullOuter")) == 2  # the joins with the texts stand above
    shown = {(r.gold_table, r.gold_writer): r.gold_inputs for r in view.where("gold_table is not null").collect()}
    assert shown["orphan", "nb_ops_gold"] == "orders, lines, solo" and shown["Sales", "nb_sales"] == "lines"
    lines = [r.line for r in docs.lineage_lines(found, texts).where("block = 'gold'").collect()]
    assert any(x.startswith("  [INFERRED] orphan (gold_wh_ops)\n       <- nb_ops_gold\n       <- orders, lines, solo\n") for x in lines)


def test_small_and_large_groups_rank_alike(spark, monkeypatch):
    rows = spark.range(60).select(
        F.when(F.col("id") % 7 != 0, F.least(F.col("id") % 5, F.lit(2))).alias("k"), F.lpad(((F.col("id") * 37) % 60).cast("string"), 3, "0").alias("o"), F.lit(2).alias("v")
    )
    took = []
    for limit in (100, 12, 0):
        monkeypatch.setattr(ranking, "WINDOW_ROWS", limit)
        ranked = ranking.rank_in_group(rows, ["k"], "o", "n").collect()
        summed = ranking.running_total(rows, ["k"], "o", "v", "n").collect()
        assert sorted((r.k, r.o, r.n * 2 - 2) for r in ranked) == sorted((r.k, r.o, r.n) for r in summed)
        took.append(sorted((r.k, r.o, r.n) for r in ranked))
    assert took[0] == took[1] == took[2] and {k for k, _, _ in took[0]} == {0, 1, 2}
