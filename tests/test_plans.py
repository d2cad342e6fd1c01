import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from catloom.operators import code_refs, docs, edges, factored, graph, measures, profile, views
from catloom.plans import runs
from catloom.plans.collect import WorkspaceInputs, collect_workspace
from catloom.plans.governance import ReportInputs, build_graph, report_usage
from catloom.sources.publish import TableSet

GUID = "00000000-0000-0000-0000-000000000001"


def b64(text):
    return base64.b64encode(text.encode()).decode()


def inputs(spark):
    make = spark.createDataFrame
    raw = [
        {"id": "b", "displayName": "bronze_lh", "type": "Lakehouse"}, {"id": "s", "displayName": "silver_lh_ops", "type": "Lakehouse"},
        {"id": "g", "displayName": "gold_wh_ops", "type": "Warehouse"}, {"id": "n", "displayName": "nb_gold", "type": "Notebook"},
        {"id": "m", "displayName": "nb_silver", "type": "Notebook"}, {"id": "p", "displayName": "flow", "type": "DataPipeline"},
        {"id": "x", "displayName": "rep", "type": "Report"},
    ]
    detail = json.dumps({"properties": {"connectionString": "c"}})
    tables = {("s", "silver_lh_ops", "orders"): 3, ("g", "gold_wh_ops", "sales"): 2, ("b", "bronze_lh", "orders"): 5}
    prof = None
    for (lh, lh_name, name), n in tables.items():
        one = profile.profile_table(spark.range(n)).select(
            F.lit(lh).alias("lh_id"), F.lit(lh_name).alias("lh_name"), F.lit("dbo").alias("schema_name"), F.lit(name).alias("table_name"), "*"
        )
        prof = one if prof is None else prof.unionByName(one)
    pipeline = json.dumps({"properties": {"activities": [
        {"name": "first", "typeProperties": {"notebookId": "m"}},
        {"name": "second", "typeProperties": {"notebookId": "n"}, "dependsOn": [{"activity": "first"}]},
    ]}})
    return WorkspaceInputs(
        "ws", "Space",
        raw_items=make([(i, json.dumps(r)) for i, r in enumerate(raw)], "ord long, raw string"),
        details=make([(i, detail) for i in "bsg"], "id string, detail string"),
        profile=prof,
        parts=make([("n", 0, "a.py", b64('spark.table("silver.orders"); x.saveAsTable("gold.sales")'))], "item_id string, ord long, path string, payload string"),
        pipelines=make([("p", pipeline)], "pipeline_id string, definition string"),
        local_files=make([], "path string, content string"),
        files=make([(1, "b", "b/Files/a.csv", 3)], "ord long, lh_id string, name string, size long"),
    )


def report_inputs(spark):
    make = spark.createDataFrame
    link = json.dumps({"datasetReference": {"byConnection": {"connectionString": f"semanticmodelid={GUID}"}}})
    visual = json.dumps({"visual": {"visualType": "card", "q": {"SourceRef": {"Entity": "Calc"}}}})
    folder = "F/F.Report"
    found = make([("ds", "Calc", "SUM(Sales[x])")], "dataset_id string, measure_group string, expr string")
    return ReportInputs(
        reports=make([(1, "r1", "Rep", GUID, "", "me"), (2, "r2", "Old", "other", "", "")], "ord long, report_id string, name string, dataset_id string, created_by string, modified_by string"),
        pages=make([(1, "r1", "p1", "One", 0, None), (2, "r2", "s1", "Old page", 0, None)], "ord long, report_id string, page_id string, display_name string, page_order int, visibility string"),
        datasources=make([(GUID, 1, "Sql", None, "GOLD_WH_OPS")], "dataset_id string, ord long, datasource_type string, path string, database_name string"),
        measures=measures.with_priority(found).withColumn("dataset_id", F.lit(GUID)),
        archive_parts=make(
            [("z", 0, f"{folder}/definition.pbir", link), ("z", 1, f"{folder}/definition/pages/p1/visuals/v/visual.json", visual)],
            "archive string, ord long, path string, content string",
        ),
        layouts=make([("r2", json.dumps({"sections": [{"name": "s1", "visualContainers": [{"config": json.dumps({"singleVisual": {"prototypeQuery": {"From": [{"Entity": "Orders"}]}}})}]}]}))], "report_id string, layout string"),
    )


def test_whole_run(spark):
    got = collect_workspace(inputs(spark))
    assert {(r.table_name, r.lh_id): (r.row_count, r.source_artifact) for r in got.tables.collect()} == {
        ("orders", "b"): (5, "nb_silver"), ("orders", "s"): (3, "nb_silver"), ("sales", "g"): (2, "nb_gold"),
    }
    gold = [(r.output_table, r.notebook_name, r.input_refs, r.confidence) for r in edges.expand_groups(got.gold).collect()]
    assert gold == [("sales", "nb_gold", ["orders"], "PARSED")]
    silver = [(r.output_table, r.notebook_name, r.input_refs, r.confidence) for r in edges.expand_groups(got.silver).collect()]
    assert silver == [("orders", "nb_silver", ["orders"], "INFERRED")]
    assert [r.notebook_name for r in got.activities.orderBy("position").collect()] == ["nb_silver", "nb_gold"]
    assert got.data_sources.count() == 1 and got.artifacts.count() == 5 and got.columns.count() == 3

    reps = report_inputs(spark)
    usage = report_usage(reps, got.tables)
    assert {(r.report_id, r.page_id, r.physical_table, r.map_source) for r in usage.page_maps.collect()} == {
        ("r1", "p1", "sales", "archive"), ("r2", "s1", "orders", "fallback_0"),
    }
    ctx = graph.GraphContext("ws", "Space", "2024-01-01 00:00:00")
    parts = dict(artifacts=got.artifacts, tables=got.tables, columns=got.columns, edges=got.edges, input_sets=got.input_sets, inputs=reps, usage=usage)
    objects, relationships = build_graph(ctx, **parts)
    kinds = {r.objects_type: r.total for r in views.type_counts(objects).collect()}
    assert kinds == {"Workspace": 1, "Lakehouse": 2, "Warehouse": 1, "Notebook": 2, "Report": 2, "Page": 2, "Visual": 1, "Table": 3, "Column": 3}
    found = {(r.source, r.target, r.relationships_type) for r in views.lineage(objects, relationships).collect()}
    assert found == {("orders", "sales", "derives_from"), ("orders", "orders", "derives_from"), ("Card", "sales", "uses"), ("One", "sales", "uses")}
    again = build_graph(ctx, **parts)
    for a, b in zip((objects, relationships), again):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    more = build_graph(ctx, **parts, page_map_edges=True)[1]
    assert more.count() == relationships.count() + 1
    counts = docs.run_summary(artifacts=got.artifacts, tables=got.tables).collect()
    assert {r.output: r.total for r in counts} == {"artifacts": 5, "tables": 3}


def test_layer_filter_limits_tables(spark):
    got = collect_workspace(inputs(spark), layers="gold")
    assert [r.table_name for r in got.tables.collect()] == ["sales"]
    assert edges.expand_groups(got.silver).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_registered_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "report" and not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_stopped_run_resumes(spark, tmp_path, monkeypatch):
    root, calls = str(tmp_path / "space"), []
    given = inputs(spark)
    plain = {n: sorted(map(str, df.collect())) for n, df in collect_workspace(given).frames().items()}

    def failing(*args):
        raise RuntimeError("stopped")

    references = code_refs.source_references
    monkeypatch.setattr(code_refs, "source_references", lambda *a: calls.append("sources") or references(*a))
    silver = edges.silver_layer
    monkeypatch.setattr(edges, "silver_layer", failing)
    with pytest.raises(RuntimeError, match="stopped"):
        runs.run_workspace(spark, root, "monday", given)
    assert {x for x in os.listdir(f"{root}/work/monday") if x.endswith(".done")} == {"base.done", "sources.done", "gold.done"}
    monkeypatch.setattr(edges, "silver_layer", silver)
    monkeypatch.setattr(edges, "gold_layer", failing)  # finished before: not made again
    got = runs.run_workspace(spark, root, "monday", given)
    assert calls == ["sources"] and os.listdir(f"{root}/work") == []
    assert {n: sorted(map(str, df.collect())) for n, df in got.frames().items()} == plain
    again = runs.run_workspace(spark, root, "monday", given)  # published: nothing is made
    assert again.tables.count() == got.tables.count() and TableSet(spark, root).versions() == [1]
    with pytest.raises(ValueError):
        runs.run_workspace(spark, root, "../monday", given)


def test_graph_from_layers(spark):
    got = collect_workspace(inputs(spark))
    reps = report_inputs(spark)
    usage = report_usage(reps, got.tables)
    ctx = graph.GraphContext("ws", "Space", "2024-01-01 00:00:00")
    parts = dict(artifacts=got.artifacts, tables=got.tables, columns=got.columns, input_sets=got.input_sets, inputs=reps, usage=usage)
    _, literal = build_graph(ctx, **parts, edges=got.edges)
    objects, made = build_graph(ctx, **parts, layers=[got.gold, got.silver])
    ids = lambda df: sorted(r.relationships_id for r in df.collect())
    assert ids(factored.expand(ctx, made)) == ids(literal)
    ends = made.select(F.col("target_objects_id").alias("objects_id"))
    assert ends.join(objects, "objects_id", "left_anti").isEmpty()
    with pytest.raises(ValueError):
        build_graph(ctx, **parts)
