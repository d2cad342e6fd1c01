import json
import re

from pyspark.sql import functions as F

from catloom.operators import measures, reports


def known(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "known string")


def dax_by_regex(expr, tables):
    """One search per known table, with the two forms a table can take."""
    refs = set()
    for m in re.finditer(r"'([^']+)'\s*\[|(\b[A-Za-z_][A-Za-z0-9_ ]*)\[", expr):
        refs.add((m.group(1) or m.group(2) or "").strip().lower())
    refs &= set(tables)
    for t in tables:
        if re.search(r"(?<![a-z0-9_'\"])" + re.escape(t) + r"(?![a-z0-9_'\"\[])", expr.lower()):
            refs.add(t)
    return refs


def test_dax_references_equal_per_table_search(spark):
    tables = ["sales", "fact sales", "dim-date", "t_1", "t_10", "売上", "a.b", "x", "(odd)"]
    exprs = [
        "SUM(Sales[amt])", "SUM('Fact Sales' [amt])", "COUNTROWS(t_1) + COUNTROWS(t_10)", "RETURN sales[x]",
        "'sales'", "fact sales", "COUNTROWS(dim-date)", "ALL(売上)", "a.b + xa.b", "\"x\"", "x[", "T_1 [q]",
        "mysales + sales_x", "f((odd))", "Fact Sales[y]", "sales\nsales", "", "x'y",
    ]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "i int, expr string")
    got = {}
    for r in measures.expression_tables(df, ["i"], known(spark, *tables)).collect():
        got.setdefault(r.i, set()).add(r.physical_table)
    assert got == {i: refs for i, e in enumerate(exprs) if (refs := dax_by_regex(e, tables))}


def test_strict_measures_look_behind_keywords(spark):
    df = spark.createDataFrame([(1, "RETURN sales[x]")], "i int, expr string")
    assert measures.expression_tables(df, ["i"], known(spark, "sales")).count() == 0
    assert measures.expression_tables(df, ["i"], known(spark, "sales"), "strict").count() == 1


def test_merge_takes_best_source_then_last_dataset(spark):
    deps = spark.createDataFrame(
        [("d1", 0, "g", "a"), ("d1", 1, "g", "b"), ("d2", 1, "g", "c"), ("d2", 1, "h", "d"), ("d1", 0, "k", "e")],
        "dataset_id string, source_priority int, measure_group string, physical_table string",
    )
    datasets = spark.createDataFrame([("d1", 1), ("d2", 2)], "dataset_id string, ord long")
    merged = {(r.measure_group, r.physical_table) for r in measures.merge_deps(deps, datasets).collect()}
    assert merged == {("g", "c"), ("h", "d"), ("k", "e")}
    stored = spark.createDataFrame([("s", "z")], "measure_group string, physical_table string")
    assert [tuple(r) for r in measures.merge_deps(deps, datasets, stored).collect()] == [("s", "z")]
    none = stored.limit(0)
    assert measures.merge_deps(deps, datasets, none).count() == 3


def test_measure_sources(spark):
    import base64

    model = json.dumps({"model": {"tables": [
        {"name": "Sales", "measures": [{"name": "m", "expression": ["SUM(", "sales[x])"]}]},
        {"name": "Calc", "measures": [{"expression": "COUNTROWS(t)"}]}, {"name": "none"},
    ]}})
    rows = measures.measures_of_model(spark.createDataFrame([("d", model)], "dataset_id string, model string")).collect()
    assert {(r.measure_group, r.expr) for r in rows} == {("Sales", "SUM(\nsales[x])"), ("Calc", "COUNTROWS(t)")}

    body = base64.b64encode(b"measure x = 1").decode()
    parts = spark.createDataFrame(
        [("d", p, body) for p in (
            "definition/tables/Calc.tmdl", "definition\\tables\\Other.tmdl", "definition/tables/Sales.tmdl",
            "definition/tables/Calc/measures/x.tmdl", "tables/Top.tmdl", "definition/model.tmdl",
        )], "dataset_id string, path string, payload string",
    )
    got = measures.measures_of_table_parts(parts, known(spark, "sales")).collect()
    assert {r.measure_group for r in got} == {"Calc", "Other"}

    files = spark.createDataFrame(
        [("d", p, "e") for p in ("SemanticModel/tables/Calc/measures/a.tmdl", "M/tables/Sales/measures/b.tmdl", "M/tables/Calc.tmdl")],
        "dataset_id string, path string, content string",
    )
    assert {r.measure_group for r in measures.measures_of_measure_files(files, known(spark, "sales")).collect()} == {"Calc"}


def facts_of(spark, rows, archive=False):
    return reports.report_facts(spark.createDataFrame(rows, "report_id string, path string, content string"), archive)


def visual(kind=None, title=None, entities=(), nested=False):
    refs = [{"SourceRef": {"Entity": e}} for e in entities]
    vis = {"query": {"deep": [{"deeper": refs}]}}
    if kind:
        vis["visualType"] = kind
    if title is not None:
        vis["visualContainerObjects"] = {"title": [
            {"properties": {}}, {"properties": {"text": {"expr": {"Literal": {"Value": title}}}}},
        ]}
    return json.dumps({"visual": vis})


def test_entities_at_any_depth(spark):
    texts = [
        visual(entities=["A", "B", "A"]),
        json.dumps({"a": {"SourceRef": {"Schema": {"SourceRef": {"Entity": "Inner"}}, "Entity": "Outer"}}}),
        json.dumps({"a": {"SourceRef": {"Entity": 'quo"te'}}}),
        json.dumps({"a": {"SourceRef": {"Entity": "é"}}}),
        json.dumps({"a": {"SourceRef": {"Source": "s"}}, "b": [{"SourceRef": {"Property": "p", "Entity": "C"}}]}),
        json.dumps({"text": '{"SourceRef": {"Entity": "not one"}}', "SourceRef": "x"}),
        json.dumps({"SourceRef": {"Entity": ""}}),
    ]
    df = reports.with_entities(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string"))
    got = {r.i: set(r.entities) for r in df.collect()}
    assert got == {0: {"A", "B"}, 1: {"Inner", "Outer"}, 2: {'quo"te'}, 3: {"é"}, 4: {"C"}, 5: set(), 6: set()}


def pages(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.report_id, r.page_id), set())
        if r.physical_table:
            out[r.report_id, r.page_id].add(r.physical_table)
    return out


def test_definition_pages(spark):
    rows = [
        ("r1", "definition/pages/pages.json", json.dumps({"pageOrder": ["p1", "p3"]})),
        ("r1", "definition/pages/p1/visuals/v1/visual.json", visual(entities=["Sales", "Calc"])),
        ("r1", "definition/pages/p2/visuals/v1/visual.json", visual(entities=["Sales"])),
        ("r2", "Report/definition/pages/p1/visuals/v1/visual.json", visual(entities=["nothing"])),
        ("r2", "Report/definition/pages/p2/visuals/v1/visual.json", "{broken"),
        ("r3", "definition/pages/pages.json", json.dumps({"pageOrder": ["p1"]})),
    ]
    deps = spark.createDataFrame([("calc", "dim"), ("sales", "wrong")], "measure_group string, physical_table string")
    facts = facts_of(spark, rows)
    # A listed page without visuals stays, an unlisted one goes; a known table is never a measure group.
    assert pages(reports.definition_page_tables(facts, known(spark, "sales"), deps)) == {
        ("r1", "p1"): {"sales", "dim"}, ("r1", "p3"): set(), ("r2", "p1"): set(),
    }


def test_archive_pages_keep_lists_without_visuals(spark):
    rows = [
        ("F/F.Report", "F/F.Report/definition/pages/pages.json", json.dumps({"pageOrder": ["p9"]})),
        ("G/G.Report", "G/G.Report/definition/pages/p1/visuals/v/visual.json", visual(entities=["Sales"])),
        ("G/G.Report", "G/G.Report/definition/pages/p1/visuals/v/deep/visual.json", visual(entities=["Other"])),
    ]
    deps = spark.createDataFrame([], "measure_group string, physical_table string")
    got = pages(reports.definition_page_tables(facts_of(spark, rows, True), known(spark, "sales", "other"), deps, True))
    assert got == {("F/F.Report", "p9"): set(), ("G/G.Report", "p1"): {"sales"}}


def test_visual_names(spark):
    base = "F/F.Report/definition/pages/p1/visuals/%s/visual.json"
    rows = [
        ("f", base % "a", visual("card", entities=["x"])), ("f", base % "b", visual("card", entities=[])),
        ("f", base % "c", visual("card", "'Own'", ["x"])), ("f", base % "d", visual("card", "''", ["x"])),
        ("f", base % "e", visual("textbox", entities=["x"])), ("f", base % "f", visual(None, entities=["x"])),
        ("f", base % "g", visual("barChart", entities=["x"])),
    ]
    facts = facts_of(spark, rows, archive=True)
    named = reports.named_visuals(facts)
    got = {r.path.split("/")[-2]: r.visual_name for r in named.collect()}
    assert got == {"a": "Card", "b": "Card (2)", "c": "Own", "d": "Card (3)", "f": "Unknown", "g": "Bar Chart"}
    resolution = reports.entity_tables(known(spark, "x"), spark.createDataFrame([], "measure_group string, physical_table string"))
    assert "b" not in {r.path.split("/")[-2] for r in reports.visual_tables(named, resolution).collect()}


def test_legacy_layout(spark):
    def config(*names):
        return {"config": json.dumps({"singleVisual": {"prototypeQuery": {"From": [{"Entity": n} for n in names]}}})}

    layout = json.dumps({"sections": [
        {"name": "s1", "visualContainers": [config("A", ""), {"config": "{bad"}, {}, config("B")]},
        {"name": "s2", "visualContainers": []}, {"name": "", "visualContainers": [config("C")]},
    ]})
    df = spark.createDataFrame([("r", layout), ("q", "nope")], "report_id string, layout string")
    deps = spark.createDataFrame([], "measure_group string, physical_table string")
    assert pages(reports.legacy_page_tables(df, known(spark, "a", "b"), deps)) == {("r", "s1"): {"a", "b"}, ("r", "s2"): set()}


def test_archive_index_last_file_wins(spark):
    def link(text):
        return json.dumps({"datasetReference": {"byConnection": {"connectionString": text}}})

    guid = "0A000000-0000-0000-0000-00000000000B"
    rows = [
        ("z", 0, "F/F.Report/definition.pbir", link(f"x;SemanticModelId={guid};")),
        ("z", 5, "G\\G.Report\\definition.pbir", link(f"semanticmodelid={guid}")),
        ("z", 6, "flat/definition.pbir", link(f"semanticmodelid={guid}")), ("z", 7, "H/H.Report/definition.pbir", "{"),
    ]
    got = reports.archive_index(spark.createDataFrame(rows, "archive string, ord long, path string, content string")).collect()
    assert [(r.model_id, r.folder, r.report_folder) for r in got] == [(guid.lower(), "G", "G/G.Report")]


def test_map_choice(spark):
    make = spark.createDataFrame
    reps = make([("r1", "M1"), ("r2", "m1"), ("r3", "m2"), ("r4", "m9"), ("r5", "m9")], "report_id string, dataset_id string")
    index = make([("m1", "F"), ("m2", "G")], "model_id string, report_folder string")
    maps = make([("F", "p1", "a"), ("F", "p2", None)], "report_folder string, page_id string, physical_table string")
    own = make([("r1", "p1"), ("r2", "other")], "report_id string, page_id string")
    first = make([(r, "d", "x") for r in ("r1", "r2", "r3", "r4")], "report_id string, page_id string, physical_table string")
    second = make([(r, "e", "y") for r in ("r4", "r5")], "report_id string, page_id string, physical_table string")
    got = {(r.report_id, r.page_id, r.map_source) for r in reports.choose_page_tables(reps, index, maps, own, [first, second]).collect()}
    # r2 shares the model but none of its pages is in the archive: it gets no map.
    assert got == {("r1", "p1", "archive"), ("r1", "p2", "archive"), ("r3", "d", "fallback_0"), ("r4", "d", "fallback_0"), ("r5", "e", "fallback_1")}
    only = reports.choose_page_tables(reps, index, maps, own, [first], archive_only=True)
    assert {r.report_id for r in only.collect()} == {"r1"}


def test_page_order_and_owner(spark):
    df = spark.createDataFrame([("r", "b", 1, 1), ("r", "a", None, 2), ("r", "c", 1, 0)], "report_id string, page_id string, page_order int, ord int")
    assert [r.page_id for r in reports.ordered_pages(df).collect()] == ["a", "c", "b"]
    people = spark.createDataFrame([("", "m"), ("c", "m"), (None, "")], "c string, m string")
    assert [r[0] for r in people.select(reports.report_owner(F.col("c"), F.col("m"))).collect()] == ["m", "c", None]


def test_braces_and_doubled_names_in_references(spark):
    texts = ['{"SourceRef":{"Entity":"a}b"}}', '{"SourceRef":{"Entity":"{c"}, "x":{"SourceRef":{"Entity":"d"}}}',
             '{"SourceRef":{"Entity":"e","Entity":"f"}}', '{"SourceRef":{"Entity":"g\\"}h"}}', '{"SourceRef":{"Entity":5}}']
    df = reports.with_entities(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string"))
    assert {r.i: set(r.entities) for r in df.collect()} == {0: {"a}b"}, 1: {"{c", "d"}, 2: {"f"}, 3: {'g"}h'}, 4: set()}


def test_other_page_lists_of_an_archive_do_not_count(spark):
    visual = json.dumps({"visual": {"visualType": "card", "q": {"SourceRef": {"Entity": "t1"}}}})
    base = "F/F.Report/definition/pages"
    rows = [
        ("F/F.Report", f"{base}/p1/visuals/v/visual.json", visual),
        ("F/F.Report", "F/F.Report/StaticResources/pages.json", json.dumps({"pageOrder": ["zzz"]})),
    ]
    df = spark.createDataFrame(rows, "report_id string, path string, content string")
    facts = reports.report_facts(df, archive=True)
    deps = spark.createDataFrame([], "measure_group string, physical_table string")
    got = reports.definition_page_tables(facts, known(spark, "t1"), deps, archive=True).collect()
    assert [tuple(r) for r in got] == [("F/F.Report", "p1", "t1")]
