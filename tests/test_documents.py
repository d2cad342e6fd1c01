"""Documents that Spark's variant type refuses."""

import json
import random

import pytest
from pyspark.sql import functions as F

from catloom.functions import documents
from catloom.operators import items, measures, reports
from catloom.sources import definitions


def plain_entities(node):
    if isinstance(node, dict):
        ref = node.get("SourceRef")
        name = ref.get("Entity") if isinstance(ref, dict) else None
        own = {name} if isinstance(name, str) and name else set()
        return own.union(*map(plain_entities, node.values()))
    return set().union(*map(plain_entities, node)) if isinstance(node, list) else set()


def finite(node):
    if isinstance(node, float) and node in (float("inf"), -float("inf")) or node != node:
        return None
    if isinstance(node, dict):
        return {k: finite(v) for k, v in node.items()}
    return [finite(v) for v in node] if isinstance(node, list) else node


def made(rng, depth=0):
    space = lambda: rng.choice(["", "", " ", "\n\t"])
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        return rng.choice(["1", "-2.5e3", '"s"', '""', "true", "null", "NaN", "-Infinity", '"\\u00e9\\n"', "[]", "{ }", '"A"', '"B"'])
    if kind < 0.6:
        return "[" + f"{space()},{space()}".join(made(rng, depth + 1) for _ in range(rng.randint(1, 3))) + "]"
    pairs = [f'"{rng.choice(["SourceRef", "Entity", "a", "b"])}"{space()}:{space()}{made(rng, depth + 1)}' for _ in range(rng.randint(1, 4))]
    return "{" + f"{space()},{space()}".join(pairs) + "}"


def test_reader_agrees_with_json_loads():
    rng, good = random.Random(1), 0
    for _ in range(4000):
        text = made(rng)
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", ":", '"', "}", "]", "x", " "]) + text[at + 1 :]
        try:
            want = json.loads(text)
        except ValueError:
            with pytest.raises(ValueError):
                documents.read(text, {})
            continue
        kept, found = documents.read(text, documents._ALL)
        assert json.loads(documents._plain(kept)) == finite(want)
        assert len(found) == len(set(found)) and set(found) == plain_entities(want)
        part = documents.read(text, documents.path_tree(["a.b", "a.*"]))[0]
        if isinstance(want, dict) and isinstance(want.get("a"), dict):
            assert json.loads(documents._plain(part)) == {"a": {"b": finite(want["a"]["b"])} if "b" in want["a"] else {}}
        good += 1
    assert good > 2000


def test_deep_long_and_broken_texts():
    deep = "[" * 5000 + '{"SourceRef":{"Entity":"deep"}}' + "]" * 5000
    assert documents.read(deep, None)[1] == ["deep"]
    for text in ("", " ", "{", '{"a"}', "[1,]", "{,}", "1 2", "nul", '"open', '{"a":1,}', "[1 2]"):
        with pytest.raises(ValueError):
            documents.read(text, None)


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


ODD = '"odd":[NaN, Infinity],'


def test_refused_visuals_keep_their_pages(spark):
    def visual(page, head, entity):
        body = f'{{{head}"visual":{{"visualType":"card","query":{{"SourceRef":{{"Entity":"{entity}"}}}}}}}}'
        return "r", f"definition/pages/{page}/visuals/v/visual.json", body

    big = '"fill":"' + "x" * 200_000 + '",'
    rows = [
        visual("plain", "", "A"), visual("nan", ODD, "B"), visual("twice", '"visual":{"visualType":"old","q":{"SourceRef":{"Entity":"Z"}}},', "C"),
        visual("big", ODD + big, "D"), visual("half", '"x":"\\ud800",', "E"), ("r", "definition/pages/cut/visuals/v/visual.json", '{"visual":'),
        ("r", "definition/pages/pages.json", '{"pageOrder":["plain"],"pageOrder":["nan","twice"]}'),
    ]
    facts = reports.report_facts(frame(spark, rows, "report_id string, path string, content string"))
    got = {r.page_id: (r.visual_type, r.entities) for r in facts.where("page_id IS NOT NULL").collect()}
    assert got == {"plain": ("card", ["A"]), "nan": ("card", ["B"]), "twice": ("card", ["C"]), "big": ("card", ["D"]), "half": ("card", ["E"])}
    assert [r.page_order for r in facts.where("page_order IS NOT NULL").collect()] == [["nan", "twice"]]


def test_other_refused_documents(spark):
    raw = [(1, '{"id":"old","id":"a","displayName":"bronze x","type":"Notebook","n":NaN}'), (2, '{"id":"b","type":"Report"}'), (3, '{"id":')]
    got = {r.ord: (r.id, r.layer) for r in items.normalize_items(frame(spark, raw, "ord long, raw string"), "ws", "Space").collect()}
    assert got == {1: ("a", "Bronze"), 2: ("b", None)} or got == {1: ("a", "Bronze"), 2: ("b", "Unknown")}
    layout = json.dumps({"sections": [{"name": "s", "visualContainers": [{"config": '{"n":NaN,"singleVisual":{"prototypeQuery":{"From":[{"Entity":"T"}]}}}'}]}]})
    found = reports.legacy_entities(frame(spark, [("r", layout), ("q", "{" + ODD + layout[1:])], "report_id string, layout string"))
    assert sorted(map(tuple, found.collect())) == [("q", "s", "T"), ("r", "s", "T")]
    flow = '{"n":NaN,"properties":{"activities":[{"name":"x","name":"a","dependsOn":[{"activity":"z"}]},{"typeProperties":{"artifactId":"7"}}]}}'
    acts = definitions.activities_of(frame(spark, [(1, "p", flow)], "pipeline_ord long, pipeline_id string, definition string")).collect()
    assert [(r.ord, r.name, r.notebook_id, r.depends_on) for r in acts] == [(0, "a", "", ["z"]), (1, "", "7", [])]
    book = '{"cells":[],"cells":[{"cell_type":"code","source":["x\\n","y"]},{"cell_type":"markdown","source":"no"},{"cell_type":"code","source":"z","m":NaN}]}'
    files = frame(spark, [("a.ipynb", book), ("b.ipynb", "{"), ("c.py", "{ not json")], "path string, content string")
    assert {r.path: r.source for r in definitions.local_scripts(files).collect()} == {"a.ipynb": "x\ny\nz", "b.ipynb": None, "c.py": "{ not json"}
    model = '{"v":NaN,"model":{"tables":[{"name":"M","measures":[{"expression":["a","b"]},{"expression":"c"}]}]}}'
    rows = measures.measures_of_model(frame(spark, [("d", model)], "dataset_id string, model string")).collect()
    assert sorted((r.measure_group, r.expr) for r in rows) == [("M", "a\nb"), ("M", "c")]
    member = ("z", 1, "F/F.Report/definition.pbir", '{"v":NaN,"datasetReference":{"byConnection":{"connectionString":"semanticmodelid=00000000-0000-0000-0000-000000000001"}}}')
    assert reports.archive_index(frame(spark, [member], "archive string, ord long, path string, content string")).count() == 1
    parts = frame(spark, [("a.json", '{"n":NaN}'), ("b.json", '{"n":1,"n":2}'), ("c.json", "{"), ("d.ipynb", "x"), ("e.txt", "{")], "path string, body string")
    errors = definitions.part_errors(parts.select("path", F.base64("body").alias("payload")))
    assert {(r.path, r.reason) for r in errors.collect()} == {("c.json", "json"), ("d.ipynb", "json")}
