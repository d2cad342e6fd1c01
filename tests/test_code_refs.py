import base64
import json

from pyspark.sql import functions as F

from catloom.operators import code_refs
from catloom.sources import definitions


def refs(spark, source, mode="compat"):
    row = code_refs.script_references(spark.createDataFrame([(source,)], "source string"), mode=mode).first()
    return row.reads, row.writes


def test_reads_and_writes(spark):
    source = """
df = Spark.Read.Table("silver.dbo.Orders")
x = spark.table('a.B').join(spark.read.format("delta").load("x.items"))
df.write.SAVEASTABLE("gold.sales"); df.writeTo ('g.Audit')
spark.sql("create or replace table if not exists gold.Dim as select * from silver.dim_src")
"""
    reads, writes = refs(spark, source)
    assert writes == ["audit", "dim", "sales"]
    assert reads == ["b", "dim_src", "items", "orders"]


def test_imports_count_as_reads_only_in_compat(spark):
    source = "from a.b import c\ndf = spark.sql('INSERT OVERWRITE TABLE g.x SELECT * FROM s.y')"
    assert refs(spark, source) == (["b", "y"], ["table"])
    assert refs(spark, source, "strict") == (["y"], ["x"])


def test_file_paths(spark):
    source = 'a.load("/mnt/a.parquet"); b.load("/mnt/raw"); c.load("t1")'
    assert refs(spark, source)[0] == ["parquet", "t1"]
    assert refs(spark, source, "strict")[0] == ["t1"]


def test_written_tables_are_not_reads_and_noise_is_dropped(spark):
    source = 'spark.table("t"); x.saveAsTable("t"); spark.sql("select * from information_schema where a from dual")'
    assert refs(spark, source) == ([], ["t"])


def test_statement_over_lines_and_unicode_space(spark):
    source = 'spark.sql("""\nINSERT INTO g.z\nSELECT 1 FROM s.q""")'
    assert refs(spark, source) == (["q"], ["z"])


def test_dataflow_references(spark):
    text = 'Source = #"My Table", b = "ab", c = \'x_y\', d = "My Table"'
    row = code_refs.dataflow_references(spark.createDataFrame([(text,)], "source string")).first()
    assert row.reads == ["my_table", "x_y"] and row.writes == []


def test_notebook_cells_of_both_forms(spark):
    doc = json.dumps({"cells": [
        {"cell_type": "code", "source": ["a\n", "b"]},
        {"cell_type": "markdown", "source": ["no"]},
        {"cell_type": "code", "source": "[1, 2]"},
        {"cell_type": "code"},
    ]})
    df = spark.createDataFrame([(doc,), ("not json",)], "x string")
    assert [r[0] for r in df.select(definitions.notebook_code(F.col("x"))).collect()] == ["a\nb\n[1, 2]\n", None]


def b64(text):
    return base64.b64encode(text if isinstance(text, bytes) else text.encode()).decode()


def test_source_choice(spark):
    artifacts = spark.createDataFrame(
        [(1, "n1", "One", "Notebook"), (2, "n2", "Two", "Notebook"), (3, "n3", "Three", "Notebook"),
         (4, "n4", "Four", "Notebook"), (5, "d1", "Flow", "Dataflow"), (6, "w", "W", "Warehouse")],
        "ord long, id string, display_name string, type string",
    )
    parts = spark.createDataFrame(
        [("n1", 0, ".platform", b64("x")), ("n1", 1, "a.py", b64('spark.table("p.first")')),
         ("n1", 2, "b.py", b64('spark.table("p.second")')), ("d1", 0, "Mashup.PQ", b64('#"Raw Data"'))],
        "item_id string, ord long, path string, payload string",
    )
    cell = json.dumps({"cells": [{"cell_type": "code", "source": 'spark.table("nb.two")'}]})
    files = definitions.local_scripts(spark.createDataFrame(
        [("/x/Two.ipynb", cell), ("/x/Two.py", 'spark.table("py.two")'), ("/x/THREE.py", 'spark.table("py.three")')],
        "path string, content string",
    ))
    got = {r.artifact_id: (r.source_method, r.reads) for r in code_refs.source_references(artifacts, parts, files).collect()}
    assert got == {
        "n1": ("getDefinition", ["first"]), "n2": ("local_file", ["two"]), "n3": ("local_file", ["three"]),
        "n4": ("none", []), "d1": ("getDefinition", ["raw_data"]),
    }


def test_payload_errors_are_reported(spark):
    parts = spark.createDataFrame(
        [("a", "ok.json", b64("{}")), ("a", "bad.json", b64("{")), ("a", "x.py", "***"), ("a", "u.py", b64(b"caf\xe9"))],
        "item_id string, path string, payload string",
    )
    errors = {(r.path, r.reason) for r in definitions.part_errors(parts).collect()}
    assert errors == {("bad.json", "json"), ("x.py", "payload")}
    text = definitions.decoded_parts(parts).where("path = 'u.py'").first().content
    assert text == b"caf\xe9".decode("utf-8", "replace")


def test_activities_of_documents(spark):
    doc = json.dumps({"properties": {"activities": [
        {"name": "a", "typeProperties": {"notebookId": "n1"}},
        {"name": "b", "typeProperties": {"notebookId": "", "artifactId": "n2"}, "dependsOn": [{"activity": "a"}]},
        {"name": "c"},
    ]}})
    df = spark.createDataFrame([(1, "p", doc), (2, "q", "{}")], "pipeline_ord long, pipeline_id string, definition string")
    got = [(r.ord, r.name, r.notebook_id, r.depends_on) for r in definitions.activities_of(df).orderBy("ord").collect()]
    assert got == [(0, "a", "n1", []), (1, "b", "n2", ["a"]), (2, "c", "", [])]
