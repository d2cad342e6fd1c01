"""Definition parts, notebook and pipeline documents, model documents, item scope: Spark form and SQL form.

The documents are built from the given tables, so the SQL states what must come out of them without reading JSON.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.operators import code_refs, graph, items, measures, reports
from catloom.session import checkpoint_folder
from catloom.sources import definitions, files
from checks.compose import with_fixtures
from checks.fixtures import fixture, table


def _numbered(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _kind() -> F.Column:
    key = F.col("c_custkey") % 5
    return F.when(key == 0, "Lakehouse").when(key == 1, "Warehouse").when(key == 2, "Notebook").when(key == 3, "Report").otherwise("Dashboard")


def _raw_items(s, d) -> DataFrame:
    """One item document per customer; every fiftieth text is no document."""
    layer = F.when(F.col("c_custkey") % 3 == 0, "bronze_lh_").when(F.col("c_custkey") % 3 == 1, "GOLD ").otherwise("plain_")
    doc = F.struct(
        _numbered("i-", "c_custkey").alias("id"), F.concat(layer, F.col("c_custkey").cast("string")).alias("displayName"),
        _kind().alias("type"), F.col("c_mktsegment").alias("description"),
        F.struct(
            F.when(F.col("c_custkey") % 2 == 0, "2024-05-06").alias("lastModifiedAt"), F.lit("2023-01-01").alias("modifiedDateTime"),
            F.struct(F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("userPrincipalName"), F.lit("shown").alias("displayName")).alias("createdBy"),
        ).alias("properties"),
    )
    raw = F.when(F.col("c_custkey") % 50 == 0, "not a document").otherwise(F.to_json(doc))
    return table(s, d, "customer").select(F.col("c_custkey").alias("ord"), raw.alias("raw"))


def _items(s, d) -> DataFrame:
    return items.normalize_items(_raw_items(s, d), "ws", "fx")


def _details(s, d) -> DataFrame:
    """Details of every customer's item: connection text in one of two places, or in none."""
    end = F.when(F.col("c_custkey") % 3 == 0, F.struct(F.col("c_name").alias("connectionString"), _numbered("e-", "c_custkey").alias("id")))
    other = F.when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    doc = F.struct(F.struct(end.alias("sqlEndpointProperties"), other.alias("connectionString"), F.lit("tables/").alias("oneLakeTablesPath")).alias("properties"))
    return table(s, d, "customer").select(_numbered("i-", "c_custkey").alias("id"), F.to_json(doc).alias("detail"))


def _containers(s, d) -> DataFrame:
    return items.normalize_containers(_items(s, d), _details(s, d))


def _pipelines(s, d) -> DataFrame:
    """One pipeline document per order, an activity per line in line order, each waiting for the line before."""
    act = F.struct(
        _numbered("act ", "l_linenumber").alias("name"),
        F.when(F.col("l_linenumber") > 1, F.array(F.struct(F.concat(F.lit("act "), (F.col("l_linenumber") - 1).cast("string")).alias("activity")))).alias("dependsOn"),
        F.struct(
            F.when(F.col("l_linenumber") % 2 == 0, _numbered("nb-", "l_suppkey")).alias("notebookId"),
            F.when(F.col("l_linenumber") % 3 == 0, _numbered("art-", "l_partkey")).alias("artifactId"),
        ).alias("typeProperties"),
    )
    rows = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    docs = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", act.alias("a")))).alias("acts"))
    return docs.select(
        F.col("l_orderkey").alias("pipeline_ord"), F.col("l_orderkey").cast("string").alias("pipeline_id"),
        F.to_json(F.struct(F.struct(F.col("acts.a").alias("activities")).alias("properties"))).alias("definition"),
    )


def _notebooks(s, d) -> DataFrame:
    """One notebook document per text of ``documents``: a code cell of lines, a cell of prose, a code cell of one text."""
    cell = lambda kind, source: F.concat(F.lit(f'{{"cell_type":"{kind}","source":'), source, F.lit("}"))
    text = F.to_json(F.array("text"))
    cells = F.array(
        cell("code", text), cell("markdown", F.lit('"prose"')),
        cell("code", F.concat(F.lit('"doc = '), F.col("doc_id").cast("string"), F.lit('"'))),
    )
    return table(s, d, "documents").where("text is not null").select(
        F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".ipynb")).alias("path"),
        F.concat(F.lit('{"cells":['), F.array_join(cells, ","), F.lit("]}")).alias("content"),
    )


def _parts(s, d) -> DataFrame:
    """Every document as a part with a base64 payload."""
    return table(s, d, "documents").select(
        "doc_id", F.concat(F.lit("a\\b\\"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"),
        F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", "").alias("payload"),
    )


def _models(s, d) -> DataFrame:
    """One model document per order line; its expression is a text or a list of lines."""
    whole = F.concat(F.lit("SUM(T_"), F.col("l_partkey").cast("string"), F.lit("[x])"))
    lines = F.to_json(F.array(F.lit("VAR a = 1"), whole))
    expression = F.when(F.col("l_linenumber") % 2 == 0, lines).otherwise(F.concat(F.lit('"'), whole, F.lit('"')))
    tables = F.concat(F.lit('{"tables":[{"name":"Measures '), F.col("l_suppkey").cast("string"), F.lit('","measures":[{"expression":'), expression, F.lit("}]}]}"))
    model = F.when(F.col("l_linenumber") % 3 == 0, tables).otherwise(F.concat(F.lit('{"model":'), tables, F.lit("}")))
    return table(s, d, "lineitem").select(_numbered("ds-", "l_orderkey").alias("dataset_id"), model.alias("model"))


def _measure_parts(s, d) -> DataFrame:
    """Table parts per part: half of the files are named like a physical table, some lie deeper."""
    name = F.when(F.col("p_partkey") % 2 == 0, _numbered("t_", "p_partkey")).otherwise(_numbered("Group ", "p_partkey"))
    folder = F.when(F.col("p_partkey") % 7 == 0, "definition/tables/x/").otherwise("definition/tables/")
    return table(s, d, "part").select(
        F.lit("m").alias("dataset_id"), F.concat(folder, name, F.lit(".tmdl")).alias("path"),
        F.base64(F.encode("p_name", "utf-8")).alias("payload"),
    )


def _measure_files(s, d) -> DataFrame:
    return table(s, d, "part").select(
        F.lit("m").alias("dataset_id"),
        F.concat(F.lit("model\\tables/"), F.when(F.col("p_partkey") % 2 == 0, _numbered("t_", "p_partkey")).otherwise(_numbered("Group ", "p_partkey")), F.lit("/measures/m.tmdl")).alias("path"),
        F.col("p_name").alias("content"),
    )


def _odd(text: F.Column, key: F.Column, doubled: str) -> F.Column:
    """Of every eight documents two hold NaN, two a doubled key whose first value is wrong, and one is cut short."""
    inner = F.substr(text, F.lit(2))
    return (
        F.when(key % 8 == 7, F.substr(text, F.lit(1), F.length(text) - 1))
        .when(key % 4 == 1, F.concat(F.lit('{"odd":[NaN,-Infinity],'), inner))
        .when(key % 4 == 2, F.concat(F.lit("{" + doubled + ","), inner))
        .otherwise(text)
    )


def _odd_items(s, d) -> DataFrame:
    return _raw_items(s, d).withColumn("raw", _odd(F.col("raw"), F.col("ord"), '"id":"wrong"'))


def _odd_pipelines(s, d) -> DataFrame:
    made = _pipelines(s, d)
    return made.withColumn("definition", _odd(F.col("definition"), F.col("pipeline_ord"), '"properties":{"activities":[{"name":"wrong"}]}'))


def _odd_notebooks(s, d) -> DataFrame:
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    return _notebooks(s, d).withColumn("content", _odd(F.col("content"), number, '"cells":[{"cell_type":"code","source":"wrong"}]'))


def _odd_models(s, d) -> DataFrame:
    number = F.regexp_extract("dataset_id", r"(\d+)", 1).cast("long")
    return _models(s, d).withColumn("model", _odd(F.col("model"), number, '"odd":[{"name":"wrong"}],"odd":null'))


def _odd_visuals(s, d) -> DataFrame:
    number = F.regexp_extract("path", r"/v\d+-(\d+)-", 1).cast("long")
    wrong = '"visual":{"visualType":"wrong","query":{"SourceRef":{"Entity":"wrong"}}}'
    return fixture(s, d, "fx_archive_parts").withColumn("content", _odd(F.col("content"), number, wrong))


def _known(s, d) -> DataFrame:
    return items.known_tables(fixture(s, d, "fx_tables"))


def _write_zips(s, d) -> str:
    """Every text as a JSON member of some archive, in one of three encodings; each task writes one archive. The folder."""
    folder = f"{checkpoint_folder(s)}/zips-{uuid.uuid4().hex}"
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.to_json(F.struct("text")).alias("body")).repartition(6, "doc_id")

    def write(batches):
        body, n = io.BytesIO(), 0
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as out:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                    out.writestr(f"n/{doc_id}.json", text.encode(("utf-8", "utf-8-sig", "utf-16-le")[doc_id % 3]))
                    n += 1
        store, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{uuid.uuid4().hex}.zip") as file:
            file.write(body.getvalue())
        yield pa.record_batch([pa.array([n])], ["n"])

    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    return folder


def _zipped_texts(s, d):
    members = files.read_archives(s, f"{_write_zips(s, d)}/*.zip", r"\.json$")
    return members.select("path", "problem", F.get_json_object(files.json_in_some_encoding("content"), "$.text").alias("text"))


def _script_items(s, d) -> DataFrame:
    return table(s, d, "orders").select(_numbered("nb-", "o_orderkey").alias("id"), _numbered("Script ", "o_orderkey").alias("display_name"))


def _script_parts(s, d) -> DataFrame:
    """A definition for every third script: a note, the code, and an older form of it."""
    forms = F.array(*[
        F.struct(F.lit(o).cast("long").alias("ord"), F.lit(path).alias("path"), F.base64(F.encode(F.concat(F.lit(head), F.col("o_orderkey").cast("string")), "utf-8")).alias("payload"))
        for o, path, head in ((0, "note.md", "note "), (1, "notebook-content.py", "code "), (2, "old.ipynb", "old "))
    ])
    return table(s, d, "orders").where("o_orderkey % 3 = 0").select(_numbered("nb-", "o_orderkey").alias("item_id"), F.inline(forms))


def _script_files(s, d) -> DataFrame:
    """Local files: of the exact name (a document beside a script), or of the name in another case."""
    rest = F.col("o_orderkey") % 4
    name = F.when(rest == 2, "sCRIPT ").otherwise("Script ")
    files = F.array(
        F.when(rest < 3, F.struct(F.concat(F.lit("dir/"), name, F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), _numbered("py ", "o_orderkey").alias("source"))),
        F.when(rest == 1, F.struct(F.concat(F.lit("dir/"), name, F.col("o_orderkey").cast("string"), F.lit(".ipynb")).alias("path"), _numbered("book ", "o_orderkey").alias("source"))),
    )
    return table(s, d, "orders").select(F.explode(files).alias("f")).where("f is not null").select("f.*")


QUERIES = {
    "script_sources": lambda s, d: code_refs.pick_script_sources(_script_items(s, d), _script_parts(s, d), _script_files(s, d)),
    "archive_members": _zipped_texts,
    "found_workspace": lambda s, d: items.find_workspace(
        table(s, d, "customer").select(F.col("c_custkey").alias("ord"), _numbered("w-", "c_custkey").alias("id"), F.col("c_mktsegment").alias("display_name")), "BUILDING"
    ),
    "normalized_items": lambda s, d: _items(s, d),
    "scoped_items": lambda s, d: items.in_scope(_items(s, d)).select("ord", "id", "type"),
    "container_details": lambda s, d: _containers(s, d).select(
        "id", "sql_endpoint.connection_string", "sql_endpoint.endpoint_id", "tables_path", "files_path"
    ),
    "profilable_containers": lambda s, d: items.profilable(_containers(s, d), "bronze, GOLD").select("id", "layer"),
    "pipeline_activities": lambda s, d: definitions.activities_of(_pipelines(s, d)).withColumn("depends_on", F.array_join("depends_on", ",")),
    "notebook_sources": lambda s, d: definitions.local_scripts(_notebooks(s, d)),
    "decoded_parts": lambda s, d: definitions.decoded_parts(_parts(s, d)),
    "odd_items": lambda s, d: items.normalize_items(_odd_items(s, d), "ws", "fx"),
    "odd_pipelines": lambda s, d: definitions.activities_of(_odd_pipelines(s, d)).withColumn("depends_on", F.array_join("depends_on", ",")),
    "odd_notebooks": lambda s, d: definitions.local_scripts(_odd_notebooks(s, d)),
    "odd_models": lambda s, d: measures.measures_of_model(_odd_models(s, d)),
    "odd_visuals": lambda s, d: reports.report_facts(_odd_visuals(s, d), archive=True).select(
        "report_id", "path", "page_id", "visual_type", "title", F.array_join(F.array_sort("entities"), ",").alias("entities")
    ),
    "odd_part_errors": lambda s, d: definitions.part_errors(
        _odd_items(s, d).select("ord", F.concat(F.lit("x/"), F.col("ord").cast("string"), F.lit(".json")).alias("path"), F.base64("raw").alias("payload"))
    ),
    "model_measures": lambda s, d: measures.measures_of_model(_models(s, d)),
    "table_part_measures": lambda s, d: measures.measures_of_table_parts(_measure_parts(s, d), _known(s, d)).select("dataset_id", "measure_group", "expr"),
    "measure_file_measures": lambda s, d: measures.measures_of_measure_files(_measure_files(s, d), _known(s, d)).select("dataset_id", "measure_group", "expr"),
    "stored_measure_deps": lambda s, d: definitions.stored_measure_deps(
        table(s, d, "lineitem").select(_numbered("Measures ", "l_suppkey").alias("measure_group"), _numbered("T_", "l_partkey").alias("physical_table")), _known(s, d)
    ),
    "node_counts": lambda s, d: graph.node_counts(fixture(s, d, "fx_paged_objects")),
    "report_pages": lambda s, d: reports.ordered_pages(
        fixture(s, d, "fx_pages").withColumn("ord", F.regexp_extract("page_id", r"(\d+)", 1).cast("long"))
    ).select("report_id", "page_id", "page_order", reports.page_visibility(F.col("visibility")).alias("visibility")),
}

_TYPE = "CASE c_custkey % 5 WHEN 0 THEN 'Lakehouse' WHEN 1 THEN 'Warehouse' WHEN 2 THEN 'Notebook' WHEN 3 THEN 'Report' ELSE 'Dashboard' END"
_LAYER = "CASE c_custkey % 3 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Gold' ELSE 'Unknown' END"
_DOCUMENT = "c_custkey % 50 <> 0"

ORACLES = {
    "script_sources": """
SELECT concat('nb-', o_orderkey) AS id, concat('Script ', o_orderkey) AS display_name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'getDefinition' WHEN o_orderkey % 4 < 3 THEN 'local_file' ELSE 'none' END AS source_method,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('code ', o_orderkey) WHEN o_orderkey % 4 = 1 THEN concat('book ', o_orderkey) WHEN o_orderkey % 4 < 3 THEN concat('py ', o_orderkey) END AS source
FROM orders""",
    "archive_members": "SELECT concat('n/', doc_id, '.json') AS path, NULL AS problem, text FROM documents WHERE text IS NOT NULL",
    "found_workspace": "SELECT c_custkey AS ord, concat('w-', c_custkey) AS id, c_mktsegment AS display_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1",
    "normalized_items": f"""
SELECT c_custkey AS ord, concat('i-', c_custkey) AS id, concat(CASE c_custkey % 3 WHEN 0 THEN 'bronze_lh_' WHEN 1 THEN 'GOLD ' ELSE 'plain_' END, c_custkey) AS display_name,
  {_TYPE} AS type, 'ws' AS workspace_id, 'fx' AS workspace_name, c_mktsegment AS description,
  CASE WHEN c_custkey % 2 = 0 THEN '2024-05-06' ELSE '2023-01-01' END AS last_modified, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'shown' END AS created_by, {_LAYER} AS layer
FROM customer WHERE {_DOCUMENT}""",
    "scoped_items": f"SELECT c_custkey AS ord, concat('i-', c_custkey) AS id, {_TYPE} AS type FROM customer WHERE {_DOCUMENT} AND c_custkey % 5 < 3",
    "container_details": f"""
SELECT concat('i-', c_custkey) AS id, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS connection_string,
  CASE c_custkey % 3 WHEN 0 THEN concat('e-', c_custkey) WHEN 1 THEN '' END AS endpoint_id, 'tables/' AS tables_path, '' AS files_path
FROM customer WHERE {_DOCUMENT} AND c_custkey % 5 < 2""",
    "profilable_containers": f"SELECT concat('i-', c_custkey) AS id, {_LAYER} AS layer FROM customer WHERE {_DOCUMENT} AND c_custkey % 5 < 2 AND c_custkey % 3 < 2",
    "pipeline_activities": """
SELECT l_orderkey AS pipeline_ord, CAST(l_orderkey AS VARCHAR) AS pipeline_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS BIGINT) AS ord,
  concat('act ', l_linenumber) AS name,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('nb-', min(l_suppkey)) WHEN l_linenumber % 3 = 0 THEN concat('art-', min(l_partkey)) ELSE '' END AS notebook_id,
  CASE WHEN l_linenumber > 1 THEN concat('act ', l_linenumber - 1) ELSE '' END AS depends_on
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "notebook_sources": "SELECT concat('n/', doc_id, '.ipynb') AS path, concat(text, chr(10), 'doc = ', doc_id) AS source FROM documents WHERE text IS NOT NULL",
    "decoded_parts": "SELECT doc_id, concat('a/b/', doc_id, '.json') AS path, text AS content FROM documents",
    "model_measures": """
SELECT concat('ds-', l_orderkey) AS dataset_id, concat('Measures ', l_suppkey) AS measure_group,
  concat(CASE WHEN l_linenumber % 2 = 0 THEN concat('VAR a = 1', chr(10)) ELSE '' END, 'SUM(T_', l_partkey, '[x])') AS expr FROM lineitem""",
    "table_part_measures": "SELECT 'm' AS dataset_id, concat('Group ', p_partkey) AS measure_group, p_name AS expr FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 7 <> 0",
    "measure_file_measures": "SELECT 'm' AS dataset_id, concat('Group ', p_partkey) AS measure_group, p_name AS expr FROM part WHERE p_partkey % 2 = 1",
    "stored_measure_deps": """
SELECT DISTINCT concat('measures ', l_suppkey) AS measure_group, concat('t_', l_partkey) AS physical_table FROM lineitem
WHERE l_partkey IN (SELECT p_partkey - p_partkey % 2 FROM part)""",
    "node_counts": with_fixtures("SELECT objects_type, count(*) AS total FROM fx_paged_objects GROUP BY 1"),
    "report_pages": """
SELECT concat('r-', o_custkey) AS report_id, concat('p-', o_orderkey) AS page_id, o_orderkey % 7 AS page_order,
  CASE WHEN o_orderstatus = 'P' THEN 'hidden' ELSE 'visible' END AS visibility FROM orders""",
}

ORACLES |= {
    "odd_items": ORACLES["normalized_items"] + " AND c_custkey % 8 <> 7",
    "odd_pipelines": ORACLES["pipeline_activities"].replace("FROM lineitem GROUP BY", "FROM lineitem WHERE l_orderkey % 8 <> 7 GROUP BY"),
    "odd_notebooks": """
SELECT concat('n/', doc_id, '.ipynb') AS path, CASE WHEN doc_id % 8 <> 7 THEN concat(text, chr(10), 'doc = ', doc_id) END AS source
FROM documents WHERE text IS NOT NULL""",
    "odd_models": ORACLES["model_measures"] + " WHERE l_orderkey % 8 <> 7",
    "odd_visuals": with_fixtures("""
SELECT report_id, path, CASE WHEN good THEN regexp_extract(path, 'pages/([^/]+)/visuals', 1) END AS page_id,
  CASE WHEN good THEN json_extract_string(content, '$.visual.visualType') END AS visual_type,
  CASE WHEN good THEN nullif(trim(coalesce(json_extract_string(content, '$.visual.visualContainerObjects.title[0].properties.text.expr.Literal.Value'), ''), chr(39)), '') END AS title,
  CASE WHEN good THEN array_to_string(list_sort(list_distinct(regexp_extract_all(content, '"Entity":"([^"]*)"', 1))), ',') END AS entities
FROM (SELECT *, CAST(regexp_extract(path, '/v[0-9]+-([0-9]+)-', 1) AS BIGINT) % 8 <> 7 AS good FROM fx_archive_parts)"""),
    "odd_part_errors": """
SELECT c_custkey AS ord, concat('x/', c_custkey, '.json') AS path, 'json' AS reason FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 8 = 7""",
}
