"""Code references, run order, layers, edges, document views: Spark form and SQL form."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.functions import text
from catloom.functions.ranking import rank_in_group
from catloom.operators import activities as A
from catloom.operators import code_refs, docs, edges, items
from catloom.session import checkpoint_folder, cut_lineage
from catloom.sources import store
from checks.compose import STEPS, with_fixtures
from checks.fixtures import fixture, table

# Inputs -------------------------------------------------------------------


def _activities(s, d) -> DataFrame:
    waits = F.when(F.col("depends_on").isNull(), F.array().cast("array<string>")).otherwise(F.array("depends_on"))
    return fixture(s, d, "fx_activities").select(
        F.col("pipeline_id").alias("pipeline_ord"), F.col("pipeline_id").cast("string").alias("pipeline_id"),
        F.col("ord").cast("long").alias("ord"), "name", "notebook_id", waits.alias("depends_on"),
    )


def _tied(s, d) -> DataFrame:
    waits = F.when(F.col("waits") == "", F.array().cast("array<string>")).otherwise(F.split("waits", ","))
    return fixture(s, d, "fx_tied_activities").select(
        F.col("pipeline_id").alias("pipeline_ord"), F.col("pipeline_id").cast("string").alias("pipeline_id"), F.col("ord").cast("long").alias("ord"),
        "name", F.lit("").alias("notebook_id"), waits.alias("depends_on"),
    )


def _scripts(s, d, mode="compat") -> DataFrame:
    return code_refs.script_references(fixture(s, d, "fx_sources"), mode=mode)


def _sources(s, d) -> DataFrame:
    """References of the scripts; the notebooks among the suppliers have no source."""
    refs = _scripts(s, d).select(
        F.concat(F.lit("nb-"), F.col("notebook_id").cast("string")).alias("id"), "reads", "writes",
        F.lit("getDefinition").alias("source_method"),
    )
    none = F.array().cast("array<string>")
    books = fixture(s, d, "fx_artifacts").where(F.col("type") == "Notebook").join(refs, "id", "left")
    return books.select(
        F.col("id").alias("artifact_id"), "display_name", F.coalesce("source_method", F.lit("none")).alias("source_method"),
        F.coalesce("reads", none).alias("reads"), F.coalesce("writes", none).alias("writes"),
        F.struct(F.lit(0).alias("_kind"), F.col("ord")).alias("src_ord"),
    )


def _transitions(s, d) -> DataFrame:
    ordered = A.run_order(_activities(s, d))
    return A.layer_transitions(ordered, fixture(s, d, "fx_tables"), fixture(s, d, "fx_artifacts"))


def lineage_inputs(s, d) -> tuple[DataFrame, ...]:
    """Containers, tables, artifacts, sources, transitions. The extracted references are used many times."""
    sources, transitions = cut_lineage(_sources(s, d)), _transitions(s, d)
    return fixture(s, d, "fx_containers"), fixture(s, d, "fx_tables"), fixture(s, d, "fx_artifacts"), sources, transitions


def lineage_files(s, d) -> DataFrame:
    """Non-empty files with a listing order."""
    return fixture(s, d, "fx_files").where(F.col("size") > 0).select(
        "lh_id", "name", "size", F.regexp_extract("name", r"f(\d+)\.html$", 1).cast("long").alias("ord")
    )


def layers(s, d) -> list[edges.LayerEdges]:
    """The edges into gold and silver tables, those of a container's unclaimed tables once for the container."""
    inputs = lineage_inputs(s, d)
    return [edges.gold_layer(*inputs), edges.silver_layer(*inputs)]


def all_edges(s, d) -> DataFrame:
    gold, silver = layers(s, d)
    return edges.expand_groups(gold).unionByName(edges.expand_groups(silver))


def input_sets(s, d) -> DataFrame:
    return edges.input_sets(fixture(s, d, "fx_containers"), fixture(s, d, "fx_tables"), lineage_files(s, d))


def _input_spans(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """How many inputs each table has by writer, the first and the last of them, from a row per edge and input.

    Spark sorts rows to find the least text but hashes them to find the least number, so names of sets are numbered in their order first.
    """
    keys = ["block", "output_lh", "output_table", "notebook_name"]
    names = sets.where(F.col("ref").isNotNull()).select(F.lit(0).alias("_all"), "ref").distinct()
    names = cut_lineage(rank_in_group(names, ["_all"], "ref", "ref_no").select("ref", "ref_no"))
    numbered = sets.join(names, "ref", "left").withColumn("of_set", F.lit(True))
    wide = edges.expand_inputs(rows, numbered)

    def spans(df: DataFrame, c: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("first"), F.max(c).alias("last"))

    shared = cut_lineage(spans(wide.where("of_set"), "ref_no"))
    for end in ("first", "last"):
        shared = shared.join(names.select(F.col("ref_no").alias(end), F.col("ref").alias(f"{end}_ref")), end, "left")
    texts = shared.select(*keys, "n", F.col("first_ref").alias("first"), F.col("last_ref").alias("last"))
    both = spans(wide.where("of_set IS NULL"), "ref").unionByName(texts)
    return both.groupBy(*keys).agg(F.sum("n").alias("n_inputs"), F.min("first").alias("first_ref"), F.max("last").alias("last_ref"))


def full_tables(s, d) -> DataFrame:
    """Tables with the container's name and the columns later steps add."""
    homes = fixture(s, d, "fx_containers").select(F.col("id").alias("lh_id"), F.col("display_name").alias("lh_name"))
    return fixture(s, d, "fx_tables").join(homes, "lh_id").withColumns(
        {"workspace_name": F.lit("fx"), "description": F.lit(""), "last_updated": F.lit("")}
    )


def _reread(s, view: DataFrame) -> DataFrame:
    """A document view as its written file reads: texts, empty ones as nothing."""
    folder = f"{checkpoint_folder(s)}/documents-{uuid.uuid4().hex}"
    store.write_documents({"tables": view}, folder)
    return s.read.csv(f"{folder}/tables", header=True, multiLine=True, escape='"', schema=", ".join(f"{c} string" for c in view.columns))


def _edge_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "output_lh", "output_table", "notebook_id", "notebook_name", "input_set",
        F.array_join("input_refs", ", ").alias("inputs"), "confidence", "notes",
    )


QUERIES = {
    "layer_detect": lambda s, d: fixture(s, d, "fx_items").select(
        "id", text.detect_item_layer(F.col("display_name"), F.col("description")).alias("layer")
    ),
    "layer_activity": lambda s, d: fixture(s, d, "fx_activities").select(
        "pipeline_id", "ord", text.detect_activity_layer(F.col("name")).alias("layer")
    ),
    "code_refs": lambda s, d: _scripts(s, d).select(
        "notebook_id", F.array_join("reads", ", ").alias("reads"), F.array_join("writes", ", ").alias("writes")
    ),
    "code_refs_strict": lambda s, d: _scripts(s, d, "strict").select(
        "notebook_id", F.array_join("reads", ", ").alias("reads"), F.array_join("writes", ", ").alias("writes")
    ),
    "dataflow_refs": lambda s, d: code_refs.dataflow_references(fixture(s, d, "fx_sources")).select(
        "notebook_id", F.array_join("reads", ", ").alias("reads")
    ),
    "document_script_refs": lambda s, d: code_refs.script_references(table(s, d, "documents"), source="text").select(
        "doc_id", F.array_join("reads", ", ").alias("reads"), F.array_join("writes", ", ").alias("writes")
    ),
    "activity_order": lambda s, d: A.run_order(_activities(s, d)).select("pipeline_id", "ord", "name", "position"),
    "activity_order_ties": lambda s, d: A.run_order(_tied(s, d)).select("pipeline_id", "ord", "name", "position"),
    "activity_order_by_chains": lambda s, d: A.run_order(_tied(s, d), group_rows=2).select("pipeline_id", "ord", "name", "position"),
    "activities_never_run": lambda s, d: A.never_run(_activities(s, d), A.run_order(_activities(s, d))).select(
        "pipeline_id", "ord", "name"
    ),
    "activity_notebooks": lambda s, d: items.activity_notebook_names(_activities(s, d), fixture(s, d, "fx_artifacts")).select(
        "pipeline_id", "ord", "notebook_name"
    ),
    "layer_transitions": lambda s, d: _transitions(s, d).select("artifact_id", "read_layer", "write_layer"),
    "edges_gold": lambda s, d: _edge_columns(edges.gold_edges(*lineage_inputs(s, d))),
    "edges_silver": lambda s, d: _edge_columns(edges.silver_edges(*lineage_inputs(s, d))),
    "edge_groups": lambda s, d: reduce(DataFrame.unionByName, [x.groups for x in layers(s, d)]).select(
        "block", "lh_id", "namesake", "notebook_id", "notebook_name", "input_set", "own_name",
        F.when(~F.col("own_name"), F.array_join("input_refs", ", ")).alias("inputs"), "confidence", "notes",
    ),
    "edge_group_members": lambda s, d: reduce(DataFrame.unionByName, [x.members for x in layers(s, d)]).select(
        "block", "lh_id", "namesake", "output_lh", "output_table"
    ),
    "input_set_texts": lambda s, d: edges.set_texts(input_sets(s, d)),
    "edge_inputs": lambda s, d: _input_spans(all_edges(s, d), input_sets(s, d)),
    "input_sets": lambda s, d: input_sets(s, d).select("input_set", "ref"),
    "source_backfill": lambda s, d: edges.fill_source_artifact(full_tables(s, d), *layers(s, d)).select(
        "lh_id", "ord", "table_name", "source_artifact"
    ),
    "data_sources": lambda s, d: edges.data_sources(fixture(s, d, "fx_containers"), lineage_files(s, d)).drop("row_ord"),
    "files_per_container": lambda s, d: items.files_per_container(lineage_files(s, d)),
    "doc_artifacts": lambda s, d: docs.artifacts_view(
        items.documented(fixture(s, d, "fx_items")).withColumns(
            {"workspace_name": F.lit("fx"), "last_modified": F.lit(""), "created_by": F.lit("")}
        )
    ),
    "doc_tables": lambda s, d: docs.tables_view(edges.fill_source_artifact(full_tables(s, d), *layers(s, d))),
    "documents_reread": lambda s, d: _reread(s, docs.tables_view(edges.fill_source_artifact(full_tables(s, d), *layers(s, d)))),
    "doc_sources": lambda s, d: docs.sources_view(
        edges.data_sources(fixture(s, d, "fx_containers"), lineage_files(s, d))
    ),
    "doc_lineage": lambda s, d: docs.lineage_view(all_edges(s, d), edges.set_texts(input_sets(s, d))),
    "lineage_lines": lambda s, d: docs.lineage_lines(all_edges(s, d), edges.set_texts(input_sets(s, d))).select("block", "line"),
}

# SQL steps ----------------------------------------------------------------

_WRITE = r"""(?i)\.saveAsTable\s*\(\s*["'']([^"'']+)["'']"""
_WRITE_TO = r"""(?i)\.writeTo\s*\(\s*["'']([^"'']+)["'']"""
_SQL_WRITE = r"""(?is)spark\.sql\s*\(\s*["''].*?(?:INSERT\s+(?:OVERWRITE\s+)?(?:INTO\s+)?|CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?)([a-zA-Z_][a-zA-Z0-9_.]+)"""
_READS = [
    r"""(?i)spark\.read\.table\s*\(\s*["'']([^"'']+)["'']""",
    r"""(?i)spark\.table\s*\(\s*["'']([^"'']+)["'']""",
    r"""(?i)\.load\s*\(\s*["'']([^"'']+)["'']""",
    r"""(?i)\bFROM\s+([a-zA-Z_][a-zA-Z0-9_.]+)\b""",
]
_NOISE = "'information_schema','sys','dual','subquery','cte','where','join','on','and','or','as'"
_CLEAN = "lower(list_extract(string_split(trim(trim(r), '\"''`'), '.'), -1))"


def _refs_sql(source: str, key: str, body: str, writes_pattern: str = _SQL_WRITE) -> str:
    writes = " || ".join(f"regexp_extract_all({source}, '{p}', 1)" for p in (_WRITE, _WRITE_TO, writes_pattern))
    reads = " || ".join(f"regexp_extract_all({body}, '{p}', 1)" for p in _READS)
    return f"""
SELECT {key}, list_sort(list_filter(r0, lambda x: NOT list_contains(w0, x))) AS reads, w0 AS writes FROM (
  SELECT {key},
    list_sort(list_distinct(list_filter(list_transform({writes}, lambda r: {_CLEAN}), lambda x: x <> ''))) AS w0,
    list_distinct(list_filter(list_transform({reads}, lambda r: {_CLEAN}),
      lambda x: x <> '' AND NOT starts_with(x, '/') AND x NOT IN ({_NOISE}))) AS r0
  FROM __from__)"""


STEPS["st_refs"] = _refs_sql("source", "notebook_id", "source").replace("__from__", "fx_sources")
STEPS["st_refs_strict"] = _refs_sql(
    "source", "notebook_id", "regexp_replace(source, '(?m)^[ \\t]*from[ \\t]+[\\w.]+[ \\t]+import\\b.*$', '', 'g')"
).replace("__from__", "fx_sources")
STEPS["st_doc_refs"] = _refs_sql("text", "doc_id", "text").replace("__from__", "documents")

STEPS["st_sources"] = """
SELECT a.id AS artifact_id, a.ord, r.notebook_id IS NOT NULL AS has_source,
       CASE WHEN r.notebook_id IS NULL THEN [] ELSE r.reads END AS reads,
       CASE WHEN r.notebook_id IS NULL THEN [] ELSE r.writes END AS writes
FROM fx_artifacts a LEFT JOIN st_refs r ON a.id = concat('nb-', r.notebook_id) WHERE a.type = 'Notebook'"""

# The activities of a pipeline form chains, so the run order is the depth in the chain.
STEPS["st_order"] = """
SELECT a.pipeline_id, a.ord, a.name, a.notebook_id, CAST(a.ord - 1 AS BIGINT) AS position
FROM fx_activities a
WHERE (SELECT count(*) FROM fx_activities b WHERE b.pipeline_id = a.pipeline_id AND b.ord <= a.ord) = a.ord"""

STEPS["st_given"] = """
SELECT pipeline_id, position, notebook_id,
  CASE WHEN contains(lower(name), 'gold') THEN 'Gold' WHEN contains(lower(name), 'silver') THEN 'Silver'
       WHEN contains(lower(name), 'bronze') THEN 'Bronze'
       WHEN n = 1 THEN CASE WHEN has_gold AND has_silver THEN 'Gold' WHEN has_silver THEN 'Silver' END
       WHEN i = 1 THEN 'Silver' WHEN i = n THEN 'Gold' END AS write_layer
FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY position) AS i,
             count(*) OVER (PARTITION BY pipeline_id) AS n,
             (SELECT count(*) > 0 FROM fx_tables WHERE layer = 'Gold') AS has_gold,
             (SELECT count(*) > 0 FROM fx_tables WHERE layer = 'Silver') AS has_silver
      FROM st_order WHERE notebook_id <> '')"""

STEPS["st_piped"] = """
SELECT notebook_id AS artifact_id, arg_max(write_layer, pipeline_id * 100 + position) AS write_layer,
       min(pipeline_id * 100 + position) AS ins
FROM st_given WHERE write_layer IS NOT NULL GROUP BY notebook_id"""

STEPS["st_named"] = """
SELECT id AS artifact_id, ord,
  CASE WHEN regexp_matches(lower(display_name), 'silver_to_gold|silver2gold|silvertogold') THEN 'Gold'
       WHEN regexp_matches(lower(display_name), 'bronze_to_silver|bronze2silver|bronzetosilver') THEN 'Silver'
       WHEN regexp_matches(lower(display_name), 'bronze_to_gold|bronze2gold') THEN 'Gold' END AS write_layer,
  CASE WHEN regexp_matches(lower(display_name), 'silver_to_gold|silver2gold|silvertogold') THEN 'Silver' ELSE 'Bronze' END AS read_layer
FROM fx_artifacts WHERE type = 'Notebook'"""

STEPS["st_transitions"] = """
SELECT artifact_id, CASE write_layer WHEN 'Gold' THEN 'Silver' WHEN 'Silver' THEN 'Bronze' ELSE 'External' END AS read_layer,
       write_layer, ins FROM st_piped
UNION ALL SELECT artifact_id, read_layer, write_layer, 1000000000000 + ord FROM st_named
WHERE write_layer IS NOT NULL AND artifact_id NOT IN (SELECT artifact_id FROM st_piped)
  AND write_layer NOT IN (SELECT write_layer FROM st_piped)"""

STEPS["st_layered"] = """
SELECT t.lh_id, c.layer, c.display_name AS output_lh, t.table_name AS output_table, lower(t.table_name) AS tname,
       c.ord * 1000000000 + t.ord AS out_ord
FROM fx_tables t JOIN fx_containers c ON c.id = t.lh_id"""

STEPS["st_orphans"] = """
SELECT l.*, CASE l.layer WHEN 'Gold' THEN replace(replace(replace(replace(replace(replace(lower(output_lh),
  'gold_wh_', ''), 'gold_lh_', ''), 'gold_', ''), '_wh', ''), '_warehouse', ''), '_lakehouse', '')
  ELSE replace(replace(lower(output_lh), 'silver_lh_', ''), 'silver_', '') END AS domain
FROM st_layered l WHERE layer IN ('Gold', 'Silver')
  AND tname NOT IN (SELECT unnest(writes) FROM st_sources)"""

STEPS["st_writers"] = """
SELECT t.*, coalesce(a.display_name, t.artifact_id) AS writer_name
FROM st_transitions t LEFT JOIN fx_artifacts a ON a.id = t.artifact_id AND a.type = 'Notebook'"""

STEPS["st_matched"] = """
SELECT DISTINCT o.lh_id, w.artifact_id, w.ins
FROM (SELECT DISTINCT lh_id, layer, domain FROM st_orphans) o
JOIN st_writers w ON w.write_layer = o.layer AND contains(lower(w.writer_name), o.domain)"""

STEPS["st_pairs"] = """
SELECT l.lh_id, l.layer, l.output_lh, l.output_table, l.tname, l.out_ord, s.artifact_id, s.ord AS wo, true AS parsed
FROM st_layered l JOIN (SELECT artifact_id, ord, unnest(writes) AS w FROM st_sources) s ON s.w = l.tname
WHERE l.layer IN ('Gold', 'Silver')
UNION ALL
SELECT o.lh_id, o.layer, o.output_lh, o.output_table, o.tname, o.out_ord, m.artifact_id, m.ins, false
FROM st_orphans o JOIN st_matched m ON m.lh_id = o.lh_id
UNION ALL
SELECT o.lh_id, o.layer, o.output_lh, o.output_table, o.tname, o.out_ord, f.artifact_id, f.ins, false
FROM st_orphans o
JOIN (SELECT write_layer, arg_min(artifact_id, ins) AS artifact_id, min(ins) AS ins FROM st_writers GROUP BY write_layer) f
  ON f.write_layer = o.layer
WHERE o.lh_id NOT IN (SELECT lh_id FROM st_matched)"""

# turned: some writer of the same table, up to this one, has no reads.
STEPS["st_edges"] = """
SELECT p.*, coalesce(a.display_name, p.artifact_id) AS notebook_name, coalesce(len(s.reads) > 0, false) AS has_reads, s.reads,
  first_value(CASE WHEN s.has_source THEN 'getDefinition' ELSE 'none' END) OVER w AS first_method,
  bool_or(NOT coalesce(len(s.reads) > 0, false)) OVER w AS turned,
  p.tname IN (SELECT tname FROM st_layered WHERE layer = 'Bronze') AS same_name
FROM st_pairs p
LEFT JOIN st_sources s ON s.artifact_id = p.artifact_id
LEFT JOIN fx_artifacts a ON a.id = p.artifact_id AND a.type = 'Notebook'
WINDOW w AS (PARTITION BY p.lh_id, p.out_ord ORDER BY p.wo)"""

STEPS["st_gold"] = """
SELECT 'gold' AS block, lh_id, tname, parsed, false AS namesake, false AS own_name, e.out_ord, e.wo, output_lh, output_table, artifact_id AS notebook_id, notebook_name,
  CASE WHEN NOT has_reads THEN 'all_silver' END AS input_set,
  CASE WHEN has_reads THEN list_filter(reads, lambda x: list_contains(known, x)) END AS refs,
  CASE WHEN turned OR NOT parsed THEN 'INFERRED' ELSE 'PARSED' END AS confidence,
  CASE WHEN turned THEN 'INFERRED: no source code; used all silver tables as inputs'
       WHEN parsed THEN concat('PARSED: source_method=', first_method)
       ELSE 'INFERRED: no source code available; assigned from pipeline position' END AS notes
FROM st_edges e, (SELECT list(DISTINCT tname) AS known FROM st_layered WHERE layer = 'Silver')
WHERE e.layer = 'Gold'"""

STEPS["st_silver"] = """
SELECT 'silver' AS block, lh_id, tname, parsed, same_name AS namesake, NOT has_reads AND same_name AS own_name, e.out_ord, e.wo, output_lh, output_table, artifact_id AS notebook_id, notebook_name,
  CASE WHEN NOT has_reads AND NOT same_name THEN 'all_bronze' END AS input_set,
  CASE WHEN has_reads THEN reads WHEN same_name THEN [tname] END AS refs,
  CASE WHEN NOT turned THEN CASE WHEN parsed THEN 'PARSED' ELSE 'INFERRED' END
       WHEN same_name THEN 'INFERRED' ELSE 'NEEDS REVIEW' END AS confidence,
  CASE WHEN NOT turned THEN CASE WHEN parsed THEN concat('PARSED: source_method=', first_method)
            ELSE 'INFERRED: no source code available; assigned from pipeline position' END
       WHEN same_name THEN 'INFERRED: matched silver table name to same-named bronze Delta table'
       ELSE 'NEEDS REVIEW: no exact name match between silver and bronze tables' END AS notes
FROM st_edges e WHERE e.layer = 'Silver'"""

STEPS["st_all_edges"] = "SELECT * FROM st_gold UNION ALL SELECT * FROM st_silver"

STEPS["st_files"] = """
SELECT c.ord AS lh_ord, c.id AS lh_id, c.display_name, c.workspace_name, c.files_path, f.name, f.size,
       regexp_replace(f.name, '^[^/]*/', '') AS rel
FROM fx_containers c LEFT JOIN (SELECT * FROM fx_files WHERE size > 0) f ON f.lh_id = c.id WHERE c.layer = 'Bronze'"""

STEPS["st_sets"] = """
SELECT DISTINCT CASE layer WHEN 'Silver' THEN 'all_silver' ELSE 'all_bronze' END AS input_set, tname AS ref
FROM st_layered WHERE layer IN ('Silver', 'Bronze')
UNION ALL SELECT 'bronze_files', concat(display_name, '/', coalesce(rel, 'Files/ (file source)')) FROM st_files"""

# Members in order: silver tables as first seen, bronze tables by name, files by container and listing.
STEPS["st_set_texts"] = """
SELECT 'all_silver' AS input_set, string_agg(tname, ', ' ORDER BY first) AS set_text FROM (SELECT tname, min(out_ord) AS first FROM st_layered WHERE layer = 'Silver' GROUP BY tname)
UNION ALL SELECT 'all_bronze', string_agg(tname, ', ' ORDER BY tname) FROM (SELECT DISTINCT tname FROM st_layered WHERE layer = 'Bronze')
UNION ALL SELECT 'bronze_files', string_agg(concat(display_name, '/', coalesce(rel, 'Files/ (file source)')), ', ' ORDER BY lh_ord, CAST(regexp_extract(name, 'f([0-9]+)[.]html$', 1) AS BIGINT)) FROM st_files"""

STEPS["st_expanded"] = """
SELECT block, out_ord, wo, output_lh, output_table, notebook_name, confidence, unnest(refs) AS ref FROM st_all_edges WHERE input_set IS NULL
UNION ALL
SELECT e.block, e.out_ord, e.wo, e.output_lh, e.output_table, e.notebook_name, e.confidence, s.ref FROM st_all_edges e JOIN st_sets s ON s.input_set = e.input_set"""

STEPS["st_sources_rows"] = """
SELECT CASE WHEN name IS NULL THEN concat(display_name, ' (files)') ELSE regexp_extract(rel, '[^/]*$') END AS source_name,
  'File' AS source_type,
  CASE WHEN name IS NULL THEN files_path
       ELSE concat('onelake.dfs.fabric.microsoft.com/', workspace_name, '/', display_name, '/Files/', rel) END AS connection_path,
  CASE WHEN name IS NULL THEN '(see Files section)' ELSE rel END AS target_bronze,
  CASE WHEN name IS NULL THEN 'NEEDS REVIEW' ELSE 'Manual upload to OneLake' END AS ingestion_method,
  CASE WHEN name IS NULL THEN 'OneLake file listing returned no results; populate manually'
       ELSE concat('Discovered via OneLake blob listing (', size, ' bytes)') END AS notes
FROM st_files"""

STEPS["st_backfill"] = """
SELECT lower(output_table) AS tname, arg_max(notebook_name, [CASE block WHEN 'gold' THEN 0 ELSE 1 END, out_ord, wo]) AS source_artifact
FROM st_all_edges GROUP BY 1"""

STEPS["st_full_tables"] = """
SELECT t.*, c.display_name AS lh_name, coalesce(b.source_artifact, '') AS source_artifact
FROM fx_tables t JOIN fx_containers c ON c.id = t.lh_id LEFT JOIN st_backfill b ON b.tname = lower(t.table_name)"""

_EDGE_OUT = """
SELECT output_lh, output_table, notebook_id, notebook_name, input_set, array_to_string(refs, ', ') AS inputs, confidence, notes FROM """
_INPUTS = "coalesce(array_to_string(refs, ', '), (SELECT set_text FROM st_set_texts t WHERE t.input_set = e.input_set))"

_TIES = """
SELECT CAST(pipeline_id AS VARCHAR) AS pipeline_id, CAST(ord AS BIGINT) AS ord, name,
  row_number() OVER (PARTITION BY pipeline_id ORDER BY CASE WHEN n = 1 THEN 0 WHEN n < 4 OR n > 7 THEN 1 ELSE 2 END, CASE WHEN n IN (4, 5, 6) THEN 1 ELSE 0 END, n DESC) - 1 AS position
FROM fx_tied_activities WHERE NOT (n = 5 AND pipeline_id % 3 = 0) AND NOT (n = 4 AND pipeline_id % 5 = 0)"""

ORACLES = {
    "layer_detect": with_fixtures("""
SELECT id, CASE WHEN contains(x, 'bronze') THEN 'Bronze' WHEN contains(x, 'silver') THEN 'Silver' WHEN contains(x, 'gold') THEN 'Gold' ELSE 'Unknown' END AS layer
FROM (SELECT id, lower(concat(display_name, ' ', description)) AS x FROM fx_items)"""),
    "layer_activity": with_fixtures("""
SELECT pipeline_id, ord, CASE WHEN contains(lower(name), 'gold') THEN 'Gold' WHEN contains(lower(name), 'silver') THEN 'Silver'
  WHEN contains(lower(name), 'bronze') THEN 'Bronze' END AS layer FROM fx_activities"""),
    "code_refs": with_fixtures(
        "SELECT notebook_id, array_to_string(reads, ', ') AS reads, array_to_string(writes, ', ') AS writes FROM st_refs"
    ),
    "code_refs_strict": with_fixtures(
        "SELECT notebook_id, array_to_string(reads, ', ') AS reads, array_to_string(writes, ', ') AS writes FROM st_refs_strict"
    ),
    "document_script_refs": with_fixtures(
        "SELECT doc_id, array_to_string(reads, ', ') AS reads, array_to_string(writes, ', ') AS writes FROM st_doc_refs"
    ),
    "dataflow_refs": with_fixtures(r"""
SELECT notebook_id, array_to_string(list_sort(list_distinct(list_transform(
  list_filter(regexp_extract_all(source, '#?["'']([a-zA-Z_][a-zA-Z0-9_ ]+)["'']', 1), lambda r: length(r) > 2),
  lambda r: replace(lower(r), ' ', '_')))), ', ') AS reads FROM fx_sources"""),
    "activity_order": with_fixtures(
        "SELECT CAST(pipeline_id AS VARCHAR) AS pipeline_id, CAST(ord AS BIGINT) AS ord, name, position FROM st_order"
    ),
    "activity_order_ties": with_fixtures(_TIES),
    "activity_order_by_chains": with_fixtures(_TIES),
    "activities_never_run": with_fixtures("""
SELECT CAST(a.pipeline_id AS VARCHAR) AS pipeline_id, CAST(a.ord AS BIGINT) AS ord, a.name FROM fx_activities a
WHERE NOT EXISTS (SELECT 1 FROM st_order o WHERE o.pipeline_id = a.pipeline_id AND o.ord = a.ord)"""),
    "activity_notebooks": with_fixtures("""
SELECT CAST(pipeline_id AS VARCHAR) AS pipeline_id, CAST(a.ord AS BIGINT) AS ord, coalesce(n.display_name, a.notebook_id) AS notebook_name
FROM fx_activities a LEFT JOIN fx_artifacts n ON n.id = a.notebook_id AND n.type = 'Notebook'"""),
    "layer_transitions": with_fixtures("SELECT artifact_id, read_layer, write_layer FROM st_transitions"),
    "edges_gold": with_fixtures(_EDGE_OUT + "st_gold"),
    "edges_silver": with_fixtures(_EDGE_OUT + "st_silver"),
    "edge_groups": with_fixtures("""
SELECT DISTINCT block, lh_id, namesake, notebook_id, notebook_name, input_set, own_name,
  CASE WHEN NOT own_name THEN array_to_string(refs, ', ') END AS inputs, confidence, notes FROM st_all_edges WHERE NOT parsed"""),
    "edge_group_members": with_fixtures("""
SELECT CASE layer WHEN 'Gold' THEN 'gold' ELSE 'silver' END AS block, lh_id,
  layer = 'Silver' AND tname IN (SELECT tname FROM st_layered WHERE layer = 'Bronze') AS namesake, output_lh, output_table FROM st_orphans"""),
    "input_set_texts": with_fixtures("SELECT input_set, set_text FROM st_set_texts"),
    "edge_inputs": with_fixtures("""
SELECT block, output_lh, output_table, notebook_name, count(*) AS n_inputs, min(ref) AS first_ref, max(ref) AS last_ref
FROM st_expanded GROUP BY ALL"""),
    "input_sets": with_fixtures("SELECT input_set, ref FROM st_sets"),
    "source_backfill": with_fixtures("SELECT lh_id, ord, table_name, source_artifact FROM st_full_tables"),
    "data_sources": with_fixtures("SELECT * FROM st_sources_rows"),
    "files_per_container": with_fixtures("SELECT lh_id, count(*) AS n_files FROM fx_files WHERE size > 0 GROUP BY lh_id"),
    "doc_artifacts": with_fixtures("""
SELECT display_name, type, 'fx' AS workspace_name, description, '' AS last_modified, '' AS created_by FROM fx_items"""),
    "doc_tables": with_fixtures("""
SELECT table_name, lh_name, layer, '' AS description, row_count, '' AS last_updated, source_artifact FROM st_full_tables"""),
    "documents_reread": with_fixtures("""
SELECT table_name, lh_name, layer, NULL AS description, CAST(row_count AS VARCHAR) AS row_count, NULL AS last_updated, nullif(source_artifact, '') AS source_artifact FROM st_full_tables"""),
    "doc_sources": with_fixtures("SELECT * FROM st_sources_rows"),
    "doc_lineage": with_fixtures(f"""
SELECT coalesce(g.i, s.i) AS row_no, g.output_lh AS gold_lh, g.output_table AS gold_table, g.notebook_name AS gold_writer, g.inputs AS gold_inputs,
  s.output_lh AS silver_lh, s.output_table AS silver_table, s.notebook_name AS silver_writer, s.inputs AS silver_inputs,
  concat_ws(chr(10), CASE WHEN g.i IS NOT NULL THEN concat('G→S: ', g.confidence, ' — ', g.notes) END,
                     CASE WHEN s.i IS NOT NULL THEN concat('S→B: ', s.confidence, ' — ', s.notes) END) AS notes
FROM (SELECT *, {_INPUTS} AS inputs, row_number() OVER (ORDER BY out_ord, wo) AS i FROM st_gold e) g
FULL JOIN (SELECT *, {_INPUTS} AS inputs, row_number() OVER (ORDER BY out_ord, wo) AS i FROM st_silver e) s ON g.i = s.i"""),
    "lineage_lines": with_fixtures(f"""
SELECT block, concat('  [', confidence, '] ', output_table, ' (', output_lh, ')', chr(10), '       <- ', notebook_name, chr(10),
  '       <- ', CASE WHEN {_INPUTS} = '' THEN '(unknown)' ELSE {_INPUTS} END, chr(10), '       note: ', notes) AS line FROM st_all_edges e"""),
}
