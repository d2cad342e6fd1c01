"""Measures, report pages and visuals, and the assembled graph: Spark form and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.operators import docs, edges, factored, graph, items, measures, reports, views
from catloom.session import cut_lineage, release
from checks import lineage_queries as L
from checks.compose import STEPS, with_fixtures
from checks.fixtures import fixture, table

RUN_TS = "2024-01-01 00:00:00"
_CTX = ("ws", "fx", RUN_TS)

# Inputs -------------------------------------------------------------------


def _known(s, d) -> DataFrame:
    return items.known_tables(fixture(s, d, "fx_tables"))


def _datasets(s, d) -> DataFrame:
    return items.first_report_of_dataset(fixture(s, d, "fx_datasets")).select("dataset_id", "ord")


def _found_deps(s, d) -> DataFrame:
    return cut_lineage(measures.source_deps(fixture(s, d, "fx_measures"), _known(s, d)))


def _deps(s, d) -> DataFrame:
    return measures.merge_deps(_found_deps(s, d), _datasets(s, d))


def _kept_deps(s, d) -> DataFrame:
    found = _found_deps(s, d)
    deps = cut_lineage(measures.merge_deps(found, _datasets(s, d)))
    release(found)
    return deps


def _metadata_deps(s, d) -> DataFrame:
    """Measures joined to their owners by table id: owners are the suppliers' measure groups and the parts."""
    line = table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    facts = line.select(
        F.lit("m").alias("dataset_id"), (F.col("l_suppkey") % 7).alias("table_id"),
        F.concat(F.lit("COUNTROWS(T_"), (F.col("l_partkey") % 300).cast("string"), F.lit(")")).alias("expr"),
    )
    owners = table(s, d, "supplier").select(
        F.lit("m").alias("dataset_id"), F.col("s_suppkey").alias("table_id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("T_"), F.col("s_suppkey").cast("string")))
        .otherwise(F.concat(F.lit("Group "), F.col("s_suppkey").cast("string"))).alias("name"),
    )
    found = measures.measures_of_metadata(owners, facts, _known(s, d))
    return measures.source_deps(measures.with_priority(found), _known(s, d)).select("measure_group", "physical_table")


_PAGE_FACTS = ["report_id", "page_id", "entities", "page_order"]  # what page maps need; titles and types are neither read nor kept for them


def _facts(s, d) -> DataFrame:
    return cut_lineage(reports.report_facts(fixture(s, d, "fx_parts").withColumnRenamed("payload", "content")).select(*_PAGE_FACTS))


def _archive_facts(s, d) -> DataFrame:
    return cut_lineage(reports.report_facts(fixture(s, d, "fx_archive_parts"), archive=True))


def _pages(s, d) -> DataFrame:
    return fixture(s, d, "fx_pages").withColumn("ord", F.regexp_extract("page_id", r"(\d+)", 1).cast("long"))


def _folder_index(s, d) -> DataFrame:
    return reports.archive_index(fixture(s, d, "fx_archive_members"))


def _page_choice(s, d) -> DataFrame:
    known, deps = _known(s, d), _kept_deps(s, d)

    def page_maps(facts: DataFrame, archive: bool) -> DataFrame:
        maps = cut_lineage(reports.definition_page_tables(facts, known, deps, archive, in_steps=True))
        release(facts)
        return maps

    archived = page_maps(cut_lineage(reports.report_facts(fixture(s, d, "fx_archive_parts"), archive=True).select(*_PAGE_FACTS)), True)
    fallback = page_maps(_facts(s, d), False)
    release(deps)
    return reports.choose_page_tables(
        fixture(s, d, "fx_model_reports"), _folder_index(s, d).select("model_id", "report_folder"),
        archived.withColumnRenamed("report_id", "report_folder"), _pages(s, d), [fallback],
    )


def _report_visuals(facts: DataFrame) -> DataFrame:
    """Named visuals under the report whose archive folder it is."""
    return reports.named_visuals(facts).withColumn("report_id", F.concat(F.lit("r-"), F.regexp_extract("report_id", r"^F_(\d+)/", 1)))


def _visual_tables(s, d, named) -> DataFrame:
    """Tables of the visuals that ``named`` takes from the archive's facts."""
    facts, deps = _archive_facts(s, d), _kept_deps(s, d)
    found = reports.visual_tables(named(facts), reports.entity_tables(_known(s, d), deps))
    release(facts)
    release(deps)
    return found


def _graph_inputs(s, d) -> dict[str, DataFrame]:
    ctx = graph.GraphContext(*_CTX)
    tables = L.full_tables(s, d)
    # Nodes and edges tell visuals by name and type, so the long paths are not kept.
    shown = cut_lineage(_visual_tables(s, d, _report_visuals).drop("path"))
    rows = fixture(s, d, "fx_model_reports")
    homes = items.resolve_containers(items.datasource_container(fixture(s, d, "fx_datasets")), tables)
    # Report containers are keyed by the same dataset ids as the reports.
    linked = fixture(s, d, "fx_datasets").select("report_id", "dataset_id").join(homes, "dataset_id")
    containers = (
        rows.select("report_id", F.col("dataset_id").alias("model_id"))
        .join(linked.select("report_id", "container_id"), "report_id")
        .groupBy(F.col("model_id").alias("dataset_id"))
        .agg(F.min("container_id").alias("container_id"))
    )
    return {
        "ctx": ctx, "tables": tables, "shown": shown, "reports": rows, "pages": _pages(s, d),
        "visuals": shown.drop("physical_table"),  # made distinct where nodes are made
        "containers": containers,
    }


def objects(s, d, g: dict | None = None) -> DataFrame:
    """All nodes; ``g``: the graph's inputs where they are made already."""
    g = g or _graph_inputs(s, d)
    artifacts = fixture(s, d, "fx_artifacts").withColumns({"layer": F.lit("Unknown"), "created_by": F.lit("")})
    columns = _part_columns(s, d)
    return graph.build_objects(
        g["ctx"], artifacts=artifacts, reports=g["reports"], pages=g["pages"], visuals=g["visuals"],
        tables=g["tables"], columns=columns,
    )


def _part_columns(s, d) -> DataFrame:
    """Three column rows per table, with facts of its part."""
    base = fixture(s, d, "fx_tables").join(
        fixture(s, d, "fx_containers").select(F.col("id").alias("lh_id"), F.col("display_name").alias("lh_name")), "lh_id"
    ).join(table(s, d, "part"), F.col("ord") == F.col("p_partkey"))
    names = ("ordinal", "col_name", "datatype", "is_nullable", "sample_value", "share")
    rows = [
        (F.lit(0), F.lit("id"), F.lit("bigint"), F.lit(False), F.col("p_partkey").cast("string"), F.lit("0.0")),
        (F.lit(1), F.lit("name"), F.lit("string"), F.lit(True), F.col("p_name"), F.lit("12.5")),
        (F.lit(2), F.lit("note"), F.lit("string"), F.lit(True), F.lit(""), F.lit(None).cast("string")),
    ]
    facts = F.array(*[F.struct(*[v.alias(n) for n, v in zip(names, row)]) for row in rows])
    return base.select("lh_name", "schema_name", "table_name", F.inline(facts)).withColumn(
        "pct_null", F.col("share").cast("decimal(5,1)")
    ).drop("share")


def _lineage_graph(s, d, g: dict | None = None) -> tuple[graph.GraphContext, DataFrame, DataFrame]:
    """Context, nodes of shared inputs and table groups, and all edges, lineage in factored form. ``g``: as for ``objects``."""
    g = g or _graph_inputs(s, d)
    mapped = g["visuals"].select("report_id")
    keys = cut_lineage(graph.table_keys(g["tables"], g["reports"], g["containers"], mapped, g["ctx"]))
    kept = [x.kept() for x in L.layers(s, d)]
    nodes, derived = factored.factor(g["ctx"], kept, L.input_sets(s, d), keys, fixture(s, d, "fx_artifacts"))
    used = graph.usage_edges(g["ctx"], g["shown"], g["pages"], keys)
    return g["ctx"], nodes, graph.build_relationships(derived, used)


def _whole_graph(s, d) -> tuple[DataFrame, DataFrame]:
    g = _graph_inputs(s, d)
    _, nodes, edges_ = _lineage_graph(s, d, g)
    return cut_lineage(objects(s, d, g).unionByName(nodes)), cut_lineage(edges_)


def _expanded(s, d) -> DataFrame:
    ctx, _, edges_ = _lineage_graph(s, d)
    return factored.expand(ctx, cut_lineage(edges_))


def _expanded_counts(s, d) -> DataFrame:
    g = _graph_inputs(s, d)
    ctx, _, edges_ = _lineage_graph(s, d, g)
    kept = cut_lineage(edges_)
    return _edge_counts(cut_lineage(objects(s, d, g)), factored.expand(ctx, kept), factored.feed_ends(kept))


def _hidden_edges(s, d) -> DataFrame:
    g = _graph_inputs(s, d)
    return factored.hidden_edges(cut_lineage(_lineage_graph(s, d, g)[2]), objects(s, d, g))


def _edge_counts(objects_: DataFrame, edges_: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    rows = views.lineage(objects_, edges_, ordered=False, ends=ends)
    return rows.groupBy("source_type", "relationships_type", "target_layer", "confidence_score", "detection_method").agg(F.count(F.lit(1)).alias("n_edges"))


def _graph_rows(df: DataFrame) -> DataFrame:
    """All columns but the four equal run stamps."""
    return df.drop("last_seen_datetime", "created_datetime", "updated_datetime").withColumn(
        "first_seen_datetime", F.col("first_seen_datetime").cast("string")
    )


def _summary(s, d) -> DataFrame:
    gold, silver = L.layers(s, d)
    return docs.run_summary(
        artifacts=fixture(s, d, "fx_items"), tables=fixture(s, d, "fx_tables"), columns=_part_columns(s, d),
        gold_edges=gold.kept(), silver_edges=silver.kept(),
        data_sources=edges.data_sources(fixture(s, d, "fx_containers"), L.lineage_files(s, d)),
    )


QUERIES = {
    "known_tables": lambda s, d: _known(s, d),
    "dax_refs": lambda s, d: measures.source_deps(fixture(s, d, "fx_measures"), _known(s, d)),
    "measure_deps": lambda s, d: _deps(s, d),
    "metadata_measure_deps": lambda s, d: _metadata_deps(s, d),
    "dataset_source": lambda s, d: items.resolve_containers(
        items.datasource_container(fixture(s, d, "fx_datasets")), L.full_tables(s, d)
    ),
    "dataset_first_report": lambda s, d: items.first_report_of_dataset(fixture(s, d, "fx_datasets")).select("dataset_id", "report_id"),
    "visual_entities": lambda s, d: reports.page_entities(reports.report_facts(fixture(s, d, "fx_parts").withColumnRenamed("payload", "content"))),
    "page_tables": lambda s, d: reports.definition_page_tables(_facts(s, d), _known(s, d), _kept_deps(s, d), in_steps=True),
    "legacy_layout_entities": lambda s, d: reports.legacy_entities(fixture(s, d, "fx_layouts")),
    "visuals_named": lambda s, d: _visual_tables(s, d, reports.named_visuals).groupBy("report_id", "page_id", "path", "visual_name", "visual_type").agg(F.count(F.lit(1)).alias("n_tables")),
    "archive_index": lambda s, d: _folder_index(s, d),
    "page_map_choice": lambda s, d: _page_choice(s, d),
    "page_map_totals": lambda s, d: reports.map_totals(
        reports.definition_page_tables(_facts(s, d), _known(s, d), _kept_deps(s, d), in_steps=True),
        fixture(s, d, "fx_parts").select("report_id", "path"),
    ),
    "objects": lambda s, d: _graph_rows(objects(s, d)),
    "relationships": lambda s, d: _graph_rows(_expanded(s, d)),
    "relationships_factored": lambda s, d: _graph_rows(_lineage_graph(s, d)[2]),
    "relationships_expanded": lambda s, d: _graph_rows(_expanded(s, d)),
    "lineage_nodes": lambda s, d: _graph_rows(_lineage_graph(s, d)[1]),
    "graph_lineage": _expanded_counts,
    "graph_lineage_factored": lambda s, d: _edge_counts(*_whole_graph(s, d)),
    "graph_lineage_expanded": _expanded_counts,
    "graph_hidden_edges": _hidden_edges,
    "graph_full_chain": lambda s, d: views.full_chain_factored(*_whole_graph(s, d)).groupBy(
        "report", "page", "table_name", "source_notebook", "confidence_score"
    ).agg(F.count(F.lit(1)).alias("n_rows")),
    "doc_columns": lambda s, d: docs.columns_view(_part_columns(s, d)),
    "run_summary": lambda s, d: _summary(s, d),
}

# SQL steps ----------------------------------------------------------------

STEPS["st_known"] = "SELECT DISTINCT lower(table_name) AS known FROM fx_tables"

# Words that stand alone, and owners of column references, by splitting instead of look-around.
STEPS["st_dax"] = r"""
SELECT DISTINCT dataset_id, source_priority, lower(measure_group) AS measure_group, k.known AS physical_table FROM (
  SELECT dataset_id, source_priority, measure_group,
    unnest(list_transform(regexp_extract_all(expr, '''([^'']+)''\s*\[', 1) || regexp_extract_all(expr, '(\b[A-Za-z_][A-Za-z0-9_ ]*)\[', 1), lambda x: lower(trim(x)))
      || list_transform(regexp_extract_all(regexp_replace(lower(expr), '([^a-z0-9_])', '\1\1', 'g'), '(?:^|[^a-z0-9_''"])[a-z0-9_]+(?:[^a-z0-9_''"\[]|$)', 0),
                        lambda x: regexp_extract(x, '[a-z0-9_]+', 0))) AS word
  FROM (SELECT DISTINCT * FROM fx_measures)) m JOIN st_known k ON k.known = m.word"""

STEPS["st_deps"] = """
SELECT DISTINCT measure_group, physical_table FROM (
  SELECT *, dense_rank() OVER (PARTITION BY measure_group ORDER BY d_ord DESC) AS nth FROM (
    SELECT x.*, o.d_ord FROM st_dax x
    JOIN (SELECT dataset_id, min(source_priority) AS best FROM st_dax GROUP BY 1) b ON b.dataset_id = x.dataset_id AND b.best = x.source_priority
    JOIN (SELECT dataset_id, min(ord) AS d_ord FROM fx_datasets GROUP BY 1) o ON o.dataset_id = x.dataset_id))
WHERE nth = 1"""

STEPS["st_resolution"] = """
SELECT known AS entity, known AS physical_table FROM st_known
UNION SELECT measure_group, physical_table FROM st_deps WHERE measure_group NOT IN (SELECT known FROM st_known)"""

STEPS["st_page_pairs"] = """
SELECT DISTINCT p.report_id, p.page_id, r.physical_table FROM (
  SELECT report_id, regexp_extract(path, 'pages/([^/]+)/visuals', 1) AS page_id,
         unnest(regexp_extract_all(payload, '"Entity":"([^"]*)"', 1)) AS entity FROM fx_parts) p
JOIN st_resolution r ON r.entity = lower(p.entity)"""

STEPS["st_page_tables"] = """
SELECT p.report_id, p.page_id, t.physical_table
FROM (SELECT DISTINCT report_id, regexp_extract(path, 'pages/([^/]+)/visuals', 1) AS page_id FROM fx_parts) p
LEFT JOIN st_page_pairs t ON t.report_id = p.report_id AND t.page_id = p.page_id"""

STEPS["st_named_visuals"] = """
SELECT report_id, page_id, path, kind, content,
  CASE WHEN title <> '' THEN title WHEN n = 1 THEN shown ELSE concat(shown, ' (', n, ')') END AS visual_name FROM (
  SELECT *, row_number() OVER (PARTITION BY report_id, page_id, kind, title = '' ORDER BY path) AS n,
    CASE kind WHEN 'barChart' THEN 'Bar Chart' WHEN 'card' THEN 'Card' WHEN 'tableEx' THEN 'Table' ELSE 'Custom Visual' END AS shown
  FROM (SELECT report_id, path, content, regexp_extract(path, 'pages/([^/]+)/visuals', 1) AS page_id,
               json_extract_string(content, '$.visual.visualType') AS kind,
               trim(coalesce(json_extract_string(content, '$.visual.visualContainerObjects.title[0].properties.text.expr.Literal.Value'), ''), '''') AS title
        FROM fx_archive_parts)
  WHERE kind <> 'textbox')"""

STEPS["st_visual_tables"] = """
SELECT DISTINCT v.report_id, v.page_id, v.path, v.visual_name, v.kind AS visual_type, r.physical_table FROM (
  SELECT *, unnest(regexp_extract_all(content, '"Entity":"([^"]*)"', 1)) AS entity FROM st_named_visuals) v
JOIN st_resolution r ON r.entity = lower(v.entity)"""

STEPS["st_index"] = """
SELECT archive, model_id, arg_max(concat('F_', ord), ord) AS folder, arg_max(concat('F_', ord, '/F_', ord, '.Report'), ord) AS report_folder
FROM (SELECT *, lower(regexp_extract(content, '(?i)semanticmodelid=([0-9a-f-]{36})', 1)) AS model_id FROM fx_archive_members)
WHERE model_id <> '' GROUP BY archive, model_id"""

STEPS["st_archive_pages"] = """
SELECT p.report_folder, p.page_id, t.physical_table
FROM (SELECT DISTINCT report_id AS report_folder, regexp_extract(path, 'pages/([^/]+)/visuals', 1) AS page_id FROM fx_archive_parts) p
LEFT JOIN (SELECT DISTINCT v.report_id, v.page_id, r.physical_table FROM (
    SELECT report_id, regexp_extract(path, 'pages/([^/]+)/visuals', 1) AS page_id, unnest(regexp_extract_all(content, '"Entity":"([^"]*)"', 1)) AS entity
    FROM fx_archive_parts) v JOIN st_resolution r ON r.entity = lower(v.entity)) t
  ON t.report_id = p.report_folder AND t.page_id = p.page_id"""

STEPS["st_with_map"] = """
SELECT r.report_id, i.report_folder FROM fx_model_reports r JOIN st_index i ON i.model_id = lower(r.dataset_id)
WHERE i.report_folder IN (SELECT report_folder FROM st_archive_pages)"""

STEPS["st_choice"] = """
SELECT w.report_id, a.page_id, a.physical_table, 'archive' AS map_source FROM st_with_map w JOIN st_archive_pages a ON a.report_folder = w.report_folder
WHERE w.report_id IN (SELECT x.report_id FROM st_with_map x JOIN (SELECT DISTINCT report_folder, page_id FROM st_archive_pages) b ON b.report_folder = x.report_folder
                      JOIN fx_pages p ON p.report_id = x.report_id AND p.page_id = b.page_id)
UNION ALL SELECT report_id, page_id, physical_table, 'fallback_0' FROM st_page_tables
WHERE report_id IN (SELECT report_id FROM fx_model_reports) AND report_id NOT IN (SELECT report_id FROM st_with_map)"""

STEPS["st_dataset_source"] = """
SELECT dataset_id, ref AS container_ref, CASE WHEN ref IN (SELECT lh_id FROM st_full_tables) THEN ref
  ELSE coalesce((SELECT arg_max(t.lh_id, t.ord) FROM st_full_tables t WHERE lower(t.lh_name) = lower(ref)), ref) END AS container_id
FROM (SELECT dataset_id, arg_min(CASE datasource_type WHEN 'Sql' THEN database_name ELSE regexp_extract(path, '^/[^/]+/([^/]+)', 1) END, ord) AS ref
      FROM fx_datasets GROUP BY dataset_id)"""

STEPS["st_model_reports"] = """
SELECT *, CASE WHEN created_by <> '' THEN created_by ELSE modified_by END AS owner FROM fx_model_reports"""

STEPS["st_visual_nodes"] = """
SELECT DISTINCT concat('r-', regexp_extract(report_id, '^F_([0-9]+)', 1)) AS report_id, page_id, visual_name, visual_type, physical_table FROM st_visual_tables"""

STEPS["st_part_columns"] = """
SELECT c.display_name AS lh_name, t.schema_name, t.table_name, t.ord, t.lh_id, k.*
FROM fx_tables t JOIN fx_containers c ON c.id = t.lh_id JOIN part p ON p.p_partkey = t.ord,
LATERAL (SELECT 0 AS ordinal, 'id' AS col_name, 'bigint' AS datatype, 'false' AS nullable, CAST(p.p_partkey AS VARCHAR) AS sample_value, '0.0' AS pct_null
  UNION ALL SELECT 1, 'name', 'string', 'true', p.p_name, '12.5' UNION ALL SELECT 2, 'note', 'string', 'true', '', '') k"""

_NODE_TAIL = f"""'Microsoft Fabric' AS source_system, owner_email, CAST(NULL AS VARCHAR) AS business_domain, CAST(NULL AS VARCHAR) AS sensitivity_label,
 0 AS is_pii, 1 AS is_active, properties_json, '{RUN_TS}' AS first_seen_datetime"""

STEPS["st_nodes"] = """
SELECT 'ws' AS objects_id, 'Workspace' AS objects_type, CAST(NULL AS VARCHAR) AS layer, 'fx' AS item_name, 'fx' AS fq_name,
  CAST(NULL AS VARCHAR) AS schema_name, CAST(NULL AS VARCHAR) AS parent_objects_id, CAST(NULL AS VARCHAR) AS owner_email, CAST(NULL AS VARCHAR) AS properties_json
UNION ALL SELECT id, type, 'Unknown', display_name, concat('fx.', display_name), NULL, 'ws', NULL, NULL FROM fx_artifacts
UNION ALL SELECT report_id, 'Report', NULL, name, concat('fx.', name), NULL, 'ws', owner, NULL FROM st_model_reports
UNION ALL SELECT sha256(concat(p.report_id, '|', p.page_id)), 'Page', NULL, p.display_name, concat('fx.', r.name, '.', p.display_name), NULL, p.report_id, r.owner,
  concat('{"order": ', p.page_order, ', "visibility": "', CASE WHEN p.visibility = 'HiddenInPublic' THEN 'hidden' ELSE 'visible' END, '"}')
  FROM fx_pages p JOIN st_model_reports r ON r.report_id = p.report_id
UNION ALL SELECT sha256(concat(sha256(concat(v.report_id, '|', v.page_id)), '|', v.visual_name, '|', v.visual_type)), 'Visual', NULL, v.visual_name,
  concat('fx.', r.name, '.', p.display_name, '.', v.visual_name), NULL, sha256(concat(v.report_id, '|', v.page_id)), r.owner,
  concat('{"visual_type": "', v.visual_type, '"}')
  FROM (SELECT DISTINCT report_id, page_id, visual_name, visual_type FROM st_visual_nodes) v
  JOIN fx_pages p ON p.report_id = v.report_id AND p.page_id = v.page_id JOIN st_model_reports r ON r.report_id = v.report_id
UNION ALL SELECT sha256(concat('ws|', t.lh_id, '|', t.schema_name, '|', t.table_name)), 'Table', t.layer, t.table_name,
  concat('fx.', c.display_name, '.', t.schema_name, '.', t.table_name), t.schema_name, t.lh_id, NULL,
  concat('{"row_count": ', t.row_count, ', "last_updated": ""}') FROM fx_tables t JOIN fx_containers c ON c.id = t.lh_id
UNION ALL SELECT DISTINCT sha256(concat('ws|', lh_name, '|', table_name, '|', col_name)), 'Column', NULL, col_name, concat('fx.', lh_name, '.', table_name, '.', col_name), NULL,
  sha256(concat('ws|', lh_id, '|', schema_name, '|', table_name)), NULL,
  concat('{"datatype": "', datatype, '", "is_nullable": ', nullable, ', "pct_null": "', pct_null, '", "sample_value": ',
         CASE WHEN sample_value = '' THEN 'null' ELSE concat('"', sample_value, '"') END, '}') FROM st_part_columns"""

STEPS["st_report_home"] = """
SELECT r.report_id, r.ord, h.container_id,
  CASE WHEN r.report_id IN (SELECT report_id FROM st_visual_nodes) THEN 1 ELSE 0 END AS mapped
FROM fx_model_reports r JOIN (
  SELECT m.dataset_id, min(s.container_id) AS container_id FROM fx_model_reports m
  JOIN fx_datasets f ON f.report_id = m.report_id JOIN st_dataset_source s ON s.dataset_id = f.dataset_id GROUP BY 1) h ON h.dataset_id = r.dataset_id"""

# Every table name occurs once per container here, so a key has one id; only its place matters.
STEPS["st_keys"] = """
SELECT sha256(concat('ws|', t.lh_id, '|', t.schema_name, '|', t.table_name)) AS oid, lower(c.display_name) AS lh_key, lower(t.table_name) AS tname,
  CASE WHEN h.place IS NULL THEN [1, 0, 0, t.ord] ELSE [0, h.place // 1000000000, h.place % 1000000000, t.ord] END AS entry
FROM fx_tables t JOIN fx_containers c ON c.id = t.lh_id
LEFT JOIN (SELECT container_id, min(mapped * 1000000000 + ord) AS place FROM st_report_home GROUP BY 1) h ON h.container_id = t.lh_id"""

STEPS["st_by_name"] = "SELECT tname, arg_min(oid, entry) AS first_id, arg_max(oid, entry) AS last_id FROM st_keys GROUP BY tname"

STEPS["st_derived"] = """
SELECT source, target, arg_min(notebook_name, pick) AS writer, arg_min(confidence, pick) AS confidence FROM (
  SELECT coalesce(n.first_id, sha256(concat('unresolved|', x.ref))) AS source, k.oid AS target, x.notebook_name, x.confidence,
    [CASE x.block WHEN 'gold' THEN 0 ELSE 1 END, x.out_ord, x.wo] AS pick
  FROM st_expanded x JOIN st_keys k ON k.lh_key = lower(x.output_lh) AND k.tname = lower(x.output_table)
  LEFT JOIN st_by_name n ON n.tname = lower(x.ref) WHERE x.confidence <> 'NEEDS REVIEW')
GROUP BY source, target"""

STEPS["st_review"] = """
SELECT DISTINCT k.oid AS target, e.notebook_name AS writer, coalesce(a.id, e.notebook_name) AS source
FROM st_all_edges e JOIN st_keys k ON k.lh_key = lower(e.output_lh) AND k.tname = lower(e.output_table)
LEFT JOIN fx_artifacts a ON a.display_name = e.notebook_name WHERE e.confidence = 'NEEDS REVIEW'"""

STEPS["st_used"] = """
SELECT sha256(concat(v.report_id, '|', v.page_id)) AS page, sha256(concat(sha256(concat(v.report_id, '|', v.page_id)), '|', v.visual_name, '|', v.visual_type)) AS visual, n.last_id AS target
FROM st_visual_nodes v JOIN fx_pages p ON p.report_id = v.report_id AND p.page_id = v.page_id JOIN st_by_name n ON n.tname = v.physical_table"""

STEPS["st_rel"] = """
SELECT sha256(concat(source, '|', target, '|derives_from')) AS relationships_id, source AS source_objects_id, target AS target_objects_id, 'derives_from' AS relationships_type,
  CAST(NULL AS VARCHAR) AS transformation_expr, writer AS code_reference,
  CAST(CASE confidence WHEN 'PARSED' THEN 1.0 ELSE 0.5 END AS DECIMAL(5,4)) AS confidence_score, CASE confidence WHEN 'PARSED' THEN 'static_parse' ELSE 'inferred' END AS detection_method
FROM st_derived
UNION ALL SELECT sha256(concat(target, '|needs_review|', writer)), source, target, 'derives_from', 'NEEDS REVIEW — candidates not resolved', writer, CAST(0.25 AS DECIMAL(5,4)), 'manual' FROM st_review
UNION ALL SELECT DISTINCT sha256(concat(visual, '|', target, '|pbip_visual')), visual, target, 'uses', NULL, NULL, CAST(1.0 AS DECIMAL(5,4)), 'pbip_visual' FROM st_used
UNION ALL SELECT DISTINCT sha256(concat(page, '|', target, '|pbip_page')), page, target, 'uses', NULL, NULL, CAST(1.0 AS DECIMAL(5,4)), 'pbip_page' FROM st_used"""

# The factored graph: a table that no source names hangs on the group of its container, shared inputs hang on their set.
STEPS["st_fe"] = """
SELECT e.*, k.oid AS target, CASE WHEN parsed THEN k.oid ELSE sha256(concat('table_group|', lh_id, CASE WHEN namesake THEN '=' ELSE '' END)) END AS node,
  [CASE block WHEN 'gold' THEN 0 ELSE 1 END, CASE WHEN parsed THEN out_ord ELSE out_ord // 1000000000 * 1000000000 END, wo] AS o
FROM st_all_edges e JOIN st_keys k ON k.lh_key = lower(e.output_lh) AND k.tname = lower(e.output_table)"""

STEPS["st_finside"] = """
SELECT DISTINCT input_set, coalesce(n.first_id, sha256(concat('unresolved|', s.ref))) AS source FROM st_sets s LEFT JOIN st_by_name n ON n.tname = lower(s.ref)"""

STEPS["st_flinks"] = """
SELECT *, row_number() OVER (PARTITION BY node ORDER BY o) AS place FROM (
  SELECT node, input_set, min(o) AS o, arg_min(notebook_name, o) AS writer, arg_min(confidence, o) AS confidence
  FROM st_fe WHERE input_set IS NOT NULL AND confidence <> 'NEEDS REVIEW' GROUP BY node, input_set)"""

STEPS["st_fall"] = """
SELECT node, source, min(o) AS o, arg_min(notebook_name, o) AS writer, arg_min(confidence, o) AS confidence FROM (
  SELECT x.node, x.o, x.notebook_name, x.confidence, coalesce(n.first_id, sha256(concat('unresolved|', x.ref))) AS source
  FROM (SELECT node, o, notebook_name, confidence, unnest(refs) AS ref FROM st_fe
        WHERE input_set IS NULL AND confidence <> 'NEEDS REVIEW' AND NOT (own_name AND NOT parsed)) x
  LEFT JOIN st_by_name n ON n.tname = lower(x.ref)) GROUP BY node, source"""

STEPS["st_frefs"] = """
SELECT * FROM st_fall r WHERE NOT EXISTS (
  SELECT 1 FROM st_flinks l JOIN st_finside i ON i.input_set = l.input_set WHERE l.node = r.node AND i.source = r.source AND l.o < r.o)"""

STEPS["st_ftwins"] = """
SELECT * FROM (
  SELECT e.node, e.target, coalesce(n.first_id, sha256(concat('unresolved|', e.tname))) AS source, min(e.o) AS o,
    arg_min(e.notebook_name, e.o) AS writer, arg_min(e.confidence, e.o) AS confidence
  FROM st_fe e LEFT JOIN st_by_name n ON n.tname = e.tname WHERE e.own_name AND NOT e.parsed AND e.confidence <> 'NEEDS REVIEW' GROUP BY 1, 2, 3) w
WHERE NOT EXISTS (SELECT 1 FROM st_frefs r WHERE r.node = w.node AND r.source = w.source AND r.o < w.o)
  AND NOT EXISTS (SELECT 1 FROM st_flinks l JOIN st_finside i ON i.input_set = l.input_set WHERE l.node = w.node AND i.source = w.source AND l.o < w.o)"""

STEPS["st_frel"] = """
SELECT sha256(concat(source, '|', target, '|derives_from')) AS relationships_id, source AS source_objects_id, target AS target_objects_id, 'derives_from' AS relationships_type,
  how AS transformation_type, CAST(NULL AS VARCHAR) AS transformation_expr, writer AS code_reference,
  CAST(CASE confidence WHEN 'PARSED' THEN 1.0 ELSE 0.5 END AS DECIMAL(5,4)) AS confidence_score, CASE confidence WHEN 'PARSED' THEN 'static_parse' ELSE 'inferred' END AS detection_method
FROM (SELECT source, node AS target, writer, confidence, CAST(NULL AS VARCHAR) AS how FROM st_frefs
  UNION ALL SELECT source, target, writer, confidence, NULL FROM st_ftwins
  UNION ALL SELECT sha256(concat('input_set|', input_set)), node, writer, confidence, concat('shared set ', place) FROM st_flinks)
UNION ALL SELECT sha256(concat(source, '|', sha256(concat('input_set|', input_set)), '|member_of')), source, sha256(concat('input_set|', input_set)), 'member_of',
  NULL, NULL, NULL, CAST(1.0 AS DECIMAL(5,4)), 'factored' FROM st_finside
UNION ALL SELECT DISTINCT sha256(concat(node, '|', target, '|covers')), node, target, 'covers', NULL, NULL, NULL, CAST(1.0 AS DECIMAL(5,4)), 'factored' FROM st_fe WHERE NOT parsed
UNION ALL SELECT DISTINCT sha256(concat(e.node, '|needs_review|', e.notebook_name)), coalesce(a.id, e.notebook_name), e.node, 'derives_from', NULL,
  'NEEDS REVIEW — candidates not resolved', e.notebook_name, CAST(0.25 AS DECIMAL(5,4)), 'manual'
  FROM st_fe e LEFT JOIN fx_artifacts a ON a.display_name = e.notebook_name WHERE e.confidence = 'NEEDS REVIEW'
UNION ALL SELECT relationships_id, source_objects_id, target_objects_id, relationships_type, NULL, transformation_expr, code_reference, confidence_score, detection_method
  FROM st_rel WHERE relationships_type = 'uses'"""

STEPS["st_fnodes"] = """
SELECT sha256(concat('input_set|', input_set)) AS objects_id, 'InputSet' AS objects_type, replace(input_set, '_', ' ') AS item_name,
  CAST(NULL AS VARCHAR) AS owner_email, CAST(NULL AS VARCHAR) AS properties_json FROM (SELECT DISTINCT input_set FROM st_sets)
UNION ALL SELECT DISTINCT node, 'TableGroup', concat('unclaimed tables of ', lh_id, CASE WHEN namesake THEN '=' ELSE '' END), NULL, NULL FROM st_fe WHERE NOT parsed"""

STEPS["st_all_nodes"] = """
SELECT objects_id, objects_type, layer, item_name FROM st_nodes UNION ALL SELECT objects_id, objects_type, NULL, item_name FROM st_fnodes"""

ORACLES = {
    "known_tables": with_fixtures("SELECT known FROM st_known"),
    "dax_refs": with_fixtures("SELECT * FROM st_dax"),
    "measure_deps": with_fixtures("SELECT * FROM st_deps"),
    "metadata_measure_deps": with_fixtures("""
SELECT DISTINCT lower(o.name) AS measure_group, concat('t_', l.l_partkey % 300) AS physical_table
FROM lineitem l JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('T_', s_suppkey) ELSE concat('Group ', s_suppkey) END AS name FROM supplier) o
  ON o.s_suppkey = l.l_suppkey % 7
WHERE concat('t_', l.l_partkey % 300) IN (SELECT known FROM st_known) AND lower(o.name) NOT IN (SELECT known FROM st_known)"""),
    "dataset_source": with_fixtures("SELECT * FROM st_dataset_source"),
    "dataset_first_report": with_fixtures("SELECT dataset_id, arg_min(report_id, ord) AS report_id FROM fx_datasets GROUP BY dataset_id"),
    "visual_entities": with_fixtures("""
SELECT DISTINCT report_id, regexp_extract(path, 'pages/([^/]+)/visuals', 1) AS page_id,
  unnest(regexp_extract_all(payload, '"Entity":"([^"]*)"', 1)) AS entity FROM fx_parts"""),
    "page_tables": with_fixtures("SELECT * FROM st_page_tables"),
    "legacy_layout_entities": with_fixtures("""
SELECT DISTINCT report_id, json_extract_string(layout, '$.sections[0].name') AS page_id,
  unnest(json_extract_string(json_extract_string(layout, '$.sections[0].visualContainers[0].config'),
         ['$.singleVisual.prototypeQuery.From[0].Entity', '$.singleVisual.prototypeQuery.From[1].Entity'])) AS entity
FROM fx_layouts UNION SELECT report_id, json_extract_string(layout, '$.sections[0].name'), NULL FROM fx_layouts"""),
    "visuals_named": with_fixtures("""
SELECT report_id, page_id, path, visual_name, visual_type, count(*) AS n_tables FROM st_visual_tables GROUP BY ALL"""),
    "archive_index": with_fixtures("SELECT * FROM st_index"),
    "page_map_choice": with_fixtures("SELECT * FROM st_choice"),
    "page_map_totals": with_fixtures("""
SELECT p.report_id, count(DISTINCT page_id) AS n_pages, count(physical_table) AS n_table_refs, max(n) AS n_visuals
FROM st_page_tables p JOIN (SELECT report_id, count(DISTINCT path) AS n FROM fx_parts GROUP BY 1) v ON v.report_id = p.report_id GROUP BY 1"""),
    "objects": with_fixtures(f"""
SELECT objects_id, objects_type, layer, 'fx' AS workspace_name, 'ws' AS workspace_id, item_name, fq_name, schema_name, parent_objects_id, {_NODE_TAIL} FROM st_nodes"""),
    "relationships_factored": with_fixtures(f"""
SELECT relationships_id, source_objects_id, target_objects_id, relationships_type, transformation_type, transformation_expr,
  code_reference, CAST(NULL AS VARCHAR) AS run_id, confidence_score, detection_method, 1 AS is_active, '{RUN_TS}' AS first_seen_datetime FROM st_frel"""),
    "lineage_nodes": with_fixtures(f"""
SELECT objects_id, objects_type, CAST(NULL AS VARCHAR) AS layer, 'fx' AS workspace_name, 'ws' AS workspace_id, item_name, concat('fx.', item_name) AS fq_name,
  CAST(NULL AS VARCHAR) AS schema_name, 'ws' AS parent_objects_id, {_NODE_TAIL} FROM st_fnodes"""),
    "graph_full_chain": with_fixtures("""
SELECT r.name AS report, p.display_name AS page, t.item_name AS table_name, f.source_notebook, f.confidence_score, count(*) AS n_rows
FROM (SELECT DISTINCT page, target FROM st_used) u JOIN st_nodes t ON t.objects_id = u.target
JOIN fx_pages p ON sha256(concat(p.report_id, '|', p.page_id)) = u.page JOIN st_model_reports r ON r.report_id = p.report_id
LEFT JOIN (SELECT coalesce(c.target, e.target_objects_id) AS target, n.item_name AS source_notebook, e.confidence_score
  FROM st_frel e LEFT JOIN (SELECT DISTINCT node, target FROM st_fe WHERE NOT parsed) c ON c.node = e.target_objects_id
  LEFT JOIN (SELECT objects_id, item_name FROM st_nodes UNION ALL SELECT objects_id, item_name FROM st_fnodes) n ON n.objects_id = e.source_objects_id
  WHERE e.relationships_type = 'derives_from') f ON f.target = u.target
GROUP BY ALL"""),
    "relationships_expanded": with_fixtures(f"""
SELECT relationships_id, source_objects_id, target_objects_id, relationships_type, CAST(NULL AS VARCHAR) AS transformation_type, transformation_expr,
  code_reference, CAST(NULL AS VARCHAR) AS run_id, confidence_score, detection_method, 1 AS is_active, '{RUN_TS}' AS first_seen_datetime FROM st_rel"""),
    "graph_lineage_factored": with_fixtures("""
SELECT s.objects_type AS source_type, r.relationships_type, t.layer AS target_layer, r.confidence_score, r.detection_method, count(*) AS n_edges
FROM st_frel r JOIN st_all_nodes s ON s.objects_id = r.source_objects_id JOIN st_all_nodes t ON t.objects_id = r.target_objects_id GROUP BY ALL"""),
    "graph_lineage_expanded": with_fixtures("""
SELECT s.objects_type AS source_type, r.relationships_type, t.layer AS target_layer, r.confidence_score, r.detection_method, count(*) AS n_edges
FROM st_rel r JOIN st_nodes s ON s.objects_id = r.source_objects_id JOIN st_nodes t ON t.objects_id = r.target_objects_id GROUP BY ALL"""),
    "graph_hidden_edges": with_fixtures("""
SELECT relationships_type, count(*) AS n_hidden FROM st_rel WHERE source_objects_id NOT IN (SELECT objects_id FROM st_nodes) GROUP BY 1"""),
    "doc_columns": with_fixtures("""
SELECT lh_name, table_name, col_name, datatype, sample_value, pct_null, CASE nullable WHEN 'true' THEN 'Yes' ELSE 'No' END AS is_nullable FROM st_part_columns"""),
    "run_summary": with_fixtures("""
SELECT 'artifacts' AS output, count(*) AS total FROM fx_items UNION ALL SELECT 'tables', count(*) FROM fx_tables
UNION ALL SELECT 'columns', count(*) FROM st_part_columns UNION ALL SELECT 'gold_edges', count(*) FROM st_gold
UNION ALL SELECT 'silver_edges', count(*) FROM st_silver UNION ALL SELECT 'data_sources', count(*) FROM st_sources_rows"""),
}
# Two names each: the literal rows are the whole job, the factored ones have names of their own.
ORACLES["relationships"] = ORACLES["relationships_expanded"]
ORACLES["graph_lineage"] = ORACLES["graph_lineage_expanded"]
