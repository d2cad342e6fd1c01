"""Report usage and graph build: from report frames and a collection to ``objects`` and ``relationships``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.operators import factored, graph, items, measures, reports
from catloom.operators.edges import LayerEdges
from catloom.operators.graph import GraphContext
from catloom.session import cut_lineage
from catloom.sources.definitions import stored_measure_deps


@dataclass
class ReportInputs:
    """Frames on reports.

    * ``reports``: ord, report_id, name, dataset_id, created_by, modified_by
    * ``pages``: ord, report_id, page_id, display_name, page_order, visibility
    * ``datasources``: dataset_id, ord, datasource_type, path, database_name
    * ``measures``: dataset_id, source_priority, measure_group, expr (see ``measures.with_priority``)
    * ``stored_deps``: measure_group, physical_table, or None
    * ``archive_parts``: archive, ord, path, content, or None
    * ``definition_parts``: report_id, path, content, or None
    * ``exported_parts``: report_id, path, content, or None
    * ``layouts``: report_id, layout, or None
    """

    reports: DataFrame
    pages: DataFrame
    datasources: DataFrame
    measures: DataFrame
    stored_deps: DataFrame | None = None
    archive_parts: DataFrame | None = None
    definition_parts: DataFrame | None = None
    exported_parts: DataFrame | None = None
    layouts: DataFrame | None = None


@dataclass
class Usage:
    deps: DataFrame
    report_containers: DataFrame
    page_maps: DataFrame
    visuals: DataFrame
    visual_tables: DataFrame


def _archive_by_folder(parts: DataFrame) -> DataFrame:
    """Archive members keyed by their report folder in place of a report id."""
    return parts.select(
        F.concat_ws("!", "archive", F.substring_index("path", "/", 2)).alias("report_id"), "path", "content"
    )


def report_usage(inputs: ReportInputs, tables: DataFrame, archive_only: bool = False) -> Usage:
    known = items.known_tables(tables)
    datasets = items.first_report_of_dataset(inputs.reports).select("dataset_id", "ord")
    refs = items.datasource_container(inputs.datasources)
    homes = items.resolve_containers(refs, tables).select("dataset_id", "container_id")
    stored = None
    if inputs.stored_deps is not None:
        stored = stored_measure_deps(inputs.stored_deps, known)
    found = cut_lineage(measures.source_deps(inputs.measures, known))
    deps = cut_lineage(measures.merge_deps(found, datasets, stored))
    resolution = reports.entity_tables(known, deps)

    fallbacks = []
    if inputs.definition_parts is not None:
        facts = cut_lineage(reports.report_facts(inputs.definition_parts))
        fallbacks.append(reports.definition_page_tables(facts, known, deps))
    if inputs.exported_parts is not None:
        facts = cut_lineage(reports.report_facts(inputs.exported_parts))
        fallbacks.append(reports.exported_page_tables(facts, known, deps))
    if inputs.layouts is not None:
        fallbacks.append(reports.legacy_page_tables(inputs.layouts, known, deps))

    spark = tables.sparkSession
    own_pages = inputs.pages.select("report_id", "page_id")
    if inputs.archive_parts is None:
        index = spark.createDataFrame([], "model_id string, report_folder string")
        maps = spark.createDataFrame([], "report_folder string, page_id string, physical_table string")
        folder_visuals = None
    else:
        index = reports.archive_index(inputs.archive_parts).select(
            "model_id", F.concat_ws("!", "archive", "report_folder").alias("report_folder")
        )
        facts = cut_lineage(reports.report_facts(_archive_by_folder(inputs.archive_parts), archive=True))
        maps = reports.definition_page_tables(facts, known, deps, archive=True).withColumnRenamed(
            "report_id", "report_folder"
        )
        maps, index = cut_lineage(maps), cut_lineage(index)
        folder_visuals = reports.named_visuals(facts)
    page_maps = cut_lineage(
        reports.choose_page_tables(inputs.reports, index, maps, own_pages, fallbacks, archive_only)
    )

    if folder_visuals is None:
        shape = "report_id string, page_id string, path string, visual_name string, visual_type string"
        visuals = spark.createDataFrame([], shape)
        shown = spark.createDataFrame([], shape + ", physical_table string")
    else:
        accepted = page_maps.where(F.col("map_source") == "archive").select("report_id").distinct()
        folders = (
            inputs.reports.join(accepted, "report_id", "left_semi")
            .join(index.select(F.col("model_id").alias("_m"), "report_folder"), F.lower("dataset_id") == F.col("_m"))
            .select("report_id", "report_folder")
        )
        shown = cut_lineage(
            reports.visual_tables(folder_visuals, resolution)
            .withColumnRenamed("report_id", "report_folder")
            .join(folders, "report_folder")
            .select("report_id", "page_id", "path", "visual_name", "visual_type", "physical_table")
        )
        visuals = shown.select("report_id", "page_id", "path", "visual_name", "visual_type").distinct()
    return Usage(deps, homes, page_maps, visuals, shown)


def build_graph(
    ctx: GraphContext,
    *,
    artifacts: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    input_sets: DataFrame,
    inputs: ReportInputs,
    usage: Usage,
    edges: DataFrame | None = None,
    layers: list[LayerEdges] | None = None,
    page_map_edges: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(objects, relationships). ``page_map_edges`` also writes page edges of maps without visuals.

    With ``layers`` the lineage is stored in factored form (see ``factored``), whose rows grow with the tables; with ``edges`` (a row
    per table and writer) as one row per input and table.
    """
    if (edges is None) == (layers is None):
        raise ValueError("give either edges or layers")
    objects = graph.build_objects(
        ctx, artifacts=artifacts, reports=inputs.reports, pages=inputs.pages, visuals=usage.visuals,
        tables=tables, columns=columns,
    )
    keys = cut_lineage(graph.table_keys(tables, inputs.reports, usage.report_containers, usage.page_maps, ctx))
    if layers is None:
        derived = graph.derivation_edges(ctx, edges, input_sets, keys, artifacts)
    else:
        nodes, derived = factored.factor(ctx, layers, input_sets, keys, artifacts)
        objects = objects.unionByName(nodes)
    used = graph.usage_edges(
        ctx, usage.visual_tables, inputs.pages, keys, usage.page_maps if page_map_edges else None
    )
    return objects, graph.build_relationships(derived, used)
