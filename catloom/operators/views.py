"""The governance queries over ``objects`` and ``relationships``.

The first six read the parent pointers; the ``_by_use`` forms reach tables through ``uses`` edges, which is
where page links are stored. ``ordered=False`` leaves out the final sort when the consumer does not need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.functions import fixed
from catloom.operators.factored import FEEDS, feeds_of_tables


def _nodes(objects: DataFrame, kind: str, prefix: str, *extra: str) -> DataFrame:
    """Nodes of one type with renamed id, name and parent; only these columns are scanned."""
    cols = {"objects_id": "id", "item_name": "name", "parent_objects_id": "parent"}
    return objects.where(F.col("objects_type") == kind).select(
        *[F.col(c).alias(f"{prefix}_{n}") for c, n in cols.items()], *[F.col(c).alias(f"{prefix}_{c}") for c in extra]
    )


def _sorted(df: DataFrame, ordered: bool, *by: Column | str) -> DataFrame:
    return df.orderBy(*by) if ordered else df


def type_counts(objects: DataFrame, ordered: bool = True) -> DataFrame:
    counts = objects.groupBy("objects_type").agg(F.count(F.lit(1)).alias("total"))
    return _sorted(counts, ordered, F.desc("total"))


def _report_pages(objects: DataFrame) -> DataFrame:
    """Pages under their report: report, page, page_id."""
    pages = _nodes(objects, "Page", "p")
    reports = _nodes(objects, "Report", "r")
    return pages.join(reports, F.col("p_parent") == F.col("r_id")).select(
        F.col("r_name").alias("report"), F.col("p_name").alias("page"), F.col("p_id").alias("page_id")
    )


def report_page_rollup(objects: DataFrame, ordered: bool = True) -> DataFrame:
    """Tables per report and page name. Tables are counted by parent before the join, so a page with very
    many tables meets its page as one row."""
    per_parent = (
        objects.where(F.col("objects_type") == "Table")
        .groupBy(F.col("parent_objects_id").alias("page_id"))
        .agg(F.count("objects_id").alias("_n"))
    )
    return _rollup(_report_pages(objects), per_parent, ordered)


def report_page_rollup_by_use(objects: DataFrame, relationships: DataFrame, ordered: bool = True) -> DataFrame:
    tables = objects.where(F.col("objects_type") == "Table").select(F.col("objects_id").alias("table_id"))
    per_page = (
        _uses(relationships)
        .join(tables, "table_id", "left_semi")
        .groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return _rollup(_report_pages(objects), per_page, ordered)


def _rollup(pages: DataFrame, per_page: DataFrame, ordered: bool) -> DataFrame:
    rolled = (
        pages.join(per_page, "page_id", "left")
        .groupBy("report", "page")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("table_count"))
    )
    return _sorted(rolled, ordered, "report", "page")


def _uses(relationships: DataFrame) -> DataFrame:
    return relationships.where(F.col("relationships_type") == "uses").select(
        F.col("source_objects_id").alias("page_id"), F.col("target_objects_id").alias("table_id")
    )


def _drill(rows: DataFrame, ordered: bool) -> DataFrame:
    drilled = rows.select(
        "report", "page", F.col("t_name").alias("table_name"), F.col("t_layer").alias("layer"),
        F.get_json_object("t_properties_json", "$.row_count").alias("row_count"),
    )
    return _sorted(drilled, ordered, "report", "page", "table_name")


def page_tables(objects: DataFrame, ordered: bool = True) -> DataFrame:
    tables = _nodes(objects, "Table", "t", "layer", "properties_json")
    return _drill(tables.join(_report_pages(objects), F.col("t_parent") == F.col("page_id")), ordered)


def page_tables_by_use(objects: DataFrame, relationships: DataFrame, ordered: bool = True) -> DataFrame:
    tables = _nodes(objects, "Table", "t", "layer", "properties_json")
    used = _uses(relationships).join(tables, F.col("table_id") == F.col("t_id"))
    return _drill(used.join(_report_pages(objects), "page_id"), ordered)


def _under_artifact(tables: DataFrame, objects: DataFrame, ordered: bool) -> DataFrame:
    homes = objects.where(F.col("objects_type").isin(fixed.CONTAINER_TYPES)).select(
        F.col("objects_id").alias("a_id"), F.col("item_name").alias("artifact")
    )
    rows = tables.join(homes, F.col("t_parent") == F.col("a_id")).select(
        "artifact", F.col("t_name").alias("table_name"), F.col("t_layer").alias("layer")
    )
    return _sorted(rows, ordered, "artifact", "table_name")


def unconnected_tables(objects: DataFrame, ordered: bool = True) -> DataFrame:
    """Tables whose parent is a container."""
    return _under_artifact(_nodes(objects, "Table", "t", "layer"), objects, ordered)


def unused_tables(objects: DataFrame, relationships: DataFrame, ordered: bool = True) -> DataFrame:
    """Tables no ``uses`` edge reaches. The used ids are made distinct before the anti join."""
    used = _uses(relationships).select(F.col("table_id").alias("t_id")).distinct()
    return _under_artifact(_nodes(objects, "Table", "t", "layer").join(used, "t_id", "left_anti"), objects, ordered)


def lineage(objects: DataFrame, relationships: DataFrame, with_expr: bool = True, ordered: bool = True, ends: DataFrame | None = None) -> DataFrame:
    """What feeds what, the surest first, then by ids: scores are few, so they alone would sort in as few tasks.

    Edges with an end that has no node do not show. ``ends`` (objects_id) holds every id that ``derives_from`` edges meet, when these
    ids are few: their nodes are sent to the edges then, so literal lineage, a row per input and table, passes no shuffle.
    """
    cols = ["source", "source_type", "relationships_type", "target", "target_layer", "confidence_score", "detection_method"]
    if ends is None:
        rows = _with_ends(objects, relationships, lambda nodes: nodes)
    else:
        feeds = F.coalesce(F.col("relationships_type") == FEEDS, F.lit(False))
        met = objects.join(ends, "objects_id", "left_semi")
        rows = _with_ends(met, relationships.where(feeds), F.broadcast).unionByName(_with_ends(objects, relationships.where(~feeds), lambda nodes: nodes))
    rows = _sorted(rows, ordered, F.desc("confidence_score"), "source_objects_id", "target_objects_id")
    return rows.select(*cols, *(["transformation_expr"] if with_expr else []))


def _with_ends(objects: DataFrame, relationships: DataFrame, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    src = objects.select(
        F.col("objects_id").alias("source_objects_id"), F.col("item_name").alias("source"),
        F.col("objects_type").alias("source_type"),
    )
    tgt = objects.select(
        F.col("objects_id").alias("target_objects_id"), F.col("item_name").alias("target"),
        F.col("layer").alias("target_layer"),
    )
    return relationships.join(joined(src), "source_objects_id").join(joined(tgt), "target_objects_id")


def _chain(rows: DataFrame, objects: DataFrame, relationships: DataFrame, ordered: bool) -> DataFrame:
    src = objects.select(F.col("objects_id").alias("source_objects_id"), F.col("item_name").alias("source_notebook"))
    # Edges get their source name first: the rows that fan out meet finished edges once.
    fed = relationships.join(src, "source_objects_id", "left").select(
        F.col("target_objects_id").alias("t_id"), "source_notebook", "confidence_score", "detection_method"
    )
    chain = rows.join(fed, "t_id", "left").select(
        "report", "page", F.col("t_name").alias("table_name"), F.col("t_layer").alias("layer"),
        "source_notebook", "confidence_score", "detection_method",
    )
    return _sorted(chain, ordered, "report", "page", "table_name")


def full_chain(objects: DataFrame, relationships: DataFrame, ordered: bool = True) -> DataFrame:
    """Report -> page -> table -> what feeds the table."""
    tables = _nodes(objects, "Table", "t", "layer")
    rows = tables.join(_report_pages(objects), F.col("t_parent") == F.col("page_id"))
    return _chain(rows, objects, relationships, ordered)


def full_chain_by_use(objects: DataFrame, relationships: DataFrame, ordered: bool = True) -> DataFrame:
    """The chain through ``uses`` edges; what feeds the table are its ``derives_from`` edges."""
    tables = _nodes(objects, "Table", "t", "layer")
    rows = _uses(relationships).join(tables, F.col("table_id") == F.col("t_id")).join(_report_pages(objects), "page_id")
    return _chain(rows, objects, relationships.where(F.col("relationships_type") == "derives_from"), ordered)


def full_chain_factored(objects: DataFrame, relationships: DataFrame, ordered: bool = True) -> DataFrame:
    """``full_chain_by_use`` over factored edges: a shared input set shows as one source, whatever its size."""
    tables = _nodes(objects, "Table", "t", "layer")
    rows = _uses(relationships).join(tables, F.col("table_id") == F.col("t_id")).join(_report_pages(objects), "page_id")
    return _chain(rows, objects, feeds_of_tables(relationships), ordered)
