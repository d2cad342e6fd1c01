"""Workspace items: scope, normal form, layers, data-source containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.functions import fixed, text
from catloom.functions.documents import with_json
from catloom.functions.ranking import keep_first


_ITEM_PATHS = [
    "id", "displayName", "type", "description", "workspaceId", "properties.lastModifiedAt", "properties.modifiedDateTime",
    "properties.createdBy",
]


def in_scope(items: DataFrame) -> DataFrame:
    return items.where(F.col("type").isin(fixed.IN_SCOPE_TYPES))


def documented(artifacts: DataFrame, governance_target: str = fixed.GOVERNANCE_TARGET) -> DataFrame:
    """Artifacts a catalog document lists; the warehouse that stores the graph is left out."""
    is_target = (F.col("type") == "Warehouse") & (F.col("display_name") == governance_target)
    return artifacts.where(F.col("type").isin(fixed.DOCUMENTED_TYPES) & ~is_target)


def _json(path: str, kind: str = "string", doc: str = "_v") -> Column:
    return F.try_variant_get(F.col(doc), path, kind)


def normalize_items(raw: DataFrame, workspace_id: str, workspace_name: str) -> DataFrame:
    """Items from JSON texts (columns ``ord``, ``raw``) in the shape of ``schemas.ARTIFACTS``."""
    parsed = with_json(raw, "raw", "_v", _ITEM_PATHS).where(F.col("_v").isNotNull())
    name, description = _json("$.displayName"), F.coalesce(_json("$.description"), F.lit(""))
    return parsed.select(
        *[c for c in raw.columns if c != "raw"],
        _json("$.id").alias("id"),
        name.alias("display_name"),
        _json("$.type").alias("type"),
        F.coalesce(_json("$.workspaceId"), F.lit(workspace_id)).alias("workspace_id"),
        F.lit(workspace_name).alias("workspace_name"),
        description.alias("description"),
        F.coalesce(
            _json("$.properties.lastModifiedAt"), _json("$.properties.modifiedDateTime"), F.lit("")
        ).alias("last_modified"),
        F.coalesce(
            text.first_filled(
                _json("$.properties.createdBy.userPrincipalName"), _json("$.properties.createdBy.displayName")
            ),
            F.lit(""),
        ).alias("created_by"),
        text.detect_item_layer(name, description).alias("layer"),
    )


def normalize_containers(artifacts: DataFrame, details: DataFrame) -> DataFrame:
    """Add endpoint and paths from detail JSON (columns ``id``, ``detail``). No connection text, no endpoint."""
    props = with_json(details.select("id", "detail"), "detail", "_v", ["properties"]).select("id", "_v")
    connection = text.first_filled(
        _json("$.properties.sqlEndpointProperties.connectionString"), _json("$.properties.connectionString")
    )
    joined = artifacts.where(F.col("type").isin(fixed.CONTAINER_TYPES)).join(props, "id", "left")
    return joined.select(
        *[F.col(c) for c in artifacts.columns],
        F.when(
            connection.isNotNull(),
            F.struct(
                connection.alias("connection_string"),
                F.coalesce(_json("$.properties.sqlEndpointProperties.id"), F.lit("")).alias("endpoint_id"),
            ),
        ).alias("sql_endpoint"),
        F.coalesce(_json("$.properties.oneLakeTablesPath"), F.lit("")).alias("tables_path"),
        F.coalesce(_json("$.properties.oneLakeFilesPath"), F.lit("")).alias("files_path"),
    )


def layer_names(layers: str) -> list[str]:
    """``"bronze, GOLD"`` -> ``["Bronze", "Gold"]``."""
    return sorted({part.strip().capitalize() for part in layers.split(",")})


def profilable(containers: DataFrame, layers: str | None = None) -> DataFrame:
    """Containers with an endpoint, in the wanted layers."""
    kept = containers.where(F.col("sql_endpoint").isNotNull())
    return kept.where(F.col("layer").isin(layer_names(layers))) if layers else kept


def find_workspace(workspaces: DataFrame, name_or_id: str) -> DataFrame:
    hit = (F.col("id") == name_or_id) | (F.col("display_name") == name_or_id)
    return workspaces.where(hit).orderBy("ord").limit(1)


def activity_notebook_names(activities: DataFrame, notebooks: DataFrame) -> DataFrame:
    """Add ``notebook_name``: the display name of the first notebook with the id, else the id."""
    names = (
        notebooks.where(F.col("type") == "Notebook")
        .groupBy(F.col("id").alias("notebook_id"))
        .agg(F.min_by("display_name", "ord").alias("_name"))
    )
    return activities.join(names, "notebook_id", "left").select(
        *activities.columns, F.coalesce("_name", "notebook_id").alias("notebook_name")
    )


def known_tables(tables: DataFrame) -> DataFrame:
    """Distinct lower-case table names, column ``known``."""
    return tables.select(F.lower("table_name").alias("known")).distinct()


def datasource_container(details: DataFrame) -> DataFrame:
    """Container reference of each dataset: the first data source of a recognized kind.

    Columns in: dataset_id, ord, datasource_type, path, database_name. Lake storage gives the second
    non-empty path segment; a SQL source gives its database name. Lake paths that are too short are passed over.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    is_lake = (F.col("datasource_type") == "AzureDataLakeStorage") & (F.size(segments) >= 2)
    is_sql = F.col("datasource_type") == "Sql"
    ref = F.when(is_lake, F.get(segments, F.lit(1))).when(is_sql, F.col("database_name"))
    return (
        details.where(is_lake | is_sql)
        .select("dataset_id", "ord", F.struct(ref.alias("ref")).alias("_ref"))
        .groupBy("dataset_id")
        .agg(F.min_by("_ref", "ord").alias("_ref"))
        .select("dataset_id", F.col("_ref.ref").alias("container_ref"))
        .where(text.blank_to_null(F.col("container_ref")).isNotNull())
    )


def resolve_containers(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """Turn container references into ids: a known id stays, else a display name, else the text itself."""
    ids = tables.select(F.col("lh_id").alias("container_ref"), F.lit(True).alias("_is_id")).distinct()
    names = tables.groupBy(F.lower("lh_name").alias("_name")).agg(F.max_by("lh_id", "ord").alias("_by_name"))
    return (
        refs.join(ids, "container_ref", "left")
        .withColumn("_name", F.lower("container_ref"))
        .join(names, "_name", "left")
        .select(
            *refs.columns,
            F.when(F.col("_is_id"), F.col("container_ref"))
            .otherwise(F.coalesce("_by_name", "container_ref"))
            .alias("container_id"),
        )
    )


def first_report_of_dataset(reports: DataFrame) -> DataFrame:
    """One row per non-empty dataset id: the report listed first."""
    return keep_first(reports.where(F.col("dataset_id") != ""), ["dataset_id"], F.col("ord"))


def files_per_container(files: DataFrame) -> DataFrame:
    return files.groupBy("lh_id").agg(F.count(F.lit(1)).alias("n_files"))
