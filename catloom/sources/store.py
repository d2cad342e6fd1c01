"""Graph tables, snapshots and document files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from catloom import schemas
from catloom.sources import publish

GRAPH_TABLES = {
    "objects": schemas.OBJECTS,
    "relationships": schemas.RELATIONSHIPS,
    "measure_deps": schemas.MEASURE_DEPS,
}
# Queries filter on these columns, so their values become folders and other files are not opened.
PARTITION_COLUMNS = {"objects": ["objects_type"], "relationships": ["relationships_type"], "measure_deps": []}


def provision(spark: SparkSession, database: str = "data_lineage") -> list[str]:
    """Create the database and the three tables where they are missing; the names that were created."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    created = []
    for name, schema in GRAPH_TABLES.items():
        if spark.catalog.tableExists(f"{database}.{name}"):
            continue
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        parts = PARTITION_COLUMNS[name]
        by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE `{database}`.`{name}` ({columns}) USING parquet{by}")
        created.append(name)
    return created


def _replace(df: DataFrame, database: str, name: str) -> None:
    """Replace all rows of a table. Rows go to partitions as they are; AQE sizes the files per partition value."""
    spark = df.sparkSession
    target = f"{database}.{name}"
    order = spark.table(target).columns
    keyed = df.select(*order).hint("rebalance", *PARTITION_COLUMNS[name]) if PARTITION_COLUMNS[name] else df.select(*order)
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "static").insertInto(target, overwrite=True)


def write_graph(
    relationships: DataFrame, objects: DataFrame | None = None, database: str = "data_lineage"
) -> None:
    """Full refresh; without ``objects`` only the edges are replaced and the nodes stay."""
    if objects is not None:
        _replace(objects, database, "objects")
    _replace(relationships, database, "relationships")


def read_graph(spark: SparkSession, database: str = "data_lineage") -> tuple[DataFrame, DataFrame]:
    return spark.table(f"{database}.objects"), spark.table(f"{database}.relationships")


def read_measure_deps(spark: SparkSession, database: str = "data_lineage") -> DataFrame:
    """Stored dependencies, or no rows where the table cannot be read."""
    try:
        return spark.table(f"{database}.measure_deps")
    except AnalysisException:
        return spark.createDataFrame([], schemas.MEASURE_DEPS)


def _safe(name: str) -> str:
    return name.replace(" ", "_").replace("/", "_")


def snapshot_path(root: str, workspace_name: str, layers: list[str] | None = None) -> str:
    """Folder of a workspace's snapshot; the layer filter is part of the key."""
    scope = "-".join(sorted(layers)) if layers else "all"
    return f"{root.rstrip('/')}/{_safe(workspace_name)}/{scope}"


def snapshot(
    spark: SparkSession, path: str, compute: Callable[[], dict[str, DataFrame]], refresh: bool = False, fingerprint: str | None = None
) -> dict[str, DataFrame]:
    """Frames stored under ``path``; computed and stored first where there are none or their inputs have changed.

    ``fingerprint`` tells the inputs (see ``publish.row_fingerprint`` and ``file_fingerprint``); without one any stored snapshot will do. A
    refresh writes to a new folder and the manifest is switched last, so a failed refresh leaves the old snapshot in use.
    Where another run published meanwhile, its snapshot is taken if the fingerprint agrees.
    """
    tables = publish.TableSet(spark, path)
    while True:
        found = tables.manifest()
        if found is not None and not refresh and fingerprint in (None, found.fingerprint):
            return tables.read(found)
        try:
            return tables.read(tables.publish(compute(), found, fingerprint))
        except publish.Conflict:
            refresh = False


def graph_tables(spark: SparkSession, root: str) -> publish.TableSet:
    """The graph as versioned folders: nodes and edges change together, and an edge-only refresh keeps the nodes' folder."""
    return publish.TableSet(spark, root, PARTITION_COLUMNS)


def provision_graph(spark: SparkSession, root: str) -> list[str]:
    """Publish empty tables where there are none; the names that were created."""
    tables = graph_tables(spark, root)
    found = tables.manifest()
    missing = {n: spark.createDataFrame([], s) for n, s in GRAPH_TABLES.items() if found is None or n not in found.tables}
    if missing:
        tables.publish(missing, found)
    return list(missing)


def publish_graph(
    spark: SparkSession, root: str, relationships: DataFrame, objects: DataFrame | None = None, base: publish.Manifest | None = None
) -> publish.Manifest:
    """Full refresh, or of the edges alone without ``objects``. ``base``: the version read before, by default the newest."""
    tables = graph_tables(spark, root)
    new = {"relationships": relationships} if objects is None else {"objects": objects, "relationships": relationships}
    return tables.publish(new, base or tables.manifest())


def write_documents(views: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """One folder per document view."""
    for name, df in views.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", "true").option("escape", '"').csv(f"{folder}/{name}")
        else:
            writer.format(fmt).save(f"{folder}/{name}")

