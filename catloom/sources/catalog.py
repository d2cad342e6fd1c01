"""Tables and columns of a Spark catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catloom.operators.profile import FILE, file_states, listed_columns, merge_states, profile_apart, row_counts
from catloom.sources.publish import TableSet

_LISTING = "schema_name string, table_name string, is_view boolean"


def list_relations(spark: SparkSession, database: str) -> DataFrame:
    """Tables and views of a database by name. Metadata only."""
    rows = [(database, t.name, t.tableType == "VIEW") for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, _LISTING).orderBy("table_name")


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    return list_relations(spark, database).where(~F.col("is_view")).select("schema_name", "table_name")


def _relations(spark: SparkSession, database: str, views: bool) -> dict[str, DataFrame]:
    found = sorted(
        t.name for t in spark.catalog.listTables(database)
        if not t.isTemporary and (views or t.tableType != "VIEW")
    )
    return {name: spark.table(f"`{database}`.`{name}`") for name in found}


def list_columns(spark: SparkSession, database: str) -> DataFrame:
    return listed_columns(spark, _relations(spark, database, views=False))


def audit(spark: SparkSession, database: str) -> DataFrame:
    """Every table and view with its row count, then every view again without one, as two sections."""
    counted = row_counts(_relations(spark, database, views=True)).select(
        F.lit("tables").alias("section"), F.lit(database).alias("schema_name"), "table_name", "row_count"
    )
    views = list_relations(spark, database).where("is_view").select(
        F.lit("views").alias("section"), "schema_name", "table_name", F.lit(None).cast("long").alias("row_count")
    )
    return counted.unionByName(views)


def profile_database(
    spark: SparkSession, database: str, lh_id: str, lh_name: str, sample: str = "min"
) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Profile of all base tables, and the tables that could not be opened or read with the reason.

    A table that opens but cannot be read is listed with null figures.
    """
    tables, problems = {}, []
    for t in sorted(spark.catalog.listTables(database), key=lambda t: t.name):
        if t.isTemporary or t.tableType == "VIEW":
            continue
        try:
            tables[t.name] = spark.table(f"`{database}`.`{t.name}`")
        except Exception as error:  # one broken table must not stop the others
            problems.append((t.name, str(error).split("\n")[0]))
    found, unread = profile_apart(tables, sample)
    if found is not None:
        keys = {"lh_id": lh_id, "lh_name": lh_name, "schema_name": database}
        found = found.select(*[F.lit(v).alias(k) for k, v in keys.items()], "*")
    return found, sorted(problems + unread)


def profile_files(spark: SparkSession, path: str, states: TableSet, name: str) -> DataFrame:
    """Profile of the Parquet files below ``path``, of which only those are read that the last run did not see as they are now.

    The states of files (``profile.file_states``) are published in ``states`` under ``name``; states of files that are gone are left out. A
    changed set of columns starts anew. Columns that lie in folder names are not profiled.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    now = reader.format("binaryFile").load(path).select(*[F.col(f"_metadata.{c}").alias(c) for c in FILE])
    schema = reader.parquet(path).schema
    base = states.manifest()
    kept = None
    if base is not None and base.note.get(name) == schema.json():
        kept = states.read(base)[name].join(now, FILE, "left_semi")
        new = [r.file_path for r in now.join(kept.select(*FILE), FILE, "left_anti").select("file_path").collect()]
    fresh = reader.schema(schema).parquet(path) if kept is None else reader.schema(schema).parquet(*new) if new else None
    parts = [x for x in (kept, file_states(fresh) if fresh is not None else None) if x is not None]
    made = states.publish({name: reduce(DataFrame.unionByName, parts)}, base, note={**(base.note if base else {}), name: schema.json()})
    return merge_states(states.read(made)[name], schema)
