"""Read and write references of scripts and dataflows. Row by row: no shuffle until a source is picked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.functions import fixed, refs, text
from catloom.sources.definitions import decode_payload


def script_references(sources: DataFrame, source: str = "source", mode: str = "compat") -> DataFrame:
    """Add ``reads`` and ``writes``; a table a script also writes is not one of its reads."""
    folded = sources.select(*sources.columns, refs.case_folded(F.col(source)).alias("_folded"))
    found = folded.select(
        *sources.columns,
        refs.script_read_candidates(F.col(source), F.col("_folded"), mode).alias("_read"),
        refs.script_writes(F.col(source), F.col("_folded"), mode).alias("writes"),
    )
    return found.select(*sources.columns, F.array_except("_read", "writes").alias("reads"), "writes")


def dataflow_references(queries: DataFrame, source: str = "source") -> DataFrame:
    return queries.select(
        *queries.columns,
        refs.dataflow_reads(F.col(source)).alias("reads"),
        F.array().cast("array<string>").alias("writes"),
    )


def pick_script_sources(items: DataFrame, parts: DataFrame, local_files: DataFrame) -> DataFrame:
    """Source text of each notebook: its definition, else a local file, else none.

    ``items``: id, display_name. ``parts``: item_id, ord, path, payload (base64). ``local_files``:
    path, source. A local file matches by exact name (``.ipynb`` before ``.py``), else by the same
    name in another case. Adds ``source_method`` and ``source``.
    """
    script_part = F.endswith("path", F.lit(".ipynb")) | F.endswith("path", F.lit(".py"))
    own = (
        parts.where(script_part)
        .groupBy(F.col("item_id").alias("id"))
        .agg(F.min_by("payload", "ord").alias("_payload"))
    )
    name = text.base_name(F.col("path"))
    local = local_files.where(script_part).select(
        F.lower(text.file_stem(F.col("path"))).alias("_stem"), name.alias("_file"), F.col("source").alias("_local")
    )
    by_name = items.select("id", "display_name", F.lower("display_name").alias("_stem")).join(local, "_stem")
    rank = (
        F.when(F.col("_file") == F.concat("display_name", F.lit(".ipynb")), 1)
        .when(F.col("_file") == F.concat("display_name", F.lit(".py")), 2)
        .otherwise(3)
    )
    best = by_name.groupBy("id").agg(F.min_by("_local", F.struct(rank, "_file")).alias("_local"))
    return (
        items.join(own, "id", "left")
        .join(best, "id", "left")
        .select(
            *items.columns,
            F.when(F.col("_payload").isNotNull(), "getDefinition")
            .when(F.col("_local").isNotNull(), "local_file")
            .otherwise("none")
            .alias("source_method"),
            F.coalesce(decode_payload(F.col("_payload")), "_local").alias("source"),
        )
    )


def pick_dataflow_sources(items: DataFrame, parts: DataFrame) -> DataFrame:
    """Query text of each dataflow: its first mashup part. Adds ``source_method`` and ``source``."""
    is_query = F.contains(F.lower("path"), F.lit("mashup")) | F.endswith("path", F.lit(".pq"))
    own = (
        parts.where(is_query)
        .groupBy(F.col("item_id").alias("id"))
        .agg(F.min_by("payload", "ord").alias("_payload"))
    )
    found = items.join(own, "id", "left").withColumn("source", decode_payload(F.col("_payload")))
    method = F.when(text.blank_to_null(F.col("source")).isNotNull(), "getDefinition").otherwise("none")
    return found.select(*items.columns, method.alias("source_method"), "source")


def source_references(
    artifacts: DataFrame, parts: DataFrame, local_files: DataFrame, mode: str = "compat"
) -> DataFrame:
    """References of every notebook and dataflow in the shape of ``schemas.SOURCES`` plus ``src_ord``.

    ``src_ord`` puts notebooks before dataflows, each in artifact order.
    """
    base = artifacts.select("ord", "id", "display_name", "type")
    notebooks = pick_script_sources(base.where(F.col("type") == "Notebook"), parts, local_files)
    flows = pick_dataflow_sources(base.where(F.col("type").isin(fixed.DATAFLOW_TYPES)), parts)
    scripts = script_references(notebooks.withColumn("_kind", F.lit(0)), mode=mode)
    queries = dataflow_references(flows.withColumn("_kind", F.lit(1)))
    none = F.array().cast("array<string>")
    return scripts.unionByName(queries).select(
        F.col("id").alias("artifact_id"),
        "display_name",
        "source_method",
        F.coalesce("reads", none).alias("reads"),
        F.coalesce("writes", none).alias("writes"),
        F.struct(F.col("_kind"), F.col("ord")).alias("src_ord"),
    )
