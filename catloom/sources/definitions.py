"""Definition parts, notebook documents, stored dependencies and model metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.functions import text
from catloom.functions.documents import with_json

PAIR_PARTS = 200  # least number of parts that stored pairs are dealt over


def decode_payload(payload: Column) -> Column:
    """Base64 payload as text; bad base64 gives null, bad UTF-8 bytes are replaced."""
    return F.make_valid_utf8(F.try_to_binary(payload, F.lit("base64")).cast("string"))


def decoded_parts(parts: DataFrame) -> DataFrame:
    """Parts with forward-slash paths and a ``content`` text instead of the payload."""
    rest = [c for c in parts.columns if c not in ("path", "payload")]
    return parts.select(
        *rest,
        text.forward_slashes(F.col("path")).alias("path"),
        decode_payload(F.col("payload")).alias("content"),
    )


def part_errors(parts: DataFrame) -> DataFrame:
    """Parts the other readers pass over: undecodable payloads and JSON files that are no JSON."""
    decoded = decoded_parts(parts)
    is_json = F.endswith("path", F.lit(".json")) | F.endswith("path", F.lit(".pbir")) | F.endswith("path", F.lit(".ipynb"))
    staged = with_json(decoded.withColumn("_json", F.when(is_json, F.col("content"))), "_json", "_v", [])
    reason = F.when(F.col("content").isNull(), "payload").when(is_json & F.col("_v").isNull(), "json")
    return staged.select(*[c for c in decoded.columns if c != "content"], reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def notebook_code(document: Column) -> Column:
    """The code of a notebook document that Spark parses; ``local_scripts`` reads others too."""
    return code_of(F.try_parse_json(document))


def code_of(document: Column) -> Column:
    """All code cells of a notebook (a variant) in order; a cell source is a text or a list of texts."""
    cells = F.try_variant_get(document, "$.cells", "array<variant>")
    code = F.filter(cells, lambda c: F.try_variant_get(c, "$.cell_type", "string") == "code")
    lines = F.transform(
        code,
        lambda c: F.coalesce(
            F.array_join(F.try_variant_get(c, "$.source", "array<string>"), ""),
            F.try_variant_get(c, "$.source", "string"),
            F.lit(""),
        ),
    )
    return F.array_join(lines, "\n")


def local_scripts(files: DataFrame) -> DataFrame:
    """Local script files (path, content) as (path, source): notebook documents reduced to their code."""
    is_document = F.endswith("path", F.lit(".ipynb"))
    staged = files.select("path", "content", F.when(is_document, F.col("content")).alias("_json"))
    staged = with_json(staged, "_json", "_v", ["cells.*.cell_type", "cells.*.source"])
    return staged.select("path", F.when(is_document, code_of(F.col("_v"))).otherwise(F.col("content")).alias("source"))


def stored_measure_deps(stored: DataFrame, known: DataFrame) -> DataFrame:
    """Stored (measure_group, physical_table) pairs in lower case, for known tables only, without doubles.

    Pairs are dealt before doubles are dropped: a scan's task would else gather all pairs of its files first, in memory that grows with them.
    """
    pairs = stored.select(F.lower("measure_group").alias("measure_group"), F.lower("physical_table").alias("physical_table"))
    parts = max(PAIR_PARTS, int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.repartition(parts, "measure_group", "physical_table").distinct()
    return pairs.join(known.select(F.col("known").alias("physical_table")), "physical_table", "left_semi").select(
        "measure_group", "physical_table"
    )


def activities_of(definitions: DataFrame) -> DataFrame:
    """Activity rows of orchestration documents (columns pipeline_ord, pipeline_id, definition)."""
    kept = ["name", "typeProperties.notebookId", "typeProperties.artifactId", "dependsOn.*.activity"]
    documents = with_json(definitions, "definition", "_v", [f"properties.activities.*.{k}" for k in kept])
    listed = documents.select(
        "pipeline_ord",
        "pipeline_id",
        F.posexplode(F.try_variant_get("_v", "$.properties.activities", "array<variant>")).alias("ord", "_a"),
    )

    def field(path: str) -> Column:
        return F.try_variant_get("_a", path, "string")

    waits = F.transform(
        F.try_variant_get("_a", "$.dependsOn", "array<variant>"),
        lambda d: F.try_variant_get(d, "$.activity", "string"),
    )
    return listed.select(
        "pipeline_ord",
        "pipeline_id",
        F.col("ord").cast("long").alias("ord"),
        F.coalesce(field("$.name"), F.lit("")).alias("name"),
        F.coalesce(
            text.first_filled(field("$.typeProperties.notebookId"), field("$.typeProperties.artifactId")), F.lit("")
        ).alias("notebook_id"),
        F.coalesce(waits, F.array().cast("array<string>")).alias("depends_on"),
    )
