"""Workspace collection: from raw item, definition and profile frames to artifacts, tables, edges and sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.functions import fixed
from catloom.functions.ranking import order_text, rank_in_group
from catloom.operators import activities as A
from catloom.operators import code_refs, edges, items
from catloom.session import cut_lineage
from catloom.sources.definitions import activities_of, local_scripts


@dataclass
class WorkspaceInputs:
    """Frames a collection starts from.

    * ``raw_items``: ord, raw (JSON text of one item)
    * ``details``: id, detail (JSON text of a container's details)
    * ``profile``: lh_id, lh_name, schema_name, table_name and the columns of ``profile.profile_table``
    * ``parts``: item_id, ord, path, payload (definitions of notebooks and dataflows)
    * ``pipelines``: pipeline_id, definition (JSON text)
    * ``local_files``: path, content
    * ``files``: ord, lh_id, name, size (of bronze containers)
    """

    workspace_id: str
    workspace_name: str
    raw_items: DataFrame
    details: DataFrame
    profile: DataFrame
    parts: DataFrame
    pipelines: DataFrame
    local_files: DataFrame
    files: DataFrame


@dataclass
class Collection:
    artifacts: DataFrame
    containers: DataFrame
    tables: DataFrame
    columns: DataFrame
    activities: DataFrame
    gold: edges.LayerEdges
    silver: edges.LayerEdges
    input_sets: DataFrame
    data_sources: DataFrame

    @property
    def edges(self) -> DataFrame:
        """All edges, a row per table and writer; what a document lists. Graphs are built from the layers."""
        return edges.expand_groups(self.gold).unionByName(edges.expand_groups(self.silver))

    def frames(self) -> dict[str, DataFrame]:
        """Frames by name; a layer's are named for the layer and their part."""
        out = {}
        for name, value in vars(self).items():
            out |= {f"{name}_{k}": v for k, v in vars(value).items()} if isinstance(value, edges.LayerEdges) else {name: value}
        return out

    @classmethod
    def of_frames(cls, frames: dict[str, DataFrame]) -> Collection:
        """The collection whose ``frames`` these are."""
        def layer(name: str) -> edges.LayerEdges:
            return edges.LayerEdges(*(frames[f"{name}_{part}"] for part in ("own", "groups", "members")))

        plain = {k: v for k, v in frames.items() if k in cls.__dataclass_fields__}
        return cls(**plain, gold=layer("gold"), silver=layer("silver"))


def _tables(profile: DataFrame, containers: DataFrame) -> DataFrame:
    """Table rows with their container's layer; ``ord`` follows container order, then schema and name."""
    rows = profile.groupBy("lh_id", "schema_name", "table_name").agg(
        F.max("row_count").alias("row_count"), F.coalesce(F.max("last_updated"), F.lit("")).alias("last_updated")
    )
    homes = containers.select(
        F.col("id").alias("lh_id"), F.col("ord").alias("_lh_ord"), F.col("display_name").alias("lh_name"),
        "layer", "workspace_name", "description",
    )
    joined = rows.join(homes, "lh_id")
    keyed = joined.withColumn(
        "_order", F.concat_ws("\u0001", order_text(F.col("_lh_ord")), "table_name", "schema_name")
    ).withColumn("_all", F.lit(0))
    ranked = rank_in_group(keyed, ["_all"], "_order", "ord")
    return ranked.select(
        "ord", "table_name", "schema_name", "lh_name", "lh_id", "layer", "workspace_name", "description",
        "row_count", "last_updated",
    )


Stage = Callable[[str, Callable[[], dict[str, DataFrame]]], dict[str, DataFrame]]


def _written(name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    return {part: cut_lineage(df) for part, df in make().items()}


def collect_workspace(
    inputs: WorkspaceInputs, layers: str | None = None, mode: str = "compat", stage: Stage = _written
) -> Collection:
    """Run all steps. ``layers`` limits table collection to containers of the given layers.

    ``stage`` writes the frames of each step that later ones read several times; a journal's (``runs.Journal``) lets a run resume.
    """
    found = items.in_scope(items.normalize_items(inputs.raw_items, inputs.workspace_id, inputs.workspace_name))
    artifacts = items.documented(found)
    containers = items.normalize_containers(artifacts, inputs.details)
    wanted = items.profilable(containers, layers)
    profile = inputs.profile.join(wanted.select(F.col("id").alias("lh_id")), "lh_id", "left_semi")
    tables = _tables(profile, containers)
    columns = profile.select(
        "lh_name", "schema_name", "table_name", "ordinal", "col_name", "datatype", "is_nullable",
        "sample_value", "pct_null",
    )
    bronze = containers.where(F.col("layer") == "Bronze").select(F.col("id").alias("lh_id"))
    files = inputs.files.join(bronze, "lh_id", "left_semi")

    orchestrations = found.where(F.col("type") == "DataPipeline").select(
        F.col("id").alias("pipeline_id"), F.col("ord").alias("pipeline_ord")
    )
    acts = activities_of(inputs.pipelines.join(orchestrations, "pipeline_id"))
    # Each of these is read many times below; source texts are scanned once.
    base = stage("base", lambda: {"tables": tables, "artifacts": artifacts, "containers": containers, "ordered": A.run_order(acts)})
    tables, artifacts, containers, ordered = (base[k] for k in ("tables", "artifacts", "containers", "ordered"))
    sources = stage("sources", lambda: {
        "refs": code_refs.source_references(artifacts, inputs.parts, local_scripts(inputs.local_files), mode)
    })["refs"]

    def layer(make: Callable[..., edges.LayerEdges]) -> dict[str, DataFrame]:
        return vars(make(containers, tables, artifacts, sources, A.layer_transitions(ordered, tables, artifacts)))

    gold = edges.LayerEdges(**stage("gold", lambda: layer(edges.gold_layer)))
    silver = edges.LayerEdges(**stage("silver", lambda: layer(edges.silver_layer)))
    return Collection(
        artifacts=artifacts.where(F.col("type").isin(fixed.DOCUMENTED_TYPES)),
        containers=containers,
        tables=edges.fill_source_artifact(tables, gold, silver),
        columns=columns,
        activities=items.activity_notebook_names(ordered, artifacts),
        gold=gold,
        silver=silver,
        input_sets=edges.input_sets(containers, tables, files),
        data_sources=edges.data_sources(containers, files),
    )
