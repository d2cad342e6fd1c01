"""Derivation edges between layers: which step wrote a table, from which inputs, how surely.

Inputs used throughout:

* ``containers``: ord, id, display_name, layer, files_path, workspace_name
* ``tables``: ord, lh_id, table_name
* ``artifacts``: ord, id, display_name, type
* ``sources``: artifact_id, source_method, reads, writes, src_ord (see ``code_refs.source_references``)
* ``transitions``: artifact_id, read_layer, write_layer, ins (see ``activities.layer_transitions``)
* ``files``: ord, lh_id, name, size

An edge row carries either its own ``input_refs`` or the name of a shared ``input_set``; the sets live once
in ``input_sets``. So an edge never holds a list that grows with the catalog.

Edges of tables that no source names are the same for all such tables of a container, so they are kept once for the
container (``LayerEdges.groups``) beside the tables they hold for. ``expand_groups`` writes them out, a row per table and writer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.functions import fixed, text
from catloom.functions.ranking import order_text, rank_in_group
from catloom.session import cut_lineage

ALL_SILVER, ALL_BRONZE, BRONZE_FILES = "all_silver", "all_bronze", "bronze_files"
# Least number of parts a shared input set is expanded in, so no single task holds all of its pairs.
SET_SPLITS = 64


def layer_tables(containers: DataFrame, tables: DataFrame, layer: str) -> DataFrame:
    """Tables of one layer with their container, in container then table order."""
    home = containers.where(F.col("layer") == layer).select(
        F.col("id").alias("lh_id"), F.col("display_name").alias("output_lh"), F.col("ord").alias("lh_ord")
    )
    return tables.select("lh_id", "table_name", F.col("ord").alias("table_ord")).join(home, "lh_id").select(
        "lh_id", "output_lh", F.col("table_name").alias("output_table"), F.lower("table_name").alias("tname"),
        F.struct("lh_ord", "table_ord").alias("out_ord"),
    )


def table_names(layered: DataFrame) -> DataFrame:
    """Distinct lower-case names of a layer with their first place."""
    return layered.groupBy("tname").agg(F.min("out_ord").alias("first_ord"))


def parsed_writers(layered: DataFrame, sources: DataFrame) -> DataFrame:
    """(table, writer) pairs where the writer's source names the table."""
    writes = sources.select("artifact_id", F.col("src_ord").alias("_o"), F.explode("writes").alias("tname"))
    order = F.struct(F.col("_o._kind").alias("a"), F.col("_o.ord").alias("b"), F.lit(0).cast("long").alias("c"))
    return layered.join(writes, "tname").select(*layered.columns, "artifact_id", order.alias("writer_ord"))


def name_pieces(names: DataFrame, key: str, text_column: str, lengths: Column) -> DataFrame:
    """Every substring of a name that has one of the ``lengths`` (an array); two narrow explodes, no pairing."""
    sized = names.select(key, F.lower(text_column).alias("_n"), F.explode(lengths).alias("_k")).where(F.col("_k") <= F.length("_n"))
    last = F.when(F.col("_k") == 0, 1).otherwise(F.length("_n") - F.col("_k") + 1)
    starts = sized.select(key, "_n", "_k", F.explode(F.sequence(F.lit(1), last)).alias("_i"))
    return starts.select(key, F.substr("_n", F.col("_i"), F.col("_k")).alias("piece"))


def domain_writers(domains: DataFrame, writers: DataFrame) -> DataFrame:
    """(lh_id, artifact_id) where the container's domain is part of the writer's name.

    An equality join of domains with the pieces of names that are as long as some domain; the empty domain meets every name.
    """
    lengths = domains.agg(F.collect_set(F.length("domain"))).scalar()
    pieces = name_pieces(writers, "artifact_id", "writer_name", lengths)
    wanted = domains.select(F.col("domain").alias("piece"), "lh_id")
    return wanted.join(pieces, "piece").select("lh_id", "artifact_id").distinct()


GROUP = ["lh_id", "namesake"]


@dataclass(frozen=True)
class LayerEdges:
    """Edges into the tables of one layer.

    * ``own``: an edge row per table and writer, for tables that some source names
    * ``groups``: block, lh_id, namesake, lh_ord, writer_ord, notebook_id, notebook_name, input_set, input_refs, own_name, confidence,
      notes; one row per group of other tables and writer. ``own_name``: each table is fed by its namesake.
    * ``members``: block, lh_id, namesake, output_lh, output_table, tname, out_ord; the tables of the groups
    """

    own: DataFrame
    groups: DataFrame
    members: DataFrame

    def kept(self) -> LayerEdges:
        return LayerEdges(*(cut_lineage(df) for df in (self.own, self.groups, self.members)))


def expand_groups(layer: LayerEdges, splits: int | None = None) -> DataFrame:
    """All edges of a layer, a row per table and writer.

    The rows are writers times tables of few groups: a group's tables are dealt over ``splits`` parts that its writers are
    copied to. The number of tasks is set, since the inputs are small and their sizes do not show what comes out.
    """
    splits = splits or max(SET_SPLITS, int(layer.groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One text names the group: a key that is the same in all rows is dropped from the join, which then deals both sides anew, to few tasks.
    group = F.concat(F.when(F.col("namesake"), "1").otherwise("0"), "lh_id").alias("_group")
    keys = ["_group", "_split"]
    members = layer.members.drop("block").select("*", group, F.pmod(F.xxhash64("out_ord", "output_table"), F.lit(splits)).alias("_split"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))).alias("_split")
    writers = layer.groups.select("*", group).drop(*GROUP).select("*", parts)
    wide = writers.repartition(2 * splits, *keys).join(members.repartition(2 * splits, *keys), keys)
    refs = F.when(F.col("own_name"), F.array("tname")).otherwise(F.col("input_refs"))
    return layer.own.unionByName(wide.withColumn("input_refs", refs).select(*layer.own.columns))


def fallback_groups(members: DataFrame, transitions: DataFrame, artifacts: DataFrame, layer: str) -> DataFrame:
    """Writers of the tables no source names, once for each group: by domain in the writer's name, else the layer's first writer."""
    names = artifacts.where(F.col("type").isin("Notebook", *fixed.DATAFLOW_TYPES)).select(
        F.col("id").alias("artifact_id"), "display_name"
    )
    writers = cut_lineage(
        transitions.where(F.col("write_layer") == layer)
        .join(names, "artifact_id", "left")
        .select("artifact_id", F.coalesce("display_name", "artifact_id").alias("writer_name"), "ins")
    )
    groups = members.groupBy(*GROUP).agg(F.min("output_lh").alias("output_lh"), F.min("out_ord.lh_ord").alias("lh_ord"))
    domains = groups.select("lh_id", text.container_domain(F.col("output_lh"), layer).alias("domain")).distinct()
    matched = cut_lineage(domain_writers(domains, writers).join(writers.select("artifact_id", "ins"), "artifact_id"))
    order = F.struct(F.col("ins.block").alias("a"), F.col("ins.major").alias("b"), F.col("ins.minor").alias("c"))
    cols = [*GROUP, "lh_ord"]
    by_domain = groups.join(matched, "lh_id").select(*cols, "artifact_id", order.alias("writer_ord"))
    first = writers.agg(F.min_by(F.struct("artifact_id", order.alias("writer_ord")), "ins").alias("w")).scalar()
    by_layer = (
        groups.join(matched.select("lh_id").distinct(), "lh_id", "left_anti")
        .withColumn("_w", first)
        .where(F.col("_w").isNotNull())
        .select(*cols, "_w.artifact_id", "_w.writer_ord")
    )
    return by_domain.unionByName(by_layer)


def _with_sources(pairs: DataFrame, sources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Add the writer's display name, its source method and whether its reads are known."""
    names = artifacts.where(F.col("type").isin("Notebook", *fixed.DATAFLOW_TYPES)).select(
        F.col("id").alias("artifact_id"), "display_name"
    )
    found = sources.select(
        "artifact_id", "source_method", ((F.col("source_method") != "none") & (F.size("reads") > 0)).alias("_known")
    )
    return (
        pairs.join(names, "artifact_id", "left")
        .join(found, "artifact_id", "left")
        .select(
            *pairs.columns,
            F.coalesce("display_name", "artifact_id").alias("notebook_name"),
            "source_method",
            F.coalesce("_known", F.lit(False)).alias("has_reads"),
        )
    )


def _carried(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Facts the writers of one table, or of one group, share: the first writer's method and the first writer without reads.

    Once a writer without reads was met, the changed confidence and note stay for the writers after it.
    """
    pairs = cut_lineage(pairs)
    shared = pairs.groupBy(*keys).agg(
        F.min_by("source_method", "writer_ord").alias("_method"),
        F.min(F.when(~F.col("has_reads"), F.col("writer_ord"))).alias("_turn"),
    )
    return pairs.join(shared, keys).withColumn(
        "turned", F.coalesce(F.col("writer_ord") >= F.col("_turn"), F.lit(False))
    )


def _verdict(parsed: bool, turned: Column) -> Column:
    """Confidence and notes; ``turned`` is that struct for rows after the turn."""
    if parsed:
        start = (F.lit(fixed.PARSED), F.concat(F.lit(fixed.NOTE_PARSED), "_method"))
    else:
        start = (F.lit(fixed.INFERRED), F.lit(fixed.NOTE_POSITION))
    return F.when(F.col("turned"), turned).otherwise(F.struct(start[0].alias("confidence"), start[1].alias("notes")))


def _layer(
    block: str, layered: DataFrame, sources: DataFrame, transitions: DataFrame, artifacts: DataFrame,
    namesakes: DataFrame | None, inputs,
) -> LayerEdges:
    """The edges of a layer. ``inputs``: rows -> (rows, input_set, input_refs, own_name, turned verdict)."""
    if namesakes is None:
        layered = layered.withColumn("namesake", F.lit(False))
    else:
        layered = layered.join(namesakes.select("tname", F.lit(True).alias("namesake")), "tname", "left").withColumn(
            "namesake", F.coalesce("namesake", F.lit(False))
        )
    layer_name = block.capitalize()
    named = sources.select(F.explode("writes").alias("tname")).distinct()
    members = layered.join(named, "tname", "left_anti").select(
        F.lit(block).alias("block"), *GROUP, "output_lh", "output_table", "tname", "out_ord"
    )
    writer = [F.col("artifact_id").alias("notebook_id"), "notebook_name"]

    pairs = _carried(_with_sources(parsed_writers(layered, sources), sources, artifacts), ["lh_id", "out_ord"])
    rows, input_set, refs, own_name, turned = inputs(pairs)
    own = rows.select(
        F.lit(block).alias("block"), "out_ord", "writer_ord", "lh_id", "output_lh", "output_table", *writer,
        input_set.alias("input_set"), F.when(own_name, F.array("tname")).otherwise(refs).alias("input_refs"),
        _verdict(True, turned).alias("_v"),
    )
    pairs = _carried(_with_sources(fallback_groups(members, transitions, artifacts, layer_name), sources, artifacts), GROUP)
    rows, input_set, refs, own_name, turned = inputs(pairs)
    groups = rows.select(
        F.lit(block).alias("block"), *GROUP, "lh_ord", "writer_ord", *writer, input_set.alias("input_set"),
        refs.alias("input_refs"), own_name.alias("own_name"), _verdict(False, turned).alias("_v"),
    )
    return LayerEdges(own.select("*", "_v.*").drop("_v"), groups.select("*", "_v.*").drop("_v"), members)


def gold_layer(
    containers: DataFrame, tables: DataFrame, artifacts: DataFrame, sources: DataFrame, transitions: DataFrame
) -> LayerEdges:
    """Gold table <- writer <- silver tables."""
    silver = table_names(layer_tables(containers, tables, "Silver"))
    known = (
        sources.select("artifact_id", F.explode("reads").alias("tname"))
        .join(silver.select("tname"), "tname", "left_semi")
        .groupBy("artifact_id")
        .agg(F.array_sort(F.collect_set("tname")).alias("_refs"))
    )
    none = F.array().cast("array<string>")
    turned = F.struct(F.lit(fixed.INFERRED).alias("confidence"), F.lit(fixed.NOTE_ALL_SILVER).alias("notes"))

    def inputs(rows: DataFrame):
        return (
            rows.join(known, "artifact_id", "left"), F.when(~F.col("has_reads"), F.lit(ALL_SILVER)),
            F.when(F.col("has_reads"), F.coalesce("_refs", none)), F.lit(False), turned,
        )

    return _layer("gold", layer_tables(containers, tables, "Gold"), sources, transitions, artifacts, None, inputs)


def silver_layer(
    containers: DataFrame, tables: DataFrame, artifacts: DataFrame, sources: DataFrame, transitions: DataFrame
) -> LayerEdges:
    """Silver table <- writer <- bronze tables or files."""
    bronze = layer_tables(containers, tables, "Bronze")
    any_bronze = bronze.limit(1).agg((F.count(F.lit(1)) > 0).alias("any")).scalar()

    def verdict(confidence: str, note: str) -> Column:
        return F.struct(F.lit(confidence).alias("confidence"), F.lit(note).alias("notes"))

    turned = (
        F.when(F.col("namesake"), verdict(fixed.INFERRED, fixed.NOTE_SAME_NAME))
        .when(F.col("_any"), verdict(fixed.NEEDS_REVIEW, fixed.NOTE_ALL_BRONZE))
        .otherwise(verdict(fixed.INFERRED, fixed.NOTE_FILES))
    )
    shared = F.when(F.col("_any"), F.lit(ALL_BRONZE)).otherwise(F.lit(BRONZE_FILES))

    def inputs(rows: DataFrame):
        reads = sources.select("artifact_id", F.col("reads").alias("_reads"))
        return (
            rows.join(reads, "artifact_id", "left").withColumn("_any", any_bronze),
            F.when(~F.col("has_reads") & ~F.col("namesake"), shared),
            F.when(F.col("has_reads"), F.col("_reads")), ~F.col("has_reads") & F.col("namesake"), turned,
        )

    silver = layer_tables(containers, tables, "Silver")
    return _layer("silver", silver, sources, transitions, artifacts, bronze.select("tname").distinct(), inputs)


def gold_edges(*inputs: DataFrame) -> DataFrame:
    """Gold edges, a row per table and writer."""
    return expand_groups(gold_layer(*inputs))


def silver_edges(*inputs: DataFrame) -> DataFrame:
    """Silver edges, a row per table and writer."""
    return expand_groups(silver_layer(*inputs))


def input_sets(containers: DataFrame, tables: DataFrame, files: DataFrame) -> DataFrame:
    """Members of the shared input sets: input_set, ref, ref_ord.

    All silver tables in first-seen order, all bronze tables in name order, all bronze files (or a stub per
    container without files) in container order.
    """
    silver = table_names(layer_tables(containers, tables, "Silver"))
    bronze = table_names(layer_tables(containers, tables, "Bronze"))
    homes = containers.where(F.col("layer") == "Bronze").select(
        F.col("id").alias("lh_id"), "display_name", F.col("ord").alias("_lh")
    )

    def member(name: str, ref: Column, first: Column, second: Column) -> list[Column]:
        place = F.struct(first.cast("long").alias("a"), second.cast("long").alias("b"))
        return [F.lit(name).alias("input_set"), ref.alias("ref"), place.alias("ref_ord")]

    zero = F.lit(0)
    parts = [
        silver.select(*member(ALL_SILVER, F.col("tname"), F.col("first_ord.lh_ord"), F.col("first_ord.table_ord"))),
        bronze.select(*member(ALL_BRONZE, F.col("tname"), zero, zero)),
        files.join(homes, "lh_id").select(
            *member(
                BRONZE_FILES,
                F.concat("display_name", F.lit("/"), text.after_first_slash(F.col("name"))),
                F.col("_lh"), F.col("ord"),
            )
        ),
        homes.join(files.select("lh_id").distinct(), "lh_id", "left_anti").select(
            *member(BRONZE_FILES, F.concat("display_name", F.lit(fixed.STUB_FILE_REF)), F.col("_lh"), zero)
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


SET_PIECE = 10_000  # members whose names are joined in one step


def set_texts(sets: DataFrame) -> DataFrame:
    """input_set, set_text: the members of each set, in order, as one text.

    Members are numbered by value ranges and joined in pieces of ``SET_PIECE``, then the pieces; the text is made once per set,
    and edges take it by the set's name.
    """
    order = F.concat_ws("\u0001", order_text(F.col("ref_ord.a"), F.col("ref_ord.b")), "ref")
    ranked = rank_in_group(sets.select("input_set", "ref", order.alias("_order")), ["input_set"], "_order", "_no")

    def joined(df: DataFrame, keys: list[str], place: str, part: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("i"), F.col(part).alias("x"))))
        return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["x"]), ", ").alias("set_text"))

    piece = F.floor((F.col("_no") - 1) / SET_PIECE).alias("_piece")
    pieces = joined(ranked.select("*", piece), ["input_set", "_piece"], "_no", "ref")
    return joined(pieces, ["input_set"], "_piece", "set_text")


def expand_inputs(edges: DataFrame, sets: DataFrame, splits: int | None = None) -> DataFrame:
    """One row per edge and input, with ``ref`` and ``ref_ord``; edges without inputs drop out.

    The edges of a shared set are dealt over ``splits`` parts that its members are copied to: edges pass one shuffle, once each, and all
    rows of an edge lie in one task, so that a count by edge combines before its own shuffle. Further columns of ``sets`` are kept; they
    are null where an edge lists its inputs itself.
    """
    splits = splits or max(SET_SPLITS, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keep = [c for c in edges.columns if c not in ("input_refs", "input_set")]
    more = [f for f in sets.schema.fields if f.name not in ("input_set", "ref", "ref_ord")]
    own = edges.where(F.col("input_set").isNull()).select(*keep, F.posexplode("input_refs").alias("_p", "ref"))
    own = own.select(
        *keep, "ref", F.struct(F.lit(0).cast("long").alias("a"), F.col("_p").cast("long").alias("b")).alias("ref_ord"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in more],
    )
    by = ["input_set", "_split"]
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long")))
    dealt = edges.where(F.col("input_set").isNotNull()).withColumn("_split", F.pmod(F.xxhash64(*keep), F.lit(splits)))
    copies = sets.withColumn("_split", parts).repartition(2 * splits, *by)
    shared = dealt.repartition(2 * splits, *by).join(copies, by).select(*keep, "ref", "ref_ord", *[f.name for f in more])
    return own.unionByName(shared)


def source_artifacts(*layers: LayerEdges) -> DataFrame:
    """Lower-case table name -> writer of its last edge (gold edges before silver edges); groups give their last writer once."""
    parts = []
    for layer in layers:
        parts.append(layer.own.select(
            F.lower("output_table").alias("_t"), F.struct("block", "out_ord", "writer_ord").alias("_o"), "notebook_name"
        ))
        last = layer.groups.groupBy(*GROUP).agg(F.max_by(F.struct("writer_ord", "notebook_name"), "writer_ord").alias("_w"))
        parts.append(layer.members.join(last, GROUP).select(
            F.col("tname").alias("_t"), F.struct("block", "out_ord", F.col("_w.writer_ord").alias("writer_ord")).alias("_o"),
            F.col("_w.notebook_name").alias("notebook_name"),
        ))
    return reduce(DataFrame.unionByName, parts).groupBy("_t").agg(F.max_by("notebook_name", "_o").alias("source_artifact"))


def fill_source_artifact(tables: DataFrame, *layers: LayerEdges) -> DataFrame:
    """Set ``source_artifact`` of every table whose name an edge writes."""
    base = tables.drop("source_artifact")
    return (
        base.withColumn("_t", F.lower("table_name"))
        .join(source_artifacts(*layers), "_t", "left")
        .select(*base.columns, F.coalesce("source_artifact", F.lit("")).alias("source_artifact"))
    )


def count_edges(layer: LayerEdges) -> DataFrame:
    """One row: how many edges ``expand_groups`` would give (``total``)."""
    per = [df.groupBy(*GROUP).agg(F.count(F.lit(1)).alias(n)) for df, n in ((layer.groups, "_w"), (layer.members, "_t"))]
    wide = per[0].join(per[1], GROUP).select((F.col("_w") * F.col("_t")).alias("_n"))
    own = layer.own.agg(F.count(F.lit(1)).alias("_n"))
    return own.unionByName(wide).agg(F.sum("_n").cast("long").alias("total"))


def data_sources(containers: DataFrame, files: DataFrame) -> DataFrame:
    """Rows on what feeds bronze: one per file, or a stub for a bronze container without files."""
    homes = containers.where(F.col("layer") == "Bronze").select(
        F.col("id").alias("lh_id"), F.col("ord").alias("lh_ord"), "display_name", "workspace_name", "files_path"
    )
    rel = text.after_first_slash(F.col("name"))
    found = files.join(homes, "lh_id").select(
        F.struct("lh_ord", "ord").alias("row_ord"),
        text.base_name(rel).alias("source_name"),
        F.lit(fixed.FILE_SOURCE_TYPE).alias("source_type"),
        F.concat(
            F.lit(fixed.FILE_HOST + "/"), "workspace_name", F.lit("/"), "display_name", F.lit("/Files/"), rel
        ).alias("connection_path"),
        rel.alias("target_bronze"),
        F.lit(fixed.FILE_INGESTION).alias("ingestion_method"),
        F.format_string(fixed.FILE_NOTE, F.col("size").cast("string")).alias("notes"),
    )
    stubs = homes.join(files.select("lh_id").distinct(), "lh_id", "left_anti").select(
        F.struct("lh_ord", F.lit(0).cast("long").alias("ord")).alias("row_ord"),
        F.concat("display_name", F.lit(" (files)")).alias("source_name"),
        F.lit(fixed.FILE_SOURCE_TYPE).alias("source_type"),
        F.col("files_path").alias("connection_path"),
        F.lit(fixed.STUB_TARGET).alias("target_bronze"),
        F.lit(fixed.STUB_INGESTION).alias("ingestion_method"),
        F.lit(fixed.STUB_NOTE).alias("notes"),
    )
    return found.unionByName(stubs)
