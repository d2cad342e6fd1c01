"""Lineage edges in factored form: the graph holds shared inputs and groups of tables as nodes of their own.

Three kinds of rows take the place of one row per input and table:

* ``member_of``: source -> input set, one row per member
* ``derives_from``: source or input set -> table or table group
* ``covers``: table group -> table, one row per table

So the rows grow with members plus tables, not with their product. A path source -> (set) -> (group) -> table stands for one literal
edge. Where several paths lead from one source to one table the nearest counts: a direct edge, then one into the group,
then the sets in the order their edges name. ``factor`` leaves out an edge that an earlier set covers, so the nearest
path carries what the first literal edge would. ``expand`` writes the literal edges; the views and counts walk the factored ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catloom.functions import fixed
from catloom.functions.ids import hash_id
from catloom.functions.ranking import keep_first
from catloom.operators import edges as E
from catloom.operators import graph
from catloom.operators.graph import GraphContext
from catloom.session import cut_lineage

MEMBER, COVERS, FEEDS = "member_of", "covers", "derives_from"
SET_NODE, GROUP_NODE = "InputSet", "TableGroup"
SHARED = "shared set "  # begins the transformation_type of an edge from a set; the edge's place among the node's sets follows
FACTORED = "factored"


def set_id(name: Column) -> Column:
    return hash_id("input_set", name)


def group_id(label: Column) -> Column:
    return hash_id("table_group", label)


def _order(table_ord: Column) -> Column:
    return F.struct("block", F.col("lh_ord"), table_ord.cast("long").alias("table_ord"), "writer_ord").alias("edge_ord")


def place_groups(members: DataFrame, keys: DataFrame) -> DataFrame:
    """target, tname, group_id, label, sig: the group of each known table no source names.

    Tables of one key in several containers of one name are one target; its group lists all of them.
    """
    targets = keys.select("lh_key", "tname", F.col("object_id").alias("target"))
    found = members.withColumn("lh_key", F.lower("output_lh")).join(targets, ["lh_key", "tname"])
    homes = F.struct("block", F.col("out_ord.lh_ord").alias("lh_ord"), "lh_id", "namesake")
    placed = found.groupBy("target", "tname").agg(F.sort_array(F.collect_set(homes)).alias("sig"))
    label = F.array_join(F.transform("sig", lambda x: F.concat(x["lh_id"], F.when(x["namesake"], "=").otherwise(""))), ",")
    return placed.withColumn("label", label).withColumn("group_id", group_id(F.col("label")))


def _node_edges(own: DataFrame, groups: DataFrame, placed: DataFrame, keys: DataFrame) -> DataFrame:
    """node (a table or a group), edge_ord, notebook_name, confidence, input_set, input_refs, own_name."""
    rest = ["notebook_name", "confidence", "input_set", "input_refs", "own_name"]
    targets = keys.select("lh_key", F.col("tname").alias("t_key"), F.col("object_id").alias("node"))
    single = (
        own.withColumn("lh_key", F.lower("output_lh")).withColumn("t_key", F.lower("output_table")).join(targets, ["lh_key", "t_key"])
        .withColumns({"lh_ord": F.col("out_ord.lh_ord"), "own_name": F.lit(False)})
        .select("node", _order(F.col("out_ord.table_ord")), *rest)
    )
    parts = placed.select("group_id", "sig").distinct().select(F.col("group_id").alias("node"), F.explode("sig").alias("_s"))
    parts = parts.select("node", "_s.block", "_s.lh_id", "_s.namesake")
    grouped = groups.join(parts, ["block", *E.GROUP]).select("node", _order(F.lit(0)), *rest)
    return single.unionByName(grouped)


def factor(ctx: GraphContext, layers: list[E.LayerEdges], sets: DataFrame, keys: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set and group nodes, factored lineage edges). Literal edges are never formed on the way."""
    own, groups, members = (reduce(DataFrame.unionByName, [getattr(x, n) for x in layers]) for n in ("own", "groups", "members"))
    names = graph.table_by_name(keys).select("tname", "first_id")
    placed = cut_lineage(place_groups(members, keys))
    rows = cut_lineage(_node_edges(own, groups, placed, keys))
    sure = rows.where(F.col("confidence") != fixed.NEEDS_REVIEW)

    def resolved(df: DataFrame) -> DataFrame:
        return df.withColumn("tname", F.lower("ref")).join(names, "tname", "left").withColumn(
            "source", F.coalesce("first_id", hash_id("unresolved", F.col("ref")))
        ).drop("tname", "first_id")

    inside = cut_lineage(keep_first(resolved(sets), ["input_set", "source"], F.col("ref_ord")).select("input_set", "source"))
    links = keep_first(
        sure.where(F.col("input_set").isNotNull()).select("node", "input_set", "edge_ord", "notebook_name", "confidence"),
        ["node", "input_set"], F.col("edge_ord"),
    )
    places = Window.partitionBy("node").orderBy("edge_ord")  # a node has at most as many sets as there are
    links = cut_lineage(links.withColumn("place", F.row_number().over(places)))

    refs = sure.where(F.col("input_set").isNull()).select(
        "node", "edge_ord", "notebook_name", "confidence", F.posexplode("input_refs").alias("_p", "ref")
    )
    refs = keep_first(
        resolved(refs).select("node", "source", F.struct("edge_ord", "_p").alias("pick"), "notebook_name", "confidence"),
        ["node", "source"], F.col("pick"),
    )
    refs = cut_lineage(refs)
    refs = refs.join(_covered(refs, links, inside, "node"), ["node", "source"], "left_anti")

    first = keep_first(sure.where("own_name").select("node", "edge_ord", "notebook_name", "confidence"), ["node"], F.col("edge_ord"))
    twins = resolved(
        placed.select("target", F.col("tname").alias("ref"), F.col("group_id").alias("node")).join(first, "node")
    ).select("node", "target", "source", F.struct("edge_ord", F.lit(0).alias("_p")).alias("pick"), "notebook_name", "confidence")
    earlier = refs.select("node", "source", F.col("pick").alias("_before"))
    twins = cut_lineage(twins.join(earlier, ["node", "source"], "left").where("_before IS NULL OR pick < _before").drop("_before"))
    twins = twins.join(_covered(twins, links, inside, "node"), ["node", "source"], "left_anti")

    sent = refs.select("source", F.col("node").alias("target"), "notebook_name", "confidence").unionByName(
        twins.select("source", "target", "notebook_name", "confidence")
    )
    shared = links.select(
        set_id(F.col("input_set")).alias("source"), F.col("node").alias("target"), "notebook_name", "confidence",
        F.concat(F.lit(SHARED), F.col("place").cast("string")).alias("how"),
    )
    derived = sent.withColumn("how", F.lit(None).cast("string")).unionByName(shared).select(
        *_edge(ctx, FEEDS, transformation_type=F.col("how"), code_reference=F.col("notebook_name"),
               confidence_score=graph._score(F.col("confidence")), detection_method=graph._method(F.col("confidence")))
    )
    certain = {"confidence_score": F.lit("1.0").cast("decimal(5,4)"), "detection_method": F.lit(FACTORED)}
    held = inside.select("source", set_id(F.col("input_set")).alias("target")).select(*_edge(ctx, MEMBER, **certain))
    covers = placed.select(F.col("group_id").alias("source"), "target").select(*_edge(ctx, COVERS, **certain))
    review = rows.where(F.col("confidence") == fixed.NEEDS_REVIEW).select(F.col("node").alias("target"), "notebook_name")
    edges = reduce(DataFrame.unionByName, [derived, held, covers, graph.review_edges(ctx, review, artifacts)])
    return _nodes(ctx, sets, placed), edges


def _covered(refs: DataFrame, links: DataFrame, inside: DataFrame, node: str) -> DataFrame:
    """(node, source) of the rows that an earlier edge from a set of the same node covers."""
    before = refs.select(node, "source", F.col("pick.edge_ord").alias("_o")).join(links.select(node, "input_set", "edge_ord"), node)
    return before.where("edge_ord < _o").join(inside, ["input_set", "source"], "left_semi").select(node, "source").distinct()


def _edge(ctx: GraphContext, kind: str, **fields: Column) -> list[Column]:
    return ctx.edge(
        relationships_id=hash_id(F.col("source"), F.col("target"), kind), source_objects_id=F.col("source"),
        target_objects_id=F.col("target"), relationships_type=F.lit(kind), **fields,
    )


def _nodes(ctx: GraphContext, sets: DataFrame, placed: DataFrame) -> DataFrame:
    """A node for each input set and each group."""
    shown = F.replace("input_set", F.lit("_"), F.lit(" "))
    kinds = [
        sets.select("input_set").distinct().select(set_id(F.col("input_set")).alias("_id"), F.lit(SET_NODE).alias("_kind"), shown.alias("_name")),
        placed.select("group_id", "label").distinct().select(
            F.col("group_id").alias("_id"), F.lit(GROUP_NODE).alias("_kind"), F.concat(F.lit("unclaimed tables of "), "label").alias("_name")
        ),
    ]
    return reduce(DataFrame.unionByName, kinds).select(
        *ctx.node(F.col("_kind"), objects_id=F.col("_id"), item_name=F.col("_name"), fq_name=ctx.fq(F.col("_name")),
                  parent_objects_id=F.lit(ctx.workspace_id))
    )


# Reading ------------------------------------------------------------------


def _parts(relationships: DataFrame) -> tuple[DataFrame, ...]:
    """Plain feeds, feeds from sets, reviews, set members, and tables of groups."""
    kind, how = F.col("relationships_type"), F.col("transformation_type")
    feeds = relationships.where(kind == FEEDS)
    review = F.coalesce(F.col("transformation_expr") == fixed.REVIEW_EXPR, F.lit(False))
    from_set = F.coalesce(how.startswith(SHARED), F.lit(False))
    ends = ["source_objects_id", "target_objects_id"]
    return (
        feeds.where(~review & ~from_set), feeds.where(from_set), feeds.where(review),
        relationships.where(kind == MEMBER).select(*ends), relationships.where(kind == COVERS).select(*ends),
    )


def expand(ctx: GraphContext, relationships: DataFrame, splits: int = E.SET_SPLITS) -> DataFrame:
    """The literal edges: a ``derives_from`` row per source and table, and all other rows as they are.

    The result grows with members times tables. Sources are dealt over ``splits`` parts by their ids, so no task holds all pairs of a
    set or group, and literal rows are shuffled only for tables that several paths of one source reach.
    """
    plain, shared, review, members, covers = _parts(relationships)
    tables = covers.select(F.col("source_objects_id").alias("node"), F.col("target_objects_id").alias("target"))
    facts = ["code_reference", "confidence_score", "detection_method"]

    def at_tables(df: DataFrame, level: Column, grouped: Column) -> DataFrame:
        """Rows (node, source, facts) at their tables; ``level`` tells near paths from far ones."""
        near = df.join(tables.select("node").distinct(), "node", "left_anti").select("source", F.col("node").alias("target"), *facts, level.alias("level"))
        far = df.join(tables, "node").select("source", "target", *facts, grouped.alias("level"))
        return near.unionByName(far)

    own = plain.select(F.col("target_objects_id").alias("node"), F.col("source_objects_id").alias("source"), *facts)
    grouped = tables.select("node", F.lit(True).alias("_grouped")).distinct()
    place = F.substring_index("transformation_type", " ", -1).cast("int").alias("place")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))).alias("_split")
    links = shared.select(F.col("source_objects_id").alias("_set"), F.col("target_objects_id").alias("node"), *facts, place, parts)
    held = members.select(
        F.col("target_objects_id").alias("_set"), F.col("source_objects_id").alias("source"),
        F.pmod(F.xxhash64("source_objects_id"), F.lit(splits)).alias("_split"),
    )
    wide = links.join(held, ["_set", "_split"]).select("node", "source", *facts, (F.col("place") + 1).cast("int").alias("level"))
    start = own.join(grouped, "node", "left").select("node", "source", *facts, F.when(F.col("_grouped"), 1).otherwise(0).alias("level"))
    # Once per node, so a group's rows are settled before its tables are met.
    settled = cut_lineage(keep_first(start.unionByName(wide), ["node", "source"], F.col("level")))
    near = settled.join(grouped, "node", "left_anti").withColumnRenamed("node", "target")
    far = settled.join(grouped, "node", "left_semi")
    # Tables that several paths of one source reach: only their rows are compared, all others are written as they are met.
    several = tables.groupBy("target").agg(F.count_distinct("node").alias("_n")).where("_n > 1").select("target")
    met = near.select("target", "source").join(tables, "target").join(far.select("node", "source"), ["node", "source"]).select("target")
    contested = cut_lineage(several.unionByName(met).distinct())

    def over(members_of: DataFrame) -> DataFrame:
        """Rows of groups at the given tables: the tables are copied to the parts that a group's sources are dealt over."""
        keys = ["node", "_split"]
        sent = far.withColumn("_split", F.pmod(F.xxhash64("source"), F.lit(splits))).repartition(2 * splits, *keys)
        return sent.join(members_of.distinct().select("*", parts).repartition(2 * splits, *keys), keys).select("source", "target", *facts, "level")

    open_ = over(tables.join(contested, "target", "left_semi")).unionByName(near.join(contested, "target", "left_semi").select("source", "target", *facts, "level"))
    single = over(tables.join(contested, "target", "left_anti")).unionByName(near.join(contested, "target", "left_anti").select("source", "target", *facts, "level"))
    once = single.unionByName(keep_first(open_, ["source", "target"], F.col("level")).select(*single.columns))
    derived = once.select(*_edge(ctx, FEEDS, **{f: F.col(f) for f in facts}))
    again = review.select(F.col("target_objects_id").alias("node"), F.col("source_objects_id").alias("source"), *facts)
    again = at_tables(again, F.lit(0), F.lit(0)).select(
        *ctx.edge(
            relationships_id=hash_id(F.col("target"), "needs_review", F.col("code_reference")), source_objects_id=F.col("source"),
            target_objects_id=F.col("target"), relationships_type=F.lit(FEEDS), transformation_expr=F.lit(fixed.REVIEW_EXPR),
            **{f: F.col(f) for f in facts},
        )
    )
    others = relationships.where(~F.col("relationships_type").isin(FEEDS, MEMBER, COVERS))
    return reduce(DataFrame.unionByName, [derived, again, others.select(*derived.columns)])


SEND_ENDS = 500_000  # ids that ``feed_ends`` gives at most


def feed_ends(relationships: DataFrame) -> DataFrame | None:
    """objects_id of whatever ``derives_from`` edges meet when expanded, told from the factored edges; None if these are too many to send."""
    lineage = relationships.where(F.col("relationships_type").isin(FEEDS, MEMBER, COVERS))
    ends = lineage.select(F.explode(F.array("source_objects_id", "target_objects_id")).alias("objects_id")).distinct()
    ends = cut_lineage(ends)
    return ends if ends.count() <= SEND_ENDS else None


def hidden_edges(relationships: DataFrame, objects: DataFrame) -> DataFrame:
    """Count of literal edges per type whose source has no node, told from the factored edges.

    A node's hidden inputs are those of its sets, counted once for every combination of sets that occurs, and those of its own that
    no set of it holds; a group's count stands for each of its tables.
    """
    plain, shared, review, members, covers = _parts(relationships)
    nodes = objects.select(F.col("objects_id").alias("source"))

    def hidden(df: DataFrame, node: str) -> DataFrame:
        return df.select(F.col("source_objects_id").alias("source"), F.col("target_objects_id").alias(node)).join(nodes, "source", "left_anti")

    size = covers.groupBy(F.col("source_objects_id").alias("node")).agg(F.count(F.lit(1)).alias("_n"))

    def total(df: DataFrame, amount: Column) -> DataFrame:
        """Sum over nodes, a group as often as it has tables."""
        weighed = df.join(size, "node", "left").select((amount * F.coalesce("_n", F.lit(1))).alias("n"))
        return weighed.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_hidden")).withColumn("relationships_type", F.lit(FEEDS))

    lost = hidden(members, "_set")
    links = shared.select(F.col("source_objects_id").alias("_set"), F.col("target_objects_id").alias("node"))
    combos = links.groupBy("node").agg(F.sort_array(F.collect_set("_set")).alias("_sets"))
    sizes = (
        combos.select("_sets").distinct().withColumn("_set", F.explode("_sets")).join(lost, "_set")
        .select("_sets", "source").distinct().groupBy("_sets").agg(F.count(F.lit(1)).alias("_lost"))
    )
    by_set = total(combos.join(sizes, "_sets"), F.col("_lost"))
    own = cut_lineage(hidden(plain, "node"))
    # What a set of the node holds is counted there; for a table of a group also what the group's own edges or sets hold.
    in_set = own.join(links, "node").join(lost, ["_set", "source"], "left_semi").select("node", "source")
    at = covers.select(F.col("source_objects_id").alias("_group"), F.col("target_objects_id").alias("node"))
    via = own.join(at, "node")
    in_group = via.join(own.select(F.col("node").alias("_group"), "source"), ["_group", "source"], "left_semi").select("node", "source")
    in_group_set = via.join(links.withColumnRenamed("node", "_group"), "_group").join(lost, ["_set", "source"], "left_semi").select("node", "source")
    twice = in_set.unionByName(in_group).unionByName(in_group_set).distinct()
    by_own = total(own.join(twice, ["node", "source"], "left_anti"), F.lit(1))
    by_review = total(hidden(review, "node"), F.lit(1))
    others = relationships.where(~F.col("relationships_type").isin(FEEDS, MEMBER, COVERS)).join(
        nodes.withColumnRenamed("source", "source_objects_id"), "source_objects_id", "left_anti"
    ).groupBy("relationships_type").agg(F.count(F.lit(1)).alias("n_hidden"))
    found = reduce(DataFrame.unionByName, [by_set, by_own, by_review, others])
    return found.groupBy("relationships_type").agg(F.sum("n_hidden").alias("n_hidden")).where("n_hidden > 0")


def feeds_of_tables(relationships: DataFrame) -> DataFrame:
    """``derives_from`` rows at tables, those of a group at each of its tables; an input set stays one source."""
    plain, shared, review, _, covers = _parts(relationships)
    feeds = plain.unionByName(shared).unionByName(review)
    tables = covers.select(F.col("source_objects_id").alias("_group"), F.col("target_objects_id").alias("_table"))
    through = feeds.join(tables, F.col("target_objects_id") == F.col("_group")).withColumn("target_objects_id", F.col("_table"))
    single = feeds.join(tables.select(F.col("_group").alias("target_objects_id")).distinct(), "target_objects_id", "left_anti")
    return single.unionByName(through.select(*single.columns))
