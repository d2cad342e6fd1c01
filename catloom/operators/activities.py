"""Execution order of activities and the layers their notebooks read and write."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catloom.functions import fixed, text
from catloom.functions.ranking import order_text, rank_in_group, running_total
from catloom.session import cut_lineage, shuffles_dropped

# Groups up to this size are ordered inside one task, which bounds its memory; larger ones by joins, chains at once.
GROUP_ROWS = 10_000


def run_order(activities: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``position`` (from 0): first-in-first-out topological order within each pipeline.

    An activity runs when all it waits for have run; ties go to the one whose last predecessor ran
    first, then to input order. Activities that can never run (a cycle, an unknown or a repeated
    predecessor) get no row here; ``never_run`` lists them. Where names repeat within a pipeline, each
    activity with an awaited name counts as one that has run. Both ways give the same order at every size.
    """
    sizes = activities.groupBy("pipeline_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > group_rows).select("pipeline_id")
    with shuffles_dropped(activities.sparkSession):
        none = large.isEmpty()
    if none:
        return _order_small(activities)
    large = cut_lineage(large)
    small = activities.join(large, "pipeline_id", "left_anti")
    return _order_small(small).unionByName(_order_large(activities.join(large, "pipeline_id", "left_semi")))


def never_run(activities: DataFrame, ordered: DataFrame) -> DataFrame:
    return activities.join(ordered.select("pipeline_id", "ord"), ["pipeline_id", "ord"], "left_anti")


def _in_order(names: list, waits: list[list]) -> list[int]:
    """Row indices of one pipeline in run order, given its activity names and what each one waits for."""
    followers: dict[str, list[int]] = {}
    missing = [len(w) for w in waits]
    for i, wait in enumerate(waits):
        for parent in dict.fromkeys(wait):
            followers.setdefault(parent, []).append(i)
    ready = deque(i for i, m in enumerate(missing) if m == 0)
    done: list[int] = []
    while ready:
        i = ready.popleft()
        done.append(i)
        for j in followers.get(names[i], ()):
            missing[j] -= 1
            if missing[j] == 0:
                ready.append(j)
    return done


def _listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come pipeline by pipeline, in run order and with their position; a pipeline may go on in the next batch."""

    def placed(batch: pa.RecordBatch, ends: list[int]) -> pa.RecordBatch:
        names, waits = _listed(batch.column("name")), batch.column("depends_on")
        at, awaited = _listed(waits.offsets), _listed(waits.values)
        rows, places, start = [], [], 0
        for end in ends:
            done = _in_order(names[start:end], [awaited[at[i] : at[i + 1]] for i in range(start, end)])
            rows += [start + i for i in done]
            places += range(len(done))
            start = end
        taken = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "position"])

    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        *ends, _ = pc.run_end_encode(batch.column("pipeline_id")).run_ends.to_pylist()
        if ends:
            yield placed(batch, ends)
        held = batch.slice(ends[-1] if ends else 0)
    if held is not None:
        yield placed(held, [held.num_rows])


def _order_small(activities: DataFrame) -> DataFrame:
    """A pipeline's rows lie side by side in one task, flat: lists of a whole pipeline cost more to make than the order itself."""
    rest = [c for c in activities.columns if c not in ("pipeline_id", "ord")]
    sorted_ = activities.repartition("pipeline_id").sortWithinPartitions("pipeline_id", "ord", *rest)
    return sorted_.mapInArrow(_positions, T.StructType([*activities.schema.fields, T.StructField("position", T.LongType())]))


def _order_large(activities: DataFrame) -> DataFrame:
    """Order by joins, in rounds that grow with the logarithm of the longest chain for each level of joins between chains.

    The activity whose run lets another one run is its decisive predecessor. Decisive predecessors form trees, and the order is by
    depth, then by place in the tree walked in input order (``_tree_places``). An activity that waits for a single other one has it
    for its decisive predecessor, so whole chains and trees are placed at once. The others are decided in turn: those whose predecessors all
    have a place, and those that would run first of their pipeline's open ones, since no later one can overtake them. Pipelines
    without open ones are done and take no part in the rounds after.
    """
    key = F.struct("pipeline_id", "ord").alias("k")
    nodes = cut_lineage(activities.select(key, "pipeline_id", "name", F.size("depends_on").alias("need"), "depends_on"))
    waits = nodes.where("need > 0").select(F.col("k").alias("child"), "pipeline_id", "need", F.explode(F.array_distinct("depends_on")).alias("name"))
    arrivals = waits.join(nodes.select(F.col("k").alias("parent"), "pipeline_id", "name"), ["pipeline_id", "name"])
    arrivals = cut_lineage(arrivals.select("child", "parent", "need"))
    known = arrivals.groupBy("child", "need").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
    roots = nodes.where("need = 0").select("k", F.lit(None).cast(nodes.schema["k"].dataType).alias("up"))
    links = cut_lineage(roots.unionByName(known.where("need = 1 and n = 1").select(F.col("child").alias("k"), F.col("parent").alias("up"))))
    open_ = cut_lineage(known.where("n >= need and not (need = 1 and n = 1)").select("child", "n"))
    lost = cut_lineage(nodes.select("k").join(links, "k", "left_anti").withColumn("up", F.col("k")))  # not decided: a pointer to itself
    done: list[DataFrame] = []
    while True:
        places = cut_lineage(_tree_places(links.unionByName(lost)))
        if open_.isEmpty():
            break
        going = cut_lineage(open_.select(F.col("child.pipeline_id").alias("_p")).distinct())
        done.append(_of_pipelines(places, going, "left_anti"))
        places, links, lost = (cut_lineage(_of_pipelines(df, going, "left_semi")) for df in (places, links, lost))
        seen = arrivals.join(open_, "child").join(places.withColumnRenamed("k", "parent"), "parent")
        seen = cut_lineage(seen.withColumn("_order", order_text(F.col("level"), F.col("place"))))
        nth = rank_in_group(seen.withColumn("_child", F.col("child").cast("string")), ["_child"], "_order", "_nth")
        ready = nth.groupBy("child", "n").agg(
            F.count(F.lit(1)).alias("_seen"), F.max(F.when(F.col("_nth") == F.col("need"), F.struct("level", "parent"))).alias("_last")
        ).where("_last is not null")
        ready = cut_lineage(ready.select("child", "n", "_seen", "_last.*"))
        first = ready.groupBy(F.col("child.pipeline_id").alias("p")).agg(F.min("level").alias("_least"))
        sure = ready.join(first, F.col("child.pipeline_id") == F.col("p")).where("_seen = n or level = _least")
        sure = cut_lineage(sure.select(F.col("child").alias("k"), F.col("parent").alias("up")))
        if sure.isEmpty():
            break
        links = cut_lineage(links.unionByName(sure))
        lost = cut_lineage(lost.join(sure.select("k"), "k", "left_anti"))
        open_ = cut_lineage(open_.join(sure.select(F.col("k").alias("child")), "child", "left_anti"))
    ranked = reduce(DataFrame.unionByName, done, places).select("k.*", order_text(F.col("level"), F.col("place")).alias("_order"))
    ranked = rank_in_group(ranked, ["pipeline_id"], "_order", "_rank")
    placed = ranked.select("pipeline_id", "ord", (F.col("_rank") - 1).cast("long").alias("position"))
    return activities.join(placed, ["pipeline_id", "ord"]).select(*activities.columns, "position")


def _of_pipelines(df: DataFrame, pipelines: DataFrame, how: str) -> DataFrame:
    return df.withColumn("_p", F.col("k.pipeline_id")).join(pipelines, "_p", how).drop("_p")


def _tree_places(links: DataFrame) -> DataFrame:
    """k, level (depth) and place (preorder number, children in the order of ``ord``) of the nodes below roots.

    ``links``: k, up (null for a root). Pointers are doubled: round r knows each node's ancestor 2**r steps up, the size of its
    subtree less than 2**r steps down, and how far it is from the root. The preorder number is the sum, on the way to the
    root, of the sizes of earlier siblings plus one, and is summed over the same pointers. Nodes on or below a cycle find no root and drop out.
    """
    state = cut_lineage(links.select("k", "up", F.lit(1).cast("long").alias("size"), F.col("up").isNotNull().cast("long").alias("level")))
    pointers, below = [state], state.where("up is not null").count()
    while below:
        state = _doubled(state)
        left = state.where("up is not null").count()
        if left == below:  # no node met its root: the rest are cycles and what hangs on them
            break
        pointers.append(state)
        below = left
    sized = state.where("up is null").select("k", "size", "level")
    siblings = links.join(sized, "k").withColumn("_parent", F.coalesce(F.col("up").cast("string"), F.col("k.pipeline_id")))
    siblings = cut_lineage(siblings.select("k", "level", "size", "_parent", F.col("up").isNull().alias("_root"), order_text(F.col("k.ord")).alias("_order")))
    weighed = running_total(siblings, ["_root", "_parent"], "_order", "size", "_before")
    place = cut_lineage(weighed.select("k", "level", (F.col("_before") + 1).alias("place")))
    for step in pointers[:-1] if len(pointers) > 1 else []:
        up = step.where("up is not null").select("k", "up")
        more = up.join(place.select(F.col("k").alias("up"), F.col("place").alias("_more")), "up").select("k", "_more")
        place = cut_lineage(place.join(more, "k", "left").select("k", "level", (F.col("place") + F.coalesce("_more", F.lit(0))).alias("place")))
    return place


def _doubled(state: DataFrame) -> DataFrame:
    """The next round of ``_tree_places``: every pointer twice as long.

    Nodes that have met their root look nothing up: their empty pointers would all be dealt to one task.
    """
    open_, met = state.where("up is not null"), state.where("up is null")
    down = open_.groupBy(F.col("up").alias("k")).agg(F.sum("size").alias("_down"))
    up = state.select(F.col("k").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
    moved = open_.join(up, "up", "left").select(
        "k", F.col("_up").alias("up"), "size", (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")
    )
    both = moved.unionByName(met).join(down, "k", "left")
    return cut_lineage(both.select("k", "up", (F.col("size") + F.coalesce("_down", F.lit(0))).alias("size"), "level"))


def notebook_positions(ordered: DataFrame) -> DataFrame:
    """First and last notebook activity of each pipeline with the count of its notebook activities.

    Only these two can take a layer from their position, so the rest of the group is never gathered.
    """
    rows = ordered.where(F.col("notebook_id") != "")
    picked = F.struct("name", "notebook_id", "position")
    ends = rows.groupBy("pipeline_ord", "pipeline_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(picked, "position").alias("_a"), F.max_by(picked, "position").alias("_z")
    )
    first = ends.select("pipeline_ord", "pipeline_id", "n", F.lit(True).alias("is_first"), "_a.*")
    last = ends.where(F.col("n") > 1).select(
        "pipeline_ord", "pipeline_id", "n", F.lit(False).alias("is_first"), "_z.*"
    )
    return first.unionByName(last)


def layer_presence(tables: DataFrame, layer: str) -> Column:
    """True when any table lies in the layer (an uncorrelated scalar subquery)."""
    hit = tables.where(F.col("layer") == layer).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()


def _named_layers(ordered: DataFrame) -> DataFrame:
    layer = text.detect_activity_layer(F.col("name"))
    return ordered.where(F.col("notebook_id") != "").select(
        "pipeline_ord", "position", "notebook_id", layer.alias("write_layer")
    ).where(F.col("write_layer").isNotNull())


def _positional_layers(ordered: DataFrame, tables: DataFrame) -> DataFrame:
    unnamed = notebook_positions(ordered).where(text.detect_activity_layer(F.col("name")).isNull())
    flags = unnamed.withColumn("_gold", layer_presence(tables, "Gold")).withColumn(
        "_silver", layer_presence(tables, "Silver")
    )
    alone = F.when(F.col("_gold") & F.col("_silver"), "Gold").when(F.col("_silver"), "Silver")
    layer = F.when(F.col("n") == 1, alone).otherwise(F.when(F.col("is_first"), "Silver").otherwise("Gold"))
    return flags.select("pipeline_ord", "position", "notebook_id", layer.alias("write_layer")).where(
        F.col("write_layer").isNotNull()
    )


def pipeline_transitions(ordered: DataFrame, tables: DataFrame) -> DataFrame:
    """Layers per notebook from its activities: the last assignment wins, the first one fixes its place.

    ``tables`` needs a ``layer`` column. Out: artifact_id, read_layer, write_layer, ins (insertion order).
    """
    given = _named_layers(ordered).unionByName(_positional_layers(ordered, tables))
    when = F.struct("pipeline_ord", "position")
    merged = given.groupBy(F.col("notebook_id").alias("artifact_id")).agg(
        F.max_by("write_layer", when).alias("write_layer"), F.min(when).alias("_first")
    )
    return merged.select(
        "artifact_id",
        text.layer_before(F.col("write_layer")).alias("read_layer"),
        "write_layer",
        _inserted(0, F.col("_first.pipeline_ord"), F.col("_first.position")).alias("ins"),
    )


def _inserted(block: int, major: Column, minor: Column) -> Column:
    return F.struct(
        F.lit(block).alias("block"), major.cast("long").alias("major"), minor.cast("long").alias("minor")
    )


def name_transition(name: Column) -> Column:
    """(read_layer, write_layer) of the first keyword group found in the name; null without a match."""
    low = F.lower(name)
    rules = []
    for words, read, write in fixed.NAME_TRANSITIONS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        rules.append(F.when(hit, F.struct(F.lit(read).alias("read_layer"), F.lit(write).alias("write_layer"))))
    return F.coalesce(*rules)


def layer_transitions(ordered: DataFrame, tables: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Layers of every notebook and dataflow that has any.

    Pipelines first; then notebook names, unless a pipeline already covers that write layer; then
    dataflow names.
    """
    ordered = cut_lineage(ordered.select("pipeline_ord", "pipeline_id", "position", "name", "notebook_id"))
    piped = cut_lineage(pipeline_transitions(ordered, tables))
    open_items = (
        artifacts.withColumn("_t", name_transition(F.col("display_name")))
        .where(F.col("_t").isNotNull())
        .join(piped.select(F.col("artifact_id").alias("id")), "id", "left_anti")
    )
    covered = piped.select("write_layer").distinct()
    books = (
        open_items.where(F.col("type") == "Notebook")
        .select(F.col("id").alias("artifact_id"), "_t.*", _inserted(1, F.col("ord"), F.lit(0)).alias("ins"))
        .join(covered, "write_layer", "left_anti")
    )
    flows = open_items.where(F.col("type").isin(fixed.DATAFLOW_TYPES)).select(
        F.col("id").alias("artifact_id"), "_t.*", _inserted(2, F.col("ord"), F.lit(0)).alias("ins")
    )
    return piped.unionByName(books).unionByName(flows)
