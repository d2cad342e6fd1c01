"""The factored graph against the literal one, on random small workspaces."""

import random

import pytest
from pyspark.sql import functions as F

from catloom.operators import edges, factored, graph, views
from tests.test_edges import ARTIFACTS, CONTAINERS, FILES, SOURCES, TABLES, TRANSITIONS

CTX = ("ws", "Space", "2024-05-06 07:08:09")
COLUMNS = [
    "relationships_id", "source_objects_id", "target_objects_id", "relationships_type", "transformation_expr", "code_reference",
    "confidence_score", "detection_method",
]


def workspace(spark, seed):
    """Containers that share names across layers, tables in several of them, writers with and without reads."""
    rng = random.Random(seed)
    names = ["ops", "Ops", "sales"]
    bronze = rng.random() < 0.7
    containers = [(1, "b1", "bronze_lh_in", "Bronze", "ws", "p1"), (2, "b2", "bronze_lh_two", "Bronze", "ws", "p2")]
    for i in range(rng.randint(2, 5)):
        containers.append((10 + i, f"c{i}", rng.choice(names), rng.choice(["Silver", "Gold"]), "ws", ""))
    containers.append((30, "s9", "silver_lh_all", "Silver", "ws", ""))
    words = ["orders", "Orders", "lines", "solo", "raw", "far"]
    tables, ord_ = [], 0
    for c in containers:
        for w in rng.sample(words, rng.randint(1, 4)) if bronze or c[3] != "Bronze" else []:
            ord_ += 1
            tables.append((ord_, c[1], w))
    artifacts = [(i, f"n{i}", rng.choice(["nb_ops_x", "nb_sales", "Maker", "all"]), "Notebook") for i in range(5)]
    reads = ["orders", "lines", "ghost", "raw", "far"]
    sources = []
    for i in range(5):
        known = rng.random() < 0.6
        sources.append((
            f"n{i}", "local_file" if known else "none", sorted(rng.sample(reads, rng.randint(0, 3))) if known else [],
            sorted(rng.sample(["orders", "solo", "far"], rng.randint(0, 1))) if known else [], (0, i),
        ))
    ins = rng.sample(range(20), 5)
    transitions = [(f"n{i}", "", rng.choice(["Gold", "Silver"]), (0, ins[i], 0)) for i in range(5)]
    files = [(1, "b1", "b1/Files/d/a.CSV", 10), (2, "b1", "plain", 5)]
    make = spark.createDataFrame
    frames = (make(containers, CONTAINERS), make(tables, TABLES), make(artifacts, ARTIFACTS), make(sources, SOURCES), make(transitions, TRANSITIONS))
    return frames, make(files, FILES)


def full_tables(frames):
    homes = frames[0].select(F.col("id").alias("lh_id"), F.col("display_name").alias("lh_name"))
    return frames[1].join(homes, "lh_id").withColumn("schema_name", F.lit("dbo"))


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def build(spark, seed):
    ctx = graph.GraphContext(*CTX)
    frames, files = workspace(spark, seed)
    reports = spark.createDataFrame([(1, "r1", "d1")], "ord long, report_id string, dataset_id string")
    homes = spark.createDataFrame([("d1", "c0")], "dataset_id string, container_id string")
    tables = full_tables(frames)
    keys = graph.table_keys(tables, reports, homes, spark.createDataFrame([], "report_id string"), ctx).cache()
    layers = [edges.gold_layer(*frames).kept(), edges.silver_layer(*frames).kept()]
    sets = edges.input_sets(frames[0], frames[1], files)
    literal = graph.derivation_edges(ctx, edges.expand_groups(layers[0]).unionByName(edges.expand_groups(layers[1])), sets, keys, frames[2])
    nodes, made = factored.factor(ctx, layers, sets, keys, frames[2])
    return ctx, tables, literal.cache(), nodes, made.cache()


@pytest.mark.parametrize("seed", range(6))
def test_expanded_rows_and_counts_equal_the_literal_ones(spark, seed):
    ctx, tables, literal, nodes, made = build(spark, seed)
    assert rows(factored.expand(ctx, made, splits=3)) == rows(literal)
    # Some inputs have a node, others (ghosts, files) have none.
    objects = graph.table_nodes(tables.withColumns({"layer": F.lit(""), "row_count": F.lit(1), "last_updated": F.lit("")}), ctx)
    got = {r.relationships_type: r.n_hidden for r in factored.hidden_edges(made, objects).collect()}
    assert got == {r.relationships_type: r.n_hidden for r in graph.hidden_edges(literal, objects).collect()}
    ids = [r.relationships_id for r in made.collect()]
    assert len(ids) == len(set(ids))
    known = {r.objects_id for r in nodes.collect()}
    used = {r.source_objects_id for r in made.where(F.col("relationships_type") == factored.COVERS).collect()}
    used |= {r.target_objects_id for r in made.where(F.col("relationships_type") == factored.MEMBER).collect()}
    assert used <= known
    spark.catalog.clearCache()


def test_rows_grow_with_tables_not_with_pairs(spark):
    sizes = {}
    for n in (10, 40):
        make = spark.createDataFrame
        containers = make([(1, "s", "silver_lh_a", "Silver", "ws", ""), (2, "g", "gold_wh_a", "Gold", "ws", "")], CONTAINERS)
        tables = make([(i, "s", f"in{i}") for i in range(n)] + [(n + i, "g", f"out{i}") for i in range(n)], TABLES)
        artifacts = make([(i, f"n{i}", f"make_a_{i}", "Notebook") for i in range(n)], ARTIFACTS)
        sources = make([(f"n{i}", "none", [], [], (0, i)) for i in range(n)], SOURCES)
        transitions = make([(f"n{i}", "Silver", "Gold", (0, i, 0)) for i in range(n)], TRANSITIONS)
        frames = containers, tables, artifacts, sources, transitions
        ctx = graph.GraphContext(*CTX)
        reports = make([], "ord long, report_id string, dataset_id string")
        keys = graph.table_keys(full_tables(frames), reports, make([], "dataset_id string, container_id string"), make([], "report_id string"), ctx)
        layer = edges.gold_layer(*frames)
        sets = edges.input_sets(containers, tables, make([], FILES))
        _, made = factored.factor(ctx, [layer], sets, keys, artifacts)
        sizes[n] = made.count()
        assert edges.count_edges(layer).first().total == n * n and layer.groups.count() == n
        assert factored.expand(ctx, made).count() == n * n
    assert sizes[10] == 2 * 10 + 1 and sizes[40] == 2 * 40 + 1


def test_chain_shows_a_set_as_one_source(spark):
    ctx, tables, literal, nodes, made = build(spark, 3)
    base = graph.table_nodes(tables.withColumns({"layer": F.lit(""), "row_count": F.lit(1), "last_updated": F.lit("")}), ctx)
    more = spark.createDataFrame([("r", "Report", "R", "ws"), ("p", "Page", "P", "r")], "objects_id string, objects_type string, item_name string, parent_objects_id string")
    objects = base.unionByName(nodes).unionByName(more, allowMissingColumns=True)
    target = made.where(F.col("relationships_type") == factored.COVERS).select("target_objects_id").distinct()
    uses = target.select(F.lit("p").alias("source_objects_id"), "target_objects_id", F.lit("uses").alias("relationships_type"))
    every = made.unionByName(uses, allowMissingColumns=True)
    feeds = factored.feeds_of_tables(every).join(target, "target_objects_id", "left_semi")
    chain = views.full_chain_factored(objects, every)
    assert chain.count() == max(feeds.count(), target.count())
    assert {r.source_notebook for r in chain.collect()} & {"all silver", "all bronze", "bronze files"} or feeds.isEmpty()
    spark.catalog.clearCache()
