"""Disk of steps that are written: no shuffle files stay behind them, and kept frames can be let go."""

import hashlib
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from catloom.functions import ranking
from catloom.operators import factored, graph, reports, views
from catloom.session import cut_lineage, release


def _shuffle_blocks(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(str(blocks.apply(i)).startswith("shuffle_") for i in range(blocks.size()))


def test_shuffles_of_a_kept_frame_are_deleted(spark):
    before = _shuffle_blocks(spark)
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    ends = time.time() + 10
    while _shuffle_blocks(spark) > before and time.time() < ends:
        time.sleep(0.1)
    assert _shuffle_blocks(spark) <= before
    assert kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_release_deletes_only_that_frame(spark):
    first, second = (cut_lineage(spark.range(n)) for n in (3, 5))
    folder = os.path.dirname(first.inputFiles()[0].removeprefix("file://"))
    release(first)
    assert not os.path.exists(folder)
    assert second.count() == 5


@pytest.mark.parametrize("buckets", [1, 65_536])
def test_ranks_are_the_same_whatever_shares_a_hash(spark, monkeypatch, buckets):
    monkeypatch.setattr(ranking, "COUNT_BUCKETS", buckets)
    monkeypatch.setattr(ranking, "WINDOW_ROWS", 4)
    rows = [("a", "x", f"{i:02d}") for i in range(9)] + [("a", "y", f"{i}") for i in range(3)] + [("b", None, "0")]
    df = spark.createDataFrame(rows, "k string, l string, o string")
    for deal in (None, ["k"]):
        ranked = ranking.rank_in_group(df, ["k", "l"], "o", "n", deal=deal)
        assert sorted(ranked.collect()) == sorted([("a", "x", f"{i:02d}", i + 1) for i in range(9)] + [("a", "y", f"{i}", i + 1) for i in range(3)])


def test_tables_of_visuals_need_nothing_they_were_found_by(spark):
    facts = cut_lineage(spark.createDataFrame(
        [("r", "p", f"v{i}", "card", None, ["T_1", f"t_{i}"]) for i in range(3)] * 2,
        "report_id string, page_id string, path string, visual_type string, title string, entities array<string>",
    ))
    resolution = cut_lineage(spark.createDataFrame([("t_1", "t_1"), ("t_2", "x")], "entity string, physical_table string"))
    found = reports.visual_tables(reports.named_visuals(facts), resolution)
    for kept in (facts, resolution):
        release(kept)
    rows = sorted((r.path, r.visual_name, r.physical_table) for r in found.collect())
    # Each row is numbered, so a path that is listed twice makes two names.
    names = {("v0", 1), ("v0", 2), ("v1", 3), ("v1", 4), ("v2", 5), ("v2", 6)}
    shown = {(p, "Card" if n == 1 else f"Card ({n})") for p, n in names}
    assert rows == sorted([(p, v, "t_1") for p, v in shown] + [(p, v, "x") for p, v in shown if p == "v2"])


def test_usage_edges_are_made_distinct_before_their_ids(spark):
    columns = "report_id string, page_id string, visual_name string, visual_type string, physical_table string"
    shown = spark.createDataFrame([("r", "p", "v", "card", "t"), ("r", "p", "v", "card", "t"), ("r", "p", None, "card", "t"), ("r", "p", "", "card", "t"), ("r", "p", "w", "card", "u")], columns)
    pages = spark.createDataFrame([("r", "p")], "report_id string, page_id string")
    keys = spark.createDataFrame([("lh", "t", 1, "id-t")], "lh_key string, tname string, entry int, object_id string")
    found = graph.usage_edges(graph.GraphContext("ws", "fx", "2024-01-01 00:00:00"), shown, pages, keys)
    page = hashlib.sha256(b"r|p").hexdigest()
    ids = [page, *(hashlib.sha256(f"{page}|{v}|card".encode()).hexdigest() for v in ("v", ""))]
    assert sorted((r.source_objects_id, r.target_objects_id) for r in found.collect()) == sorted((i, "id-t") for i in ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*source#", plan)  # such a shuffle held two ids of 64 characters a row


def test_literal_lineage_passes_no_shuffle_when_its_ends_are_known(spark):
    objects = spark.createDataFrame(
        [("a", "A", "Table", "Bronze"), ("b", "B", "Table", "Silver"), ("b", "B2", "Table", None), ("p", "P", "Page", None), (None, "N", "Table", "Gold")],
        "objects_id string, item_name string, objects_type string, layer string",
    )
    edges = spark.createDataFrame(
        [("a", "b", "derives_from"), ("a", "b", "derives_from"), ("lost", "b", "derives_from"), (None, "b", "derives_from"), ("p", "b", "uses"), ("a", "b", None)],
        "source_objects_id string, target_objects_id string, relationships_type string",
    ).selectExpr("*", "CAST(0.5 AS DECIMAL(5,4)) AS confidence_score", "'m' AS detection_method", "CAST(NULL AS STRING) AS transformation_expr")
    ends = factored.feed_ends(edges)
    assert {r.objects_id for r in ends.collect()} == {"a", "b", "lost", None}
    rows = [sorted(map(str, views.lineage(objects, edges, ends=e).collect())) for e in (None, ends)]
    assert rows[0] == rows[1] and len(rows[0]) == 8
    feeds = views.lineage(objects, edges.where("relationships_type = 'derives_from'"), ordered=False, ends=ends)
    plan = feeds._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2


def test_ends_that_are_too_many_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(factored, "SEND_ENDS", 1)
    edges = spark.createDataFrame([("a", "b", "member_of"), ("c", "d", "uses")], "source_objects_id string, target_objects_id string, relationships_type string")
    assert factored.feed_ends(edges) is None
