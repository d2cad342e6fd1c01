import hashlib
import json

from pyspark.sql import functions as F

from catloom.functions import fixed, ids, text
from catloom.functions.ranking import keep_first, keep_last, order_text, rank_in_group


def values(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


def test_clean_ref(spark):
    got = values(spark, [' "silver.dbo.T1" ', "`Plain`", "a.b.C", "/mnt/a.parquet", " x.Y "], text.clean_ref(F.col("x")))
    assert got == ["t1", "plain", "c", "parquet", "y"]


def test_layer_detectors_disagree(spark):
    names = ["bronze_to_silver", "silver_to_gold", "other"]
    assert values(spark, names, text.detect_item_layer(F.col("x"), F.lit(""))) == ["Bronze", "Silver", "Unknown"]
    assert values(spark, names, text.detect_activity_layer(F.col("x"))) == ["Silver", "Gold", None]


def test_title_case_matches_python(spark):
    words = ["e15_a", "custom visual", "ABC def", "x1y2", "it's", "Éa éB", ""]
    assert values(spark, words, text.title_case(F.col("x"))) == [w.title() for w in words]


def test_visual_display_name(spark):
    names = ["tableEx", "customVisual", "kpi", "myChart15"]
    assert values(spark, names, text.visual_display_name(F.col("x"))) == ["Table", "Custom Visual", "KPI", "My Chart15"]


def test_domains(spark):
    got = values(spark, ["gold_wh_Sales_warehouse", "Gold_X", "gold_wh"], text.container_domain(F.col("x"), "Gold"))
    assert got == ["sales", "x", "wh"]
    assert values(spark, ["silver_lh_Ops", "silver_"], text.container_domain(F.col("x"), "Silver")) == ["ops", ""]


def test_paths(spark):
    got = spark.createDataFrame([("lh/Files/a/b.CSV",), ("plain",)], "x string").select(
        text.after_first_slash(F.col("x")), text.base_name(F.col("x")), text.file_extension(F.col("x"))
    ).collect()
    assert [tuple(r) for r in got] == [("Files/a/b.CSV", "b.CSV", "csv"), ("plain", "plain", "")]


def test_control_characters_and_file_name(spark):
    assert values(spark, ["a\x00b\tc\x1fd\n"], text.printable(F.col("x"))) == ["ab\tcd\n"]
    assert values(spark, ["My Space/R&D"], text.safe_file_name(F.col("x"))) == ["My_Space_R&D"]


def test_hash_id_equals_hashlib(spark):
    got = values(spark, ["é", ""], ids.hash_id("ws", F.col("x")))
    assert got == [hashlib.sha256(f"ws|{v}".encode()).hexdigest() for v in ["é", ""]]


def test_json_object_equals_json_dumps(spark):
    rows = ['say "hi"\\', "tab\tnew\nline", "é😀", None, "x[1]"]
    got = values(spark, rows, ids.json_object(a=ids.json_text(F.col("x")), n=ids.json_number(F.lit(3))))
    assert got == [json.dumps({"a": v, "n": 3}) for v in rows]


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in keep_first(df, ["k"], F.col("o")).collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v) for r in keep_last(df, ["k"], F.col("o")).collect()} == {("a", "y"), ("b", "z")}


def test_rank_of_hot_groups_equals_plain_rank(spark):
    rows = [("hot", f"pre/{i * 7919 % 100003:06d}") for i in range(3000)] + [("b", "x2"), ("b", "x1")]
    rows += [("words", w) for w in ("", "a", "ab", "b", "é", "z", "ze")]
    df = spark.createDataFrame(rows, "k string, o string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges also for few rows
    try:
        ranked = rank_in_group(df, ["k"], "o", "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for key in {"hot", "b", "words"}:
        for i, value in enumerate(sorted(v for k, v in rows if k == key), 1):
            want[key, value] = i
    assert {(r.k, r.o): r.n for r in ranked} == want


def test_order_text_sorts_like_numbers(spark):
    nums = [0, 5, 10, 99, 100, 10**18]
    keys = values(spark, nums, order_text(F.col("x")), "x long")
    assert keys == sorted(keys)


def test_twentynine_visual_names():
    assert len(fixed.VISUAL_NAMES) == 29 and len(fixed.TIMESTAMP_COLUMNS) == 11
