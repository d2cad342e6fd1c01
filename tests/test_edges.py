from pyspark.sql import functions as F

from catloom.functions import fixed
from catloom.operators import docs, edges

CONTAINERS = "ord long, id string, display_name string, layer string, workspace_name string, files_path string"
TABLES = "ord long, lh_id string, table_name string"
ARTIFACTS = "ord long, id string, display_name string, type string"
SOURCES = "artifact_id string, source_method string, reads array<string>, writes array<string>, src_ord struct<_kind:int,ord:long>"
TRANSITIONS = "artifact_id string, read_layer string, write_layer string, ins struct<block:int,major:long,minor:long>"
FILES = "ord long, lh_id string, name string, size long"


def world(spark, bronze_tables=True):
    containers = [
        (1, "b1", "bronze_lh_in", "Bronze", "ws", "p1"), (2, "s1", "silver_lh_ops", "Silver", "ws", ""),
        (3, "g1", "gold_wh_ops", "Gold", "ws", ""), (4, "g2", "gold_", "Gold", "ws", ""),
        (5, "b2", "bronze_lh_two", "Bronze", "ws", "p2"), (6, "g3", "gold_wh_nothing", "Gold", "ws", ""),
    ]
    tables = [(1, "s1", "Orders"), (2, "s1", "lines"), (3, "s1", "solo"), (4, "g1", "Sales"), (5, "g1", "orphan"), (6, "g2", "all"), (7, "g3", "far")]
    if bronze_tables:
        tables += [(8, "b1", "orders"), (9, "b2", "raw")]
    artifacts = [
        (1, "n1", "nb_sales", "Notebook"), (2, "n2", "nb_ops_gold", "Notebook"), (3, "n3", "nb_late", "Notebook"),
        (4, "n4", "nb_silver", "Notebook"),
    ]
    sources = [
        ("n1", "local_file", ["lines", "unknown"], ["sales"], (0, 1)), ("n2", "none", [], [], (0, 2)),
        ("n3", "getDefinition", [], ["sales"], (0, 3)), ("n4", "none", [], [], (0, 4)),
        ("n5", "getDefinition", ["orders"], ["sales"], (0, 5)),
    ]
    transitions = [
        ("n2", "Silver", "Gold", (0, 1, 0)), ("x9", "Silver", "Gold", (0, 0, 5)), ("n4", "Bronze", "Silver", (0, 2, 0)),
    ]
    files = [(1, "b1", "b1/Files/d/a.CSV", 10), (2, "b1", "plain", 5)]
    make = spark.createDataFrame
    return (
        make(containers, CONTAINERS), make(tables, TABLES), make(artifacts, ARTIFACTS), make(sources, SOURCES),
        make(transitions, TRANSITIONS),
    ), make(files, FILES)


def rows(df):
    return [
        (r.output_table, r.notebook_name, r.input_set, r.input_refs, r.confidence, r.notes)
        for r in df.orderBy("out_ord", "writer_ord").collect()
    ]


def test_gold_edges(spark):
    inputs, _ = world(spark)
    got = rows(edges.gold_edges(*inputs))
    all_silver = (edges.ALL_SILVER, None, fixed.INFERRED, fixed.NOTE_ALL_SILVER)
    assert got == [
        ("Sales", "nb_sales", None, ["lines"], fixed.PARSED, fixed.NOTE_PARSED + "local_file"),
        # n3 has no reads: from here on the changed verdict stays, also for n5 which has reads.
        ("Sales", "nb_late", *all_silver),
        ("Sales", "n5", None, ["orders"], fixed.INFERRED, fixed.NOTE_ALL_SILVER),
        ("orphan", "nb_ops_gold", *all_silver),
        # An empty domain matches every writer; insertion order puts x9 first.
        ("all", "x9", *all_silver), ("all", "nb_ops_gold", *all_silver),
        # No writer holds the domain: the first gold writer is taken.
        ("far", "x9", *all_silver),
    ]


def test_silver_edges_with_bronze_tables(spark):
    inputs, _ = world(spark)
    got = rows(edges.silver_edges(*inputs))
    assert got == [
        ("Orders", "nb_silver", None, ["orders"], fixed.INFERRED, fixed.NOTE_SAME_NAME),
        ("lines", "nb_silver", edges.ALL_BRONZE, None, fixed.NEEDS_REVIEW, fixed.NOTE_ALL_BRONZE),
        ("solo", "nb_silver", edges.ALL_BRONZE, None, fixed.NEEDS_REVIEW, fixed.NOTE_ALL_BRONZE),
    ]


def test_silver_edges_without_bronze_tables_use_files(spark):
    inputs, files = world(spark, bronze_tables=False)
    found = edges.silver_edges(*inputs)
    assert {(r[2], r[4], r[5]) for r in rows(found)} == {(edges.BRONZE_FILES, fixed.INFERRED, fixed.NOTE_FILES)}
    sets = edges.input_sets(inputs[0], inputs[1], files)
    refs = [r.ref for r in sets.where(F.col("input_set") == edges.BRONZE_FILES).orderBy("ref_ord").collect()]
    assert refs == ["bronze_lh_in/Files/d/a.CSV", "bronze_lh_in/plain", "bronze_lh_two/Files/ (file source)"]


def test_expanded_inputs(spark):
    inputs, files = world(spark)
    sets = edges.input_sets(inputs[0], inputs[1], files)
    wide = edges.expand_inputs(edges.gold_edges(*inputs), sets, splits=3)
    got = {}
    for r in wide.orderBy("ref_ord").collect():
        got.setdefault((r.output_table, r.notebook_name), []).append(r.ref)
    assert got["Sales", "nb_late"] == ["orders", "lines", "solo"]
    assert got["Sales", "nb_sales"] == ["lines"] and len(got) == 7


def test_rows_of_an_edge_lie_in_one_task(spark):
    inputs, files = world(spark)
    sets = edges.input_sets(inputs[0], inputs[1], files)
    wide = edges.expand_inputs(edges.gold_edges(*inputs), sets.withColumn("of_set", F.lit(True)), splits=16)
    rows_ = wide.select("output_table", "notebook_name", "ref", "of_set", F.spark_partition_id().alias("task")).collect()
    shared = [r for r in rows_ if r.of_set]
    assert len({(r.output_table, r.notebook_name, r.task) for r in shared}) == len({(r.output_table, r.notebook_name) for r in shared})
    assert len(shared) == 3 * len({(r.output_table, r.notebook_name) for r in shared})
    assert {(r.ref, r.of_set) for r in rows_ if r.notebook_name == "nb_sales"} == {("lines", None)}


def test_input_spans_with_numbered_names(spark):
    from checks.lineage_queries import _input_spans

    row = "block string, output_lh string, output_table string, notebook_name string, input_set string, input_refs array<string>"
    rows_ = [("g", "l", "t", "n", "s", None), ("g", "l", "t", "n", None, ["b", "zz"]), ("g", "l", "u", None, "s", None), ("g", "l", "v", "n", None, [])]
    sets = spark.createDataFrame(
        [("s", "Z", (0, 0)), ("s", "\u00e9", (0, 1)), ("s", "c", (0, 2)), ("s", "c", (0, 3)), ("s", None, (0, 4))],
        "input_set string, ref string, ref_ord struct<a:long,b:long>",
    )
    found = _input_spans(spark.createDataFrame(rows_, row), sets)
    got = {(r.output_table, r.notebook_name): (r.n_inputs, r.first_ref, r.last_ref) for r in found.collect()}
    assert got == {("t", "n"): (7, "Z", "\u00e9"), ("u", None): (5, "Z", "\u00e9")}


def test_backfill_takes_the_last_edge(spark):
    inputs, _ = world(spark)
    layers = edges.gold_layer(*inputs), edges.silver_layer(*inputs)
    tables = inputs[1].withColumn("source_artifact", F.lit("old"))
    got = {r.table_name: r.source_artifact for r in edges.fill_source_artifact(tables, *layers).collect()}
    assert got == {
        "Orders": "nb_silver", "orders": "nb_silver", "lines": "nb_silver", "solo": "nb_silver", "Sales": "n5",
        "orphan": "nb_ops_gold", "all": "nb_ops_gold", "far": "x9", "raw": "",
    }


def test_data_sources_and_stub(spark):
    inputs, files = world(spark)
    got = [tuple(r)[1:4] for r in edges.data_sources(inputs[0], files).orderBy("row_ord").select("row_ord", "source_name", "connection_path", "notes").collect()]
    host = fixed.FILE_HOST
    assert got == [
        ("a.CSV", f"{host}/ws/bronze_lh_in/Files/Files/d/a.CSV", "Discovered via OneLake blob listing (10 bytes)"),
        ("plain", f"{host}/ws/bronze_lh_in/Files/plain", "Discovered via OneLake blob listing (5 bytes)"),
        ("bronze_lh_two (files)", "p2", fixed.STUB_NOTE),
    ]


def test_name_pieces_are_all_substrings_of_the_lengths(spark):
    df = spark.createDataFrame([("k", "aBca"), ("e", "")], "k string, n string")
    lengths = F.array(*[F.lit(n) for n in (0, 1, 3, 4, 9)])
    got = [(r.k, r.piece) for r in edges.name_pieces(df, "k", "n", lengths).distinct().collect()]
    word = "abca"
    want = {("k", word[i : i + n]) for n in (0, 1, 3, 4) for i in range(5 - n)} | {("e", "")}
    assert set(got) == want and len(got) == len(want)


def test_lineage_view_zips_blocks(spark):
    inputs, _ = world(spark)
    every = edges.gold_edges(*inputs).unionByName(edges.silver_edges(*inputs))
    got = docs.lineage_view(every).orderBy("row_no").collect()
    assert [(r.row_no, r.gold_table, r.silver_table) for r in got][:4] == [
        (1, "Sales", "Orders"), (2, "Sales", "lines"), (3, "Sales", "solo"), (4, "orphan", None)
    ]
    assert got[0].notes == f"G→S: PARSED — {fixed.NOTE_PARSED}local_file\nS→B: INFERRED — {fixed.NOTE_SAME_NAME}"
    lines = docs.lineage_lines(every).orderBy("block", "out_ord", "writer_ord").first().line
    assert lines == f"  [PARSED] Sales (gold_wh_ops)\n       <- nb_sales\n       <- lines\n       note: {fixed.NOTE_PARSED}local_file"


def test_groups_hold_one_row_per_writer(spark):
    inputs, _ = world(spark)
    gold, silver = edges.gold_layer(*inputs), edges.silver_layer(*inputs)
    assert sorted((r.lh_id, r.notebook_name) for r in gold.groups.collect()) == [("g1", "nb_ops_gold"), ("g2", "nb_ops_gold"), ("g2", "x9"), ("g3", "x9")]
    assert sorted((r.lh_id, r.namesake, r.own_name, r.input_set) for r in silver.groups.collect()) == [("s1", False, False, edges.ALL_BRONZE), ("s1", True, True, None)]
    for layer in (gold, silver):
        assert edges.count_edges(layer).first().total == edges.expand_groups(layer).count()


def test_lineage_with_member_texts(spark, monkeypatch):
    inputs, files = world(spark)
    sets = edges.input_sets(inputs[0], inputs[1], files)
    for piece in (1, 2, 10_000):
        monkeypatch.setattr(edges, "SET_PIECE", piece)
        texts = {r.input_set: r.set_text for r in edges.set_texts(sets).collect()}
        assert texts == {
            edges.ALL_SILVER: "orders, lines, solo", edges.ALL_BRONZE: "orders, raw",
            edges.BRONZE_FILES: "bronze_lh_in/Files/d/a.CSV, bronze_lh_in/plain, bronze_lh_two/Files/ (file source)",
        }
    every = edges.gold_edges(*inputs)
    got = {(r.gold_table, r.gold_writer): r.gold_inputs for r in docs.lineage_view(every, edges.set_texts(sets)).collect()}
    assert got["far", "x9"] == got["Sales", "nb_late"] == "orders, lines, solo" and got["Sales", "nb_sales"] == "lines"
    lines = [r.line for r in docs.lineage_lines(every, edges.set_texts(sets)).collect()]
    assert sum("<- orders, lines, solo\n" in x for x in lines) == 5 and not any("(all silver)" in x for x in lines)
