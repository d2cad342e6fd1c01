import io
import json
import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catloom import schemas
from catloom.operators import docs, items, profile
from catloom.sources import catalog, files, publish, store
from catloom.sources.definitions import stored_measure_deps


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, None, "2024-01-02", {"k": 1}, 0.5), (2, "a" * 300, None, None, -0.0), (3, None, "2024-01-01", None, None)],
        "id int, txt string, Updated_At string, m map<string,int>, d double",
    )
    rows = {r.col_name: r for r in profile.profile_table(df).collect()}
    assert [rows[c].ordinal for c in df.columns] == [0, 1, 2, 3, 4]
    assert rows["txt"].pct_null == Decimal("66.7") and rows["txt"].sample_value == "a" * 200
    assert rows["m"].pct_null == Decimal("66.7") and rows["m"].sample_value == '{"k":1}'
    assert rows["d"].sample_value == "0.0" and rows["id"].datatype == "int"
    assert {(r.last_updated_column, r.last_updated, r.row_count) for r in rows.values()} == {("Updated_At", "2024-01-02", 3)}
    first = {r.col_name: r.sample_value for r in profile.profile_table(df, sample="first").collect()}
    assert first["id"] in {"1", "2", "3"}


def test_profile_of_empty_and_wide_tables(spark):
    empty = profile.profile_table(spark.createDataFrame([], "a int")).first()
    assert (empty.row_count, empty.pct_null, empty.sample_value) == (0, None, None)
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(205)])
    rows = profile.profile_table(wide).orderBy("ordinal").collect()
    assert [r.col_name for r in rows] == wide.columns and {r.row_count for r in rows} == {3}


def test_update_column_follows_column_order():
    assert profile.update_column(["x", "load_date", "_updated_at"]) == "load_date"
    assert profile.update_column(["x"]) is None


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS cat")
    spark.range(3).write.mode("overwrite").saveAsTable("cat.b_tab")
    spark.range(2).selectExpr("id AS a", "'x' AS `odd name`").write.mode("overwrite").saveAsTable("cat.a_tab")
    spark.sql("CREATE OR REPLACE VIEW cat.v AS SELECT * FROM cat.b_tab WHERE id > 0")
    assert [r.table_name for r in catalog.list_tables(spark, "cat").collect()] == ["a_tab", "b_tab"]
    got = {(r.section, r.table_name, r.row_count) for r in catalog.audit(spark, "cat").collect()}
    assert got == {("tables", "a_tab", 2), ("tables", "b_tab", 3), ("tables", "v", 2), ("views", "v", None)}
    cols = [(r.table_name, r.col_name) for r in catalog.list_columns(spark, "cat").collect()]
    assert cols == [("a_tab", "a"), ("a_tab", "odd name"), ("b_tab", "id")]
    prof, problems = catalog.profile_database(spark, "cat", "lh", "Lake")
    assert problems == [] and {r.table_name: r.row_count for r in profile.to_tables(prof).collect()} == {"a_tab": 2, "b_tab": 3}
    assert profile.to_columns(prof).count() == 3


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archives_and_encodings(spark, tmp_path):
    layout = '{"sections": "é"}'
    (tmp_path / "a.zip").write_bytes(zipped({
        "Report/Layout": layout.encode("utf-16-le"), "bom.json": layout.encode("utf-8-sig"), "x/y.json": layout.encode(), "bad.json": b"\xff{", "skip.txt": b"no",
    }))
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    members = files.read_archives(spark, str(tmp_path / "*.zip"), members=r"(Layout|\.json)$")
    rows = members.select("archive", "ord", "path", "problem", files.json_in_some_encoding("content").alias("t")).collect()
    got = {r.path: r.t for r in rows if r.problem is None}
    assert got == {"Report/Layout": layout, "bom.json": layout, "x/y.json": layout, "bad.json": None}
    assert [r.archive.split("/")[-1] for r in files.archive_problems(members).collect()] == ["b.zip"]
    assert files.member_texts(members).where("path = 'bad.json'").first().content == "�{"


def test_file_listing(spark, tmp_path):
    top = tmp_path / "lh" / "Files"
    (top / "deep").mkdir(parents=True)
    (top / "deep" / "n.csv").write_text("abc")
    (top / "empty.csv").write_text("")
    nested = files.container_files(spark, str(top), "lh").collect()
    assert [(r.name, r["size"]) for r in nested] == [("lh/deep/n.csv", 3)]
    (top / "t.csv").write_text("ab")
    assert [r.name for r in files.container_files(spark, str(top), "lh").collect()] == ["lh/t.csv"]


def test_graph_tables(spark):
    assert set(store.provision(spark, "gov")) == {"objects", "relationships", "measure_deps"}
    assert store.provision(spark, "gov") == []
    node = {f.name: None for f in schemas.OBJECTS.fields}
    nodes = spark.createDataFrame([tuple({**node, "objects_id": i, "objects_type": t}.values()) for i, t in (("a", "Page"), ("b", "Table"))], schemas.OBJECTS)
    edge = {f.name: None for f in schemas.RELATIONSHIPS.fields}
    links = spark.createDataFrame([tuple({**edge, "relationships_id": "x", "relationships_type": "uses"}.values())], schemas.RELATIONSHIPS)
    store.write_graph(links, nodes, "gov")
    store.write_graph(links, nodes.where("objects_id = 'a'"), "gov")
    objects, relationships = store.read_graph(spark, "gov")
    assert [r.objects_id for r in objects.collect()] == ["a"] and relationships.count() == 1
    store.write_graph(links.limit(0), database="gov")
    assert store.read_graph(spark, "gov")[0].count() == 1 and store.read_graph(spark, "gov")[1].count() == 0
    assert store.read_measure_deps(spark, "gov").count() == 0 and store.read_measure_deps(spark, "absent").count() == 0


def test_snapshot_key_holds_the_layers(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return {"t": spark.range(len(calls))}

    every = store.snapshot_path(str(tmp_path), "My Space")
    some = store.snapshot_path(str(tmp_path), "My Space", ["Gold"])
    assert store.snapshot(spark, every, compute)["t"].count() == 1
    assert store.snapshot(spark, every, compute)["t"].count() == 1 and len(calls) == 1
    assert store.snapshot(spark, some, compute)["t"].count() == 2


def test_documents(spark, tmp_path):
    store.write_documents({"a": spark.createDataFrame([("x", "y,\n\"z\"")], "p string, q string")}, str(tmp_path))
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "a"))
    assert [tuple(r) for r in back.collect()] == [("x", 'y,\n"z"')]


def test_stored_deps(spark):
    df = spark.createDataFrame([("G", "Sales"), ("g", "SALES"), ("h", "nope")], "measure_group string, physical_table string")
    known = spark.createDataFrame([("sales",)], "known string")
    assert [tuple(r) for r in stored_measure_deps(df, known).collect()] == [("g", "sales")]


def test_items(spark):
    raw = [
        {"id": "1", "displayName": "Gold A", "type": "Warehouse", "description": "silver", "properties": {"createdBy": {"userPrincipalName": "", "displayName": "Ann"}, "modifiedDateTime": "m"}},
        {"id": "2", "displayName": "wh_governance", "type": "Warehouse", "properties": {"createdBy": "text", "lastModifiedAt": "l", "modifiedDateTime": "m"}},
        {"id": "3", "displayName": "x", "type": "Report"}, {"id": "4", "displayName": "p", "type": "DataPipeline"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raw)] + [(9, "{")], "ord int, raw string")
    arts = items.in_scope(items.normalize_items(df, "ws", "Space"))
    got = {r.id: (r.created_by, r.last_modified, r.layer, r.workspace_id) for r in arts.collect()}
    assert got == {"1": ("Ann", "m", "Silver", "ws"), "2": ("", "l", "Unknown", "ws"), "4": ("", "", "Unknown", "ws")}
    assert [r.id for r in items.documented(arts).collect()] == ["1"]
    details = spark.createDataFrame(
        [("1", json.dumps({"properties": {"sqlEndpointProperties": {"connectionString": "", "id": "e"}, "connectionString": "c", "oneLakeFilesPath": "f"}}))], "id string, detail string"
    )
    homes = {r.id: r for r in items.normalize_containers(arts, details).collect()}
    assert homes["1"].sql_endpoint.connection_string == "c" and homes["1"].sql_endpoint.endpoint_id == "e" and homes["1"].files_path == "f"
    assert homes["2"].sql_endpoint is None
    kept = items.profilable(items.normalize_containers(arts, details), " gold, SILVER")
    assert [r.id for r in kept.collect()] == ["1"]
    spaces = spark.createDataFrame([(1, "a", "X"), (2, "X", "b")], "ord int, id string, display_name string")
    assert items.find_workspace(spaces, "X").first().id == "a"


def test_dataset_containers(spark):
    details = spark.createDataFrame([
        ("d1", 1, "File", None, None), ("d1", 2, "AzureDataLakeStorage", "/only", None), ("d1", 3, "AzureDataLakeStorage", "/ws/lh1/", None), ("d1", 4, "Sql", None, "late"),
        ("d2", 1, "Sql", None, "GOLD"), ("d3", 1, "Sql", None, None), ("d4", 1, "Sql", None, "other"),
    ], "dataset_id string, ord int, datasource_type string, path string, database_name string")
    tables = spark.createDataFrame([(1, "lh1", "Lake"), (2, "lh2", "Gold")], "ord int, lh_id string, lh_name string")
    got = {r.dataset_id: r.container_id for r in items.resolve_containers(items.datasource_container(details), tables).collect()}
    assert got == {"d1": "lh1", "d2": "lh2", "d4": "other"}


def test_views_sort_and_clean(spark):
    tables = spark.createDataFrame(
        [("b", "l", "Gold"), ("a", "l", "Gold"), ("c", "k\x01", "Bronze"), ("d", "k", "Unknown"), ("e", "k", "Odd")], "table_name string, lh_name string, layer string"
    ).withColumns({"description": F.lit(""), "row_count": F.lit(1), "last_updated": F.lit(""), "source_artifact": F.lit("")})
    rows = docs.tables_view(tables).collect()
    assert [r.table_name for r in rows] == ["c", "a", "b", "d", "e"] and rows[0].lh_name == "k"


def graph_frames(spark, ids=("a", "b")):
    node = {f.name: None for f in schemas.OBJECTS.fields}
    edge = {f.name: None for f in schemas.RELATIONSHIPS.fields}
    nodes = [tuple({**node, "objects_id": i, "objects_type": "Page" if i == "a" else "Table"}.values()) for i in ids]
    links = [tuple({**edge, "relationships_id": f"x{i}", "relationships_type": "uses"}.values()) for i in ids]
    return spark.createDataFrame(nodes, schemas.OBJECTS), spark.createDataFrame(links, schemas.RELATIONSHIPS)


def seen(spark, root):
    got = store.graph_tables(spark, root).read()
    return sorted(r.objects_id for r in got["objects"].collect()), sorted(r.relationships_id for r in got["relationships"].collect())


def test_published_graph_changes_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert set(store.provision_graph(spark, root)) == {"objects", "relationships", "measure_deps"} and store.provision_graph(spark, root) == []
    assert seen(spark, root) == ([], [])
    nodes, links = graph_frames(spark)
    first = store.publish_graph(spark, root, links, nodes)
    assert first.version == 2 and seen(spark, root) == (["a", "b"], ["xa", "xb"])
    old = store.graph_tables(spark, root).read()["objects"]
    # The second table cannot be written: neither changes, and nothing of the attempt stays.
    broken = links.withColumn("relationships_id", F.raise_error(F.lit("no")).cast("string"))
    folders = publish.Files(spark, root).names(f"{root}/data")
    with pytest.raises(Exception, match="no"):
        store.publish_graph(spark, root, broken, nodes.limit(1))
    assert seen(spark, root) == (["a", "b"], ["xa", "xb"]) and publish.Files(spark, root).names(f"{root}/data") == folders
    # Edges alone: the nodes' folder stays.
    third = store.publish_graph(spark, root, links.limit(0))
    assert third.tables["objects"] == first.tables["objects"] and seen(spark, root) == (["a", "b"], [])
    # A writer that read version 2 comes too late.
    with pytest.raises(publish.Conflict):
        store.publish_graph(spark, root, links, nodes, base=first)
    assert seen(spark, root) == (["a", "b"], []) and store.graph_tables(spark, root).versions() == [1, 2, 3]
    store.publish_graph(spark, root, links, nodes.limit(0))
    assert old.count() == 2  # readers of the old version go on
    assert store.graph_tables(spark, root).read()["objects"].schema == schemas.OBJECTS
    gone = store.graph_tables(spark, root).vacuum(keep=1)
    assert len(gone) == 2 and seen(spark, root) == ([], ["xa", "xb"]) and store.graph_tables(spark, root).versions() == [4]
    assert store.graph_tables(spark, root).read()["measure_deps"].count() == 0


def test_snapshot_follows_its_inputs(spark, tmp_path):
    root, data = str(tmp_path / "snap"), str(tmp_path / "in")
    spark.range(3).write.parquet(data)
    calls = []

    def run(fail=False, refresh=False, mark=publish.file_fingerprint):
        def compute():
            calls.append(1)
            rows = spark.read.parquet(data)
            return {"n": rows.selectExpr("id + raise_error('bad') AS id") if fail else rows, "m": rows.groupBy().count()}

        key = mark(spark, data) if mark is publish.file_fingerprint else mark(spark.read.parquet(data))
        return store.snapshot(spark, root, compute, refresh, fingerprint=key)

    assert run()["n"].count() == 3 and run()["m"].first()[0] == 3 and len(calls) == 1
    spark.range(5).write.mode("append").parquet(data)
    with pytest.raises(Exception, match="bad"):
        run(fail=True)
    assert store.snapshot(spark, root, dict)["n"].count() == 3  # the failed refresh left the old one
    assert run()["n"].count() == 8 and run()["n"].count() == 8 and len(calls) == 3
    assert run(refresh=True)["n"].count() == 8 and len(calls) == 4


def test_row_fingerprint_sees_rows_not_their_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    mark = publish.row_fingerprint(df)
    assert publish.row_fingerprint(df.orderBy(F.desc("k")).repartition(3)) == mark
    for other in (df.distinct(), df.limit(0), df.fillna("x"), df.withColumnRenamed("v", "w"), df.withColumn("k", F.col("k").cast("long"))):
        assert publish.row_fingerprint(other) != mark


def test_a_damaged_table_does_not_stop_the_profile(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS damaged")
    for name in ("good", "bad", "more"):
        spark.range(4).selectExpr("id", "'x' AS v").coalesce(1).write.mode("overwrite").option("path", str(tmp_path / name)).saveAsTable(f"damaged.{name}")
    part = next((tmp_path / "bad").glob("*.parquet"))
    body = bytearray(part.read_bytes())
    body[4 : len(body) // 2] = b"\0" * (len(body) // 2 - 4)
    part.write_bytes(bytes(body))
    for crc in (tmp_path / "bad").glob(".*.crc"):
        crc.unlink()
    found, problems = catalog.profile_database(spark, "damaged", "lh", "Lake")
    assert [name for name, _ in problems] == ["bad"] and problems[0][1]
    rows = {(r.table_name, r.col_name): r for r in found.collect()}
    assert {k: r.row_count for k, r in rows.items()} == {(t, c): None if t == "bad" else 4 for t in ("good", "bad", "more") for c in ("id", "v")}
    assert rows["bad", "id"].datatype == "bigint" and rows["bad", "id"].sample_value is None
    assert {r.table_name: r.row_count for r in profile.to_tables(found).collect()} == {"good": 4, "bad": None, "more": 4}
    assert profile.profile_apart({}) == (None, [])


def test_profile_reads_only_new_files(spark, tmp_path):
    data, states = str(tmp_path / "t"), publish.TableSet(spark, str(tmp_path / "states"))

    def add(lo, hi):
        df = spark.range(lo, hi).selectExpr("id", "IF(id % 3 = 0, NULL, concat('v', id)) AS v", "map('k', id) AS m", "CAST(-0.0 AS DOUBLE) AS d", "concat('2024-', id) AS updated_at")
        df.coalesce(2).write.mode("append").parquet(data)

    def same():
        got = catalog.profile_files(spark, data, states, "t")
        want = profile.profile_table(spark.read.parquet(data))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    add(10, 40)
    same()
    first = {r.file_path: r.rows for r in states.read()["t"].collect()}
    add(1, 7)
    old = next(iter((tmp_path / "t").glob("*.parquet")))
    seen = []
    plain = catalog.file_states
    catalog.file_states = lambda df: seen.extend(df.inputFiles()) or plain(df)
    try:
        same()
        assert seen and len(seen) == len(list((tmp_path / "t").glob("*.parquet"))) - len(first)
        seen.clear()
        same()
        assert not seen  # nothing new, nothing read
        old.unlink()
        same()
        assert not seen
        spark.range(3).write.mode("overwrite").parquet(data)  # other columns: all files anew
        same()
        assert seen
    finally:
        catalog.file_states = plain


def test_hidden_names_are_listed(spark, tmp_path):
    top = tmp_path / "odd [1]" / "Files"
    (top / "_dir" / "deep").mkdir(parents=True)
    (top / "sub" / ".more").mkdir(parents=True)
    for name in ("a.csv", "_m.csv", ".h.csv", "_dir/x.csv", "_dir/deep/_y.csv", "sub/b.csv", "sub/_c.csv", "sub/.more/d.csv"):
        (top / name).write_text("abc")
    (top / "_none.csv").write_text("")
    root = str(top)
    plain = tmp_path / "plain"
    plain.mkdir()
    for name in ("a.csv", "_m.csv", ".h.csv"):
        (plain / name).write_text("abc")
    assert {r.path.split("/")[-1] for r in files.list_files(spark, str(plain)).collect()} == {"a.csv", "_m.csv", ".h.csv"}
    (plain / "z" / "_q").mkdir(parents=True)
    (plain / "z" / "_q" / "w.csv").write_text("abc")
    (plain / "z" / ".k.csv").write_text("abc")
    deep = {r.path.split("/plain/")[1] for r in files.list_files(spark, str(plain), recursive=True).collect()}
    assert deep == {"a.csv", "_m.csv", ".h.csv", "z/_q/w.csv", "z/.k.csv"}
    assert {x[0].split("/Files/")[1] for x in files._hidden_files(spark, root, True)} == {
        "_m.csv", ".h.csv", "_dir/x.csv", "_dir/deep/_y.csv", "sub/_c.csv", "sub/.more/d.csv"
    }


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    bodies = {f"d/{i:03}.json": rng.randbytes(rng.choice([0, 10, 20_000])) for i in range(120)}
    (tmp_path / "one.zip").write_bytes(zipped(bodies))
    (tmp_path / "two words.zip").write_bytes(zipped({"d/x.json": b"{}", "d/": b""}))
    torn = bytearray(zipped({"d/a.json": b"a" * 5000, "d/b.json": b"b" * 5000}))
    torn[60:90] = b"\xff" * 30  # inside the first member
    (tmp_path / "torn.zip").write_bytes(bytes(torn))
    listed = files.archive_directory(spark, str(tmp_path / "*.zip"), r"\.json$")
    sizes = {(r.archive.split("/")[-1], r.path): r["size"] for r in listed.collect()}
    assert len(sizes) == 123 and sizes["one.zip", "d/007.json"] == len(bodies["d/007.json"])
    monkeypatch.setattr(files, "READ_BYTES", 100_000)
    monkeypatch.setattr(files, "BATCH_BYTES", 30_000)
    read = files.read_archives(spark, str(tmp_path / "*.zip"), r"\.json$").withColumn("task", F.spark_partition_id())
    rows = read.collect()
    got = {r.path: bytes(r.content) for r in rows if r.archive.endswith("one.zip")}
    assert got == bodies and len({r.task for r in rows if r.archive.endswith("one.zip")}) > 3
    assert [r.ord for r in sorted((r for r in rows if r.archive.endswith("one.zip")), key=lambda r: r.path)] == list(range(120))
    other = {(r.archive.split("/")[-1], r.path): (r.content, r.problem) for r in rows if not r.archive.endswith("one.zip")}
    assert bytes(other["torn.zip", "d/b.json"][0]) == b"b" * 5000 and other["torn.zip", "d/a.json"][0] is None and other["torn.zip", "d/a.json"][1]
    assert len(other) == 3 and any(v[0] == b"{}" for v in other.values())
    assert files.archive_problems(read).count() == 1


def test_parts_and_layouts_of_archives(spark, tmp_path):
    layout = json.dumps({"sections": [{"name": "s"}]})
    (tmp_path / "a.zip").write_bytes(zipped({"F\\F.Report\\definition.pbir": b"{}", "Report/Layout": layout.encode("utf-16-le"), "x.txt": b""}))
    parts = files.archive_parts(spark, str(tmp_path / "*.zip")).collect()
    assert [(r.ord, r.path, r.content) for r in parts] == [(0, "F/F.Report/definition.pbir", "{}")]
    found = files.archive_layouts(spark, str(tmp_path / "*.zip")).collect()
    assert [(r.report_id.split("/")[-1], r.layout) for r in found] == [("a.zip", layout)]
