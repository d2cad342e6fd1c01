import random

from pyspark.sql import functions as F

from catloom.operators import activities as A

SCHEMA = "pipeline_ord long, pipeline_id string, ord long, name string, notebook_id string, depends_on array<string>"


def brute_force(rows):
    """Rescan all rows after each step; follow the definition of first-in-first-out order."""
    out = {}
    for pid in {r[1] for r in rows}:
        acts = [r for r in rows if r[1] == pid]
        left = {a[3]: len(a[5]) for a in acts}
        queue = [a for a in acts if left[a[3]] == 0]
        place = 0
        while queue:
            node, queue = queue[0], queue[1:]
            out[pid, node[2]] = place
            place += 1
            for a in acts:
                if node[3] in a[5]:
                    left[a[3]] -= 1
                    if left[a[3]] == 0:
                        queue.append(a)
    return out


def random_rows(seed, pipelines, size):
    rng = random.Random(seed)
    rows = []
    for p in range(pipelines):
        names = [f"a{i}" for i in range(rng.randint(1, size))]
        for i, name in enumerate(names):
            waits = [rng.choice(names + ["ghost"]) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]
            if rng.random() < 0.7:
                waits = list(dict.fromkeys(w for w in waits if w in names[:i]))
            rows.append((p, f"p{p}", i, name, f"n{i}", waits))
    return rows


def test_order_equals_brute_force_small_and_large(spark):
    rows = random_rows(7, 25, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_force(rows)
    small = {(r.pipeline_id, r.ord): r.position for r in A.run_order(df).collect()}
    assert small == want
    large = A.run_order(df, group_rows=4)
    assert {(r.pipeline_id, r.ord): r.position for r in large.collect()} == want
    assert A.never_run(df, large).count() == len(rows) - len(want)


def test_cycle_unknown_and_repeated_parents_never_run(spark):
    rows = [
        (0, "p", 0, "a", "", []), (0, "p", 1, "b", "", ["c"]), (0, "p", 2, "c", "", ["b"]),
        (0, "p", 3, "d", "", ["zzz"]), (0, "p", 4, "e", "", ["a", "a"]), (0, "p", 5, "f", "", ["a"]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (100, 2):
        assert {r.name: r.position for r in A.run_order(df, limit).collect()} == {"a": 0, "f": 1}


def test_repeated_names_give_one_order_at_every_size(spark):
    rows = [
        (0, "p", 0, "a", "", []), (0, "p", 1, "a", "", []), (0, "p", 2, "b", "", ["a"]), (0, "p", 3, "c", "", ["b"]),
        (0, "p", 4, "d", "", ["a", "a"]), (0, "p", 5, "e", "", ["c", "a"]), (0, "p", 6, "f", "", ["b", "ghost"]),
        (0, "p", 7, "a", "", ["c"]), (0, "p", 8, "g", "", ["d", "b", "a"]), (1, "q", 0, "x", "", ["x"]),
    ]
    rng = random.Random(3)
    for p in range(12):
        names = [rng.choice("abcde") for _ in range(rng.randint(3, 9))]
        rows += [(2 + p, f"r{p}", i, n, "", [rng.choice(names) for _ in range(rng.choice([0, 0, 1, 2]))]) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, SCHEMA)
    small, large = ({(r.pipeline_id, r.ord): r.position for r in A.run_order(df, limit).collect()} for limit in (100, 2))
    assert small == large
    assert [small["p", i] for i in range(6)] == [0, 1, 2, 5, 3, 4] and ("p", 6) not in small


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n = 20_000
    rows = [(0, "p", i, f"a{i}", "", [f"a{i - 1}"] if i else []) for i in range(n)]
    # Two shorter chains beside it, one joined to the long one, and a cycle.
    rows += [(0, "p", n + i, f"b{i}", "", [f"b{i - 1}"] if i else []) for i in range(50)]
    rows += [(0, "p", 2 * n, "join", "", ["a30", "b30"]), (0, "p", 2 * n + 1, "x", "", ["y"]), (0, "p", 2 * n + 2, "y", "", ["x"])]
    rounds, plain = [], A._doubled
    monkeypatch.setattr(A, "_doubled", lambda state: rounds.append(1) or plain(state))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.name: r.position for r in A.run_order(df, group_rows=100).collect()}
    assert len(got) == len(rows) - 2 and not {"x", "y"} & set(got)
    assert len(rounds) < 40
    # a0 b0 a1 b1 ... ; the join follows b30 at the next level, after a31 and b31.
    assert [got[f"a{i}"] for i in range(30)] == [2 * i for i in range(30)] and got["b30"] == 61
    assert (got["a31"], got["b31"], got["join"], got["a32"]) == (62, 63, 64, 65)
    assert got["a50"] == 51 + 50 + 1 - 1 and got["a19999"] == len(rows) - 3


def transitions(spark, rows, layers, artifacts):
    df = spark.createDataFrame(rows, SCHEMA)
    tables = spark.createDataFrame([(x,) for x in layers], "layer string")
    arts = spark.createDataFrame(artifacts, "ord long, id string, display_name string, type string")
    out = A.layer_transitions(A.run_order(df), tables, arts)
    return {r.artifact_id: (r.read_layer, r.write_layer) for r in out.collect()}


def test_positions_and_names(spark):
    rows = [
        (1, "one", 0, "x", "n_one", []),
        (2, "two", 0, "x", "n_a", []), (2, "two", 1, "y", "n_b", ["x"]),
        (3, "three", 0, "x", "n_c", []), (3, "three", 1, "y", "n_d", ["x"]), (3, "three", 2, "z", "n_e", ["y"]),
        (3, "three", 3, "no notebook", "", ["z"]),
        (4, "named", 0, "Load Bronze", "n_f", []), (4, "named", 1, "silver_to_gold", "n_g", []),
        (5, "again", 0, "to silver", "n_g", []),
    ]
    got = transitions(spark, rows, ["Gold", "Silver"], [(1, "q", "q", "Notebook")])
    assert got == {
        "n_one": ("Silver", "Gold"), "n_a": ("Bronze", "Silver"), "n_b": ("Silver", "Gold"),
        "n_c": ("Bronze", "Silver"), "n_e": ("Silver", "Gold"),
        "n_f": ("External", "Bronze"), "n_g": ("Bronze", "Silver"),
    }


def test_single_activity_depends_on_layers(spark):
    rows = [(1, "one", 0, "x", "n", [])]
    arts = [(1, "q", "q", "Notebook")]
    assert transitions(spark, rows, ["Silver"], arts) == {"n": ("Bronze", "Silver")}
    assert transitions(spark, rows, ["Gold"], arts) == {}


def test_name_rule_yields_to_covered_layer_for_notebooks_only(spark):
    rows = [(1, "p", 0, "make gold", "n1", [])]
    arts = [
        (1, "n1", "bronze_to_silver_x", "Notebook"), (2, "n2", "silver_to_gold", "Notebook"),
        (3, "n3", "bronze2silver", "Notebook"), (4, "d1", "silver2gold", "DataflowGen2"), (5, "d2", "plain", "Dataflow"),
    ]
    assert transitions(spark, rows, ["Gold", "Silver"], arts) == {
        "n1": ("Silver", "Gold"), "n3": ("Bronze", "Silver"), "d1": ("Silver", "Gold"),
    }


def test_pipeline_over_several_batches_and_no_list_of_a_pipeline(spark, capsys):
    rows = random_rows(11, 12, 9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        ordered = A.run_order(spark.createDataFrame(rows, SCHEMA))
        assert {(r.pipeline_id, r.ord): r.position for r in ordered.collect()} == brute_force(rows)
        ordered.explain()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in capsys.readouterr().out


def test_nodes_that_met_their_root_look_nothing_up(spark, monkeypatch):
    """Their empty pointers would share one task: no row without a pointer may enter the lookup of the next round."""
    made = []
    monkeypatch.setattr(A, "cut_lineage", lambda df: made.append(df) or df)
    state = spark.range(8).selectExpr("struct('p' as pipeline_id, id as ord) as k", "if(id = 0, null, struct('p' as pipeline_id, id div 2 as ord)) as up", "1L as size", "if(id = 0, 0L, 1L) as level").localCheckpoint()
    out = {r.k.ord: (r.up and r.up.ord, r.size, r.level) for r in A._doubled(state).collect()}
    assert out == {0: (None, 2, 0), 1: (None, 3, 1), 2: (0, 3, 2), 3: (0, 3, 2), 4: (1, 1, 2), 5: (1, 1, 2), 6: (1, 1, 2), 7: (1, 1, 2)}
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter, (up"):].split("\n")[1:3]
    assert any("isnotnull(" in line for line in left), plan


def test_pipelines_without_open_activities_leave_the_rounds(spark, monkeypatch):
    rows = [(0, "p", i, f"a{i}", "", w) for i, w in enumerate([[], ["a0"], ["a0"], ["a1", "a2"], ["a3"]])]
    rows += [(1, "q", i, f"a{i}", "", [f"a{i - 1}"] if i else []) for i in range(4)]
    seen, places = [], A._tree_places
    monkeypatch.setattr(A, "_tree_places", lambda links: seen.append({r.p for r in links.select("k.pipeline_id").distinct().toDF("p").collect()}) or places(links))
    got = {(r.pipeline_id, r.ord): r.position for r in A.run_order(spark.createDataFrame(rows, SCHEMA), group_rows=2).collect()}
    assert got == brute_force(rows)
    assert seen == [{"p", "q"}, {"p"}]
