"""Governance queries and profiles: Spark form and SQL form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catloom.operators import profile, views
from catloom.session import checkpoint_folder
from catloom.sources import files, publish, store
from checks.compose import STEPS, with_fixtures
from checks.fixtures import RAW_TABLES, fixture, table


def _graph(spark, d, prefix="fx"):
    return fixture(spark, d, f"{prefix}_objects"), fixture(spark, d, f"{prefix}_relationships")


QUERIES = {
    "g1_type_counts": lambda s, d: views.type_counts(fixture(s, d, "fx_objects")),
    "g2_report_page_rollup": lambda s, d: views.report_page_rollup(fixture(s, d, "fx_paged_objects")),
    "g3_page_tables": lambda s, d: views.page_tables(fixture(s, d, "fx_paged_objects")),
    "g4_unconnected_tables": lambda s, d: views.unconnected_tables(fixture(s, d, "fx_objects")),
    "g5_lineage": lambda s, d: views.lineage(*_graph(s, d)),
    "g6_full_chain": lambda s, d: views.full_chain(*_graph(s, d, "fx_paged")),
    "g2e_report_page_rollup": lambda s, d: views.report_page_rollup_by_use(*_graph(s, d)),
    "g3e_page_tables": lambda s, d: views.page_tables_by_use(*_graph(s, d)),
    "g4e_unused_tables": lambda s, d: views.unused_tables(*_graph(s, d)),
    "g6e_full_chain": lambda s, d: views.full_chain_by_use(*_graph(s, d)),
}

def _graph_steps(p: str) -> dict[str, str]:
    """Typed nodes and edges of the graph with table prefix ``p``."""
    return {
        f"st_{p}_report_nodes": f"SELECT objects_id AS report_id, item_name AS report FROM {p}_objects WHERE objects_type = 'Report'",
        f"st_{p}_page_nodes": f"""
SELECT n.objects_id AS page_id, n.item_name AS page, report FROM st_{p}_report_nodes
INNER JOIN {p}_objects n ON (n.parent_objects_id, n.objects_type) = (report_id, 'Page')""",
        f"st_{p}_table_nodes": f"""
SELECT objects_id AS table_id, parent_objects_id AS home_id, item_name AS table_name, layer, properties_json ->> '$.row_count' AS row_count
FROM {p}_objects WHERE objects_type = 'Table'""",
        f"st_{p}_names": f"SELECT objects_id AS id, item_name AS name, objects_type AS kind, layer AS tier FROM {p}_objects",
        f"st_{p}_use": f"""
SELECT source_objects_id AS page_id, target_objects_id AS table_id FROM {p}_relationships WHERE relationships_type = 'uses'""",
        f"st_{p}_feed": f"""
SELECT target_objects_id AS table_id, name AS source_notebook, confidence_score, detection_method
FROM (FROM {p}_relationships WHERE relationships_type = 'derives_from') LEFT JOIN st_{p}_names ON id = source_objects_id""",
    }


STEPS |= _graph_steps("fx") | _graph_steps("fx_paged")

_HOMES = "SELECT id AS home_id, name AS artifact FROM st_fx_names WHERE kind = 'Lakehouse' OR kind = 'Warehouse'"

ORACLES = {
    "g1_type_counts": with_fixtures("SELECT kind AS objects_type, count(id) AS total FROM st_fx_names GROUP BY kind"),
    "g2_report_page_rollup": with_fixtures("""
SELECT report, page, CAST(sum(coalesce(held, 0)) AS BIGINT) AS table_count
FROM st_fx_paged_page_nodes LEFT JOIN (SELECT home_id AS page_id, count(*) AS held FROM st_fx_paged_table_nodes GROUP BY home_id) USING (page_id)
GROUP BY ALL"""),
    "g3_page_tables": with_fixtures(
        "SELECT report, page, table_name, layer, row_count FROM st_fx_paged_page_nodes, st_fx_paged_table_nodes WHERE page_id = home_id"
    ),
    "g4_unconnected_tables": with_fixtures(f"SELECT artifact, table_name, layer FROM ({_HOMES}) JOIN st_fx_table_nodes USING (home_id)"),
    "g5_lineage": with_fixtures("""
SELECT a.name AS source, a.kind AS source_type, relationships_type, b.name AS target, b.tier AS target_layer,
       confidence_score, detection_method, transformation_expr
FROM st_fx_names a, st_fx_names b, fx_relationships WHERE (a.id, b.id) = (source_objects_id, target_objects_id)"""),
    "g6_full_chain": with_fixtures("""
SELECT report, page, table_name, layer, source_notebook, confidence_score, detection_method
FROM (SELECT * FROM st_fx_paged_page_nodes, st_fx_paged_table_nodes WHERE page_id = home_id) LEFT JOIN st_fx_paged_feed USING (table_id)"""),
    "g2e_report_page_rollup": with_fixtures("""
SELECT report, page, CAST(sum(coalesce(held, 0)) AS BIGINT) AS table_count
FROM st_fx_page_nodes LEFT JOIN (
  SELECT page_id, count(*) AS held FROM st_fx_use WHERE table_id IN (SELECT table_id FROM st_fx_table_nodes) GROUP BY page_id) USING (page_id)
GROUP BY ALL"""),
    "g3e_page_tables": with_fixtures("""
SELECT report, page, table_name, layer, row_count FROM st_fx_table_nodes JOIN st_fx_use USING (table_id) JOIN st_fx_page_nodes USING (page_id)"""),
    "g4e_unused_tables": with_fixtures(f"""
SELECT artifact, table_name, layer FROM (FROM st_fx_table_nodes ANTI JOIN st_fx_use USING (table_id)) JOIN ({_HOMES}) USING (home_id)"""),
    "g6e_full_chain": with_fixtures("""
SELECT report, page, table_name, layer, source_notebook, confidence_score, detection_method
FROM (FROM st_fx_page_nodes JOIN st_fx_use USING (page_id) JOIN st_fx_table_nodes USING (table_id)) LEFT JOIN st_fx_feed USING (table_id)"""),
}

# Published graphs and snapshots -------------------------------------------


def _published(s, d):
    """The graph as read back: nodes first without edges, then the edges alone, then a writer that came too late."""
    nodes, edges = _graph(s, d)
    root = f"{checkpoint_folder(s)}/published-{uuid.uuid4().hex}"
    store.provision_graph(s, root)
    first = store.publish_graph(s, root, edges.limit(0), nodes)
    store.publish_graph(s, root, edges)
    try:
        store.publish_graph(s, root, edges.limit(0), nodes.limit(0), base=first)
    except publish.Conflict:
        pass
    tables = store.graph_tables(s, root).read()
    return tables["objects"], tables["relationships"]


def _snapshots(s, d):
    """Orders per status as three runs see them: computed, read again, and computed again from changed rows."""
    root = f"{checkpoint_folder(s)}/snapshot-{uuid.uuid4().hex}"
    rows, runs, computed = table(s, d, "orders"), [], []
    for run, given in enumerate((rows, rows.repartition(3), rows.where("o_orderkey % 2 = 0"))):
        def compute(given=given, run=run):
            computed.append(run)
            return {"counts": given.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))}

        found = store.snapshot(s, root, compute, fingerprint=publish.row_fingerprint(given.select("o_orderkey", "o_orderstatus")))
        runs.append(found["counts"].withColumns({"run": F.lit(run), "computed_in": F.lit(computed[-1])}))
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


QUERIES |= {
    "published_type_counts": lambda s, d: views.type_counts(_published(s, d)[0]),
    "published_full_chain": lambda s, d: views.full_chain_by_use(*_published(s, d)),
    "published_lineage": lambda s, d: views.lineage(*_published(s, d)),
    "snapshot_runs": _snapshots,
}
ORACLES |= {
    "published_type_counts": ORACLES["g1_type_counts"],
    "published_full_chain": ORACLES["g6e_full_chain"],
    "published_lineage": ORACLES["g5_lineage"],
    "snapshot_runs": """
SELECT o_orderstatus, count(*) AS n, run, CASE run WHEN 2 THEN 2 ELSE 0 END AS computed_in
FROM orders, range(3) t(r), LATERAL (SELECT CAST(r AS INTEGER) AS run) WHERE run < 2 OR o_orderkey % 2 = 0 GROUP BY ALL""",
}

# Profiles -----------------------------------------------------------------

TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
FIXTURE_COLUMNS = {
    "fx_profile_documents": ["doc_id", "lang", "source", "n_chars", "quality", "toxic"],
    "fx_profile_events": ["event_id", "updated_at", "user_id", "event_type", "value", "props"],
}


def _sample_text(name: str, c: str) -> str:
    """Of a list the first value is compared: the engines write small floats differently."""
    whole = f"substring(CAST(min({c}) AS VARCHAR), 1, 200)"
    return f"split_part({whole}, ',', 1)" if name == "embeddings" else whole


def _profile_sql(columns: dict[str, list[str]], sample: bool) -> str:
    """One SELECT per column; the percent is rounded half up in whole-number arithmetic."""
    selects = []
    for name, cols in columns.items():
        for i, c in enumerate(cols):
            tail = (
                f"regexp_replace({_sample_text(name, c)}, '^-0[.]0$', '0.0') AS sample_value"
                if sample
                else f"count(*) AS row_count, count(*) - count({c}) AS n_null, "
                f"CAST(((count(*) - count({c})) * 2000 + count(*)) // (2 * count(*)) / 10.0 AS DECIMAL(5,1)) AS pct_null"
            )
            selects.append(f"SELECT '{name}' AS table_name, {i} AS ordinal, '{c}' AS col_name, {tail} FROM {name}")
    return "\nUNION ALL ".join(selects)


def _profiles(s, d, names, *cols):
    load = fixture if names[0].startswith("fx_") else table
    sample = "min" if "sample_value" in cols else None
    return profile.profile_tables({n: load(s, d, n) for n in names}, sample).select("table_name", "ordinal", "col_name", *cols)


QUERIES |= {
    "profile_columns": lambda s, d: _profiles(s, d, RAW_TABLES, "row_count", "n_null", "pct_null"),
    "profile_nulls": lambda s, d: _profiles(s, d, list(FIXTURE_COLUMNS), "row_count", "n_null", "pct_null"),
    "profile_sample": lambda s, d: _profiles(s, d, RAW_TABLES, "sample_value").withColumn(
        "sample_value",
        F.when(F.col("table_name") == "embeddings", F.substring_index("sample_value", ",", 1)).otherwise(F.col("sample_value")),
    ),
    "profile_last_updated": lambda s, d: profile.profile_tables(
        {n: fixture(s, d, n) for n in FIXTURE_COLUMNS}, sample=None
    ).groupBy("table_name").agg(F.max("last_updated_column").alias("last_updated_column"), F.max("last_updated").alias("last_updated")),
    "catalog_columns": lambda s, d: profile.listed_columns(s, {n: table(s, d, n) for n in RAW_TABLES}).drop("is_nullable"),
    "file_inventory": lambda s, d: files.list_files(s, d).select(
        F.substring_index("path", "/", -1).alias("file_name"), "size"
    ),
    "catalog_counts": lambda s, d: profile.row_counts({n: table(s, d, n) for n in RAW_TABLES}),
}
ORACLES |= {
    "profile_columns": _profile_sql(TABLE_COLUMNS, sample=False),
    "profile_nulls": with_fixtures(_profile_sql(FIXTURE_COLUMNS, sample=False)),
    "profile_sample": _profile_sql(TABLE_COLUMNS, sample=True),
    "profile_last_updated": with_fixtures("""
SELECT 'fx_profile_documents' AS table_name, CAST(NULL AS VARCHAR) AS last_updated_column, CAST(NULL AS VARCHAR) AS last_updated
UNION ALL SELECT 'fx_profile_events', 'updated_at', CAST(max(updated_at) AS VARCHAR) FROM fx_profile_events"""),
    "catalog_columns": "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, {i} AS ordinal, '{c}' AS col_name, CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' "
        "WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
        f"WHEN 'FLOAT[]' THEN 'array<float>' END AS datatype FROM {n}"
        for n, cols in TABLE_COLUMNS.items() for i, c in enumerate(cols)
    ),
    "catalog_counts": "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in RAW_TABLES
    ),
}
