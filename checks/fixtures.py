"""Operator inputs derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from catloom.session import spread

RAW_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIXTURES: dict[str, str] = {
    "fx_items": """
SELECT s_suppkey AS ord, concat('lh-', CAST(s_suppkey AS STRING)) AS id,
       concat(CASE s_suppkey % 4 WHEN 0 THEN 'bronze_lh_' WHEN 1 THEN 'silver_lh_' WHEN 2 THEN 'gold_wh_' ELSE 'nb_silver_to_gold_' END, CAST(s_suppkey AS STRING)) AS display_name,
       CASE WHEN s_suppkey % 4 = 2 THEN 'Warehouse' WHEN s_suppkey % 4 = 3 THEN 'Notebook' ELSE 'Lakehouse' END AS type,
       s_name AS description
FROM supplier""",
    "fx_tables": """
SELECT p_partkey AS ord, concat('t_', CAST(p_partkey - p_partkey % 2 AS STRING)) AS table_name, 'dbo' AS schema_name,
       concat('lh-', CAST(p_partkey % 10 AS STRING)) AS lh_id,
       CASE (p_partkey % 10) % 4 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Gold' ELSE 'Unknown' END AS layer,
       p_size AS row_count
FROM part""",
    "fx_pages": """
SELECT concat('p-', CAST(o_orderkey AS STRING)) AS page_id, concat('r-', CAST(o_custkey AS STRING)) AS report_id,
       concat('Page ', CAST(o_orderkey AS STRING)) AS display_name, o_orderkey % 7 AS page_order,
       CASE WHEN o_orderstatus = 'P' THEN 'HiddenInPublic' ELSE NULL END AS visibility
FROM orders""",
    "fx_datasets": """
SELECT c_custkey AS ord, concat('r-', CAST(c_custkey AS STRING)) AS report_id, concat('ds-', CAST(c_custkey % 50 AS STRING)) AS dataset_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'AzureDataLakeStorage' ELSE 'Sql' END AS datasource_type,
       CASE WHEN c_custkey % 2 = 0 THEN concat('/ws/lh-', CAST(c_custkey % 10 AS STRING), '/') ELSE NULL END AS path,
       CASE WHEN c_custkey % 2 = 1 THEN concat('SILVER_LH_', CAST(c_custkey % 10 AS STRING)) ELSE NULL END AS database_name
FROM customer""",
    "fx_sources": """
SELECT o_orderkey AS notebook_id,
       concat('from pyspark.sql import functions', chr(10),
              'df = spark.read.table("silver.dbo.T_', CAST(o_custkey % 200 AS STRING), '")', chr(10),
              'x = spark.sql("INSERT INTO gold.t_', CAST(o_orderkey % 200 AS STRING), ' SELECT * FROM silver.t_', CAST(o_orderkey % 150 AS STRING), '")', chr(10),
              'df.write.saveAsTable("gold.t_', CAST(o_orderkey % 100 AS STRING), '")') AS source
FROM orders""",
    "fx_activities": """
SELECT l_orderkey AS pipeline_id, l_linenumber AS ord,
       concat('act_', CAST(l_linenumber AS STRING), CASE l_linenumber % 4 WHEN 1 THEN '_silver' WHEN 2 THEN '_gold' ELSE '' END) AS name,
       concat('lh-', CAST(min(l_suppkey) AS STRING)) AS notebook_id,
       CASE WHEN l_linenumber > 1 THEN concat('act_', CAST(l_linenumber - 1 AS STRING), CASE (l_linenumber - 1) % 4 WHEN 1 THEN '_silver' WHEN 2 THEN '_gold' ELSE '' END) ELSE NULL END AS depends_on
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    # Lines of an order as a tree with listing order against it: line 6 waits for two, some lines for themselves or for nobody known.
    "fx_tied_activities": """
SELECT pipeline_id, n, 100 - n AS ord, concat('a', CAST(n AS STRING)) AS name,
       CASE WHEN n = 1 THEN '' WHEN n > 7 THEN 'a1' WHEN n = 6 THEN 'a2,a3' WHEN n = 5 AND pipeline_id % 3 = 0 THEN 'a2,a5' WHEN n = 4 AND pipeline_id % 5 = 0 THEN 'ghost'
            WHEN n < 4 THEN 'a1' WHEN n = 7 THEN 'a3' ELSE 'a2' END AS waits
FROM (SELECT l_orderkey AS pipeline_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) x""",
    "fx_measures": """
SELECT concat('ds-', CAST(l_suppkey % 50 AS STRING)) AS dataset_id, concat('Measures ', CAST(l_partkey AS STRING)) AS measure_group,
       l_linenumber % 3 AS source_priority,
       concat('SUM(t_', CAST(l_partkey - l_partkey % 2 AS STRING), '[qty]) / COUNTROWS(T_', CAST(l_orderkey % 100 AS STRING), ') + CALCULATE(''fact t''[x])') AS expr
FROM lineitem""",
    "fx_parts": """
SELECT concat('r-', CAST(o_custkey AS STRING)) AS report_id,
       concat('Rep/definition/pages/p-', CAST(l_orderkey AS STRING), '/visuals/v', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '/visual.json') AS path,
       concat('{"visual":{"visualType":"', CASE l_linenumber % 5 WHEN 0 THEN 'textbox' WHEN 1 THEN 'barChart' WHEN 2 THEN 'card' WHEN 3 THEN 'tableEx' ELSE 'customVisual' END,
              '","query":{"a":[{"SourceRef":{"Entity":"T_', CAST(l_partkey - l_partkey % 2 AS STRING), '"}},{"SourceRef":{"Entity":"Measures ', CAST(l_partkey AS STRING), '"}}]}}}') AS payload
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "fx_files": """
SELECT concat('lh-', CAST(page_id % 10 AS STRING)) AS lh_id, concat('lh-', CAST(page_id % 10 AS STRING), '/Files/d', CAST(page_id % 3 AS STRING), '/f', CAST(page_id AS STRING), '.html') AS name,
       CAST(CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END AS BIGINT) AS size
FROM pages""",
    "fx_profile_documents": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "fx_profile_events": """
SELECT event_id, ts AS updated_at, user_id, event_type, nullif(value, 0.0) AS value, props FROM events""",
    "fx_objects": """
SELECT 'ws' AS objects_id, 'Workspace' AS objects_type, CAST(NULL AS STRING) AS layer, 'fx' AS item_name, CAST(NULL AS STRING) AS parent_objects_id, CAST(NULL AS STRING) AS properties_json
UNION ALL SELECT concat('lh-', CAST(s_suppkey AS STRING)), CASE WHEN s_suppkey % 4 = 2 THEN 'Warehouse' WHEN s_suppkey % 4 = 3 THEN 'Notebook' ELSE 'Lakehouse' END,
   CASE s_suppkey % 4 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Gold' ELSE 'Unknown' END, s_name, 'ws', NULL FROM supplier
UNION ALL SELECT concat('r-', CAST(c_custkey AS STRING)), 'Report', NULL, c_name, 'ws', NULL FROM customer
UNION ALL SELECT concat('p-', CAST(o_orderkey AS STRING)), 'Page', NULL, concat('Page ', CAST(o_orderkey AS STRING)), concat('r-', CAST(o_custkey AS STRING)), NULL FROM orders
UNION ALL SELECT concat('t-', CAST(p_partkey AS STRING)), 'Table', CASE (p_partkey % 10) % 4 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Gold' ELSE 'Unknown' END,
   concat('t_', CAST(p_partkey - p_partkey % 2 AS STRING)), concat('lh-', CAST(p_partkey % 10 AS STRING)), concat('{"row_count": ', CAST(p_size AS STRING), '}') FROM part""",
    "fx_relationships": """
SELECT DISTINCT concat('p-', CAST(l_orderkey AS STRING)) AS source_objects_id, concat('t-', CAST(l_partkey AS STRING)) AS target_objects_id,
       CASE WHEN l_partkey % 10 = 9 THEN 'mentions' ELSE 'uses' END AS relationships_type, CAST(NULL AS STRING) AS transformation_expr, CAST(1.0 AS DECIMAL(5,4)) AS confidence_score, 'pbip_page' AS detection_method
FROM lineitem
UNION ALL SELECT CASE WHEN p_partkey % 50 = 0 THEN concat('unresolved-', CAST(p_partkey AS STRING)) WHEN p_partkey % 2 = 0 THEN 'lh-3' ELSE 'lh-7' END,
       concat('t-', CAST(p_partkey AS STRING)), 'derives_from', NULL, CAST(0.5 AS DECIMAL(5,4)), 'inferred' FROM part""",
    # Tables parented to pages, so the parent-pointer queries have rows too: one node per page and part.
    "fx_paged_objects": """
SELECT concat('r-', CAST(c_custkey AS STRING)) AS objects_id, 'Report' AS objects_type, CAST(NULL AS STRING) AS layer, c_name AS item_name, 'ws' AS parent_objects_id, CAST(NULL AS STRING) AS properties_json FROM customer
UNION ALL SELECT concat('p-', CAST(o_orderkey AS STRING)), 'Page', NULL, concat('Page ', CAST(o_orderkey AS STRING)), concat('r-', CAST(o_custkey AS STRING)), NULL FROM orders
UNION ALL SELECT concat('lh-', CAST(s_suppkey AS STRING)), 'Notebook', NULL, s_name, 'ws', NULL FROM supplier
UNION ALL SELECT concat('t-', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING)), 'Table', CASE (l_partkey % 10) % 4 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Gold' ELSE 'Unknown' END,
   concat('t_', CAST(l_partkey AS STRING)), concat('p-', CAST(l_orderkey AS STRING)), concat('{"row_count": ', CAST(max(l_linenumber) AS STRING), '}')
   FROM lineitem GROUP BY l_orderkey, l_partkey""",
    # A returned line's table points at the supplier instead, so some tables are fed by nothing.
    "fx_paged_relationships": """
SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN concat('t-', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING)) ELSE concat('lh-', CAST(l_suppkey AS STRING)) END AS source_objects_id,
       CASE WHEN l_returnflag = 'R' THEN concat('lh-', CAST(l_suppkey AS STRING)) ELSE concat('t-', CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING)) END AS target_objects_id,
       CASE WHEN l_returnflag = 'R' THEN 'mentions' ELSE 'derives_from' END AS relationships_type, CAST(0.5 AS DECIMAL(5,4)) AS confidence_score, 'inferred' AS detection_method
FROM lineitem""",
    # Lineage inputs ------------------------------------------------------
    "fx_containers": """
SELECT s_suppkey AS ord, concat('lh-', CAST(s_suppkey AS STRING)) AS id,
       concat(CASE s_suppkey % 4 WHEN 0 THEN 'bronze_lh_' WHEN 1 THEN 'silver_lh_' WHEN 2 THEN 'gold_wh_' ELSE 'nb_silver_to_gold_' END, CAST(s_suppkey AS STRING)) AS display_name,
       CASE s_suppkey % 4 WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Gold' ELSE 'Unknown' END AS layer,
       'fx' AS workspace_name, concat('https://files/', s_name) AS files_path
FROM supplier""",
    "fx_artifacts": """
SELECT s_suppkey AS ord, concat('lh-', CAST(s_suppkey AS STRING)) AS id,
       concat(CASE s_suppkey % 4 WHEN 0 THEN 'bronze_lh_' WHEN 1 THEN 'silver_lh_' WHEN 2 THEN 'gold_wh_' ELSE 'nb_silver_to_gold_' END, CAST(s_suppkey AS STRING)) AS display_name,
       CASE WHEN s_suppkey % 4 = 2 THEN 'Warehouse' WHEN s_suppkey % 4 = 3 THEN 'Notebook' ELSE 'Lakehouse' END AS type
FROM supplier
UNION ALL SELECT 1000000000 + o_orderkey, concat('nb-', CAST(o_orderkey AS STRING)), concat('script ', CAST(o_orderkey AS STRING)), 'Notebook' FROM orders""",
    # Report inputs -------------------------------------------------------
    "fx_layouts": """
SELECT concat('r-', CAST(l_suppkey AS STRING)) AS report_id,
       replace(concat('{"sections":[{"name":"p-', CAST(l_orderkey AS STRING), '","visualContainers":[{"config":"{~"singleVisual~":{~"prototypeQuery~":{~"From~":[{~"Entity~":~"T_', CAST(l_partkey AS STRING),
              '~"},{~"Entity~":~"Measures ', CAST(l_suppkey % 5 AS STRING), '~"}]}}}"},{"config":"not json"}]},{"name":"","visualContainers":[]}]}'), '~', chr(92)) AS layout
FROM lineitem""",
    "fx_archive_members": """
SELECT 'all.zip' AS archive, c_custkey AS ord, concat('F_', CAST(c_custkey AS STRING), '/F_', CAST(c_custkey AS STRING), '.Report/definition.pbir') AS path,
       concat('{"datasetReference":{"byConnection":{"connectionString":"Data Source=x;', CASE WHEN c_mktsegment = 'BUILDING' THEN 'other=' ELSE 'semanticModelId=' END,
              '00000000-0000-0000-ABCD-', lpad(CAST(c_custkey % 500 AS STRING), 12, '0'), ';"}}}') AS content
FROM customer""",
    "fx_archive_parts": """
SELECT concat('F_', CAST(o_custkey AS STRING), '/F_', CAST(o_custkey AS STRING), '.Report') AS report_id,
       concat('F_', CAST(o_custkey AS STRING), '/F_', CAST(o_custkey AS STRING), '.Report/definition/pages/p-', CAST(l_orderkey AS STRING), '/visuals/v', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '/visual.json') AS path,
       concat('{"visual":{"visualType":"', CASE l_linenumber % 5 WHEN 0 THEN 'textbox' WHEN 1 THEN 'barChart' WHEN 2 THEN 'card' WHEN 3 THEN 'tableEx' ELSE 'customVisual' END,
              CASE WHEN l_returnflag = 'R' THEN concat('","visualContainerObjects":{"title":[{"properties":{"text":{"expr":{"Literal":{"Value":"''Title ', CAST(l_partkey AS STRING), '''"}}}}}]},"x":"') ELSE '' END,
              '","query":{"a":[{"SourceRef":{"Entity":"T_', CAST(l_partkey - l_partkey % 2 AS STRING), '"}},{"SourceRef":{"Entity":"Measures ', CAST(l_partkey AS STRING), '"}}]}}}') AS content
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "fx_model_reports": """
SELECT c_custkey AS ord, concat('r-', CAST(c_custkey AS STRING)) AS report_id, c_name AS name,
       concat('00000000-0000-0000-abcd-', lpad(CAST(c_custkey % 500 AS STRING), 12, '0')) AS dataset_id,
       CASE WHEN c_acctbal < 0 THEN '' ELSE concat('u', CAST(c_nationkey AS STRING), '@x') END AS created_by,
       concat('m', CAST(c_nationkey AS STRING), '@x') AS modified_by
FROM customer""",
}


# Fixtures of long texts that the operators parse row by row, with the columns their table is spread by before the texts are made.
TEXT_FIXTURES = {
    "fx_sources": {"orders": ["o_orderkey", "o_custkey"]},
    "fx_measures": {"lineitem": ["l_suppkey", "l_partkey", "l_linenumber", "l_orderkey"]},
    "fx_parts": {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]},
    "fx_archive_parts": {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]},
    "fx_layouts": {"lineitem": ["l_suppkey", "l_orderkey", "l_partkey"]},
}


def load_raw(spark: SparkSession, sf_dir: str, names: list[str] = RAW_TABLES, by: dict[str, list[str]] | None = None) -> None:
    """Register the given tables as temporary views under their own names; those in ``by`` spread by the columns given there."""
    for name in names:
        raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (spread(raw, by[name]) if by and name in by else raw).createOrReplaceTempView(name)


def raw_names(sql: str) -> list[str]:
    return [t for t in RAW_TABLES if re.search(rf"(?i)\b(?:from|join)\s+{t}\b", sql)]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    load_raw(spark, sf_dir, raw_names(sql), TEXT_FIXTURES.get(name))
    return spark.sql(sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
