"""Names, word lists, patterns and texts that results depend on."""

# Item types ---------------------------------------------------------------
IN_SCOPE_TYPES = ["Lakehouse", "Warehouse", "Notebook", "DataflowGen2", "Dataflow", "DataPipeline"]
DOCUMENTED_TYPES = ["Lakehouse", "Warehouse", "Notebook", "DataflowGen2", "Dataflow"]
CONTAINER_TYPES = ["Lakehouse", "Warehouse"]
DATAFLOW_TYPES = ["DataflowGen2", "Dataflow"]
GOVERNANCE_TARGET = "wh_governance"
SOURCE_SYSTEM = "Microsoft Fabric"
FILE_HOST = "onelake.dfs.fabric.microsoft.com"

# Layers -------------------------------------------------------------------
LAYERS_ITEM_PRIORITY = ["bronze", "silver", "gold"]
LAYERS_ACTIVITY_PRIORITY = ["gold", "silver", "bronze"]
LAYER_BEFORE = {"Bronze": "External", "Silver": "Bronze", "Gold": "Silver"}
LAYER_RANK = {"Bronze": 0, "Silver": 1, "Gold": 2, "Unknown": 3}
OTHER_LAYER_RANK = 9
NAME_TRANSITIONS = [
    (["silver_to_gold", "silver2gold", "silvertogold"], "Silver", "Gold"),
    (["bronze_to_silver", "bronze2silver", "bronzetosilver"], "Bronze", "Silver"),
    (["bronze_to_gold", "bronze2gold"], "Bronze", "Gold"),
]
DOMAIN_STRIPS = {
    "Gold": ["gold_wh_", "gold_lh_", "gold_", "_wh", "_warehouse", "_lakehouse"],
    "Silver": ["silver_lh_", "silver_"],
}

# Profiling ----------------------------------------------------------------
TIMESTAMP_COLUMNS = [
    "_ingested_at", "_generated_at", "_updated_at", "_modified_at",
    "ingestion_date", "load_date", "loaded_at", "updated_at",
    "modified_at", "_created_at", "last_modified",
]
SAMPLE_CHARS = 200
NODE_SAMPLE_CHARS = 500

# Code references ----------------------------------------------------------
# Each pattern with a lower-case text every match holds.
WRITE_PATTERNS = [
    (".saveastable", r"""\.saveAsTable\s*\(\s*["']([^"']+)["']"""),
    (".writeto", r"""\.writeTo\s*\(\s*["']([^"']+)["']"""),
]
SQL_WRITE_TEXT = "spark.sql"
SQL_WRITE_PATTERN = (
    r"""spark\.sql\s*\(\s*["'].*?(?:INSERT\s+(?:OVERWRITE\s+)?(?:INTO\s+)?"""
    r"""|CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?)([a-zA-Z_][a-zA-Z0-9_.]+)"""
)
# As above, with the optional TABLE keyword after INSERT (strict mode).
SQL_WRITE_PATTERN_STRICT = (
    r"""spark\.sql\s*\(\s*["'].*?(?:INSERT\s+(?:OVERWRITE\s+)?(?:INTO\s+)?(?:TABLE\s+)?"""
    r"""|CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?)([a-zA-Z_][a-zA-Z0-9_.]+)"""
)
READ_PATTERNS = [
    ("spark.read.table", r"""spark\.read\.table\s*\(\s*["']([^"']+)["']"""),
    ("spark.table", r"""spark\.table\s*\(\s*["']([^"']+)["']"""),
    (".load", r"""\.load\s*\(\s*["']([^"']+)["']"""),
    ("from", r"""\bFROM\s+([a-zA-Z_][a-zA-Z0-9_.]+)\b"""),
]
READ_NOISE = [
    "information_schema", "sys", "dual", "subquery", "cte",
    "where", "join", "on", "and", "or", "as",
]
DATAFLOW_PATTERN = r"""#?["']([a-zA-Z_][a-zA-Z0-9_ ]+)["']"""
IMPORT_LINE = r"""(?m)^[ \t]*from[ \t]+[\w.]+[ \t]+import\b.*$"""

# Measure expressions ------------------------------------------------------
DAX_COLUMN_PATTERN = r"""'([^']+)'\s*\[|(\b[A-Za-z_][A-Za-z0-9_ ]*)\["""
DAX_WORD_PATTERN = r"""(?<![a-z0-9_'"])[a-z0-9_]++(?!['"\[])"""

# Visuals ------------------------------------------------------------------
DECORATION_TYPES = [
    "actionButton", "image", "textbox", "shape",
    "bookmarkNavigator", "pageNavigator", "groupShape",
]
VISUAL_NAMES = {
    "barChart": "Bar Chart",
    "clusteredBarChart": "Clustered Bar Chart",
    "clusteredColumnChart": "Clustered Column Chart",
    "stackedBarChart": "Stacked Bar Chart",
    "stackedColumnChart": "Stacked Column Chart",
    "lineChart": "Line Chart",
    "areaChart": "Area Chart",
    "stackedAreaChart": "Stacked Area Chart",
    "ribbonChart": "Ribbon Chart",
    "waterfallChart": "Waterfall Chart",
    "funnelChart": "Funnel Chart",
    "pieChart": "Pie Chart",
    "donutChart": "Donut Chart",
    "treemap": "Treemap",
    "map": "Map",
    "filledMap": "Filled Map",
    "shapeMap": "Shape Map",
    "tableEx": "Table",
    "pivotTable": "Matrix",
    "card": "Card",
    "multiRowCard": "Multi-Row Card",
    "kpi": "KPI",
    "gauge": "Gauge",
    "slicer": "Slicer",
    "scatterChart": "Scatter Chart",
    "decompositionTreeVisual": "Decomposition Tree",
    "keyDriversVisual": "Key Influencers",
    "cardVisual": "New Card",
    "advancedSlicerVisual": "New Slicer",
}
MODEL_ID_PATTERN = r"(?i)semanticmodelid=([0-9a-f-]{36})"

# Edges --------------------------------------------------------------------
PARSED, INFERRED, NEEDS_REVIEW = "PARSED", "INFERRED", "NEEDS REVIEW"
CONFIDENCE_SCORE = {PARSED: "1.0", INFERRED: "0.5", NEEDS_REVIEW: "0.25"}
DETECTION_METHOD = {PARSED: "static_parse", INFERRED: "inferred", NEEDS_REVIEW: "manual"}
NOTE_PARSED = "PARSED: source_method="
NOTE_POSITION = "INFERRED: no source code available; assigned from pipeline position"
NOTE_ALL_SILVER = "INFERRED: no source code; used all silver tables as inputs"
NOTE_SAME_NAME = "INFERRED: matched silver table name to same-named bronze Delta table"
NOTE_ALL_BRONZE = "NEEDS REVIEW: no exact name match between silver and bronze tables"
NOTE_FILES = "INFERRED: no source code; bronze layer has no registered tables; file path used"
REVIEW_EXPR = "NEEDS REVIEW — candidates not resolved"

# Data-source rows ---------------------------------------------------------
FILE_SOURCE_TYPE = "File"
FILE_INGESTION = "Manual upload to OneLake"
FILE_NOTE = "Discovered via OneLake blob listing (%s bytes)"
STUB_TARGET = "(see Files section)"
STUB_INGESTION = "NEEDS REVIEW"
STUB_NOTE = "OneLake file listing returned no results; populate manually"
STUB_FILE_REF = "/Files/ (file source)"

# Characters removed by a plain strip: all Unicode white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
