"""Declared schemas of the stored tables and of the frames operators exchange."""

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


ARTIFACTS = _struct(
    ord=_L, id=_S, display_name=_S, type=_S, workspace_id=_S, workspace_name=_S,
    description=_S, last_modified=_S, created_by=_S, layer=_S,
)
ENDPOINT = _struct(connection_string=_S, endpoint_id=_S)
CONTAINERS = T.StructType(
    [*ARTIFACTS.fields, T.StructField("sql_endpoint", ENDPOINT), *_struct(tables_path=_S, files_path=_S).fields]
)
TABLES = _struct(
    ord=_L, table_name=_S, schema_name=_S, lh_name=_S, lh_id=_S, layer=_S, workspace_name=_S,
    description=_S, row_count=_L, last_updated=_S, source_artifact=_S,
)
COLUMNS = _struct(
    lh_name=_S, schema_name=_S, table_name=_S, ordinal=_I, col_name=_S, datatype=_S,
    is_nullable=T.BooleanType(), sample_value=_S, pct_null=T.DecimalType(5, 1),
)
ACTIVITIES = _struct(
    pipeline_ord=_L, pipeline_id=_S, ord=_L, name=_S, notebook_id=_S, depends_on=T.ArrayType(_S),
)
SOURCES = _struct(
    artifact_id=_S, display_name=_S, source_method=_S,
    reads=T.ArrayType(_S), writes=T.ArrayType(_S),
)
DATA_SOURCES = _struct(
    source_name=_S, source_type=_S, connection_path=_S, target_bronze=_S, ingestion_method=_S, notes=_S,
)
OBJECTS = _struct(
    objects_id=_S, objects_type=_S, layer=_S, workspace_name=_S, workspace_id=_S, item_name=_S,
    fq_name=_S, schema_name=_S, parent_objects_id=_S, source_system=_S, owner_email=_S,
    business_domain=_S, sensitivity_label=_S, is_pii=_I, is_active=_I, properties_json=_S,
    first_seen_datetime=_TS, last_seen_datetime=_TS, created_datetime=_TS, updated_datetime=_TS,
)
RELATIONSHIPS = _struct(
    relationships_id=_S, source_objects_id=_S, target_objects_id=_S, relationships_type=_S,
    transformation_type=_S, transformation_expr=_S, code_reference=_S, run_id=_S,
    confidence_score=T.DecimalType(5, 4), detection_method=_S, is_active=_I,
    first_seen_datetime=_TS, last_seen_datetime=_TS, created_datetime=_TS, updated_datetime=_TS,
)
MEASURE_DEPS = _struct(sm_name=_S, measure_group=_S, physical_table=_S, updated_datetime=_TS)
