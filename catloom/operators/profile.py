"""Table profiles: row count, share of nulls, a sample value and the last update in one scan per table."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catloom.functions import fixed, text
from catloom.session import checkpoint_folder

# Aggregates per scan; wider tables are read in column batches (each batch reads only its columns).
COLUMNS_PER_SCAN = 200


def table_columns(df: DataFrame) -> list[tuple[int, str, str, bool]]:
    """(ordinal, name, type, nullable) of each column, in order."""
    return [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]


def update_column(names: list[str]) -> str | None:
    """First column, in column order, whose name marks a row timestamp."""
    return next((n for n in names if n.lower() in fixed.TIMESTAMP_COLUMNS), None)


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _sample(field: T.StructField, how: str | None) -> Column:
    if how is None:
        return F.lit(None).cast("string")
    col = _quoted(field.name)
    kind = field.dataType
    if how == "first":
        return text.cut(F.first(col, ignorenulls=True), fixed.SAMPLE_CHARS)
    if not _orderable(kind):
        return F.min(F.substring(F.to_json(col), 1, fixed.SAMPLE_CHARS))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        col = (col + F.lit(0.0)).cast(kind)  # one form of zero
    return text.cut(F.min(col), fixed.SAMPLE_CHARS)


def _share(nulls: Column, rows: Column) -> Column:
    """Percent with one decimal, rounded half up; null for an empty table."""
    return (F.when(rows > 0, nulls.cast("decimal(20,0)") * 100 / rows.cast("decimal(20,0)"))).cast("decimal(5,1)")


def profile_table(df: DataFrame, sample: str | None = "min") -> DataFrame:
    """One row per column: ordinal, col_name, datatype, is_nullable, row_count, n_null, pct_null, sample_value,
    last_updated_column, last_updated.

    ``sample="min"`` takes the smallest value (repeatable), ``"first"`` any value that is not null, None none. A table
    wider than ``COLUMNS_PER_SCAN`` is read once for each batch of so many columns, with the same rows.
    Counts combine on the map side, so only one row per task is shuffled, whatever the distribution of values.
    """
    fields = df.schema.fields
    stamp = update_column(df.columns)
    last = F.max(_quoted(stamp)).cast("string") if stamp else F.lit(None).cast("string")
    outs = []
    for first in range(0, len(fields), COLUMNS_PER_SCAN):
        batch = fields[first : first + COLUMNS_PER_SCAN]
        stats = [F.count(F.lit(1)).alias("_rows"), last.alias("_last")]
        for i, field in enumerate(batch):
            stats.append(F.count(_quoted(field.name)).alias(f"_c{i}"))
            stats.append(_sample(field, sample).alias(f"_s{i}"))
        outs.append(_column_rows(df.agg(*stats), batch, first, stamp))
    return reduce(DataFrame.unionByName, outs)


def _column_rows(one: DataFrame, fields: list[T.StructField], first: int, stamp: str | None) -> DataFrame:
    """The row per column of ``profile_table`` from one row of aggregates: _rows, _last, and _c0, _s0, ... of the columns from ``first`` on."""
    rows = F.array(
        *[
            F.struct(
                F.lit(first + i).alias("ordinal"),
                F.lit(field.name).alias("col_name"),
                F.lit(field.dataType.simpleString()).alias("datatype"),
                F.lit(field.nullable).alias("is_nullable"),
                (F.col("_rows") - F.col(f"_c{i}")).alias("n_null"),
                F.col(f"_s{i}").alias("sample_value"),
            )
            for i, field in enumerate(fields)
        ]
    )
    return one.select("_rows", "_last", F.inline(rows)).select(
        "ordinal", "col_name", "datatype", "is_nullable",
        F.col("_rows").alias("row_count"),
        "n_null",
        _share(F.col("n_null"), F.col("_rows")).alias("pct_null"),
        "sample_value",
        F.lit(stamp).cast("string").alias("last_updated_column"),
        F.col("_last").alias("last_updated"),
    )


# Partial states -----------------------------------------------------------

FILE = ["file_path", "file_size", "file_modification_time"]


def file_states(df: DataFrame) -> DataFrame:
    """One row per input file: rows, and of column i its filled values (c<i>), smallest value (m<i>); ``last``: the largest timestamp.

    States of files are merged by ``merge_states``; values keep their types until then. ``df`` must read files.
    """
    stamp = update_column(df.columns)
    stats = [F.count(F.lit(1)).alias("rows"), (F.max(_quoted(stamp)) if stamp else F.lit(None).cast("string")).alias("last")]
    for i, field in enumerate(df.schema.fields):
        col = _quoted(field.name)
        if not _orderable(field.dataType):
            least = F.min(F.substring(F.to_json(col), 1, fixed.SAMPLE_CHARS))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            least = F.min((col + F.lit(0.0)).cast(field.dataType))
        else:
            least = F.min(col)
        stats += [F.count(col).alias(f"c{i}"), least.alias(f"m{i}")]
    return df.groupBy(*[F.col(f"_metadata.{c}").alias(c) for c in FILE]).agg(*stats)


def merge_states(states: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of ``profile_table`` (with the smallest values as samples) from the states of a table's files."""
    fields = schema.fields
    stats = [F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("_rows"), F.max("last").cast("string").alias("_last")]
    for i in range(len(fields)):
        stats += [F.coalesce(F.sum(f"c{i}"), F.lit(0)).cast("long").alias(f"_c{i}"), text.cut(F.min(f"m{i}"), fixed.SAMPLE_CHARS).alias(f"_s{i}")]
    return _column_rows(states.agg(*stats), fields, 0, update_column(schema.names))


# Many tables --------------------------------------------------------------


def profile_apart(
    tables: dict[str, DataFrame], sample: str | None = "min", threads: int = 8
) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(``profile_tables`` of all tables, (table, reason) of those that could not be read).

    Every table is one job of its own, ``threads`` at a time, and only its few result rows are kept. A table that fails on the way, say
    for a damaged file, is listed with its columns and null figures, and the others go on.
    """
    if not tables:
        return None, []
    spark = next(iter(tables.values())).sparkSession
    folder = f"{checkpoint_folder(spark)}/profile-{uuid.uuid4().hex}"

    def run(item: tuple[int, tuple[str, DataFrame]]) -> str | None:
        place, (name, df) = item
        try:
            profile_table(df, sample).select(F.lit(name).alias("table_name"), "*").write.parquet(f"{folder}/{place}")
            return None
        except Exception as error:  # a table that cannot be read must not stop the others
            return str(error).strip().split("\n")[0]

    with ThreadPoolExecutor(threads) as pool:
        failed = list(pool.map(run, enumerate(tables.items())))
    shape = profile_table(spark.range(0), None).select(F.lit("").alias("table_name"), "*").schema
    good = [f"{folder}/{i}" for i, problem in enumerate(failed) if problem is None]
    found = spark.read.schema(shape).parquet(*good) if good else spark.createDataFrame([], shape)
    lost = [(name, *column) for (name, df), problem in zip(tables.items(), failed) if problem is not None for column in table_columns(df)]
    if lost:
        listed = spark.createDataFrame(lost, "table_name string, ordinal int, col_name string, datatype string, is_nullable boolean")
        nulls = {f.name: F.lit(None).cast(f.dataType) for f in shape.fields if f.name not in listed.columns}
        found = found.unionByName(listed.withColumns(nulls).select(*shape.names))
    return found, [(name, problem) for name, problem in zip(tables, failed) if problem is not None]


def profile_tables(tables: dict[str, DataFrame], sample: str | None = "min") -> DataFrame:
    """``profile_table`` of many tables with a leading ``table_name``; the scans run side by side."""
    each = [profile_table(df, sample).select(F.lit(n).alias("table_name"), "*") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    each = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, each)


def to_tables(profile: DataFrame) -> DataFrame:
    """Table rows (table keys, row_count, last_updated) of a profile that carries table keys."""
    keys = [c for c in ("lh_id", "lh_name", "schema_name", "table_name") if c in profile.columns]
    return profile.groupBy(*keys).agg(
        F.max("row_count").alias("row_count"), F.coalesce(F.max("last_updated"), F.lit("")).alias("last_updated")
    )


def to_columns(profile: DataFrame) -> DataFrame:
    keys = [c for c in ("lh_id", "lh_name", "schema_name", "table_name") if c in profile.columns]
    return profile.select(*keys, "ordinal", "col_name", "datatype", "is_nullable", "sample_value", "pct_null")


def listed_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column listing of many tables without reading data."""
    rows = [(name, *col) for name, df in tables.items() for col in table_columns(df)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, col_name string, datatype string, is_nullable boolean")
