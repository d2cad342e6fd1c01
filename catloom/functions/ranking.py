"""Order-dependent steps that survive a group holding a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catloom.session import cut_lineage, shuffles_dropped

# Groups up to this size are ranked by a plain window; only larger ones are dealt by ranges.
WINDOW_ROWS = 100_000
COUNT_BUCKETS = 65_536  # groups are counted by these many hashes first


def order_text(*numbers: Column, width: int = 19) -> Column:
    """Text whose byte order equals the order of the given non-negative numbers."""
    return F.concat(*[F.lpad(n.cast("string"), width, "0") for n in numbers])


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the first by order. A combine on the map side, not a window over the group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_kept"))
    return picked.select(*keys, *[F.col(f"_kept.{c}").alias(c) for c in rest])


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_kept"))
    return picked.select(*keys, *[F.col(f"_kept.{c}").alias(c) for c in rest])


def _split_groups(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups a window may hold, and those of larger groups, or None if there are none.

    Rows are counted by a hash of their keys first, a few numbers from each task; only when many share a hash the keys themselves are counted.
    """
    full = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))

    def above(by: list[Column | str]) -> DataFrame:
        return full.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WINDOW_ROWS).drop("_n")

    with shuffles_dropped(df.sparkSession):
        if above([F.pmod(F.xxhash64(*keys), F.lit(COUNT_BUCKETS)).alias("_bucket")]).isEmpty():
            return full, None
        large = cut_lineage(above(keys))
        if large.isEmpty():
            return full, None
    return full.join(large, keys, "left_anti"), full.join(large, keys, "left_semi")


def rank_in_group(df: DataFrame, keys: list[str], order: str, out: str, deal: list[str] | None = None) -> DataFrame:
    """Row number (from 1) by the text column ``order``, unique within each group of non-null keys.

    Groups up to ``WINDOW_ROWS`` go through a window. Rows of larger ones are dealt by ranges of (keys, order), so a large group is
    spread over several tasks by its own values. Each range is numbered by itself and shifted by the row counts of the group's
    ranges before it. The dealt rows are written first: both readers must see the same ranges, also after an executor was lost.
    Rows of small groups are dealt to tasks by ``deal``, some of the keys, if it is given.
    """
    small, large = _split_groups(df, keys)
    small = small.repartition(*deal) if deal else small
    ranked = small.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")).select(*df.columns, out)
    if large is None:
        return ranked
    ranges = large.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    dealt = cut_lineage(ranges.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    shifts = cut_lineage(sizes.select(*keys, "_range", shift.alias("_shift")))  # few rows: the planner sees that
    wide = dealt.join(shifts, [*keys, "_range"]).withColumn(out, F.col("_row") + F.col("_shift")).select(*df.columns, out)
    return ranked.unionByName(wide)


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each one by the text column ``order``, unique within each group of non-null keys.

    As in ``rank_in_group`` only large groups are dealt by ranges.
    """
    small, large = _split_groups(df, keys)

    def total(parts: list[str]) -> Column:
        earlier = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    summed = small.withColumn(out, total(keys)).select(*df.columns, out)
    if large is None:
        return summed
    dealt = cut_lineage(large.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))
    wide = dealt.join(shifts, [*keys, "_range"])
    return summed.unionByName(wide.withColumn(out, total([*keys, "_range"]) + F.col("_shift")).select(*df.columns, out))
