"""Which physical tables each measure group rests on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.functions import refs, text
from catloom.functions.documents import with_json
from catloom.session import cut_lineage
from catloom.sources.definitions import decoded_parts

_RUN = r"[a-z0-9_]+"
_OTHER = r"[^a-z0-9_\s]"
# Up to this many table names are sent to the texts; more meet them in a shuffle.
SENT_NAMES = 200_000
# Parts the texts of one word are dealt over there: words like a function's name stand in nearly every expression.
WORD_SPLITS = 32
# Before that shuffle words are looked up in a bit map of hashed names, most bits of it at most (16 MB).
MOST_BITS = 2**27
# Parts the rows of one dataset are dealt over.
DATASET_SPLITS = 32


def expression_tables(exprs: DataFrame, keys: list[str], known: DataFrame, mode: str = "compat") -> DataFrame:
    """Distinct (keys, physical_table) for tables of ``known`` that the ``expr`` texts name.

    Texts are cut into candidate words once and the words meet the table names in an equality join; only hits are made distinct.
    Where the names are too many to be sent, a bit map of their hashes is sent instead, so that words of all texts that are no names
    are not shuffled. The other words meet the names themselves, each word and name dealt over ``WORD_SPLITS`` parts, so a name in all
    texts is not one task's work; equal rows lie in one part, so they are made distinct without a further shuffle.
    Names with other characters than letters, digits and underscores meet texts through one of their
    own words, then the whole name is checked.
    """
    words = exprs.select(*keys, F.explode(refs.dax_tokens(F.col("expr"), mode)).alias("physical_table"))
    names = cut_lineage(known.select(F.col("known").alias("physical_table")))
    n_names = names.count()
    if n_names <= SENT_NAMES:
        plain = words.join(F.broadcast(names), "physical_table", "left_semi").distinct()
    else:
        part = F.pmod(F.xxhash64(*keys), F.lit(WORD_SPLITS)).cast("int")
        dealt = names.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(WORD_SPLITS - 1)))).hint("shuffle_merge")
        likely = _likely_names(words, names, n_names).withColumn("_part", part)
        plain = likely.join(dealt, ["physical_table", "_part"], "left_semi").select(*keys, "physical_table", "_part").distinct().drop("_part")
    odd = names.where(~F.col("physical_table").rlike(r"^[a-z0-9_]+$") & (F.col("physical_table") != ""))
    if odd.isEmpty():  # the usual case; spares a second pass over the texts
        return plain
    return plain.unionByName(_odd_names(exprs, keys, odd)).distinct()


def _likely_names(words: DataFrame, names: DataFrame, n_names: int) -> DataFrame:
    """The words whose hash is that of some name: all names and few others. The bit map is sent, 32768 bits in a row."""
    n_bits = min(MOST_BITS, 16 * n_names // 32_768 * 32_768 + 32_768)

    def places(df: DataFrame) -> DataFrame:
        bit = F.pmod(F.xxhash64("physical_table"), F.lit(n_bits))
        return df.withColumns({"_row": F.floor(bit / 32_768), "_long": (F.floor(bit / 64) % 512).cast("int"), "_bit": (bit % 64).cast("int")})

    longs = places(names).groupBy("_row", "_long").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    listed = longs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_long", "_bits"))).alias("_at"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0).cast("long")))
    rows = listed.select("_row", filled.alias("_longs"))
    met = places(words).join(F.broadcast(rows), "_row").where(F.getbit(F.get("_longs", F.col("_long")), F.col("_bit")) == 1)
    return met.select(*words.columns)


def _odd_names(exprs: DataFrame, keys: list[str], odd: DataFrame) -> DataFrame:
    run = F.regexp_extract(F.col("physical_table"), _RUN, 0)
    other = F.regexp_extract(F.col("physical_table"), _OTHER, 0)
    anchored = odd.withColumn("_anchor", F.when(run != "", run).otherwise(other))
    anchors = anchored.select("_anchor").distinct()
    low = F.lower("expr")
    runs = F.regexp_extract_all(low, F.lit(_RUN), F.lit(0))
    chars = F.regexp_extract_all(low, F.lit(_OTHER), F.lit(0))
    hits = (
        exprs.select(*keys, low.alias("_low"), F.explode(F.array_distinct(F.concat(runs, chars))).alias("_anchor"))
        .join(anchors, "_anchor", "left_semi")
        .join(anchored, "_anchor")
    )
    whole = F.concat(
        F.lit("(?<![a-z0-9_'\"])\\Q"), F.col("physical_table"), F.lit("\\E(?![a-z0-9_'\"\\[])")
    )
    return hits.where(F.contains("_low", F.col("physical_table")) & F.regexp_like("_low", whole)).select(
        *keys, "physical_table"
    )


def not_physical(measures: DataFrame, known: DataFrame) -> DataFrame:
    """Drop measures whose group is itself a physical table."""
    keyed = measures.withColumn("_g", F.lower("measure_group"))
    return keyed.join(known.select(F.col("known").alias("_g")), "_g", "left_anti").select(*measures.columns)


def measures_of_model(models: DataFrame) -> DataFrame:
    """Measures of model documents (columns dataset_id, model): every table's measures, physical or not."""
    parts = ["tables.*.name", "tables.*.measures.*.expression"]
    doc = with_json(models.select("dataset_id", "model"), "model", "_v", [*parts, *(f"model.{p}" for p in parts)])
    tables = F.coalesce(
        F.try_variant_get("_v", "$.model.tables", "array<variant>"), F.try_variant_get("_v", "$.tables", "array<variant>")
    )
    listed = doc.select("dataset_id", F.explode(tables).alias("_t")).select(
        "dataset_id",
        F.coalesce(F.try_variant_get("_t", "$.name", "string"), F.lit("")).alias("measure_group"),
        F.explode(F.try_variant_get("_t", "$.measures", "array<variant>")).alias("_m"),
    )
    return listed.select(
        "dataset_id",
        "measure_group",
        F.coalesce(
            F.array_join(F.try_variant_get("_m", "$.expression", "array<string>"), "\n"),
            F.try_variant_get("_m", "$.expression", "string"),
            F.lit(""),
        ).alias("expr"),
    )


def _tables_child(path: Column) -> Column:
    """Path after the first ``tables`` folder, or null."""
    rest = F.regexp_extract(path, r"^(?:(?!tables/)[^/]*/)*tables/(.+)$", 1)
    return text.blank_to_null(rest)


def measures_of_table_parts(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Measure groups of model parts: the files directly under ``tables/``. Columns dataset_id, path, payload."""
    below = _tables_child(F.col("path"))
    files = (
        decoded_parts(parts)
        .where(F.endswith("path", F.lit(".tmdl")) & F.contains("path", F.lit("/tables/")))
        .where(below.isNotNull() & ~F.contains(below, F.lit("/")) & F.col("content").isNotNull())
    )
    found = files.select(
        "dataset_id", F.regexp_replace(below, r"\.tmdl$", "").alias("measure_group"), F.col("content").alias("expr")
    )
    return not_physical(found, known)


def measures_of_measure_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Measure groups of ``tables/<group>/measures/`` files. Columns dataset_id, path, content."""
    path = text.forward_slashes(F.col("path"))
    below = _tables_child(path)
    found = files.where(F.endswith(path, F.lit(".tmdl")) & F.contains("path", F.lit("/measures/"))).where(
        below.isNotNull()
    )
    return not_physical(
        found.select(
            "dataset_id", F.substring_index(below, "/", 1).alias("measure_group"), F.col("content").alias("expr")
        ),
        known,
    )


def measures_of_metadata(model_tables: DataFrame, model_measures: DataFrame, known: DataFrame) -> DataFrame:
    """Measures of metadata rows: (dataset_id, table_id, expr) with their owner's name from (dataset_id, table_id, name)."""
    owned = model_measures.join(model_tables, ["dataset_id", "table_id"]).where(
        text.blank_to_null(F.col("name")).isNotNull()
    )
    return not_physical(
        owned.select("dataset_id", F.col("name").alias("measure_group"), F.coalesce("expr", F.lit("")).alias("expr")),
        known,
    )


def with_priority(*sources: DataFrame) -> DataFrame:
    """Union of measure frames; an earlier argument has the higher priority (0 is best)."""
    ranked = [s.withColumn("source_priority", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked)


def source_deps(measures: DataFrame, known: DataFrame, mode: str = "compat") -> DataFrame:
    """Distinct (dataset_id, source_priority, measure_group, physical_table)."""
    lowered = measures.withColumn("measure_group", F.lower("measure_group"))
    return expression_tables(lowered, ["dataset_id", "source_priority", "measure_group"], known, mode)


def merge_deps(deps: DataFrame, datasets: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Final (measure_group, physical_table).

    Stored pairs, when there are any, are used alone. Otherwise each dataset takes its best source that
    found something, and a group found in several datasets takes the tables of the last one.
    ``datasets``: dataset_id, ord.
    """
    best = deps.groupBy("dataset_id").agg(F.min("source_priority").alias("source_priority"))
    # Datasets may be few, so each one's rows are dealt over parts; the choice is written first, which shows the planner its size.
    choice = cut_lineage(best.join(datasets.select("dataset_id", F.col("ord").alias("_ord")), "dataset_id"))
    dealt = choice.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DATASET_SPLITS - 1))))
    part = F.pmod(F.xxhash64("measure_group", "physical_table"), F.lit(DATASET_SPLITS)).cast("int")
    chosen = deps.withColumn("_part", part).join(dealt, ["dataset_id", "source_priority", "_part"])
    last = chosen.groupBy("measure_group").agg(F.max("_ord").alias("_ord"))
    merged = chosen.join(last, ["measure_group", "_ord"], "left_semi").select("measure_group", "physical_table")
    if stored is None:
        return merged
    has_stored = stored.limit(1).agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    return (
        merged.withColumn("_stored", has_stored).where(~F.col("_stored")).drop("_stored")
        .unionByName(stored.select("measure_group", "physical_table"))
    )
