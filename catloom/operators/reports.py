"""Pages and visuals of report definitions and the physical tables they show.

``parts``: report_id, path, content (decoded text). All parsing is row by row in the JVM; the equality joins
resolve entity names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.functions import fixed, text
from catloom.functions.documents import entities_any_depth, with_json
from catloom.functions.ranking import keep_last, rank_in_group
from catloom.session import cut_lineage, release

_VISUAL_PATH = r"^(?:(?!visuals/)[^/]*/)*?([^/]+)/visuals/(?:.*/)?visual\.json$"
_ARCHIVE_LIST_PATH = r"^[^/]+/[^/]+/definition/pages/pages\.json$"
_ARCHIVE_VISUAL_PATH = r"^[^/]+/[^/]+/definition/pages/([^/]+)/visuals/[^/]+/visual\.json$"
_REPORT_PATHS = ["visual.visualType", "visual.visualContainerObjects.title", "pageOrder"]
_REF_KEY = r'"SourceRef"'
_FLAT_REF = r'"SourceRef"\s*:\s*(\{(?:[^{}"\\]++|"[^"\\]*+")*+\})'  # braces inside a text do not count
_TWO_NAMES = r'(?s)"Entity".*"Entity"'
_ENTITY = r'"Entity"\s*:\s*"([^"]*)"'


def with_entities(docs: DataFrame, content: str = "content", plain: str | None = None) -> DataFrame:
    """Add ``entities``: distinct source entities at any depth.

    Flat references, the usual form, are read by a pattern in the JVM. A text is sent to Python only when the
    pattern does not account for every reference key in it, as with an escape or a nested value, or a reference
    names two entities, or the column ``plain`` says that keys may be doubled.
    """
    doc = F.col(content)
    staged = docs.withColumn("_refs", F.regexp_extract_all(doc, F.lit(_FLAT_REF), F.lit(1)))
    doubled = F.exists("_refs", lambda r: r.rlike(_TWO_NAMES))
    n_keys = (F.length(doc) - F.length(F.replace(doc, F.lit(_REF_KEY), F.lit("")))) / len(_REF_KEY)
    staged = staged.withColumn("_simple", (F.size("_refs") == n_keys) & ~doubled & (F.col(plain) if plain else F.lit(True)))
    names = F.transform("_refs", lambda r: F.regexp_extract(r, _ENTITY, 1))
    easy = F.array_distinct(F.filter(names, lambda e: e != ""))
    hard = entities_any_depth(F.when(~F.col("_simple"), doc))
    return staged.withColumn("entities", F.when(F.col("_simple"), easy).otherwise(hard)).drop("_refs", "_simple")


def page_of_path(path: Column, archive: bool = False) -> Column:
    """Page id of a visual file path, or null."""
    return text.blank_to_null(F.regexp_extract(path, _ARCHIVE_VISUAL_PATH if archive else _VISUAL_PATH, 1))


def report_facts(parts: DataFrame, archive: bool = False) -> DataFrame:
    """What the other functions need of all visual and page-list files, in one pass and without a shuffle.

    Rows with a ``page_id`` are visuals (``visual_type``, ``title``, ``entities``); rows with ``page_order`` are
    page lists; in an archive only the one list beside the pages counts. Files that do not parse give neither. Keep
    the result (``session.cut_lineage``) when it is used more than once: it is far smaller than the texts.
    """
    # Filtered by path alone: a filter on the parsed text would parse it a second time.
    wanted = parts.where(F.endswith("path", F.lit("visual.json")) | F.endswith("path", F.lit("pages.json")))
    staged = wanted.select("report_id", "path", "content", page_of_path(F.col("path"), archive).alias("_page"))
    parsed = with_entities(with_json(staged, "content", "doc", _REPORT_PATHS, plain="_plain"), plain="_plain").withColumn(
        "page_id", F.when(F.col("doc").isNotNull(), F.col("_page"))
    )
    on_visual = F.col("page_id").isNotNull()
    listing = F.col("path").rlike(_ARCHIVE_LIST_PATH) if archive else F.endswith("path", F.lit("pages.json"))
    kind = F.coalesce(F.try_variant_get("doc", "$.visual.visualType", "string"), F.lit("unknown"))
    return parsed.select(
        "report_id", "path", "page_id",
        F.when(on_visual, kind).alias("visual_type"),
        F.when(on_visual, visual_title(F.col("doc"))).alias("title"),
        F.when(on_visual, F.col("entities")).alias("entities"),
        F.when(listing, F.try_variant_get("doc", "$.pageOrder", "array<string>")).alias("page_order"),
    )


def _visual_entities(facts: DataFrame) -> DataFrame:
    """(report_id, page_id, entity), a row per visual and entity."""
    # An inner explode lets Spark infer a filter on the array, which would parse the texts once more below their spreading.
    found = facts.select("report_id", "page_id", F.posexplode_outer("entities").alias("_at", "entity"))
    return found.where(F.col("_at").isNotNull()).select("report_id", "page_id", "entity")


def page_entities(facts: DataFrame) -> DataFrame:
    """Distinct (report_id, page_id, entity) of the visuals."""
    return _visual_entities(facts).distinct()


def pages_with_visuals(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("page_id").isNotNull()).select("report_id", "page_id").distinct()


def listed_pages(facts: DataFrame) -> DataFrame:
    """Page lists as rows: report_id, page_id, page_ord."""
    return facts.select("report_id", F.posexplode("page_order").alias("page_ord", "page_id"))


def entity_tables(known: DataFrame, deps: DataFrame) -> DataFrame:
    """Lower-case entity -> physical table: a known table is itself, else a measure group gives its tables."""
    itself = known.select(F.col("known").alias("entity"), F.col("known").alias("physical_table"))
    groups = deps.select(F.col("measure_group").alias("entity"), "physical_table").join(
        known.select(F.col("known").alias("entity")), "entity", "left_anti"
    )
    return itself.unionByName(groups).distinct()


def resolve(entities: DataFrame, keys: list[str], resolution: DataFrame, in_steps: bool = False) -> DataFrame:
    """Distinct (keys, physical_table) of rows with an ``entity``; doubles are merged before the join.

    The rows found are dealt by ``keys``, so a join on these that follows shuffles them no more. ``in_steps``: both steps are
    kept; the shuffles of one are gone before the next begins, and of the whole only the result stays.
    """
    low = entities.select(*keys, F.lower("entity").alias("entity")).distinct()
    if not in_steps:
        return low.join(resolution, "entity").select(*keys, "physical_table").repartition(*keys).distinct()
    low = cut_lineage(low)
    found = cut_lineage(low.join(resolution, "entity").select(*keys, "physical_table").distinct())
    release(low)
    return found


def page_tables(
    entities: DataFrame, seen: DataFrame, listed: DataFrame | None, resolution: DataFrame, in_steps: bool = False
) -> DataFrame:
    """(report_id, page_id, physical_table); pages without tables keep one row with a null table.

    A report with a page order list shows exactly the listed pages, any other report the pages seen. ``in_steps``: as for ``resolve``.
    """
    pairs = resolve(entities, ["report_id", "page_id"], resolution, in_steps)
    pages = seen.select("report_id", "page_id")
    if listed is not None:
        ordered = listed.select("report_id", "page_id").distinct()
        without = pages.join(ordered.select("report_id").distinct(), "report_id", "left_anti")
        pages = ordered.unionByName(without)
    return pages.join(pairs, ["report_id", "page_id"], "left").select("report_id", "page_id", "physical_table")


def definition_page_tables(
    facts: DataFrame, known: DataFrame, deps: DataFrame, archive: bool = False, in_steps: bool = False
) -> DataFrame:
    """Page tables of definition parts or archive members, from their facts. ``in_steps``: as for ``resolve``.

    In definition form a report without any readable visual gives no pages, even when it lists some.
    """
    seen, listed = pages_with_visuals(facts), listed_pages(facts)
    if not archive:
        listed = listed.join(seen.select("report_id").distinct(), "report_id", "left_semi")
    return page_tables(_visual_entities(facts), seen, listed, entity_tables(known, deps), in_steps)


def exported_page_tables(facts: DataFrame, known: DataFrame, deps: DataFrame) -> DataFrame:
    """Page tables of exported archives with ``Report/definition``: the listed pages only."""
    inside = facts.where(F.startswith("path", F.lit("Report/definition/pages/")))
    listed = listed_pages(inside.where(F.col("path") == "Report/definition/pages/pages.json"))
    return page_tables(_visual_entities(inside), listed, None, entity_tables(known, deps))


def legacy_entities(layouts: DataFrame) -> DataFrame:
    """(report_id, page_id, entity) of single-file layouts (columns report_id, layout).

    Each visual's ``config`` is a JSON text of its own. Sections without a name are passed over; a section
    without entities keeps one row with a null entity.
    """
    sections = with_json(layouts, "layout", "_v", ["sections.*.name", "sections.*.visualContainers.*.config"]).select(
        "report_id", F.explode(F.try_variant_get("_v", "$.sections", "array<variant>")).alias("_s")
    ).select(
        "report_id",
        F.try_variant_get("_s", "$.name", "string").alias("page_id"),
        F.try_variant_get("_s", "$.visualContainers", "array<variant>").alias("_vcs"),
    ).where(text.blank_to_null(F.col("page_id")).isNotNull())
    configs = sections.select("report_id", "page_id", F.explode_outer("_vcs").alias("_vc")).select(
        "report_id", "page_id", F.try_variant_get("_vc", "$.config", "string").alias("_text")
    )
    configs = with_json(configs, "_text", "_cfg", ["singleVisual.prototypeQuery.From"])
    sources = configs.select(
        "report_id", "page_id",
        F.explode_outer(
            F.try_variant_get("_cfg", "$.singleVisual.prototypeQuery.From", "array<variant>")
        ).alias("_f"),
    )
    return sources.select(
        "report_id", "page_id", text.blank_to_null(F.try_variant_get("_f", "$.Entity", "string")).alias("entity")
    ).distinct()


def legacy_page_tables(layouts: DataFrame, known: DataFrame, deps: DataFrame) -> DataFrame:
    found = legacy_entities(layouts)
    pages = found.select("report_id", "page_id").distinct()
    return page_tables(found.where(F.col("entity").isNotNull()), pages, None, entity_tables(known, deps))


def visual_title(doc: Column) -> Column:
    """First non-empty title literal without its quotes, or null."""
    titles = F.try_variant_get(doc, "$.visual.visualContainerObjects.title", "array<variant>")
    texts = F.transform(
        titles,
        lambda t: text.strip(F.try_variant_get(t, "$.properties.text.expr.Literal.Value", "string"), "'"),
    )
    return F.get(F.filter(texts, lambda t: t != ""), F.lit(0))


def named_visuals(facts: DataFrame) -> DataFrame:
    """Visuals that are not decoration, with type, name and entities.

    A visual without a title takes its type's display name; within a page the second and later ones of a type
    add their number in path order. Numbers count visuals that resolve to no table too.
    """
    shown = facts.where(F.col("page_id").isNotNull() & ~F.col("visual_type").isin(fixed.DECORATION_TYPES))
    # Titled visuals take no number: they form a group of their own beside the untitled ones.
    marked = shown.select(
        "report_id", "page_id", "path", "visual_type", "title", "entities", F.col("title").isNotNull().alias("_titled")
    )
    # Dealt by page, the rows pass one shuffle for their numbers and for what groups them by page and name after that.
    ranked = rank_in_group(
        marked, ["report_id", "page_id", "visual_type", "_titled"], "path", "_n", deal=["report_id", "page_id"]
    )
    base = text.visual_display_name(F.col("visual_type"))
    numbered = F.when(F.col("_n") == 1, base).otherwise(F.concat(base, F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    return ranked.select(
        "report_id", "page_id", "path", F.coalesce("title", numbered).alias("visual_name"), "visual_type", "entities"
    )


def visual_tables(visuals: DataFrame, resolution: DataFrame) -> DataFrame:
    """Distinct (report_id, page_id, path, visual_name, visual_type, physical_table); visuals without tables drop out.

    The result reads neither ``visuals`` nor ``resolution``: what it takes from them is kept.
    """
    keys = ["report_id", "page_id", "path", "visual_name", "visual_type"]
    # Names are looked up by row number: the long paths pass one shuffle before and one after, not one for every name and table.
    merged = visuals.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("entities"))
    rows = cut_lineage(merged.withColumn("_row", F.monotonically_increasing_id()))
    # A row's names are made distinct within the row, which shuffles none of them before the lookup.
    names = F.array_distinct(F.transform("entities", lambda e: F.lower(e)))
    found = cut_lineage(rows.select("_row", F.explode(names).alias("entity")).join(resolution, "entity").select("_row", "physical_table"))
    found = found.repartition("_row").distinct()
    return rows.select("_row", *keys).join(found, "_row").select(*keys, "physical_table")


def archive_index(members: DataFrame) -> DataFrame:
    """Model id -> report folder of archive members (archive, ord, path, content); the last file wins."""
    path = text.forward_slashes(F.col("path"))
    where = "datasetReference.byConnection.connectionString"
    link = F.try_variant_get("_v", f"$.{where}", "string")
    files = with_json(members.where(F.endswith(path, F.lit("definition.pbir"))), "content", "_v", [where]).select(
        "archive", "ord", path.alias("_path"), F.lower(F.regexp_extract(link, fixed.MODEL_ID_PATTERN, 1)).alias("model_id")
    )
    rows = files.where((F.col("model_id") != "") & (F.size(F.split("_path", "/")) >= 3)).select(
        "archive", "model_id", "ord",
        F.substring_index("_path", "/", 1).alias("folder"),
        F.substring_index("_path", "/", 2).alias("report_folder"),
    )
    return keep_last(rows, ["archive", "model_id"], F.col("ord")).drop("ord")


def choose_page_tables(
    reports: DataFrame,
    index: DataFrame,
    archive_maps: DataFrame,
    report_pages: DataFrame,
    fallbacks: list[DataFrame],
    archive_only: bool = False,
) -> DataFrame:
    """Page tables per report from the best source, with its name in ``map_source``.

    ``reports``: report_id, dataset_id. ``index``: model_id, report_folder. ``archive_maps``: report_folder,
    page_id, physical_table. ``report_pages``: report_id, page_id. ``fallbacks``: frames of report_id, page_id,
    physical_table in falling priority.

    A report whose model is in the archive takes the archive's map when at least one page id is its own, and
    no map at all when none is. The fallbacks serve the reports the archive has no pages for.
    """
    linked = reports.join(
        index.select(F.col("model_id").alias("_m"), "report_folder"), F.lower("dataset_id") == F.col("_m")
    ).select("report_id", "report_folder")
    filled = archive_maps.select("report_folder").distinct()
    with_map = linked.join(filled, "report_folder", "left_semi")
    shared = (
        with_map.join(archive_maps.select("report_folder", "page_id").distinct(), "report_folder")
        .join(report_pages.select("report_id", "page_id").distinct(), ["report_id", "page_id"], "left_semi")
        .select("report_id")
        .distinct()
    )
    accepted = with_map.join(shared, "report_id", "left_semi")
    out = accepted.join(archive_maps, "report_folder").select(
        "report_id", "page_id", "physical_table", F.lit("archive").alias("map_source")
    )
    if archive_only:
        return out
    left = reports.select("report_id").join(with_map.select("report_id"), "report_id", "left_anti")
    for i, maps in enumerate(fallbacks):
        own = maps.join(left, "report_id", "left_semi")
        out = out.unionByName(
            own.select("report_id", "page_id", "physical_table", F.lit(f"fallback_{i}").alias("map_source"))
        )
        left = left.join(maps.select("report_id").distinct(), "report_id", "left_anti")
    return out


def ordered_pages(pages: DataFrame) -> DataFrame:
    """Pages of each report by their order number; a missing number counts as 0, ties keep listing order."""
    return pages.orderBy("report_id", F.coalesce("page_order", F.lit(0)), "ord")


def page_visibility(raw: Column) -> Column:
    return F.when(raw == "HiddenInPublic", F.lit("hidden")).otherwise(F.lit("visible"))


def report_owner(created_by: Column, modified_by: Column) -> Column:
    return text.first_filled(created_by, modified_by)


def map_totals(page_maps: DataFrame, visuals: DataFrame) -> DataFrame:
    """Pages, table references and visuals with tables per report."""
    refs = page_maps.groupBy("report_id").agg(
        F.count_distinct("page_id").alias("n_pages"), F.count("physical_table").alias("n_table_refs")
    )
    shown = visuals.select("report_id", "path").distinct().groupBy("report_id").agg(F.count(F.lit(1)).alias("n_visuals"))
    return refs.join(shown, "report_id", "left").select(
        "report_id", "n_pages", "n_table_refs", F.coalesce("n_visuals", F.lit(0)).alias("n_visuals")
    )
