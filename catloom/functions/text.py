"""String expressions. All are built-in Spark functions, so they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from catloom.functions import fixed


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty; null when there is none."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def strip(col: Column, chars: str = fixed.WHITE_SPACE) -> Column:
    return F.btrim(col, F.lit(chars))


def clean_ref(col: Column) -> Column:
    """Table reference without quotes and schema prefixes, in lower case."""
    bare = strip(strip(col), "\"'`")
    return F.lower(F.substring_index(bare, ".", -1))


def replace_all(col: Column, texts: list[str], by: str = "") -> Column:
    return reduce(lambda c, t: F.replace(c, F.lit(t), F.lit(by)), texts, col)


def container_domain(name: Column, layer: str) -> Column:
    """Container name without its layer prefixes, used to pick writers by name."""
    return replace_all(F.lower(name), fixed.DOMAIN_STRIPS[layer])


def after_first_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"^[^/]*/", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    name = base_name(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def printable(col: Column) -> Column:
    """Drop control characters that spreadsheet cells reject."""
    return F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def cut(col: Column, chars: int) -> Column:
    return F.substring(col.cast("string"), 1, chars)


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))


def capitalize(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 2**31 - 1)))


def safe_file_name(col: Column) -> Column:
    return F.translate(col, " /", "__")


def dotted(*parts: Column) -> Column:
    """Fully qualified name; a null part counts as empty, so every dot is kept."""
    return F.concat_ws(".", *[F.coalesce(p, F.lit("")) for p in parts])


def title_case(col: Column) -> Column:
    """Upper-case the first letter after any non-letter, lower-case the others."""
    runs = F.regexp_extract_all(col, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def visual_display_name(visual_type: Column) -> Column:
    pairs = [F.lit(v) for kv in fixed.VISUAL_NAMES.items() for v in kv]
    known = F.try_element_at(F.create_map(*pairs), visual_type)
    spaced = strip(F.regexp_replace(visual_type, r"([A-Z])", r" $1"))
    return F.coalesce(known, title_case(spaced))


def detect_item_layer(name: Column, description: Column) -> Column:
    """Layer of an item from its name and description: bronze before silver before gold."""
    text = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    return F.coalesce(_first_keyword(text, fixed.LAYERS_ITEM_PRIORITY), F.lit("Unknown"))


def detect_activity_layer(name: Column) -> Column:
    """Layer an activity writes, from its name: gold before silver before bronze; else null."""
    return _first_keyword(F.lower(name), fixed.LAYERS_ACTIVITY_PRIORITY)


def _first_keyword(text: Column, words: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w.capitalize())) for w in words])


def layer_before(layer: Column) -> Column:
    pairs = [F.lit(v) for kv in fixed.LAYER_BEFORE.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), layer)


def layer_rank(layer: Column) -> Column:
    chain = F.lit(None).cast("int")
    for name, rank in fixed.LAYER_RANK.items():
        chain = F.coalesce(chain, F.when(layer == name, F.lit(rank)))
    return F.coalesce(chain, F.lit(fixed.OTHER_LAYER_RANK))
