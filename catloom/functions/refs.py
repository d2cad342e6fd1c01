"""Reference extraction from script, dataflow and measure texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catloom.functions import fixed, text

# Case-blind, with Unicode white space and word characters.
_FLAGS = "(?iU)"
_FLAGS_DOTALL = "(?isU)"


def _all(source: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(group))


def case_folded(source: Column) -> Column:
    """Text in which a case-blind match of an ASCII word shows as that word in lower case."""
    return F.lower(F.upper(source))


def _found(source: Column, folded: Column, hint: str, pattern: str) -> Column:
    """Matches of a pattern; a text without the hint cannot match and skips the regular expression."""
    return F.when(F.contains(folded, F.lit(hint)), _all(source, pattern)).otherwise(F.array().cast("array<string>"))


def script_writes(source: Column, folded: Column, mode: str = "compat") -> Column:
    """Sorted distinct tables a script writes. ``folded`` is ``case_folded(source)``."""
    sql_pattern = fixed.SQL_WRITE_PATTERN if mode == "compat" else fixed.SQL_WRITE_PATTERN_STRICT
    found = [_found(source, folded, hint, _FLAGS + p) for hint, p in fixed.WRITE_PATTERNS]
    found.append(_found(source, folded, fixed.SQL_WRITE_TEXT, _FLAGS_DOTALL + sql_pattern))
    refs = F.transform(F.concat(*found), text.clean_ref)
    return F.array_sort(F.array_distinct(F.filter(refs, lambda r: r != "")))


def script_read_candidates(source: Column, folded: Column, mode: str = "compat") -> Column:
    """Distinct tables named in read positions. ``folded`` is ``case_folded(source)``.

    ``compat`` keeps every match. ``strict`` passes over import lines and references that hold a slash.
    """
    body = source if mode == "compat" else F.regexp_replace(source, fixed.IMPORT_LINE, "")
    found = F.concat(*[_found(body, folded, hint, _FLAGS + p) for hint, p in fixed.READ_PATTERNS])
    if mode != "compat":
        found = F.filter(found, lambda r: ~F.contains(r, F.lit("/")))
    noise = F.array(*[F.lit(w) for w in fixed.READ_NOISE])
    refs = F.filter(
        F.transform(found, text.clean_ref),
        lambda r: (r != "") & ~F.startswith(r, F.lit("/")) & ~F.array_contains(noise, r),
    )
    return F.array_sort(F.array_distinct(refs))


def dataflow_reads(query: Column) -> Column:
    """Sorted distinct quoted names of a dataflow text longer than two characters."""
    names = F.filter(_all(query, fixed.DATAFLOW_PATTERN), lambda r: F.length(r) > 2)
    return F.array_sort(F.array_distinct(F.transform(names, lambda r: F.replace(F.lower(r), F.lit(" "), F.lit("_")))))


def dax_tokens(expr: Column, mode: str = "compat") -> Column:
    """Distinct lower-case texts of a measure expression that may name a table.

    Owners of column references, and words that stand alone. ``strict`` also takes the last word of a
    column owner, so a keyword in front of it does not hide the table.
    """
    columns = _all(expr, fixed.DAX_COLUMN_PATTERN, 0)
    # A whole match is 'Name' with a bracket, or a bare name with a bracket.
    owners = F.transform(
        columns,
        lambda m: F.lower(
            F.when(F.startswith(m, F.lit("'")), text.strip(F.substring_index(F.substring(m, 2, 2**31 - 1), "'", 1)))
            .otherwise(F.trim(F.substring_index(m, "[", 1)))
        ),
    )
    words = _all(F.lower(expr), fixed.DAX_WORD_PATTERN, 0)
    found = [owners, words]
    if mode != "compat":
        found.append(F.transform(owners, lambda r: F.substring_index(r, " ", -1)))
    return F.array_distinct(F.filter(F.concat(*found), lambda r: r != ""))
