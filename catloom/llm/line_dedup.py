"""Line deduplication by a suffix array over line sequences, with DataFrame functions only.

A text is lines between line feeds. Lines are ranked by their first place in the corpus; prefix doubling then ranks the
sequences of 2, 4, ... lines that start at a line by the pair of ranks at it and ``h`` lines on, for as long as sequences
are not unique and shorter than ``run`` lines. Equal ranks in the array mark a common prefix of that many lines, and the
union of such prefixes is a maximal repeated run. A line is deleted if it lies in a run of at least ``run`` lines that also
starts at an earlier place (smaller doc_id, or the same document and a smaller line number), or if the line alone is such
a run and has at least ``line_chars`` characters. So a long line that many documents share stays once, and short lines go only
as part of a longer copy.

Edge cases: a null or empty text has no lines and stays as it is; rows without a doc_id take no part; rows that share a doc_id
count as one place after the other, ordered by the hash of their text, and equal rows among them are not told apart, so
neither is deleted for the other; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catloom.llm.common import Kept

RUN = 4
LINE_CHARS = 40


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), i, two hashes and the length of each line."""
    line = F.posexplode(F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.length(x).alias("chars"))))
    rows = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.select("doc_id", "th", line.alias("i", "line")).select("doc_id", "th", "i", "line.*")


def _ranked(rows: DataFrame, keys: list[str], kept: Kept) -> DataFrame:
    """The rows whose keys are not unique, with ``rank``: the first place (doc_id, th, i) with these keys."""
    firsts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "th", "i")).alias("rank")).where("_n > 1")
    return rows.join(kept.table(firsts.drop("_n"), f"firsts-{len(keys)}-{uuid.uuid4().hex}"), keys)


def repeated_lines(docs: DataFrame, *, run: int = RUN, line_chars: int = LINE_CHARS) -> DataFrame:
    """doc_id, th, gone (sorted line numbers to delete) of the documents that lose lines."""
    kept = Kept(docs.sparkSession, "lines")
    place = F.struct("doc_id", "th", "i")
    ranks = kept.table(_ranked(_placed(docs), ["h1", "h2"], kept).select("doc_id", "th", "i", "chars", "rank"), "rank-1")
    later = F.col("rank") != place
    gone = [ranks.where(later & (F.col("chars") >= line_chars)).select("doc_id", "th", F.col("i").alias("lo"), F.col("i").alias("hi"))]
    length = 1
    while length < run:
        step = min(length, run - length)
        order = Window.partitionBy("doc_id", "th").orderBy("i").rangeBetween(step, step)
        pairs = ranks.select("doc_id", "th", "i", F.col("rank").alias("one"), F.first("rank").over(order).alias("two")).where("two is not null")
        length += step
        ranks = kept.table(_ranked(pairs, ["one", "two"], kept).select("doc_id", "th", "i", "rank"), f"rank-{length}")
    gone.append(ranks.where(later).select("doc_id", "th", F.col("i").alias("lo"), (F.col("i") + run - 1).alias("hi")))
    numbers = gone[0].unionByName(gone[1]).groupBy("doc_id", "th").agg(F.collect_set(F.sequence("lo", "hi")).alias("parts"))
    return numbers.select("doc_id", "th", F.array_sort(F.array_distinct(F.flatten("parts"))).alias("gone"))


def delete_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc (a struct of all columns as they were), text without the deleted lines, gone (their numbers), n_lines; all rows."""
    gone = repeated_lines(docs.select("doc_id", "text"), **options)
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    both = packed.join(gone, (F.col("_id") == gone["doc_id"]) & (F.col("_th") == gone["th"]), "left")
    old = F.col("doc.text")
    lines = F.split(old, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return both.select(
        "doc", text.alias("text"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
        F.when(old != "", F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
    )
