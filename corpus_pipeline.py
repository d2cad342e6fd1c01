"""A training corpus from the documents table in five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catloom.llm import decontaminate, language_id, line_dedup, minhash, packing
from catloom.llm.common import Kept, delete_folder
from catloom.session import checkpoint_folder


SIMILAR = 80  # percent of shared shingles from which two documents are near-duplicates
BANDS, ROWS = 25, 4  # a pair at 80 percent meets in no band twice in about 10**6 pairs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language the network tells with a probability of 0.4 or more; it fills null ``lang``. Others (null too) go.

    Of the 10,000 documents at sf0.1 the rule on the network takes two, a line of an address and digits and one of eleven letters.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that are later copies; ``n_chars`` follows the text.

    A document that loses lines and has no visible character left goes, since all of it stands elsewhere.
    """
    cleaned = line_dedup.delete_repeats(docs)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("gone") > 0, size).otherwise(F.col("doc.n_chars"))
    cleaned = cleaned.where((F.size("gone") == 0) | F.col("text").rlike("\\S"))
    return cleaned.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), the one with the smallest doc_id."""
    return minhash.first_of_group(docs, percent=SIMILAR, bands=BANDS, rows=ROWS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, digest=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The language network and the tokenizer are not SQL; tests/llm/test_pipeline.py holds the pipeline to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again.

    Once a stage's result is written, the tables it kept and its predecessor's result are deleted.
    """
    root = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        mark = len(Kept.roots)
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        Kept.drop_since(spark, mark)
        if before:
            delete_folder(spark, f"{root}/{before}")
        docs, before = spark.read.parquet(f"{root}/{name}"), name
    return docs
