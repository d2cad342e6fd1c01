"""Removal of passages that appeared in an earlier document, found by repeated-phrase automata.

Texts are words ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if a window of ``window`` consecutive words covers it
whose words also start in a document with a smaller doc_id; windows are judged on the input. The look at window anchors
(repeats.py) leaves the runs of windows that recur as a whole, and those whose surroundings differ from place to place.
For the latter the recurring phrases, windows that start in several documents, are confirmed by counting. They are compiled
into Aho-Corasick automata over word numbers, one for each shard of phrases, and the open contexts are streamed through
their shard's automaton, which locates every occurrence. Contexts around a frequent phrase are dealt over several tasks.

Edge cases: null and empty texts have no words; rows without a doc_id come after all others; rows that share a doc_id do not
remove each other's words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import SPACE_WORDS, Spans, removed_spans, slices, text_buffer, word_hashes, word_spans
from catloom.llm.repeats import Found, Kind, first_look, keyed, place, runs_by_text

WINDOW = 50
PROBE = 16
SHARD_PHRASES = 4000  # phrases in an automaton, on average
SHARD_CONTEXTS = 20_000  # contexts streamed by one task, on average


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(batch.column("text"))
    starts, ends, first = word_spans(data, offsets, SPACE_WORDS)
    return word_hashes(data, starts, ends), first


def recurring_phrases(found: Found, kind: Kind) -> DataFrame:
    """probe, phrase (its word hashes, binary), least: the windows of open contexts that start in several documents."""
    size = kind.window * 8

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "symbols", 1_000_000):
            far, near = (batch.column(c).to_numpy() for c in ("far", "near"))
            count = far - near + 1
            rows = np.repeat(np.arange(batch.num_rows), count)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)  # window number in its context
            data, base = text_buffer(batch.column("symbols"))
            rank = Spans(data.view(np.uint64)).of(base[rows] // 8 + at, base[rows] // 8 + at + kind.window).view(np.int64)
            take = pa.array(rows)
            yield pa.record_batch(
                [batch.column("probe").take(take), batch.column("context").take(take), batch.column("first").take(take), pa.array(at.astype(np.int32)), pa.array(rank)],
                ["probe", "context", "first", "at", "rank"],
            )

    windows = found.kept.table(found.open.mapInArrow(cut, "probe long, context long, first long, at int, rank long"), "windows")
    ranks = windows.groupBy("probe", "rank").agg(
        F.min("first").alias("least"), F.max("first").alias("most"), F.min(F.struct("context", "at")).alias("one")
    ).where("least < most")
    shown = ranks.select("probe", "rank", "least", F.col("one.context").alias("context"), F.col("one.at").alias("at"))
    text = found.open.select("probe", "context", "symbols")
    phrase = F.expr(f"substring(symbols, at * 8 + 1, {size})")
    return shown.join(text, ["probe", "context"]).select("probe", phrase.alias("phrase"), "least")


def dealt(found: Found, phrases: DataFrame, shard_phrases: int, shard_contexts: int) -> tuple[DataFrame, DataFrame]:
    """The phrases and the contexts to search for them, both with the ``shard`` and ``part`` of the task they go to.

    Contexts of a probe without a phrase have nothing to find and stay out. There are as many shards as the larger of
    both sides needs; a probe with many contexts is dealt over several parts, each with the distinct phrases of that probe.
    """
    asked = found.open.where("target")
    probes = found.kept.table(phrases.select("probe").distinct(), "phrase-probes")
    counts = asked.groupBy("probe").agg(F.count(F.lit(1)).alias("n")).join(probes, "probe")
    deal = found.kept.table(counts.withColumn("deal", F.ceil(F.col("n") / shard_contexts).cast("int")), "deal")
    contexts = deal.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-phrases.count() // shard_phrases), -(-contexts // shard_contexts))
    shard = F.pmod(F.xxhash64("probe"), F.lit(shards)).alias("shard")
    left = phrases.join(deal, "probe").select(shard, F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("part"), "phrase", "least")
    part = F.pmod(F.xxhash64("context"), F.col("deal")).cast("int").alias("part")
    right = asked.join(deal, "probe").select(shard, part, "probe", "context", "first", "far", "near", "symbols")
    return left, right


def locate(found: Found, kind: Kind, *, shard_phrases: int = SHARD_PHRASES, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """probe, context, first, far, near of the windows of open contexts that start in an earlier document."""
    phrases = found.kept.table(recurring_phrases(found, kind), "phrases")
    left, right = dealt(found, phrases, shard_phrases, shard_contexts)
    words = kind.window

    def stream(phrases: pd.DataFrame, contexts: pd.DataFrame) -> pd.DataFrame:
        hits = {"probe": [], "context": [], "first": [], "far": [], "near": []}
        if len(phrases) and len(contexts):
            texts = np.frombuffer(b"".join(phrases["phrase"]), np.uint64)
            numbers, own = np.unique(texts, return_inverse=True)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for row, least in zip((own + 1).reshape(-1, words).tolist(), phrases["least"]):
                automaton.add_word(tuple(row), int(least))
            automaton.make_automaton()
            for probe, context, first, far, near, blob in contexts[["probe", "context", "first", "far", "near", "symbols"]].itertuples(index=False):
                text = np.frombuffer(blob, np.uint64)
                slot = np.minimum(np.searchsorted(numbers, text), len(numbers) - 1)
                known = np.where(numbers[slot] == text, slot + 1, 0)
                for end, least in automaton.iter(tuple(known.tolist())):
                    if least < first:
                        distance = far - (end + 1 - words)
                        for column, value in zip(hits.values(), (probe, context, first, distance, distance)):
                            column.append(value)
        return pd.DataFrame(hits).astype({"probe": "int64", "context": "int64", "first": "int64", "far": "int32", "near": "int32"})

    pairs = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part"))
    return pairs.applyInPandas(stream, "probe long, context long, first long, far int, near int")


def remove_earlier(docs: DataFrame, *, window: int = WINDOW, probe: int = PROBE, **options) -> DataFrame:
    """doc_id, n_words, spans array<struct<lo,hi>> (removed word ranges), kept (words left, joined by one space), kept_sha256."""
    kind = Kind(_words, lambda units: units, "uint64", window, probe, earlier=True)
    found = first_look(docs, kind, "phrases")
    runs = place(found, locate(found, kind, **options), kind)
    grouped = runs_by_text(runs)
    none = F.array().cast(grouped.schema["runs"].dataType)
    texts = keyed(docs).join(grouped, ["did", "th"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_buffer(batch.column("text"))
            starts, ends, first = word_spans(data, offsets, SPACE_WORDS)
            owner, lo, hi = removed_spans(batch, first, window)
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, lo, 1)
            np.add.at(gone, hi, -1)
            stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            # The words left with one space after each; then cut by document.
            sizes = ends[stay] - starts[stay] + 1
            at = np.concatenate([[0], np.cumsum(sizes)])
            text = np.full(at[-1], 0x20, np.uint8)
            inside = np.ones(at[-1], bool)
            inside[at[1:] - 1] = False
            text[inside] = data[(np.repeat(starts[stay] - at[:-1], sizes) + np.arange(at[-1]))[inside]]
            cut_at = np.searchsorted(stay, first)
            kept = [text[a : b - 1].tobytes() if b > a else b"" for a, b in zip(at[cut_at[:-1]], at[cut_at[1:]])]
            firsts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            spans = pa.StructArray.from_arrays([pa.array(lo - first[owner]), pa.array(hi - first[owner])], ["lo", "hi"])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), spans), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["doc_id", "n_words", "spans", "kept", "kept_sha256"],
            )

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(cut, f"doc_id {kind_of_id}, n_words long, spans array<struct<lo:long,hi:long>>, kept string, kept_sha256 string")
