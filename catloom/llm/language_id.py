"""Language identification by a byte convolutional network.

Each byte is embedded, filters of several widths run over fixed-length windows, the largest response of a filter in a window
is one feature, and a softmax layer reads the features. Filters narrower than the widest one are padded with zeros, so one
matrix product applies all of them. A document is read whole: its windows' logits are averaged, weighted by their bytes.
Everything is numpy; Spark gives the training windows to the driver and sends the finished network (some KB) to the tasks.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; without any training row every text does. Ties
between languages go to the first in name order. Repeated rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import lower_ascii, slices, split_row, text_buffer

UNDETERMINED = "und"
TRAIN_DOCS = 3000  # labelled documents the network is fitted on at most, shared evenly among the languages
REJECT_BELOW = 0.4  # a document whose likeliest language is less probable has none; of 10,000 documents at sf0.1 two are
TRAIN_WINDOWS = 4  # windows taken from each of them
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # widest * EMBED x features
    bias: np.ndarray
    out: np.ndarray  # features x languages
    out_bias: np.ndarray

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Logits of byte windows (rows of WINDOW bytes, padded with 0)."""
        n, length = data.shape
        widest = max(WIDTHS)
        found = np.empty((n, self.filters.shape[1]), np.float32)
        step = 128  # windows at a time, so that the responses stay in cache
        for lo in range(0, n, step):
            part = self.embed[np.pad(data[lo : lo + step], ((0, 0), (0, widest - 1)))]
            seen = np.lib.stride_tricks.sliding_window_view(part, widest, axis=1)  # rows, positions, EMBED, widest
            flat = np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(-1, widest * EMBED)
            found[lo : lo + step] = (flat @ self.filters).reshape(len(part), length, -1).max(axis=1)
        return np.maximum(found + self.bias, 0) @ self.out + self.out_bias

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of each text's languages; texts without bytes get zeros."""
        sizes = np.diff(offsets)
        count = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), count)
        start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        size = np.minimum(WINDOW, offsets[owner + 1] - start)
        padded = np.concatenate([lower_ascii(data), np.zeros(WINDOW, np.uint8)])
        result = np.zeros((len(sizes), len(self.languages)))
        for lo in range(0, len(owner), 4096):
            at = slice(lo, lo + 4096)
            rows = padded[start[at, None] + np.arange(WINDOW)]
            rows[np.arange(WINDOW) >= size[at, None]] = 0
            np.add.at(result, owner[at], self.windows(rows) * size[at, None])
        full = sizes > 0
        mean = result[full] / sizes[full, None]
        e = np.exp(mean - mean.max(axis=1, keepdims=True))
        result[full] = e / e.sum(axis=1, keepdims=True)
        return result


def fit(texts: list[bytes], labels: list[str], *, epochs: int = 4, batch: int = 64, seed: int = 5) -> Network:
    """Train by Adam on windows of the texts; some are cut short, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    widest, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((widest, EMBED, total), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(widest * EMBED, total)
    embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
    embed[0] = 0
    net = Network(
        languages, embed, (rng.normal(0, 0.2, mask.shape) * mask).astype(np.float32), np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    windows, answers = [], []
    for text, label in zip(texts, labels):
        data = lower_ascii(np.frombuffer(text, np.uint8))
        for _ in range(TRAIN_WINDOWS):
            size = WINDOW if rng.random() < 0.5 else int(rng.integers(12, WINDOW))
            at = int(rng.integers(0, max(1, len(data) - size + 1)))
            row = np.zeros(WINDOW, np.uint8)
            row[: len(data[at : at + size])] = data[at : at + size]
            windows.append(row)
            answers.append(languages.index(label))
    x, y = np.array(windows), np.array(answers)
    names = ["embed", "filters", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            step += 1
            grads = _gradients(net, x[order[lo : lo + batch]], y[order[lo : lo + batch]], mask)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
            net.embed[0] = 0
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    n, length = x.shape
    widest = max(WIDTHS)
    padded = np.pad(x, ((0, 0), (0, widest - 1)))
    seen = np.lib.stride_tricks.sliding_window_view(net.embed[padded], widest, axis=1)
    flat = np.ascontiguousarray(seen.transpose(0, 1, 3, 2)).reshape(n, length, widest * EMBED)
    response = flat.reshape(-1, widest * EMBED) @ net.filters
    response = response.reshape(n, length, -1)
    top = response.argmax(axis=1)  # n x features
    rows = np.arange(n)[:, None]
    before = response[rows, top, np.arange(top.shape[1])] + net.bias
    hidden = np.maximum(before, 0)
    logits = hidden @ net.out + net.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ net.out.T) * (before > 0)  # n x features
    inputs = flat[rows, top]  # n x features x widest*EMBED
    d_filters = np.einsum("nf,nfe->ef", back, inputs) * mask
    d_inputs = (back[:, :, None] * net.filters.T[None]).reshape(n, -1, widest, EMBED)
    d_embed = np.zeros_like(net.embed)
    at = padded[rows[:, :, None], top[:, :, None] + np.arange(widest)]
    np.add.at(d_embed, at, d_inputs)
    return {"embed": d_embed, "filters": d_filters, "bias": back.sum(0), "out": hidden.T @ p, "out_bias": p.sum(0)}


def train(labelled: DataFrame, *, train_docs: int = TRAIN_DOCS) -> Network | None:
    """Fit on a fixed pseudo-random sample of at most ``train_docs`` rows (text, lang), evenly by language."""
    usable = labelled.where("lang is not null and text rlike '\\\\p{L}'").select("text", "lang")
    names = [r[0] for r in usable.select("lang").distinct().orderBy("lang").collect()]
    if not names:
        return None
    # Only a stretch at a random place of each text is used, so only that much of it reaches the driver.
    width = TRAIN_WINDOWS * WINDOW
    start = 1 + F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - width)).cast("int")
    cut = usable.select("lang", F.xxhash64("text").alias("h"), F.substr("text", start, F.lit(width)).alias("text"))
    parts = [cut.where(F.col("lang") == name).orderBy("h").limit(-(-train_docs // len(names))) for name in names]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)
    rows = sorted((r.lang, r.h, r.text) for r in sample.collect())
    return fit([t.encode() for _, _, t in rows], [lang for lang, _, _ in rows])


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) as doc_id, lang_pred, score; score is the probability of lang_pred."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = sent.value
        for batch in slices(batches):
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            n = batch.num_rows
            best, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            if net is not None and letters.any():
                p = net.documents(*text_buffer(batch.column("text")))
                best[letters] = np.array(net.languages, object)[p.argmax(axis=1)][letters]
                score[letters] = p.max(axis=1)[letters]
            yield pa.record_batch([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, network: Network | None, least: float = REJECT_BELOW) -> DataFrame:
    """The rows whose text has a letter and whose language the network tells with a probability of ``least`` or more.

    Where ``lang`` is null it becomes the network's language; other columns stay as they were. Without a network (no labelled row) all rows
    with a letter stay, null languages too.
    """
    lettered = docs.where(F.coalesce(F.col("text").cast("string").rlike("\\p{L}"), F.lit(False)))
    if network is None:
        return lettered
    named = predict(lettered.select(F.struct("*").alias("doc_id"), F.col("text").cast("string").alias("text")), network).where(F.col("score") >= least)
    columns = {c: F.col(f"doc_id.`{c}`") for c in docs.columns}
    if "lang" in columns:
        columns["lang"] = F.coalesce(columns["lang"], F.col("lang_pred").cast(docs.schema["lang"].dataType))
    return named.select(*[c.alias(name) for name, c in columns.items()])


def identify(docs: DataFrame, *, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the rows outside the held-out fold."""
    held_out = F.coalesce(split_row(F.col("doc_id")) == 0, F.lit(False))
    network = train(docs.where(~held_out), train_docs=train_docs)
    found = predict(docs.select(F.col("doc_id").cast("long"), "text"), network)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
