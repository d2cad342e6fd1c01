"""Toxicity scores of texts restored from obfuscated spelling by a noisy channel.

A writer who wants to be read but not found replaces letters by look-alikes (``5tup1d``), sets them apart (``s t u p i d``) or
repeats them (``stuupid``), or all of these. Such spots are found by their shape; the rest of a text is taken as it stands. For a spot the
channel gives a lattice: each character may stand for itself, for a letter it looks like, or for nothing (a separator between
single symbols, a repeated symbol). Viterbi decoding finds the cheapest path under a character trigram model counted over
all texts. A text's features are the whole words and the first 4, 5 and 6 bytes of words, both as written and as restored; a
logistic model over the features that tell toxic from other rows gives the score.

Edge cases: null and empty texts, and texts without any known feature, get the score of no evidence; with labels of one
kind only, or none, every score is 0; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import Kept, Spans, byte_symbols, lower_ascii, slices, split_row, text_buffer, word_spans

TRAIN_ROWS = 12_000  # labelled rows the classifier is fitted on at most, half of them toxic if there are so many
FEATURES = 6000  # features the classifier may read
MIN_TOXIC_ROWS = 4  # toxic training rows that must hold a feature
PREFIXES = (4, 5, 6)

# Which letters a character may stand for (fixed values).
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_COST_LOOK, _COST_SAME_ODD, _COST_DROP = 1.0, 6.0, 0.7
# Letters for words and features: ASCII letters and every byte of a non-ASCII character.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CLASS = np.full(256, 27, np.int64)  # 0 border, 1-26 letters, 27 any other letter byte
_CLASS[range(0x61, 0x7B)] = np.arange(1, 27)
_CLASS[[*range(0x00, 0x61), *range(0x7B, 0x80)]] = 0
_STATES = 28

_ODD = "".join(re.escape(c) for c in LOOKS_LIKE)
_APART = rf"(?:[^\w{_ODD}]|_){{1,3}}"  # between single symbols: anything but letters, digits and look-alikes
_SPOT = re.compile(
    rf"(?<![^\W_])(?=(?:[{_ODD}]{_APART})*[a-z](?![^\W_]))(?:[a-z{_ODD}]{_APART}){{3,}}[a-z{_ODD}](?![^\W_])"  # single symbols set apart
    rf"|(?<![a-z{_ODD}])(?=[{_ODD}]*[a-z])(?=[a-z]*[{_ODD}])[a-z{_ODD}]{{3,}}"  # letters with look-alikes
    rf"|\b(?=[a-z]*([a-z])\1)[a-z]{{4,}}\b"  # a letter twice or more in a row
)


@dataclass
class Channel:
    """The decoder: costs of trigrams (negative logarithms) and a memory of spots that were decoded."""

    costs: np.ndarray  # _STATES ** 3
    known: dict[str, str] = field(default_factory=dict)

    def restore(self, spot: str) -> str:
        if len(spot) > 64:
            return self._decode(spot)
        if spot not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[spot] = self._decode(spot)
        return self.known[spot]

    def _decode(self, spot: str) -> str:
        # By the last two letters: cost, and the text as its last letter behind the text before it.
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        last = ""
        for c in spot:
            if not ("a" <= c <= "z" or c in LOOKS_LIKE):  # a separator, the same price on every path
                paths = {key: (cost + _COST_DROP, text) for key, (cost, text) in paths.items()}
                continue
            options = [(c, 0.0)] if "a" <= c <= "z" else [*((x, _COST_LOOK) for x in LOOKS_LIKE[c]), ("", _COST_SAME_ODD)]
            if c == last:
                options.append(("", _COST_DROP))
            last = c
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, text) in paths.items():
                for out, price in options:
                    if out:
                        x = ord(out) - 96
                        key, total = (b, x), cost + price + self.costs[(a * _STATES + b) * _STATES + x]
                    else:
                        key, total = (a, b), cost + price
                    if key not in following or total < following[key][0]:
                        following[key] = (total, (text, out) if out else text)
            paths = following
        text = min(((cost + self.costs[(a * _STATES + b) * _STATES], text) for (a, b), (cost, text) in paths.items()), key=lambda x: x[0])[1]
        letters = []
        while text:
            text, letter = text
            letters.append(letter)
        return "".join(reversed(letters))


def restored_words(text: str, channel: Channel) -> list[str]:
    """The decoded words of a lower-cased text's spots."""
    return [w for m in _SPOT.finditer(text) if (w := channel.restore(m.group())) and w != m.group()]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over the whole texts (a fixed table of 28**3 numbers)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_STATES**3, np.int64)
        for batch in slices(batches):
            data, offsets = text_buffer(batch.column("text"))
            cls = np.insert(_CLASS[lower_ascii(data)], offsets, 0)  # a border before each text and at the end
            cls = cls[(cls > 0) | (np.concatenate([[1], cls[:-1]]) > 0)]  # one border between words
            cls = np.concatenate([[0], cls])
            if len(cls) > 2:
                # The first letter of a word is judged after two borders.
                code = (cls[:-2] * _STATES + cls[1:-1]) * _STATES + cls[2:]
                code = np.where(cls[1:-1] == 0, cls[2:], code)
                total += np.bincount(code, minlength=_STATES**3)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(_STATES**3)
    for row in rows.collect():
        counts[row.code] = row.n
    return counts


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative logarithms of the next letter's probability, trigrams mixed with bigrams and letters."""
    three = counts.reshape(_STATES, _STATES, _STATES) + 1e-9
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + _STATES)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).ravel()


def _features(batch: pa.RecordBatch, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature hashes of all words of a batch, as written and as restored (not made distinct)."""
    raw, offsets = text_buffer(batch.column("text"))
    data = lower_ascii(raw)
    extra: list[str] = []
    for i in range(batch.num_rows):
        own = data[offsets[i] : offsets[i + 1]].tobytes()
        extra.append(" ".join(restored_words(own.decode("utf-8", "replace"), channel)))
    rows, hashes = [], []
    more, more_offsets = text_buffer(pa.array(extra, pa.string()))
    for data, offsets in ((data, offsets), (more, more_offsets)):
        starts, ends, first = word_spans(data, offsets, _WORD)
        spans = Spans(byte_symbols(data))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
        rows.append(owner)
        hashes.append(spans.of(starts, ends))
        for size in PREFIXES:
            long = ends - starts > size
            rows.append(owner[long])
            hashes.append(spans.of(starts[long], starts[long] + size) ^ np.uint64(size))
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def _distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


@dataclass
class Model:
    channel: Channel
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        total = np.full(batch.num_rows, self.bias)
        if len(self.features):
            rows, values = _features(batch, self.channel)
            at = np.minimum(np.searchsorted(self.features, values), len(self.features) - 1)
            hit = self.features[at] == values
            rows, at = _distinct(rows[hit], at[hit])
            np.add.at(total, rows, self.weights[at])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _logistic(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features, both labels weighted alike, by gradient steps with momentum.

    Each step hides half of the features at random, so that one telling word alone is enough evidence.
    """
    rng = np.random.default_rng(11)
    weights, bias, speed = np.zeros(n_features), 0.0, np.zeros(n_features + 1)
    scale = np.bincount(columns, minlength=n_features) / len(labels) + 0.005
    share = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(1200):
        seen = rng.random(len(rows)) < 0.5
        row, column = rows[seen], columns[seen]
        total = bias + 2 * np.bincount(row, weights[column], len(labels))
        error = share * (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels)
        step = np.bincount(column, error[row], n_features) / len(labels) + 1e-5 * weights
        speed = 0.9 * speed + np.append(step / scale, error.mean() * 4)
        weights, bias = weights - 0.2 * speed[:-1], bias - 0.2 * speed[-1]
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, channel: Channel, kept: Kept, *, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most ``train_rows`` labelled documents, the first of each label in a fixed pseudo-random order of ids.

    The ids are chosen without their texts; being so few, they are then broadcast to the scan of the texts.
    """
    with_text = docs.where("text is not null").select("doc_id").distinct()
    known = with_text.join(labels.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "doc_id")
    half = train_rows // 2
    parts = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for label in (0, 1)]
    chosen_ids = kept.table(parts[0].unionByName(parts[1]), "chosen-ids")
    rows = docs.where("text is not null").join(F.broadcast(chosen_ids), "doc_id").select("text", "toxic")
    sample = kept.table(rows.withColumn("row", F.monotonically_increasing_id()), "sample")
    none = Model(channel, np.zeros(0, np.int64), np.zeros(0), -30.0)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return none
    sent = sample.sparkSession.sparkContext.broadcast(channel)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, values = _distinct(*_features(batch, sent.value))
            yield pa.record_batch([batch.column("row").take(pa.array(at)), batch.column("toxic").take(pa.array(at)), pa.array(values)], ["row", "toxic", "feature"])

    spread = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism, "row")
    held = kept.table(spread.select("row", "toxic", "text").mapInArrow(cut, "row long, toxic int, feature long"), "features")
    counts = held.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    rate = (F.col("bad") + 0.5) / sizes[1] / ((F.col("all") - F.col("bad") + 0.5) / sizes[0])
    telling = counts.where(f"bad >= {MIN_TOXIC_ROWS}").withColumn("gain", F.log(rate) * F.sqrt("bad")).where(rate > 3)
    chosen = telling.orderBy(F.desc("gain"), "feature").limit(features).select("feature")
    chosen = kept.table(chosen, "chosen")
    names = np.sort(np.array([r.feature for r in chosen.collect()], np.int64))
    if not len(names):
        return none
    labels = {r.row: r.toxic for r in sample.select("row", "toxic").collect()}
    order = {row: i for i, row in enumerate(sorted(labels))}
    pairs = held.join(F.broadcast(chosen), "feature").select("row", "feature").toPandas().sort_values(["row", "feature"])
    y = np.array([labels[row] for row in sorted(labels)], float)
    at = np.array([order[row] for row in pairs["row"]], np.int64)
    weights, bias = _logistic(at, np.searchsorted(names, pairs["feature"].to_numpy(np.int64)), y, len(names))
    return Model(channel, names, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (probability of label 1) of the rows of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(sent.value.scores(batch))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels are learned outside the held-out fold only."""
    kept = Kept(docs.sparkSession, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    channel = Channel(trigram_costs(trigram_counts(texts)))
    held_out = F.coalesce(split_row(F.col("doc_id")) == 0, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long"), "toxic").where(F.col("toxic").isNotNull() & (split_row(F.col("doc_id")) != 0))
    model = train(texts, known, channel, kept, **options)
    return score(texts, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
