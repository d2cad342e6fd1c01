"""Phrases of two to five words that occur often, with a score of how firmly their parts belong together.

Counting is a multikey quicksort of suffix pointers that stops at ``DEPTH`` words. A suffix is a place in a piece of text with the
words that follow it there. Suffixes are dealt to tasks by their leading words: by the first one, and by one more for as long as the
words before lead more than ``GROUP_WORDS`` places (``heavy`` prefixes, whose counts are found one length at a time and so are
known beforehand). A task holds all suffixes that begin with the words it was dealt. It parts pointers in three by
a pivot word, the part with equal words is a phrase and its size the phrase's count, and parts smaller than the least
count are abandoned.

Before suffixes are dealt, equal ones of a slice of text become one with a count, and those that begin with a word that is itself
too rare stay behind; a bitmap of fixed size tells that, and what it lets through in error is abandoned later.

Edge cases: a null or empty text has no words; rows with a null language count for ``und``; repeated rows count again, each phrase
once per place; other columns are ignored; an empty table gives an empty table. Texts longer than a slice are cut
at the ends of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catloom.llm.common import Kept, lower_ascii, mix, slices, text_buffer, word_hashes, word_spans
from catloom.llm.periodic_runs import coded_words, word_names

LEAST, DEPTH, TOP = 100, 5, 2000
SLICE_BYTES = 4_000_000  # text worked on at a time
GROUP_WORDS = 1_000_000  # places that one leading phrase may have in one task
MAX_HEAVY = 200_000  # heavy prefixes of one length that tasks are told of, at most; the groups grow beyond that
BITMAP = 1 << 22  # buckets of the words that are frequent enough
LINES = 200_000  # suffixes written or sorted at a time, but for a group that is larger
UNKNOWN = "und"
GROUP = ["lang", "lead", "part"]

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_TAIL_WORD = np.ones(256, bool)
_TAIL_WORD[[0x20, 0x0A]] = False


# --- words of a slice -----------------------------------------------------------------------------------------


@dataclass
class Words:
    """The words of a slice: their places in its bytes, languages, numbers, and where their pieces end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: np.ndarray  # number of the language, for each word
    name: np.ndarray  # number of the word
    piece_end: np.ndarray  # index of the word after the piece
    langs: list[str]
    vocabulary: pa.Array  # the words by number

    def text(self, i: int, j: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j]))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Bytes, offsets and languages of a slice; one very long text in parts that end where pieces end."""
    data, offsets = text_buffer(batch.column(1))
    lang = batch.column(0)
    if len(data) <= 2 * SLICE_BYTES:
        yield data, offsets, lang
        return
    for row in range(batch.num_rows):
        own = data[offsets[row] : offsets[row + 1]]
        ends = np.flatnonzero(_ENDS[own])
        at = 0
        while at < len(own):
            k = int(np.searchsorted(ends, at + SLICE_BYTES))
            upto = int(ends[k]) + 1 if k < len(ends) and at + SLICE_BYTES < len(own) else len(own)
            yield own[at:upto], np.array([0, upto - at]), lang.slice(row, 1)
            at = upto


def _words(data: np.ndarray, offsets: np.ndarray, lang: pa.Array) -> Words | None:
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, _WORD)
    if not len(starts):
        return None
    coded = lang.fill_null(UNKNOWN).dictionary_encode()
    of_text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    piece = np.cumsum(_ENDS[data])[starts] + text  # both grow, so a change of either is a change of the sum
    last = np.ones(len(starts), bool)
    last[:-1] = piece[1:] != piece[:-1]
    breaks = np.flatnonzero(last) + 1
    piece_end = breaks[np.searchsorted(breaks, np.arange(len(starts)), "right")]
    named = coded_words(data, starts, ends)
    name = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(data, starts, ends, of_text[text], name, piece_end, coded.dictionary.to_pylist(), named.dictionary.cast(pa.large_string()).cast(pa.string()))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in slices(batches, limit=SLICE_BYTES):
        for part in _parts(batch):
            words = _words(*part)
            if words is not None:
                yield words


def _counts(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    langs, phrases, sizes = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int64())], ["lang", "phrase", "a"])


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language and word number of each distinct pair, and its count."""
    base = len(words.vocabulary)
    pair = words.lang * base + words.name
    if base * len(words.langs) <= 8 * len(pair):
        count = np.bincount(pair, minlength=base * len(words.langs))
        some = np.flatnonzero(count)
        return some // base, some % base, count[some]
    some, count = np.unique(pair, return_counts=True)
    return some // base, some % base, count


def count_words(source: DataFrame) -> DataFrame:
    """lang, phrase (one word), a: how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _each(batches):
            lang, name, count = _distinct(words)
            yield pa.record_batch(
                [pa.array(words.langs, pa.string()).take(pa.array(lang)), words.vocabulary.take(pa.array(name)), pa.array(count, pa.int64())],
                ["lang", "phrase", "a"],
            )

    return source.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


# --- routing --------------------------------------------------------------------------------------------------


def _buckets(langs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The bitmap's bucket of each pair of a language's and a word's hash."""
    return (mix(words + mix(langs)) & np.uint64(BITMAP - 1)).astype(np.int64)


def _hashes(texts: pa.Array) -> np.ndarray:
    letters, ends = text_buffer(texts)
    return word_hashes(letters, ends[:-1], ends[1:])


def _bitmap(words: DataFrame) -> np.ndarray:
    """Which buckets hold a word; a few KB for each 32,768 buckets come to the driver, whatever the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.unique(_buckets(*map(_hashes, batch.columns))))], ["bit"])

    bits = words.select("lang", "phrase").mapInArrow(run, "bit long")
    parts = bits.groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    out = np.zeros(BITMAP, bool)
    for row in parts.collect():
        out[row.part * 32768 : (row.part + 1) * 32768] = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
    return out


class Guide:
    """What tasks know beforehand: which words may be frequent, and the heavy prefixes as a tree of (language or prefix, word)."""

    def __init__(self, frequent: np.ndarray, group_words: int) -> None:
        self.frequent, self.group_words = frequent, group_words
        self.nodes: dict[tuple[object, str], int] = {}
        self.buckets: list[int] = []  # of each heavy prefix
        self.depth = 0

    def add(self, prefixes: list[tuple[str, str, int]]) -> None:
        """The heavy prefixes (language, words, count) that are one word longer than those known so far."""
        for lang, phrase, count in prefixes:
            *before, word = phrase.split(" ")
            node: object = lang
            for w in before:
                node = self.nodes[node, w]
            self.nodes[node, word] = len(self.nodes)
            self.buckets.append(-(-2 * count // self.group_words))
        self.depth += 1

    def begins(self, words: Words) -> np.ndarray:
        """Whether each word may be frequent enough to begin a phrase."""
        lang, name, _ = _distinct(words)
        known = np.zeros(len(words.langs) * len(words.vocabulary), bool)
        hashes = _hashes(words.vocabulary)
        known[lang * len(words.vocabulary) + name] = self.frequent[_buckets(_hashes(pa.array(words.langs, pa.string()))[lang], hashes[name])]
        return known[words.lang * len(words.vocabulary) + words.name]

    def lead(self, words: Words, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest heavy prefix of each suffix, and the number of that prefix (-1: none)."""
        length, longest = np.zeros(len(reach), np.int64), np.full(len(reach), -1)
        if not self.nodes:
            return length, longest
        known = list(dict.fromkeys(word for _, word in self.nodes))
        places = pc.index_in(pa.array(known, pa.string()), value_set=words.vocabulary).to_pylist()
        number = {w: k for w, k in zip(known, places) if k is not None}
        names, lang = len(words.vocabulary), {x: -1 - k for k, x in enumerate(words.langs)}
        edges: dict[int, int] = {}
        for (parent, word), node in self.nodes.items():
            k, up = number.get(word), parent if isinstance(parent, int) else lang.get(parent)
            if k is not None and up is not None:
                edges[(up + len(lang)) * names + k] = node
        keys = np.sort(np.fromiter(edges, np.int64, len(edges)))
        to = np.array([edges[k] for k in keys.tolist()], np.int64)
        going, node = np.arange(len(reach)), -1 - words.lang
        for d in range(self.depth if len(keys) else 0):
            inside = reach[going] > d
            going, node = going[inside], node[inside]
            key = (node + len(lang)) * names + words.name[going + d]
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            heavy = keys[slot] == key
            going, node = going[heavy], to[slot[heavy]]
            length[going], longest[going] = d + 1, node
        return length, longest


def _reach(words: Words, depth: int) -> np.ndarray:
    """How many words, at most ``depth``, the suffix at each word has before its piece ends."""
    return np.minimum(words.piece_end - np.arange(len(words.starts)), depth)


def _sorted_suffixes(words: Words, group: np.ndarray, at: np.ndarray, upto: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of distinct suffixes (group, words at .. upto) in the order of group and words, and how often each occurs."""
    base = len(words.vocabulary) + 1
    columns = [np.where(at + d < upto, words.name[np.minimum(at + d, len(words.name) - 1)] + 1, 0) for d in range(depth)]
    columns.insert(0, group)
    packed = [columns[k] * base + columns[k + 1] if k + 1 < len(columns) else columns[k] for k in range(0, len(columns), 2)]
    order = np.lexsort(packed[::-1])
    new = np.zeros(len(at), bool)
    new[:1] = True
    for column in packed:
        own = column[order]
        new[1:] |= own[1:] != own[:-1]
    heads = np.flatnonzero(new)
    return order[heads], np.diff(np.append(heads, len(at)))


def _prefix_counts(words: Words, guide: Guide, length: int) -> pa.RecordBatch:
    """Counts of the prefixes of ``length`` words whose first and whose last ``length - 1`` are heavy; no other can be heavy."""
    reach = _reach(words, length)
    heavy = guide.lead(words, reach)[0] >= length - 1
    at = np.flatnonzero((reach >= length) & heavy & np.append(heavy[1:], False))
    heads, count = _sorted_suffixes(words, words.lang[at], at, at + length, length)
    return _counts([(words.langs[words.lang[i]], words.text(i, i + length).decode(), int(c)) for i, c in zip(at[heads], count)])


def _routed(words: Words, guide: Guide, depth: int) -> Iterator[pa.RecordBatch]:
    """lang, lead (the leading words), part (the bucket), tails (what follows, a line for each suffix), counts (of the lines)."""
    reach = _reach(words, depth)
    heavy, node = guide.lead(words, reach)
    at = np.flatnonzero((reach >= 2) & (heavy < reach) & guide.begins(words))
    if not len(at):
        return
    # A group: the first word, or the longest heavy prefix and a bucket of the word after it.
    many = np.array([1, *guide.buckets], np.int64)
    bucket = np.zeros(len(at), np.int64)
    deep = np.flatnonzero(heavy[at] > 0)
    if len(deep):
        hashes = (_hashes(words.vocabulary) >> np.uint64(1)).astype(np.int64)
        bucket[deep] = hashes[words.name[at[deep] + heavy[at[deep]]]] % many[node[at[deep]] + 1]
    plain_groups = len(words.langs) * len(words.vocabulary)
    offset = np.cumsum(many) - many + plain_groups
    group = np.where(heavy[at] > 0, offset[node[at] + 1] + bucket, words.lang[at] * len(words.vocabulary) + words.name[at])
    heads, count = _sorted_suffixes(words, group, at, at + reach[at], depth)
    at, group, bucket = at[heads], group[heads], bucket[heads]
    lead = np.maximum(heavy[at], 1)
    sizes = words.ends - words.starts + 1
    spot = np.concatenate([[0], np.cumsum(sizes)])
    plain = np.full(spot[-1], 0x20, np.uint8)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    mask = np.ones(spot[-1], bool)
    mask[spot[1:] - 1] = False
    plain[mask] = words.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    langs = pa.array(words.langs, pa.string())
    for lo in range(0, len(at), LINES):
        own, times, r = at[lo : lo + LINES], count[lo : lo + LINES], lead[lo : lo + LINES]
        code = group[lo : lo + LINES]
        groups = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        begin = spot[own + r]
        size = spot[own + reach[own]] - begin
        upto = np.cumsum(size)
        tails = plain[np.repeat(begin - upto + size, size) + np.arange(upto[-1])]
        tails[upto - 1] = 0x0A
        lines, marks = np.append(groups, len(own)), np.append((upto - size)[groups], upto[-1])
        first, long = own[groups], np.flatnonzero(r[groups] > 1)
        leads = words.vocabulary.take(pa.array(words.name[first]))
        if len(long):
            texts = leads.to_pylist()
            for k in long:
                texts[k] = words.text(first[k], first[k] + r[groups[k]]).decode()
            leads = pa.array(texts, pa.string())
        yield pa.record_batch([
            langs.take(pa.array(words.lang[first])), leads, pa.array(bucket[lo : lo + LINES][groups]),
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(groups), [None, pa.py_buffer(marks), pa.py_buffer(tails)]).cast(pa.binary()),
            pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(groups), [None, pa.py_buffer(lines * 4), pa.py_buffer(times.astype("<i4"))]).cast(pa.binary()),
        ], ["lang", "lead", "part", "tails", "counts"])


# --- multikey quicksort ---------------------------------------------------------------------------------------


def quicksort(columns: list[np.ndarray], weight: np.ndarray, least: int, groups: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(a pointer, number of words, weight) of every sequence of leading words that weighs at least ``least``.

    ``columns``: the first, second, ... word of each pointer (-1 past its end); ``groups``: pointers to be sorted among themselves.
    """
    found = []
    todo = [(g, 0) for g in groups]
    while todo:
        own, depth = todo.pop()
        words, load = columns[depth][own], weight[own]
        a, b, c = words[0], words[len(words) // 2], words[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        less, same = words < pivot, words == pivot
        below, equal, whole = int(np.add.reduce(load[less])), int(np.add.reduce(load[same])), int(np.add.reduce(load))
        if below >= least:
            todo.append((own[less], depth))
        if whole - below - equal >= least:
            todo.append((own[~(less | same)], depth))
        if equal >= least and pivot >= 0:
            mine = own[same]
            found.append((int(mine[0]), depth + 1, equal))
            if depth + 1 < len(columns):
                todo.append((mine, depth + 1))
    return found


def _sort_groups(table: pa.Table, least: int, depth: int) -> pa.RecordBatch | None:
    """Counts of the phrases of whole groups, whose rows are in the order of language and leading words."""
    keys = list(zip(*(table.column(c).to_pylist() for c in GROUP)))
    data, offsets = text_buffer(table.column("tails").combine_chunks().cast(pa.large_binary()))
    counts, spots = text_buffer(table.column("counts").combine_chunks().cast(pa.large_binary()))
    weight = np.frombuffer(counts.tobytes(), "<i4").astype(np.int64)
    line_ends = np.flatnonzero(data == 0x0A)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    row = np.repeat(np.arange(len(keys)), np.diff(spots) // 4)
    new = np.ones(len(keys), bool)
    new[1:] = [a != b for a, b in zip(keys[1:], keys[:-1])]
    group = (np.cumsum(new) - 1)[row]
    bounds = np.searchsorted(group, np.arange(new.sum() + 1))
    load = np.add.reduceat(weight, bounds[:-1])
    starts, ends, first = word_spans(data, np.append(line_starts, len(data)), _TAIL_WORD)
    names = word_names(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
    columns = []
    for d in range(depth - 1):
        inside = first[:-1] + d < first[1:]
        column = np.full(len(row), -1, np.int64)
        column[inside] = names[first[:-1][inside] + d]
        columns.append(column)
    big = np.flatnonzero(load >= least)
    found = quicksort(columns, weight, least, [np.arange(bounds[g], bounds[g + 1]) for g in big])
    rows = []
    for line, n, a in found:
        lang, lead, _ = keys[row[line]]
        rows.append((lang, f"{lead} {data[line_starts[line] : ends[first[line] + n - 1]].tobytes().decode()}", a))
    return _counts(rows) if rows else None


def _last_group(table: pa.Table) -> int:
    """Index of the first row of the group that the last row belongs to."""
    last, other = table.slice(table.num_rows - 1).to_pylist()[0], np.zeros(table.num_rows, bool)
    for c in GROUP:
        other |= pc.not_equal(table.column(c), last[c]).to_numpy()
    return int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0


def _count_groups(routed: DataFrame, least: int, depth: int) -> DataFrame:
    """lang, phrase, a of the frequent phrases in dealt suffixes; whole groups are sorted some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += len(text_buffer(batch.column(4).cast(pa.large_binary()))[0]) // 4
                if size < LINES:
                    continue
            table = pa.Table.from_batches(held) if held else None
            cut = table.num_rows if table is not None and batch is None else _last_group(table) if table is not None and table.num_rows else 0
            if cut:
                made = _sort_groups(table.slice(0, cut), least, depth)
                if made is not None:
                    yield made
                held = table.slice(cut).to_batches()
            size = 0  # what is held is one group that goes on

    dealt = routed.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(run, "lang string, phrase string, a long")


# --- phrases and scores ---------------------------------------------------------------------------------------


def count_phrases(docs: DataFrame, kept: Kept, *, least: int = LEAST, depth: int = DEPTH, group_words: int = GROUP_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, n: all its words), (lang, phrase, a: how often it occurs) of phrases of up to ``depth`` words that occur ``least`` times."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    words = kept.table(count_words(source), "words")
    totals = kept.table(words.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    frequent = words.where(F.col("a") >= least)
    limit = max(group_words, least, (totals.agg(F.sum("n")).first()[0] or 0) // MAX_HEAVY)
    guide = Guide(_bitmap(frequent), limit)
    heavy, parts = words.where(F.col("a") > limit), [frequent]
    for length in range(2, depth + 1):
        prefixes = [tuple(r) for r in heavy.select("lang", "phrase", "a").collect()]
        if not prefixes:
            break
        guide.add(prefixes)
        told = spark.sparkContext.broadcast(guide)

        def extend(batches: Iterator[pa.RecordBatch], told=told, length=length) -> Iterator[pa.RecordBatch]:
            for own in _each(batches):
                yield _prefix_counts(own, told.value, length)

        longer = source.mapInArrow(extend, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        heavy = kept.table(longer.where(F.col("a") > limit), f"heavy{length}")
        parts.append(heavy)
    else:
        guide.add([tuple(r) for r in heavy.select("lang", "phrase", "a").collect()])
    told = spark.sparkContext.broadcast(guide)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _each(batches):
            yield from _routed(own, told.value, depth)

    parts.append(_count_groups(source.mapInArrow(route, "lang string, lead string, part long, tails binary, counts binary"), least, depth))
    found = parts[0].select("lang", "phrase", "a")
    for part in parts[1:]:
        found = found.unionByName(part)
    return totals, kept.table(found, "phrases")


def collocations(docs: DataFrame, *, least: int = LEAST, depth: int = DEPTH, top: int = TOP, group_words: int = GROUP_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language.

    a, l, r: how often the phrase and the two parts at its weakest cut occur; score: 1000 * a * n / (l * r), rounded down. A phrase is left
    out where one that is a word longer, and so by steps any longer one, contains it and occurs as often.
    """
    kept = Kept(docs.sparkSession, "collocations")
    totals, phrases = count_phrases(docs, kept, least=least, depth=depth, group_words=group_words)
    split = phrases.withColumn("w", F.split("phrase", " ")).withColumn("m", F.size("w"))
    several = split.where("m > 1")
    covers = several.where("m > 2").select(
        "lang", "a", F.explode(F.array(F.expr("slice(w, 1, m - 1)"), F.expr("slice(w, 2, m - 1)"))).alias("inner")
    ).groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    open_ = several.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    cuts = open_.select("lang", "phrase", "a", "m", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, m - k), ' ')").alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    score = F.expr(
        "(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    )
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
