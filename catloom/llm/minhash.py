"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct shingles of five words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased); with fewer words, the
whole sequence is the one shingle. SuperMinHash gives each element a random order of the registers; in step j an element offers
j plus a random fraction to the next register of its order, and a register keeps the smallest offer. Once every register of a
document holds less than j + 1, later steps cannot change it, so most documents need one to three steps.

Documents with equal sets form a class and only its first member goes on. Classes that agree in a band meet in a bucket.
A bucket compares its members with one centre, the member with the most company in all its buckets. Where members are left
outside the largest component of their bucket, an exact prefix filter finds all partners they may have in other components.
So no link between two components is lost, and pairs inside a component, which could change nothing, are never made.

Edge cases: null or empty texts, and texts without words, have the empty set and are linked with nothing; rows without a
doc_id too; rows that share a doc_id are judged each by its text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import SPACE_WORDS, Kept, Spans, lower_ascii, mix, slices, text_buffer, word_hashes, word_spans
from catloom.llm.graph import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 20, 5  # a pair at the threshold meets in no band once in about 10**5 pairs
REGISTERS = BANDS * ROWS
_STEP = np.uint64(57)  # an offer is step * 2**57 plus 57 random bits, which leaves room for 127 registers


def shingle_sets(batch: pa.RecordBatch, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other and the offsets between them."""
    raw, offsets = text_buffer(batch.column("text"))
    data = lower_ascii(raw)
    starts, ends, first = word_spans(data, offsets, SPACE_WORDS)
    words = np.diff(first)
    spans = Spans(word_hashes(data, starts, ends))
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(words)), count)
    begin = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    hashes = spans.of(begin, np.minimum(begin + shingle, first[owner + 1])).view(np.int64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(words) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash registers (uint64) of each set; rows of empty sets stay at the largest value."""
    rows = len(offsets) - 1
    values = np.full(rows * registers, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    seeds = mix(hashes.view(np.uint64))
    order = None  # each element's order of the registers, kept from the second step on
    for step in range(registers):
        if not len(owner):
            break
        random = mix(seeds + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = step + (((random >> np.uint64(32)) * np.uint64(registers - step)) >> np.uint64(32)).astype(np.int64)
        if step == 0:
            register = pick
            first_pick = pick
        else:
            if order is None:
                order = np.tile(np.arange(registers, dtype=np.uint8), (len(owner), 1))
                order[np.arange(len(owner)), first_pick] = 0
                order[:, 0] = first_pick
            at = np.arange(len(owner))
            register = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, step]
            order[:, step] = register
        offer = (np.uint64(step) << _STEP) | (mix(random) >> np.uint64(7))
        np.minimum.at(values, owner * registers + register, offer)
        open_ = values.reshape(rows, registers).max(axis=1) >= (np.uint64(step + 1) << _STEP)
        going = open_[owner]
        if not going.all():
            owner, seeds = owner[going], seeds[going]
            if order is not None:
                order = order[going]
            else:
                first_pick = first_pick[going]
    return values.reshape(rows, registers)


def numbered(docs: DataFrame) -> DataFrame:
    """row (a number), doc_id, text."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def sketch(source: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, th (hash of the text), n_shingles, digest of the set (two longs), bands (one hash each) of every row of ``source`` (row, doc_id, text)."""
    n_bands, n_rows = bands, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1_000_000):
            hashes, offsets = shingle_sets(batch)
            sizes = np.diff(offsets)
            digests = []
            for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes.view(np.uint64) ^ np.uint64(seed)))])
                digests.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
            bands = Spans(signatures(hashes, offsets, n_bands * n_rows).ravel())
            n = batch.num_rows
            starts = np.arange(n * n_bands) * n_rows
            keys = mix(bands.of(starts, starts + n_rows) + np.tile(np.arange(n_bands, dtype=np.uint64), n)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, n_bands, 0))])
            flat = keys.reshape(n, n_bands)[sizes > 0].ravel()
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), batch.column("th"), pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                ["row", "doc_id", "th", "n_shingles", "d1", "d2", "bands"],
            )

    keyed = source.select("row", "doc_id", F.xxhash64("text").alias("th"), "text")
    return keyed.mapInArrow(run, "row long, doc_id long, th long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(source: DataFrame, wanted: DataFrame, kept: Kept) -> DataFrame:
    """node, elements: the whole shingle sets of the wanted classes (node, doc_id, th, d1, d2), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, offsets = shingle_sets(batch)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes.view(np.uint64) ^ np.uint64(s)))]) for s in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35)]
            own = [(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]
            same = (own[0] == batch.column("d1").to_numpy()) & (own[1] == batch.column("d2").to_numpy())
            out = pa.record_batch([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes))], ["node", "elements"])
            yield out.filter(pa.array(same))

    texts = source.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sets = texts.join(wanted, ["doc_id", "th"]).select("node", "d1", "d2", "text").mapInArrow(run, "node long, elements array<long>")
    sets = kept.table(sets, "sets")
    found = sets.agg(F.count("node"), F.count_distinct("node")).first()
    return sets if found[0] == found[1] else kept.table(sets.dropDuplicates(["node"]), "sets-once")  # equal rows with one doc_id


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common: Column = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def _candidates(nodes: DataFrame, sets: DataFrame, percent: int, kept: Kept) -> DataFrame:
    """Pairs (a, b) of two components, one of them ``outside``, that may be similar enough: all of them, by prefix filtering.

    The elements of each set are put in one order, rarest first. Two similar sets share an element so early in both that
    what follows it still makes up the overlap they need. An element nobody shares is only counted. Rows for which the
    smallest set with the same element would already be too large are dropped before the join, so an element that half
    of a large group shares does not meet itself in pairs.
    """
    known = nodes.join(sets, "node").select("node", "component", "outside", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    known = kept.table(known, "elements")
    often = kept.table(known.groupBy("element").agg(F.count(F.lit(1)).alias("often")), "often")
    sorted_ = known.join(often, "element").groupBy("node", "component", "outside", "n").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("order"))
    first = F.slice("order", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    placed = sorted_.select("node", "component", "outside", "n", F.posexplode(first).alias("before", "e"))
    rows = kept.table(placed.where("e.often > 1").select("node", "component", "outside", "n", (F.col("n") - F.col("before")).alias("left"), F.col("e.element").alias("element")), "prefixes")
    least = rows.groupBy("element").agg(F.min("n").alias("_all"), F.min(F.when(F.col("outside"), F.col("n"))).alias("_outside")).where("_outside is not null")
    least = kept.table(least, "least")
    bounded = rows.join(least, "element")
    fits = lambda left, n, other: left * (100 + percent) >= (n + other) * percent
    asks = bounded.where(F.col("outside") & fits(F.col("left"), F.col("n"), F.col("_all")))
    asks = asks.select("element", F.col("node").alias("a"), F.col("component").alias("_ca"), F.col("n").alias("_na"), F.col("left").alias("_la"))
    others = bounded.where(fits(F.col("left"), F.col("n"), F.col("_outside")))
    others = others.select("element", F.col("node").alias("b"), F.col("component").alias("_cb"), F.col("n").alias("_nb"), F.col("left").alias("_lb"), "outside")
    met = kept.table(asks, "asks").join(kept.table(others, "others"), "element").where(
        (F.col("_ca") != F.col("_cb")) & (~F.col("outside") | (F.col("a") < F.col("b")))
        & fits(F.least("_la", "_lb"), F.col("_na"), F.col("_nb"))
    )
    return met.select("a", "b").distinct()


def duplicate_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), one row per document.

    The links hold between full sets; the groups are their connected components.
    """
    return grouped_rows(numbered(docs), **options).select("doc_id", "n_shingles", "component_id")


def grouped_rows(source: DataFrame, *, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row, doc_id, n_shingles, component_id, first_row (the group's first row by doc_id, then row) of the rows of ``source``."""
    kept = Kept(source.sparkSession, "minhash")
    all_sets = kept.table(sketch(source, bands, rows), "sketches")
    usable = all_sets.where("n_shingles > 0 and doc_id is not null")
    classes = kept.table(usable.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min(F.struct("doc_id", "row")).alias("first_doc")), "classes")
    firsts = classes.join(all_sets.select(F.col("row").alias("node"), "doc_id", "th", "bands"), "node").select("node", "doc_id", "th", "d1", "d2", "bands")
    buckets = firsts.select("node", F.explode("bands").alias("bucket"))
    shared = kept.table(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    members = kept.table(buckets.join(shared, "bucket"), "members")

    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = kept.table(members.select("node", "bucket").join(company, "node"), "ranked")
    kept.drop("members")
    wanted = firsts.join(ranked.select("node").distinct(), "node").drop("bands")
    sets = full_sets(source, wanted, kept)
    centres = kept.table(ranked.groupBy("bucket").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("centre")), "centres")
    pairs = ranked.join(centres, "bucket").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = kept.table(_linked(pairs, sets, percent), "links")
    groups = components(links, kept, "first")

    # Members outside the largest component of their bucket look for partners in other components.
    placed = ranked.select("node", "bucket").join(groups, "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("component"))
    placed = kept.table(placed, "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups"), F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
    mixed = kept.table(main.where("groups > 1").select("bucket", "main"), "mixed")
    named = classes.select("node", "d1", "d2", "first_doc").join(groups, "node", "left").select("d1", "d2", "first_doc", F.coalesce("component", "node").alias("component"))
    if not mixed.isEmpty():
        inside = placed.join(mixed, "bucket").groupBy("node", "component").agg(F.max(F.col("component") != F.col("main")).alias("outside"))
        inside = kept.table(inside, "inside")
        rest = _candidates(inside, sets, percent, kept).join(pairs, ["a", "b"], "left_anti")
        more = _linked(rest, sets, percent)
        # The components are joined as wholes: a link between members is a link between their components.
        home = inside.select("node", "component")
        more = more.join(home.toDF("a", "_ca"), "a").join(home.toDF("b", "_cb"), "b").select(F.col("_ca").alias("a"), F.col("_cb").alias("b"))
        whole = components(kept.table(more.distinct(), "more"), kept, "second").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        named = named.join(whole, "component", "left").select("d1", "d2", "first_doc", F.coalesce("whole", "component").alias("component"))
    smallest = kept.table(named.groupBy("component").agg(F.min("first_doc").alias("component_id")), "smallest")
    by_set = kept.table(named.join(smallest, "component").select("d1", "d2", F.col("component_id").alias("least")), "named")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return all_sets.join(by_set, ["d1", "d2"], "left").select(
        "row", "doc_id", "n_shingles", *[F.when(linked, F.col(f"least.{c}")).otherwise(F.col(c)).alias(name) for c, name in (("doc_id", "component_id"), ("row", "first_row"))],
    )


def first_of_group(docs: DataFrame, **options) -> DataFrame:
    """The first row of each group, all columns as they were; rows without a doc_id are kept.

    Each row is judged by itself, whatever other rows have its doc_id. The rows are written with their numbers first, so
    that a number names the same row whenever it is read.
    """
    kept = Kept(docs.sparkSession, "first-of-group")
    held = kept.table(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    source = held.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))
    gone = grouped_rows(source, **options).where("row <> first_row").select("row")
    return held.join(gone, "row", "left_anti").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
