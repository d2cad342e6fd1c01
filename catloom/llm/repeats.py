"""Windows of a fixed number of symbols (bytes or words) that occur more than once, found at any position.

Ranking every position of a corpus would shuffle several times its size in each round. A sample of positions is enough:
the leftmost smallest hash among the short strings (``probe`` symbols) of a window names the window's anchor, and equal
windows have equal anchors at equal distances. So only anchors are ranked first, and only windows around anchors whose
probe recurs can recur. The neighbouring windows of one anchor make a run with one context, the symbols all of them cover:

* an anchor whose probe is unique holds no repeated window;
* runs with equal contexts form a class, and all their windows are repeated;
* what is left, one run per class where one probe has several contexts, is ranked at growing lengths.

``lo`` and ``hi`` are the first and the last window start of a run, ``a`` is its anchor, and a window start is a minus its
distance d. Documents are identified by ``did`` (the doc_id; null is above all others) and ``th``, a hash of the text; rows
that agree in both have equal findings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import Kept, Spans, mix, slices

NO_ID = (1 << 63) - 1
_INDEX = np.uint64((1 << 24) - 1)  # low bits of a probe's rank hold its place, so ties go to the leftmost
_ROWS = 1 << 22  # window starts looked at together


@dataclass(frozen=True)
class Kind:
    """``read`` gives the units of a batch (bytes or word hashes) and the offsets between its texts."""

    read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
    symbols: Callable[[np.ndarray], np.ndarray]  # 64-bit values of units
    dtype: str  # of units
    window: int
    probe: int
    earlier: bool  # a repeat counts only if it starts in a document with a smaller id


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))


def anchor_runs(symbols: np.ndarray, offsets: np.ndarray, window: int, probe: int) -> tuple[np.ndarray, ...]:
    """Text number, lo, hi, a (positions in ``symbols``) of the runs of all texts."""
    valid = np.zeros(len(symbols) + 1, np.int64)
    long_enough = np.diff(offsets) >= window
    np.add.at(valid, offsets[:-1][long_enough], 1)
    np.add.at(valid, offsets[1:][long_enough] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    spans = Spans(symbols)
    width = window - probe + 1
    anchors = []
    for lo in range(0, int(starts[-1]) + 1, _ROWS):
        n = min(_ROWS, int(starts[-1]) + 1 - lo) + width - 1
        at = np.arange(lo, lo + n)
        at = at[at + probe <= len(symbols)]
        rank = (spans.of(at, at + probe) & ~_INDEX) | (at - lo).astype(np.uint64)
        size = 1
        while 2 * size <= width:
            rank = np.minimum(rank[:-size], rank[size:])
            size *= 2
        if size < width:
            rank = np.minimum(rank[: len(rank) - (width - size)], rank[width - size :])
        anchors.append((rank & _INDEX).astype(np.int64) + lo)
    anchor = np.concatenate(anchors)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    lo, hi = starts[heads], starts[np.append(heads[1:], len(starts)) - 1]
    return np.searchsorted(offsets, lo, "right") - 1, lo, hi, anchor[heads]


def _anchors(docs: DataFrame, kind: Kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units, offsets = kind.read(batch)
            symbols = kind.symbols(units)
            text, lo, hi, a = anchor_runs(symbols, offsets, kind.window, kind.probe)
            first, second = Spans(symbols), Spans(symbols, 1)
            probe = first.of(a, a + kind.probe)
            context = mix(second.of(lo, hi + kind.window) + (a - lo).astype(np.uint64))
            base = offsets[text]
            rows = pa.array(text)
            yield pa.record_batch(
                [batch.column("did").take(rows), batch.column("th").take(rows), *[pa.array((x - base).astype(np.int32)) for x in (lo, hi, a)], pa.array(probe.view(np.int64)), pa.array(context.view(np.int64))],
                ["did", "th", "lo", "hi", "a", "probe", "context"],
            )

    return keyed(docs).select("did", "th", "text").mapInArrow(run, "did long, th long, lo int, hi int, a int, probe long, context long")


def _contexts(docs: DataFrame, runs: DataFrame, kind: Kind) -> DataFrame:
    """The rows of ``runs`` with the symbols of their contexts (``symbols``, binary)."""
    rest = [c for c in runs.columns if c not in ("did", "th")]
    by_text = runs.groupBy("did", "th").agg(F.collect_list(F.struct(*rest)).alias("runs"))
    texts = keyed(docs).select("did", "th", "text").join(by_text, ["did", "th"])
    out = "runs array<" + by_text.schema["runs"].dataType.elementType.simpleString() + ">, symbols array<binary>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units, offsets = kind.read(batch)
            runs = batch.column("runs")
            flat = runs.flatten()
            at = np.repeat(offsets[:-1], pc.list_value_length(runs).to_numpy(zero_copy_only=False))
            lo = at + flat.field("lo").to_numpy(zero_copy_only=False)
            hi = at + flat.field("hi").to_numpy(zero_copy_only=False) + kind.window
            parts = pa.array([units[i:j].tobytes() for i, j in zip(lo, hi)], pa.binary())
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))])
            yield pa.record_batch([runs, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)], ["runs", "symbols"])

    found = texts.select("runs", "text").mapInArrow(cut, out)
    both = found.select(F.explode(F.arrays_zip("runs", "symbols")).alias("z"))
    return both.select(*[F.col(f"z.runs.{c}").alias(c) for c in rest], F.col("z.symbols").alias("symbols"))


@dataclass
class Found:
    """What the first look leaves: repeated runs, and the runs whose windows must be told apart."""

    kept: Kept
    candidates: DataFrame  # did, th, lo, hi, a, probe, context: runs whose probe recurs
    whole: DataFrame  # did, th, lo, hi: runs of repeated windows
    open: DataFrame  # probe, context, first, target, far, near, symbols: one run per class; far and near bound d


def first_look(docs: DataFrame, kind: Kind, name: str) -> Found:
    kept = Kept(docs.sparkSession, name)
    anchors = kept.table(_anchors(docs, kind), "anchors")
    recurs = F.col("first") < F.col("last") if kind.earlier else F.col("n") > 1
    probes = anchors.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("first"), F.max("did").alias("last")).where(recurs)
    probes = kept.table(probes.select("probe"), "probes")
    candidates = kept.table(anchors.join(probes, "probe"), "candidates")
    kept.drop("anchors")

    classes = kept.table(
        candidates.groupBy("probe", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min("did").alias("first"), F.min(F.struct("did", "th", "lo", "hi", "a")).alias("one")
        ),
        "classes",
    )
    several = classes.groupBy("probe").agg(F.count(F.lit(1)).alias("contexts"), F.min("first").alias("least")).where("contexts > 1")
    several = kept.table(several, "several")
    repeated = candidates.join(classes.where("n > 1").select("probe", "context", "first"), ["probe", "context"])
    whole = (repeated.where("did > first") if kind.earlier else repeated).select("did", "th", "lo", "hi")
    target = F.col("first") > F.col("least") if kind.earlier else F.col("n") == 1
    left = classes.join(several, "probe").select("one.*", "probe", "context", "first", target.alias("target"))
    bounds = [(F.col("a") - F.col("lo")).alias("far"), (F.col("a") - F.col("hi")).alias("near")]
    open_ = _contexts(docs, left, kind).select("probe", "context", "first", "target", *bounds, "symbols")
    open_ = kept.table(open_, "open")
    # Rows that agree in did and th each give the contexts of their text; one of each is enough.
    if open_.count() > (several.agg(F.sum("contexts")).first()[0] or 0):
        open_ = kept.table(open_.dropDuplicates(["probe", "context"]), "open-once")
    return Found(kept, candidates, whole, open_)


def place(found: Found, windows: DataFrame, kind: Kind) -> DataFrame:
    """did, th, lo, hi of all repeated runs, from those of whole runs and the windows (probe, context, far, near) of classes."""
    near = windows.select("probe", "context", F.col("far").alias("_far"), F.col("near").alias("_near"), "first")
    own = found.candidates.join(near, ["probe", "context"])
    if kind.earlier:
        own = own.where("did = first")
    parts = own.select("did", "th", (F.col("a") - F.col("_far")).alias("lo"), (F.col("a") - F.col("_near")).alias("hi"))
    return found.whole.unionByName(parts)


def runs_by_text(runs: DataFrame) -> DataFrame:
    """did, th, runs: the distinct (lo, hi) of each text, however many equal rows gave them."""
    return runs.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def by_length(found: Found, kind: Kind, blocks: tuple[int, ...]) -> DataFrame:
    """Windows of open runs that are repeated, by ranking blocks of windows at growing lengths.

    A block holds the windows at distances j * size to j * size + size - 1. The string all of them share is ranked first (the
    shorter length): where it is unique, no window is repeated and the block drops out. Where the string that covers
    them all (the longer length) is not unique, every window is repeated. Other blocks are cut into smaller ones,
    until a block is one window and both lengths are the threshold itself. A rank is the hash of the string.
    """
    kept, window = found.kept, kind.window
    state = found.open.withColumn("todo", F.lit(None).cast("array<int>"))
    parts = []
    for turn, size in enumerate(blocks):
        bigger = blocks[turn - 1] if turn else 0

        def rank(batches: Iterator[pa.RecordBatch], size=size, bigger=bigger) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "symbols", 1_000_000):
                yield _ranked(batch, kind, size, bigger)

        ranks = kept.table(
            state.mapInArrow(rank, "probe long, context long, first long, target boolean, far int, near int, block int, shared long, cover long"),
            f"ranks-{turn}",
        )
        alive = F.col("least") < F.col("most") if kind.earlier else F.col("n") > 1
        count = [F.count(F.lit(1)).alias("n"), F.min("first").alias("least"), F.max("first").alias("most")]
        shared = ranks.groupBy("probe", "block", "shared").agg(*count, F.max("target").alias("asked")).where(alive & F.col("asked"))
        shared = kept.table(shared.select("probe", "block", "shared"), f"shared-{turn}")
        cover = ranks.groupBy("probe", "block", "cover").agg(*count).where(alive).select("probe", "block", "cover", F.col("least").alias("_least"))
        cover = kept.table(cover, f"cover-{turn}")
        going = ranks.join(shared, ["probe", "block", "shared"]).join(cover, ["probe", "block", "cover"], "left")
        done = F.col("target") & F.col("_least").isNotNull() & (F.col("_least") < F.col("first") if kind.earlier else F.lit(True))
        going = kept.table(going.select("probe", "context", "first", "target", "far", "near", "block", F.coalesce(done, F.lit(False)).alias("done")), f"going-{turn}")
        kept.drop(f"ranks-{turn}")
        parts.append(going.where("done").select("probe", "context", "far", "near", "first"))
        if size == 1:
            break
        # A block goes on where some run still asks; the runs that have their answer stay as partners.
        asking = going.where("target and not done").select("probe", "block").distinct()
        todo = going.join(asking, ["probe", "block"]).groupBy("probe", "context").agg(
            F.collect_set("block").alias("todo"), F.collect_set(F.when(F.col("target") & ~F.col("done"), F.col("block"))).alias("asked")
        )
        state = found.open.drop("target").join(todo, ["probe", "context"]).select(
            "probe", "context", "first", (F.size("asked") > 0).alias("target"), "far", "near", "symbols", "todo"
        )
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    return windows


def _ranked(batch: pa.RecordBatch, kind: Kind, size: int, bigger: int) -> pa.RecordBatch:
    """Blocks of ``size`` of each run, within the blocks of size ``bigger`` still to do."""
    blob = batch.column("symbols")
    data = np.frombuffer(b"".join(blob.to_pylist()), kind.dtype)
    base = np.concatenate([[0], np.cumsum(pc.binary_length(blob).to_numpy(zero_copy_only=False) // data.itemsize)])
    spans = Spans(kind.symbols(data))
    far, near = (batch.column(c).to_numpy() for c in ("far", "near"))
    todo = batch.column("todo").to_pylist()
    rows, blocks = [], []
    for i, (most, least) in enumerate(zip(far, near)):
        if todo[i] is None:
            mine = range(least // size, most // size + 1)
        else:
            step = bigger // size
            mine = [b for t in todo[i] for b in range(t * step, t * step + step) if b * size <= most and b * size + size > least]
        rows.extend([i] * len(mine))
        blocks.extend(mine)
    rows, blocks = np.array(rows, np.int64), np.array(blocks, np.int64)
    top = np.minimum(blocks * size + size - 1, far[rows])
    low = np.maximum(blocks * size, near[rows])
    # Position of distance d in a context is far - d. The shared string runs from the block's nearest window start
    # to the end of its farthest one, whether or not the run reaches that far.
    at = base[rows] + far[rows]
    shared = spans.of(at - blocks * size, at - (blocks * size + size - 1) + kind.window)
    cover = mix(spans.of(at - top, at - low + kind.window) + mix((top * 4096 + low).astype(np.uint64)))
    take = pa.array(rows)
    return pa.record_batch(
        [*[batch.column(c).take(take) for c in ("probe", "context", "first", "target")], pa.array(top.astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(blocks.astype(np.int32)), pa.array(shared.view(np.int64)), pa.array(cover.view(np.int64))],
        ["probe", "context", "first", "target", "far", "near", "block", "shared", "cover"],
    )
