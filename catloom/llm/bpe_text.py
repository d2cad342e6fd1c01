"""Byte-level BPE by a rank file: whole texts to token ids and ids back to bytes, with the tiktoken library.

A text above ``SEGMENT_CHARS`` is encoded in segments. Segments end only where the pattern surely ends a match: before a white-space
character that a visible one follows (a run of white space gives up its last character to what comes next), and
after an ASCII letter that an ASCII character other than a letter follows. So the ids are those of the whole text, and the splitting expression never
sees more than one segment or one unbroken run.

Edge cases: a null or empty text has no ids (an empty array), and ids that are null or empty decode to no bytes; white space and runs of
any length keep every character; rows stay apart whatever their other columns hold; other columns are kept as they are, but one
with the name of the result is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import slices
from catloom.llm.tokenizing import tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
SEGMENT_CHARS = 1 << 15
SLICE_IDS = 1 << 19  # ids decoded at a time; a longer text is decoded alone
_SAFE = re.compile(r"(?=[ \t\r\n]\S)|(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])")
_loaded: dict[tuple[str, str], "Codec"] = {}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """An encoding made from a rank file: one base64 token and its rank a line."""

    def __init__(self, path: str, pat: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("ranks", pat_str=pat, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for segment in segments(text):
            ids += self.own.encode_ordinary(segment)
        return ids

    def decode(self, ids: list[int] | None) -> bytes:
        return self.own.decode_bytes(ids) if ids else b""


def codec(path: str, pat: str) -> Codec:
    """The codec of a rank file and pattern, made once per Python worker."""
    if (path, pat) not in _loaded:
        _loaded[path, pat] = Codec(path, pat)
    return _loaded[path, pat]


def segments(text: str, size: int | None = None) -> Iterator[str]:
    """The text in order, cut at the first safe place after every ``size`` characters."""
    size, at = size or SEGMENT_CHARS, 0
    while len(text) - at > size:
        safe = _SAFE.search(text, at + size)
        if safe is None or safe.start() == len(text):
            break
        yield text[at : safe.start()]
        at = safe.start()
    yield text[at:]


def _with_column(docs: DataFrame, name: str, kind: str) -> tuple[list[str], str]:
    others = [c for c in docs.columns if c != name]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return others, ", ".join([*fields, f"`{name}` {kind}"])


def encode(docs: DataFrame, *, ranks: str | None = None, pat: str | None = None, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns and ``ids`` array<int>. ``ranks``: path of the rank file on every executor; ``pat``: the splitting expression."""
    path, pat = ranks or tokenizer_path(RANKS), pat or pattern()
    others, out = _with_column(docs, ids, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pat)
        for batch in slices(batches, text):
            at = batch.schema.get_field_index(text)
            found = pa.array([own.encode(t) for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.record_batch([*(batch.column(i) for i in range(len(others))), found], [*others, ids])

    if text not in others:
        raise ValueError(f"the ids need a name of their own: {ids}")
    return docs.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(run, out)


def decode(coded: DataFrame, *, ranks: str | None = None, pat: str | None = None, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """All columns but ``ids``, and ``data`` binary: the bytes of the tokens one after the other, valid UTF-8 or not."""
    path, pat = ranks or tokenizer_path(RANKS), pat or pattern()
    others, out = _with_column(coded.drop(ids), data, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pat)
        for batch in batches:
            coded_ids = batch.column(len(others))
            flat, ends = coded_ids.values.to_numpy(zero_copy_only=False), coded_ids.offsets.to_numpy()
            at = 0
            while at < batch.num_rows:  # a bounded number of ids at a time
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_IDS, "right")) - 1)
                found = pa.array([own.decode(flat[ends[i] : ends[i + 1]].tolist()) for i in range(at, upto)], pa.binary())
                yield pa.record_batch([*(batch.column(i).slice(at, upto - at) for i in range(len(others))), found], [*others, data])
                at = upto

    return coded.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids}`")).mapInArrow(run, out)
