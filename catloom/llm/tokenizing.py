"""Token ids of whole texts by a public tokenizer, with the work shared among equal pieces of text.

A byte-level BPE tokenizer first cuts a text into pretokens. It always cuts before a single space between two characters
that are not white space, after an ASCII letter that no letter follows, and after a line feed between two characters that
are not white space. Encoding the segments between such places one by one gives the ids of the whole text. Segments
repeat all the time, so each distinct one is encoded once per slice and most are found in a bounded cache.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from catloom.llm.common import text_buffer

TOKENIZER = "byte_bpe_50k.json"
CACHE_SEGMENTS = 800_000  # distinct segments a worker remembers; beyond it the cache starts anew
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_NO_LETTER = ~_LETTER
_NO_LETTER[0x80:] = False
_loaded: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file, loaded once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte: printable Latin-1 as it is, the rest in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, segment: str) -> list[int]:
        """Ids of one segment; a run of letters is one pretoken and goes to the merges at once."""
        if segment[segment[0] == " " :].isalpha():
            return [t.id for t in self.merge(segment.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        return self.tokenizer.encode(segment, add_special_tokens=False).ids

    def _learn(self, segments: list[str]) -> None:
        lists = [self._ids(s) for s in segments]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        size = self.ends[-1] + int(sizes.sum())
        if size > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.ends[-1]], np.zeros(max(size, len(self.ids)), np.uint32)])
        self.ids[self.ends[-1] : size] = np.fromiter(chain.from_iterable(lists), np.uint32, size - self.ends[-1])
        self.known.update(zip(segments, range(len(self.ends) - 1, len(self.ends) - 1 + len(segments))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32) and the offsets between them (null: empty)."""
        data, offsets = text_buffer(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        cuts = _cuts(data, offsets, self.special)
        whole = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
        coded = whole.dictionary_encode()
        segments = coded.dictionary.to_pylist()
        if len(self.known) + len(segments) > CACHE_SEGMENTS:
            self._reset()
        new = [s for s in segments if s not in self.known]
        if new:
            self._learn(new)
        ends = self.ends
        slots = np.fromiter((self.known[s] for s in segments), np.int64, len(segments))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = ends[slots + 1] - ends[slots]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(ends[slots] - at[:-1], sizes) + np.arange(at[-1])]
        return ids, at[np.searchsorted(cuts, offsets)]


def _cuts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where segments begin, and the end of the data: text borders and the places at which a pretoken surely ends."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _LETTER[data[:-1]] & _NO_LETTER[data[1:]]
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    # Non-ASCII white space is U+0085, U+00A0 (lead byte C2) or three bytes led by E1, E2 or E3.
    second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    odd_before = (before >= 0x80) & ((second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3)))
    odd_after = (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    at = at[~(_SPACE[before] | _SPACE[after] | odd_before | odd_after)]
    cut[at[data[at] == 0x20]] = True
    cut[at[data[at] == 0x0A] + 1] = True
    text = data.tobytes() if special else b""
    for token in special:  # stays whole: the tokenizer looks for it first
        at = text.find(token)
        while at >= 0:
            cut[at + 1 : at + len(token)] = False
            at = text.find(token, at + len(token))
    cut[offsets] = True
    return np.flatnonzero(cut)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    rows = len(offsets) - 1
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(rows + 1)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    own = encoder(path)
    for batch in batches:
        yield batch, *with_end(*own.encode(batch.column("text")), end_id)
