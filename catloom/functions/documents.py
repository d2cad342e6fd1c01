"""JSON documents as variants, also those Spark's variant type refuses.

Spark refuses doubled keys, ``NaN`` and the infinities, deep nesting, lone surrogates and texts above its size limit. Only such a text goes to
Python, in Arrow batches. There a reader takes it event by event and keeps no more than the asked parts, the last of equal
keys, so a text of any length comes back as a small one that Spark reads. A text of up to ``WHOLE_CHARS`` is parsed at once by the standard
library instead, which takes a tenth of the time and gives the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = " \t\n\r"
_number = json.scanner.NUMBER_RE.match
_WORDS = {"true": True, "false": False, "null": None, "NaN": None, "Infinity": None, "-Infinity": None}
# A text that begins with a letter but with no word of JSON: it goes to neither reader, since a refusal costs more than a parse.
_NO_JSON = r"^[ \t\n\r]*(?!true|false|null|NaN|Infinity)[A-Za-z]"
_ALL: dict = {}  # a place of the path tree below which everything is kept


def events(text: str) -> Iterator[tuple[str, object]]:
    """("{" or "[", None), ("key", name), ("value", scalar), ("}" or "]", None) of a JSON text; ValueError where it is none.

    Numbers come as their own text; ``NaN`` and the infinities count as null.
    """
    at, size, open_ = 0, len(text), []
    want = "value"  # or: "first" (value or end of list), "key", "first key", "next" (comma or end)
    while True:
        while at < size and text[at] in _SPACE:
            at += 1
        if want == "next" and not open_:
            if at < size:
                raise ValueError(f"text after the document at {at}")
            return
        c = text[at : at + 1]
        if want in ("next", "first", "first key") and open_ and c == {"{": "}", "[": "]"}[open_[-1]]:
            open_.pop()
            yield c, None
            at, want = at + 1, "next"
        elif want == "next":
            if c != ",":
                raise ValueError(f"no comma at {at}")
            at, want = at + 1, "key" if open_[-1] == "{" else "value"
        elif want in ("key", "first key"):
            if c != '"':
                raise ValueError(f"no key at {at}")
            name, at = scanstring(text, at + 1, True)
            while at < size and text[at] in _SPACE:
                at += 1
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            yield "key", name
            at, want = at + 1, "value"
        elif c in ("{", "["):
            open_.append(c)
            yield c, None
            at, want = at + 1, "first key" if c == "{" else "first"
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
            yield "value", value
            want = "next"
        else:
            number = _number(text, at)
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None and number is None:
                raise ValueError(f"no value at {at}")
            yield "value", _WORDS[word] if word is not None else _Number(number.group())
            at, want = at + len(word) if word is not None else number.end(), "next"


class _Number(str):
    """The text of a number."""


# Numbers as their own text; ``NaN`` and the infinities count as null, of equal keys the last one stays.
_whole = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=lambda _: None)


class _Frame:
    """An object or list that is being read: what is kept of it, and the source entities below each key."""

    def __init__(self, opened: str, place: dict | None) -> None:
        self.kept: dict | list = {} if opened == "{" else []
        self.place, self.key = place, None
        self.found: dict[object, tuple] = {}
        self.name = self.ref = None  # the last ``Entity``, and that of the last ``SourceRef``

    def below(self) -> dict | None:
        if self.place is None or self.place is _ALL:
            return self.place
        return self.place.get("*" if isinstance(self.kept, list) else self.key)

    def add(self, value: object, wanted: bool, found: tuple, inner: _Frame | None) -> None:
        if isinstance(self.kept, list):
            if wanted:
                self.kept.append(value)
            self.found[len(self.found)] = found
            return
        if wanted:
            self.kept[self.key] = value
        self.found[self.key] = found
        if self.key == "Entity":
            self.name = value if isinstance(value, str) and not isinstance(value, _Number) else None
        elif self.key == "SourceRef":
            self.ref = inner.name if inner is not None else None


WHOLE_CHARS = 1_000_000  # longer texts are read event by event, so that only the asked parts are held


def read(text: str, paths: dict | None) -> tuple[object, list[str]]:
    """What lies on the path tree, and the distinct names of ``SourceRef`` entities at any depth. ValueError if it is no JSON."""
    if len(text) > WHOLE_CHARS:
        return read_events(text, paths)
    try:
        document = _whole.decode(text)
        found: dict[str, None] = {}
        _collect(document, found)
        return ({} if paths is None else _pruned(document, paths)), list(found)
    except RecursionError:  # nested too deep for the calls
        return read_events(text, paths)


def _collect(value: object, found: dict[str, None]) -> None:
    """Names of ``SourceRef`` entities, an object's own before those below it."""
    if isinstance(value, dict):
        ref = value.get("SourceRef")
        name = ref.get("Entity") if isinstance(ref, dict) else None
        if isinstance(name, str) and not isinstance(name, _Number) and name:
            found[name] = None
        for part in value.values():
            _collect(part, found)
    elif isinstance(value, list):
        for part in value:
            _collect(part, found)


def _pruned(value: object, place: dict) -> object:
    """The parts of a value that lie on the path tree."""
    if place is _ALL:
        return value
    if isinstance(value, dict):
        return {k: _pruned(v, place[k]) for k, v in value.items() if k in place}
    if isinstance(value, list):
        return [_pruned(v, place["*"]) for v in value] if "*" in place else []
    return value


def read_events(text: str, paths: dict | None) -> tuple[object, list[str]]:
    """``read`` for texts of any length and depth."""
    stack: list[_Frame] = []
    top = _Frame("[", {"*": paths} if paths is not None else None)
    for kind, value in events(text):
        frame = stack[-1] if stack else top
        if kind == "key":
            frame.key = value
        elif kind == "value":
            frame.add(value, frame.below() is not None, (), None)
        elif kind in "{[":
            stack.append(_Frame(kind, frame.below()))
        else:
            done, parent = stack.pop(), stack[-1] if stack else top
            own = (done.ref,) if isinstance(done.kept, dict) and done.ref else ()
            found = tuple(dict.fromkeys(own + tuple(x for part in done.found.values() for x in part)))
            parent.add(done.kept, parent.below() is not None, found, done)
    return (top.kept[0] if top.kept else {}), list(next(iter(top.found.values()), ()))


def path_tree(paths: list[str]) -> dict:
    """Dotted paths, ``*`` for the members of a list, as a tree; everything below a path's end is kept."""
    tree: dict = {}
    for path in paths:
        node = tree
        *steps, last = path.split(".")
        for step in steps:
            node = node.setdefault(step, {})
        node[last] = _ALL
    return tree


def _plain(value: object) -> str:
    """JSON text; numbers as they were written, lone surrogates replaced."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_plain(k)}:{_plain(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    return json.dumps(value)


def _over_texts(texts: pa.Array, make, kind: pa.DataType) -> pa.Array:
    def one(text: str | None):
        try:
            return None if text is None else make(text)
        except ValueError:
            return None

    if texts.null_count == len(texts):  # the usual case: Spark took every document
        return pa.nulls(len(texts), kind)
    return pa.array(map(one, texts.to_pylist()), kind, size=len(texts))


def reduced(paths: list[str]):
    """Column function: the asked parts of a JSON text as JSON text, null where it is no JSON."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        tree = path_tree(paths)
        return _over_texts(texts, lambda t: _plain(read(t, tree)[0]), pa.string())

    return run


@F.arrow_udf(T.ArrayType(T.StringType()))
def entities_any_depth(texts: pa.Array) -> pa.Array:
    """Source entities of JSON texts at any depth, the last of equal keys counting; null texts and bad JSON give an empty list."""
    kind = pa.list_(pa.string())
    if texts.null_count == len(texts):
        return pa.ListArray.from_arrays(pa.array([0] * (len(texts) + 1), pa.int32()), pa.array([], pa.string()))
    return pa.array([x or [] for x in _over_texts(texts, lambda t: read(t, None)[1], kind).to_pylist()], kind)


def with_json(df: DataFrame, content: str, out: str, paths: list[str], plain: str | None = None) -> DataFrame:
    """Add ``out``: the document as a variant, null where it is no JSON.

    Of a document that Spark refuses only ``paths`` are there. ``plain``: a column that tells whether Spark took the document.
    """
    text = F.when(~F.col(content).rlike(_NO_JSON), F.col(content))
    staged = df.withColumn("_first", F.try_parse_json(text))
    refused = F.when(F.col("_first").isNull(), text)
    staged = staged.withColumn("_rest", reduced(paths)(refused))
    if plain is not None:
        staged = staged.withColumn(plain, F.col("_first").isNotNull())
    return staged.withColumn(out, F.coalesce("_first", F.try_parse_json("_rest"))).drop("_first", "_rest")
