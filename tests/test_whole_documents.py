import random

from catloom.functions import documents
from tests.test_documents import made

TREES = [None, [], ["a.*.b", "SourceRef"], ["*.a", "b.Entity"]]


def result(reader, text, tree):
    try:
        return repr(reader(text, tree))
    except ValueError:
        return "no JSON"


def test_both_readers_agree():
    rng = random.Random(7)
    for _ in range(1500):
        text = made(rng)
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", ":", '"', "}", "]", "x", "0", "\x01", "﻿"]) + text[at + 1 :]
        for paths in TREES:
            tree = None if paths is None else documents.path_tree(paths)
            assert result(documents.read, text, tree) == result(documents.read_events, text, tree), text


def test_only_long_and_deep_texts_are_read_by_events(monkeypatch):
    asked = []
    monkeypatch.setattr(documents, "read_events", lambda text, paths: asked.append(len(text)))
    documents.read('{"a": NaN, "a": 1}', {})
    assert asked == []
    deep = "[" * 200_000 + "]" * 200_000
    documents.read(deep, {})
    monkeypatch.setattr(documents, "WHOLE_CHARS", 10)
    documents.read('{"a": [1, 2, 3]}', {})
    assert asked == [len(deep), 16]
