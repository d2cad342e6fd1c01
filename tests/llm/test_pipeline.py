"""The stages of the corpus pipeline against plain Python."""

from __future__ import annotations

import dataclasses
import os
import random
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from catloom.llm import language_id
from catloom.llm.tokenizing import encoder, tokenizer_path
from test_operators import brute_groups, words


def edited(rng, text, edits):
    """The text with some of its words replaced, far from each other."""
    cut = text.split(" ")
    for k in range(edits):
        cut[5 + k * 10] = "zz" + str(rng.randrange(10**9))
    return " ".join(cut)


def brute_lines(rows):
    seen, runs, out = set(), set(), []
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for k, line in enumerate(lines):
            if line in seen and len(line) >= 40:
                gone.add(k)
            seen.add(line)
            four = tuple(lines[k : k + 4])
            if len(four) == 4:
                if four in runs:
                    gone |= set(range(k, k + 4))
                runs.add(four)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def brute_clean(rows, items):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: token.findall("".join(c.lower() if c < "\x80" else c for c in t))
    windows = {tuple(w[k : k + 13]) for t in items for w in [cut(t)] for k in range(max(1, len(w) - 12))}
    for i, t in rows:
        w, hit = cut(t), set()
        for p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
        if not (hit and 20 * len(hit) >= len(w)):
            yield i, t


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    base, item = [words(rng, 204) for _ in range(12)], words(rng, 20)
    rows = [(k, t) for k, t in enumerate(base)]
    # Of 200 shingles, n edits change 5 n: 4 edits leave 180 / 220 = 0.818, 5 leave 175 / 225 = 0.778.
    rows += [(100 + k, edited(rng, t, 4 if k < 6 else 5)) for k, t in enumerate(base)]
    rows += [(200, None), (201, ""), (202, "12 34 !"), (203, item + " " + words(rng, 9)), (204, words(rng, 30))]
    whole = ["y" * 50, "z" * 44, words(rng, 12) + " " + "w" * 40]
    rows += [(210, "\n".join(whole)), (211, "\n".join(whole[:2])), (212, whole[2] + "\n" + whole[0])]  # nothing is left of the last two
    rows += [(205, words(rng, 8) + "\n" + "x" * 45 + "\n" + words(rng, 9)), (206, words(rng, 8) + "\n" + "x" * 45)]
    table = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    table.selectExpr("doc_id", "text", "string(null) lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    before = dict(left)
    left = [(i, t) for i, t in brute_lines(left) if t == before[i] or t.strip()]
    assert 210 in dict(left) and not {211, 212} & set(dict(left))
    first = {i for i, (_, c) in brute_groups(left, 80).items() if i == c}
    assert {100 + k for k in range(6)} & first == set() and {100 + k for k in range(6, 12)} <= first
    left = dict(brute_clean([(i, t) for i, t in left if i in first], [item]))
    assert 203 not in left and 204 in left

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    held = set(os.listdir(folder))
    tokenizer = encoder(tokenizer_path()).tokenizer
    found = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        found[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(found) == set(left)
    for i, pieces in found.items():
        n = len(tokenizer.encode(left[i], add_special_tokens=False).ids) + 1
        starts, lengths, totals = zip(*sorted(pieces))
        assert set(totals) == {n} and list(starts) == [0, *np.cumsum(lengths)[:-1]] and sum(lengths) == n
    # The tables of the stages are gone; what is left is the last stage's result.
    (made,) = [x for x in os.listdir(folder) if x not in held and not x.startswith("cut-")]
    assert made.startswith("pipeline-") and os.listdir(f"{folder}/{made}") == ["packing"]


def test_language_stage_rejects_what_the_network_cannot_tell(spark):
    rng = random.Random(3)
    kinds = {"aa": "abcd", "bb": "wxyz", "cc": "klmn"}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(40)), None if i % 5 == 0 else k, k) for i in range(120) for k in [rng.choice(list(kinds))]]
    rows += [(900, "12 34", "aa", "aa"), (901, None, "aa", "aa"), (902, "", None, "aa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    network = language_id.train(table)
    kept = {r.doc_id: r for r in language_id.keep_identified(table, network).collect()}
    assert set(kept) == set(range(120)) and all(kept[i].lang == k and kept[i].score == k for i, _, _, k in rows[:120])
    unsure = dataclasses.replace(network, out=np.zeros_like(network.out), out_bias=np.zeros_like(network.out_bias))
    assert language_id.keep_identified(table, unsure).count() == 0
    assert language_id.keep_identified(table, unsure, least=0.3).count() == 120
    assert language_id.keep_identified(table.drop("lang"), network).columns == ["doc_id", "text", "score"]
    assert language_id.keep_identified(table, None).count() == 120
