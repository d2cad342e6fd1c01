"""The operators against plain Python on small tables with the cases that go wrong: nulls, empty and long texts, repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catloom.llm import (
    decontaminate, language_id, line_dedup, minhash, packing, phrase_dedup, repeats, suffix_dedup, token_files, topk, toxicity,
)
from catloom.llm.common import Kept, split_row
from catloom.llm.graph import UnionFind, components
from catloom.llm.tokenizing import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, th string, runs int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [words(rng, 90) for _ in range(4)]
    texts = [None, "", "   ", "\n\n", "1 2 3", "one", words(rng, 4), words(rng, 3000)]
    texts += [base[0], base[0], base[0] + " tail", "Head " + base[0], base[1].upper(), base[1]]
    texts += [words(rng, 30) + "\n" + base[2] + "\n" + words(rng, 40) for _ in range(5)]
    texts += ["aaaa " * 300, "aaaa " * 300 + "b", base[3].replace(" a", " x", 1), base[3]]
    texts += ["first line of all\nsecond line\nthird\nfourth\nfifth\n" + words(rng, 20) for _ in range(3)]
    texts += ["a line that is much longer than forty characters in all\n" + words(rng, 5) for _ in range(3)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i % 3 else "en", None, None, 7, "x", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_language(spark, empty):
    rng = random.Random(1)
    kinds = {"aa": "abcd", "bb": "wxyz", "cc": "áéíó"}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(rng.randint(3, 200))), k) for i in range(300) for k in [rng.choice(list(kinds))]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !", "bb"), (903, "abcd", None), (904, "abcd " * 5000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert len(found) == len(rows)
    assert {found[i].lang_pred for i in (900, 901, 902)} == {"und"} and found[900].score == 0
    held = [(found[i].lang_pred, k) for i, _, k in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert found[903].lang_pred == found[904].lang_pred == "aa"
    assert language_id.identify(empty).count() == 0
    assert language_id.keep_identified(table, language_id.train(table)).columns == table.columns
    assert language_id.keep_identified(table, language_id.train(table)).count() == 302
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_language_fills_nulls_and_keeps_unlabelled(spark):
    rng = random.Random(2)
    kinds = {"aa": "abcd", "bb": "wxyz"}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(40)), k) for i in range(100) for k in [rng.choice(list(kinds))]]
    table = spark.createDataFrame(rows + [(200, "12 !", "aa"), (201, None, None)], "doc_id long, text string, lang string")
    hidden = table.withColumn("lang", F.when(F.col("doc_id") % 4 > 0, F.col("lang")))
    found = language_id.keep_identified(hidden, language_id.train(hidden))
    assert {(r.doc_id, r.text, r.lang) for r in found.collect()} == set(rows) and found.columns == table.columns
    bare = table.withColumn("lang", F.lit(None).cast("string"))
    found = language_id.keep_identified(bare, language_id.train(bare))
    assert {(r.doc_id, r.lang) for r in found.collect()} == {(i, None) for i, _, _ in rows}


def removed_bytes(rows, length):
    places = Counter(b[p : p + length] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - length + 1))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if places[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        yield i, b, gone


@pytest.mark.parametrize("length,probe,blocks", [(60, 20, (16, 4, 1)), (400, 100, (64, 16, 4, 1))])
def test_suffix_dedup(docs, empty, length, probe, blocks):
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length=length, probe=probe, blocks=blocks).collect()}
    for i, b, gone in removed_bytes(corpus(), length):
        row = found.pop(i)
        assert (row.n_bytes, bytes(row.kept)) == (len(b), bytes(x for x, g in zip(b, gone) if not g)), i
        assert sum(s.hi - s.lo for s in row.spans) == sum(gone) and row.kept_sha256 == sha(bytes(row.kept))
    assert not found
    assert suffix_dedup.remove_repeats(empty).count() == 0


def brute_groups(rows, percent=85):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_minhash(spark, docs, empty):
    rng = random.Random(5)
    rows, base = corpus(), words(rng, 150).split()
    for i in range(120):  # a chain-like group: each copy has up to six edits, so only some are near the base
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = words(rng, 1) + str(rng.randint(0, 3))
        rows.append((1000 + i, " ".join(copy)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.duplicate_groups(frame(spark, rows)).collect()}
    assert found == brute_groups(rows)
    assert minhash.duplicate_groups(empty).count() == 0
    kept = minhash.first_of_group(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in brute_groups(corpus()).values()})


def test_toxicity(spark, empty):
    rng = random.Random(2)
    clean = ["tree", "house", "river", "stone", "cloud", "garden", "window", "letter"]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    odd = {900: "the 1d10t of the house", 901: "m o r o n in the garden", 902: "moooron by the river", 903: "tree 555 stone", 904: None, 905: ""}
    rows += list(odd.items())
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(901, None)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(table, known).collect()}
    assert all(found[i].predicted == y for i, y in labels)
    assert [found[i].predicted for i in odd] == [1, 1, 1, 0, 0, 0]
    assert toxicity.toxicity(empty, known).count() == 0
    assert {r.score < 0.5 for r in toxicity.toxicity(table, known.where("toxic = 0")).collect()} == {True}


def test_rows_of_one_id_are_judged_each(spark):
    rng = random.Random(12)
    base, other, item = words(rng, 80), words(rng, 80), words(rng, 20)
    near = base + " tail"
    rows = [(1, base), (2, near), (2, other), (3, other + " z"), (4, item), (4, words(rng, 30)), (None, item), (None, base), (5, item)]
    rows += [(6, rows[5][1] + " and more")] * 3
    table = frame(spark, [(0, "x")]).limit(0).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), True).repartition(3)
    first = minhash.first_of_group(table)
    assert first.columns == table.columns
    expected = [(1, base), (2, other), (4, item), (4, rows[5][1]), (None, item), (None, base)]
    assert Counter((r.doc_id, r.text) for r in first.collect()) == Counter(expected)
    clean = decontaminate.clean_documents(table, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for r in rows if r[1] != item)


def test_full_sets_hold_each_node_once(spark):
    rng = random.Random(13)
    texts = [words(rng, 40) for _ in range(3)]
    rows = [(1, texts[0])] * 3 + [(1, texts[1]), (2, texts[2])]
    source = minhash.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = minhash.Kept(spark, "sets-test")
    sketches = kept.table(minhash.sketch(source), "s")
    wanted = sketches.groupBy("doc_id", "th", "d1", "d2").agg(F.min("row").alias("node"))
    found = minhash.full_sets(source, wanted, kept).collect()
    assert len(found) == len({r.node for r in found}) == 3 and {len(r.elements) for r in found} == {36}


def test_each_obfuscated_form_is_restored():
    import pyarrow as pa

    rng = random.Random(4)
    plain = pa.array([" ".join(rng.choice(["stupid", "jerk", "idiot", "kill", "tree", "house", "river", "letter"]) for _ in range(2000))])
    data, offsets = toxicity.text_buffer(plain)
    counts = np.zeros(28**3)
    cls = np.concatenate([[0], toxicity._CLASS[data], [0]])
    code = (cls[:-2] * 28 + cls[1:-1]) * 28 + cls[2:]
    np.add.at(counts, np.where(cls[1:-1] == 0, cls[2:], code), 1)
    channel = toxicity.Channel(toxicity.trigram_costs(counts))
    forms = {
        "stupid": ["s t u p 1 d", "s.t.u.p.1.d", "5 t u p 1 d", "s  t  u  p  i  d", "s/t/u/p/i/d", "s, t, u, p, i, d", "s_t_u_p_i_d", "stuupiid", "stuup1d", "s t u u p i d", "st" + "u" * 50 + "pid", "5tup1d", "stuuupid"],
        "idiot": ["idio7", "1d10t", "i d i 0 t"], "kil": ["ki1"],
    }
    for word, texts in forms.items():
        for text in texts:
            assert toxicity.restored_words(text, channel) == [word], text
            own = np.unique(toxicity._features(pa.record_batch([pa.array([text + " tree"])], ["text"]), channel)[1])
            assert word == "kil" or set(toxicity._features(pa.record_batch([pa.array([word])], ["text"]), channel)[1]) <= set(own), text
    assert toxicity.restored_words("jerk$", channel) in ([], ["jerk"], ["jerks"]) and toxicity._SPOT.search("jerk$")
    assert toxicity.restored_words("1 2 3 4 5 and 2024-10-11 in the river", channel) == []
    assert toxicity._SPOT.search("q" * 100_000) and not toxicity._SPOT.search("ab" * 100_000)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(0, 0.3, 8).round(1).tolist() for i in range(300)}
    rows = [*vectors.items(), (400, None), (420, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in topk.top_k(table, k=7, shard_vectors=60).collect():
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors.items()}
    for q in range(0, 300, 20):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:7]
        assert sorted(found.pop(q)) == [(k + 1, -s, i) for k, (s, i) in enumerate(best)]
    assert not found
    assert topk.top_k(table.where("vec_id = 0")).count() == 0 and topk.top_k(table.limit(0)).count() == 0


def test_topk_of_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(12)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "x", 1, 2.0) for i in range(200)]
    rows += rows[:45] + [rows[20], rows[20]]  # equal rows, queries among them
    rows += [(40, [0.5] * 6, "y", 1, 1.0), (41, [0.9] * 6, "y", 1, 1.0), (60, [-0.9] * 6, "y", 1, 1.0)]  # one id, two vectors
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, kind int, score double").repartition(5)
    once = {(i, tuple(math.floor(64 * x) for x in v)) for i, v, *_ in rows}
    want = {}
    for q in {i for i, _ in once if i % 20 == 0}:
        asked = min(v for i, v in once if i == q)
        scored = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in once if i != q)
        want[q] = [(i, -s) for s, i in scored[:20]]
    for size in (16_384, 50, 7):
        found = defaultdict(list)
        for r in topk.top_k(table, shard_vectors=size).orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.vec_id, r.score))
        assert found == want
    assert all(len(x) == 20 for x in want.values())


def test_decontaminate(spark, docs, empty):
    rng = random.Random(8)
    items = [(1, words(rng, 30)), (2, "one"), (3, None), (4, ""), (5, corpus()[8][1]), (5, corpus()[8][1]), (10, words(rng, 5)), (11, "AAAA aaaa")]
    rows = corpus() + [(500, "x " + items[0][1].upper().replace(" ", "--") + " y"), (501, "z " * 400 + items[6][1])]
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: token.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
    windows = {(i, tuple(w[k : k + 13])) for i, t in items for w in [cut(t)] for k in range(max(1, len(w) - 12)) if w}
    table, tests = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    for shard in (200_000, 7):
        found = {r.doc_id: r for r in decontaminate.judge(decontaminate.find_items(table, tests, shard_patterns=shard)).collect()}
        for i, t in rows:
            w = cut(t)
            hit, names = set(), set()
            for item, p in windows:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        names.add(item)
            r = found[i]
            assert (r.n_words, r.n_hit, sorted(r.items)) == (len(w), len(hit), sorted(names)), i
            assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontaminate.find_items(empty, tests).count() == 0
    assert {r.n_hit for r in decontaminate.judge(decontaminate.find_items(table, tests.limit(0))).collect()} == {0}
    assert decontaminate.clean_documents(table, tests).columns == table.columns


def test_packing(docs, empty):
    tokenizer = encoder(tokenizer_path()).tokenizer
    rows = packing.pack_documents(docs, length=256, group_docs=10).toPandas()
    for i, t in corpus():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = rows[rows.doc_id == i].sort_values("start")
        assert [x for blob in own.ids for x in np.frombuffer(blob, "<u4")] == ids
        assert list(own.start) == [0, *np.cumsum(own.length)[:-1]] and set(own.doc_tokens) == {len(ids)}
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 256
    assert packing.pack_documents(empty).count() == 0


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 101, 300))[::-1]
    room, expected = [], []
    for s in sizes:
        at = next((k for k, r in enumerate(room) if r >= s), len(room))
        if at == len(room):
            room.append(100)
        room[at] -= s
        expected.append(at)
    assert packing.first_fit(sizes, 100)[0].tolist() == expected


@pytest.mark.parametrize("window,probe", [(12, 4), (50, 16)])
def test_phrase_dedup(spark, empty, window, probe):
    rng = random.Random(6)
    shared = words(rng, 70)
    rows = corpus() + [(700 + i, f"{words(rng, 25)} {shared} {words(rng, 25)}") for i in range(8)] + [(None, shared), (None, shared)]
    cut = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t) in enumerate(rows)}
    key = lambda k: float("inf") if rows[k][0] is None else rows[k][0]
    first = {}
    for k, w in cut.items():
        for p in range(len(w) - window + 1):
            s = tuple(w[p : p + window])
            first[s] = min(first.get(s, key(k)), key(k))
    expected = Counter()
    for k, w in cut.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < key(k):
                gone[p : p + window] = [True] * window
        expected[(rows[k][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = phrase_dedup.remove_earlier(table, window=window, probe=probe, shard_phrases=50, shard_contexts=3)
    assert Counter((r.doc_id, r.n_words, sum(s.hi - s.lo for s in r.spans), r.kept) for r in found.collect()) == expected
    assert phrase_dedup.remove_earlier(empty).count() == 0


def test_phrase_contexts_are_dealt(spark):
    rng = random.Random(9)
    kind = repeats.Kind(phrase_dedup._words, lambda units: units, "uint64", 12, 4, earlier=True)
    quotes, wholes = [words(rng, 8) for _ in range(40)], [words(rng, 12) for _ in range(40)]
    around = lambda q: f"{words(rng, 20)} {q} {words(rng, 20)}"
    short = [around(q) for q in quotes for _ in range(4)]
    shared = [around(q) for q in wholes for _ in range(4)]
    for texts, some in ((short, False), (short + shared, True)):
        found = repeats.first_look(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), kind, "dealt")
        phrases = found.kept.table(phrase_dedup.recurring_phrases(found, kind), "phrases")
        left, right = phrase_dedup.dealt(found, phrases, 1000, 10)
        probes = {r.probe for r in phrases.collect()}
        assert found.open.where("target").count() > 0 and bool(probes) == some
        assert {r.probe for r in right.collect()} == probes  # contexts around short quotes have no phrase to find
        assert all(r["count"] <= 40 for r in right.groupBy("shard", "part").count().collect())


def test_equal_rows_are_listed_once(spark):
    rng = random.Random(10)
    shared = words(rng, 60)
    rows = [(1, shared)] + [(None, f"{words(rng, 20)} {shared} tail")] * 30 + [(2, f"{words(rng, 9)} {shared}")] * 30
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for kind in (repeats.Kind(phrase_dedup._words, lambda u: u, "uint64", 12, 4, True), repeats.Kind(suffix_dedup._bytes, suffix_dedup.byte_symbols, "uint8", 60, 20, False)):
        found = repeats.first_look(table, kind, "equal")
        assert found.open.count() == found.open.select("probe", "context").distinct().count() > 0
        for r in repeats.runs_by_text(found.whole.unionByName(found.whole)).collect():
            assert len(r.runs) == len({(x.lo, x.hi) for x in r.runs})
    found = phrase_dedup.remove_earlier(table, window=12, probe=4).where("doc_id = 2").collect()
    assert len(found) == 30 and {r.n_words - sum(s.hi - s.lo for s in r.spans) for r in found} == {9}


def test_token_files(spark, docs, empty, tmp_path):
    tokenizer = encoder(tokenizer_path()).tokenizer
    manifest = token_files.write_token_files(docs, str(tmp_path / "a"), parts=3)
    found = token_files.read_token_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("doc_id").collect()
    at = 0
    assert len(found) == len(corpus()) and manifest["bytes"] == 2
    for r, (i, t) in zip(found, corpus()):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    token_files.write_token_files(empty, str(tmp_path / "b"))
    assert token_files.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_encoding_in_segments():
    import pyarrow as pa

    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "b", "é", "1", "!", " ", "　", "'s", "'", "x", "\t", "中", " ", ".", " z", "<|endoftext|>", "\x1c", "\x85", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    own = encoder(tokenizer_path())
    ids, offsets = own.encode(pa.array(texts))
    whole = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(ids[a:b].tolist() == e.ids for a, b, e in zip(offsets, offsets[1:], whole))


def test_line_dedup(spark, docs, empty):
    rows = [(i, t.split("\n")) for i, t in corpus() if t]
    seen, runs, gone = set(), set(), defaultdict(set)
    for i, lines in rows:
        for k, line in enumerate(lines):
            if line in seen and len(line) >= 40:
                gone[i].add(k)
            seen.add(line)
            four = tuple(lines[k : k + 4])
            if len(four) == 4:
                if four in runs:
                    gone[i] |= set(range(k, k + 4))
                runs.add(four)
    found = {r.doc.doc_id: r for r in line_dedup.delete_repeats(docs).collect()}
    assert set(found) == {i for i, _ in corpus()}
    for i, t in corpus():
        expected = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t else t
        assert (found[i].text, set(found[i].gone)) == (expected, gone[i]), i
    assert line_dedup.delete_repeats(empty).count() == 0
    twice = spark.createDataFrame([(None, "x" * 50), (None, "x" * 50), (1, "y" * 50), (1, "y" * 50)], "doc_id long, text string")
    assert {len(r.gone) for r in line_dedup.delete_repeats(twice).collect()} == {0}


def test_fold(spark):
    ids = spark.range(50).select("id", split_row(F.col("id")).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in ids)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(17)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    pairs += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(7, 7), (100, 101)]
    union = UnionFind()
    for a, b in pairs:
        union.union(a, b)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    found = components(links, Kept(spark, "components"), "t").collect()
    assert {r.node: r.component for r in found} == {x: union.find(x) for x in linked} and len(found) == len(linked)
    assert components(links.limit(0), Kept(spark, "components"), "t").count() == 0
