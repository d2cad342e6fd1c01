"""Periodic runs, phrases and byte-level BPE against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from catloom.llm import bpe_text, collocations, periodic_runs, queries
from catloom.llm.recompression import Grammar
from catloom.llm.tokenizing import tokenizer_path


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- recompression and runs -----------------------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_grammar_extends_exactly(letters):
    rng = random.Random(letters)
    for _ in range(30):
        n = rng.randint(2, 120)
        body = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5:
            body = (body[: rng.randint(1, 9)] * n)[:n]
        s = np.array([100, *body, 101])
        g = Grammar(s)
        i, j = np.array([(a, b) for a in range(1, n + 1) for b in range(a + 1, n + 1)]).T if n > 1 else (np.zeros(0, int),) * 2
        ahead, behind = g.ahead(i, j), g.behind(i, j)
        for a, b, f, r in zip(i, j, ahead, behind):
            k = 0
            while s[a + k] == s[b + k]:
                k += 1
            assert f == k
            k = 0
            while s[a - k] == s[b - k]:
                k += 1
            assert r == k


def plain_runs(w, least=24, times=3):
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            k = i
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            if k - i + p >= max(least, times * p):
                found.setdefault((i, k - i + p), p)
            i = max(k, i) + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_texts():
    rng = random.Random(5)

    def made(n, letters="abc"):
        return [rng.choice(letters) for _ in range(n)]

    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a\tb\n" * 12, "a b " * 11 + "a b", "é " * 30 + "x " + "é " * 30]
    for _ in range(60):
        base = made(rng.randint(1, 40))
        texts.append(" ".join(made(rng.randint(0, 30)) + base * rng.randint(1, 9) + base[: rng.randint(0, len(base))] + made(rng.randint(0, 30))))
    texts += [" ".join((made(5) * 4 + ["z"]) * 6) for _ in range(5)]
    texts += ["a b c " * 20 + "a b d " * 20 + "a " * 50, " ".join(made(4000, "ab")), " ".join(made(700) * 5), texts[20], texts[20]]
    return texts


def test_runs(spark):
    texts = run_texts()
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, runs string, row int").repartition(3)
    found = {r.row: r for r in periodic_runs.periodic_runs(table).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = plain_runs(w)
        assert [tuple(r) for r in found[i].runs] == want, i
        assert found[i].n_words == len(w) and found[i].collapsed == plain_collapse(w, want), i
    assert any(len(r.runs) > 1 for r in found.values())


def test_runs_of_other_lengths(spark):
    rng = random.Random(9)
    words = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(80)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    for least, times in ((4, 2), (7, 4)):
        found = {r.doc_id: r for r in periodic_runs.periodic_runs(table, least=least, times=times).collect()}
        assert all([tuple(r) for r in found[i].runs] == plain_runs(w, least, times) for i, w in enumerate(words))


def test_runs_places_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PLACES", 7)
    w = np.array([0, 1, 2] * 20 + [5] + [3, 4] * 30)
    found = periodic_runs.find_runs(w, np.array([0, 61, 61, len(w)]))
    assert found.tolist() == [[0, 0, 60, 3], [2, 0, 60, 2]]


def test_op13_query(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, None if i == 3 else " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 150)))) for i in range(400)]
    rows += [(None, "a b " * 20), (500, "x " * 40), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    planted = 0
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        r = found[i]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)) and r.collapsed_sha256 == sha(plain_collapse(w, runs))
    assert planted > 20


# --- phrases --------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top, depth=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(depth, len(w) - i) + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if 1 < len(p) <= depth and a >= least}
        inner = Counter()
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        scored = []
        for p, a in some.items():
            if inner[p] >= a:
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(7)
    vocabulary = ["The", "of", "a", "é", "naïve", "x1", "-", "日本", *(f"w{i}" for i in range(40))]
    weights = [30, 25, 20, 8, 5, 5, 5, 4, *([1.5] * 40)]
    rows = [(None, None), ("en", ""), ("en", "  \t . ,, \n"), ("fr", None)]
    for i in range(150):
        text = "".join(
            w + rng.choices([" ", "  ", "\t", ", ", ". ", "\n", "!?"], [20, 1, 1, 2, 1, 1, 1])[0]
            for w in rng.choices(vocabulary, weights, k=rng.randint(1, 60))
        )
        rows.append((rng.choices(["en", "fr", None], [6, 2, 1])[0], text))
    rows += [("en", "Once upon a time there was the end of a story")] * 30 + [("en", "the of " * 400), ("fr", "a " * 300)]
    return rows


@pytest.mark.parametrize("group_words", [10**6, 200, 3])
def test_phrases(spark, group_words, monkeypatch):
    rows = phrase_rows()
    table = spark.createDataFrame([(i % 5, lang, t, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, a int").repartition(4)
    monkeypatch.setattr(collocations, "LINES", 150)
    for least, top in ((12, 2000), (4, 15)):
        found = collocations.collocations(table, least=least, top=top, group_words=group_words)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in found.collect()) == plain_phrases(rows, least, top)


def test_phrases_of_long_texts_and_empty_tables(spark, monkeypatch):
    rng = random.Random(8)
    long = "".join(rng.choice(["aa ", "bb ", "cc ", "dd. ", "ee, "]) for _ in range(20000))
    table = spark.createDataFrame([("en", long), ("en", "aa bb")], "lang string, text string").coalesce(1)
    own = plain_phrases([("en", long), ("en", "aa bb")], 100, 50)
    assert sorted(tuple(r) for r in collocations.collocations(table, top=50).collect()) == own
    data = np.frombuffer(long.encode(), np.uint8)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 900)
    import pyarrow as pa

    parts = list(collocations._parts(pa.record_batch([pa.array(["en"]), pa.array([long])], ["lang", "text"])))
    assert len(parts) > 10 and b"".join(p[0].tobytes() for p in parts) == data.tobytes()
    assert all(chr(p[0][-1]) in ".," for p in parts[:-1])
    assert collocations.collocations(table.limit(0)).count() == 0


def test_quicksort_counts_prefixes():
    rng = random.Random(4)
    lines = [[rng.randrange(4) for _ in range(rng.randint(0, 4))] for _ in range(500)]
    columns = [np.array([x[d] if d < len(x) else -1 for x in lines]) for d in range(4)]
    weight = np.array([rng.randint(1, 3) for _ in lines])
    found = collocations.quicksort(columns, weight, 5, [np.arange(250), np.arange(250, 500)])
    for lo, hi in ((0, 250), (250, 500)):
        want = Counter()
        for x, w in zip(lines[lo:hi], weight[lo:hi]):
            for m in range(1, len(x) + 1):
                want[tuple(x[:m])] += int(w)
        got = {tuple(lines[i][:m]): a for i, m, a in found if lo <= i < hi}
        assert got == {p: a for p, a in want.items() if a >= 5}


# --- byte-level BPE -------------------------------------------------------------------------------------------


def plain_encode(text):
    """Each match of the pattern merged by itself, the lowest rank first."""
    import base64

    import regex

    if not hasattr(plain_encode, "ranks"):
        with open(tokenizer_path(bpe_text.RANKS), "rb") as lines:
            plain_encode.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    ranks, ids = plain_encode.ranks, []
    for match in regex.findall(bpe_text.pattern(), text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        ids += [ranks[p] for p in parts]
    return ids


def bpe_texts():
    rng = random.Random(6)
    signs = ["a", "é", " ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "7", "日本", "🙂", " ", " ", "\x1c", "<|endoftext|>", "word ", ", ", "́", "ﬁ"]
    texts = [None, "", " ", "\n" * 40, " " * 300 + "x", "x" + " " * 300, "don't we'll they'Re", "<|endoftext|>", "a" * 2000, "1" * 500]
    return texts + ["".join(rng.choices(signs, k=rng.randint(1, 300))) for _ in range(150)]


@pytest.mark.parametrize("size", [1 << 15, 5])
def test_bpe(spark, size, monkeypatch):
    texts = bpe_texts()
    own = bpe_text.Codec(tokenizer_path(bpe_text.RANKS), bpe_text.pattern())
    monkeypatch.setattr(bpe_text, "SEGMENT_CHARS", size)
    for t in texts:
        assert "".join(bpe_text.segments(t or "")) == (t or "")
        assert own.encode(t) == plain_encode(t or ""), t
        assert own.decode(own.encode(t)) == (t or "").encode()


def test_bpe_columns_and_bytes(spark):
    texts = bpe_texts() + ["tok " * 60000, "y" * 200000]
    rows = [(i % 9 or None, t, "old", i) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, row int")
    coded = bpe_text.encode(table)
    assert coded.columns == ["doc_id", "text", "row", "token_ids"]
    back = bpe_text.decode(coded.drop("text"))
    assert back.columns == ["doc_id", "row", "decoded"]
    found = {r.row: bytes(r.decoded) for r in back.collect()}
    assert all(found[i] == (t or "").encode() for i, t in enumerate(texts))
    ids = [(0, [0, 255]), (1, [50255]), (2, []), (3, None)]
    raw = {r.row: bytes(r.decoded) for r in bpe_text.decode(spark.createDataFrame(ids, "row int, token_ids array<int>")).collect()}
    own = bpe_text.Codec(tokenizer_path(bpe_text.RANKS), bpe_text.pattern())
    assert raw == {i: own.decode(x) for i, x in ids} and raw[2] == raw[3] == b""
    assert bpe_text.encode(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe_text.encode(table, ids="text")


def test_op12_query(spark, tmp_path):
    rows = list(enumerate(bpe_texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op12_bpe_text(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = plain_encode(t or "")
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    assert len(found) == len(rows)
