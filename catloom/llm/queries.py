"""The registered queries of the operators, each over its whole tables, and the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catloom.llm import (
    bpe_text, collocations, decontaminate, language_id, line_dedup, minhash, packing, periodic_runs, phrase_dedup, suffix_dedup, token_files,
    topk, toxicity,
)
from catloom.llm.common import documents
from catloom.session import checkpoint_folder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.duplicate_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir), labels)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.judge(decontaminate.find_items(documents(spark, sf_dir), items))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), digest=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup.remove_earlier(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), folder)
    return token_files.read_token_files(spark, folder)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its lines, how many go, in how many unbroken runs, and the hash of the text that is left."""
    found = line_dedup.delete_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    heads = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) < x - 1))
    return found.select(
        "doc.doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"),
        F.size(heads).cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_bpe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_text.encode(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256)
    numbered = coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "token_ids")
    return bpe_text.decode(numbered).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The documents, of which a tenth, told by the crc32 of the id, repeat their words with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    marked = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    marked = marked.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    marked = marked.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return marked.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(documents(spark, sf_dir).select("doc_id", "text")))
    greater = "r.length * best.period > best.length * r.period"  # the greater share of length and period; the first run of equal ones
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (best, r) -> if({greater}, r, best))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_suffix_dedup, op3_minhash_groups, op4_toxicity, op5_exact_topk, op6_decontaminate, op7_packing,
    op8_phrase_dedup, op9_token_files, op10_line_dedup, op11_collocations, op12_bpe_text, op13_periodic_runs,
)}

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = """
WITH starts AS (
    SELECT doc_id, p, md5(array_slice(b, p + 1, p + 400)) AS h
    FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS p FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents) WHERE octet_length(b) >= 400)
), repeated AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
marked AS (SELECT doc_id, p AS lo, p + 400 AS hi FROM starts SEMI JOIN repeated USING (h)),
edges AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM marked),
runs AS (SELECT *, count(*) FILTER (reach IS NULL OR lo > reach) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM edges),
spans AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM runs GROUP BY doc_id, run),
gaps AS (
    SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
    UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id
), sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
left_over AS (
    SELECT g.doc_id, string_agg(hex(array_slice(encode(d.text), g.lo + 1, coalesce(g.hi, octet_length(encode(d.text))))), '' ORDER BY g.lo) AS kept
    FROM gaps g JOIN documents d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, octet_length(encode(coalesce(d.text, '')))::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
       coalesce(s.n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN s.doc_id IS NULL THEN sha256(coalesce(d.text, '')) ELSE sha256(unhex(k.kept)) END AS kept_sha256
FROM documents d LEFT JOIN sums s USING (doc_id) LEFT JOIN left_over k USING (doc_id)
"""

_OP3 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x AS doc_id, x AS r FROM ways UNION SELECT w.y, reached.r FROM reached JOIN ways w ON w.x = reached.doc_id),
least AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
       coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

_OP5 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER w)::INTEGER AS "rank", vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""

_TOKENS = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP6 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_TOKENS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_TOKENS.format(text=_LOWER.format(text="coalesce(text, '')"))} AS w FROM benchmark),
patterns AS MATERIALIZED (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)
), found AS MATERIALIZED (SELECT doc_id, i, p.n, item_id FROM places q JOIN patterns p ON p.n = q.n AND p.s = q.s),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP8 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS MATERIALIZED (
    SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM windows JOIN firsts USING (h) WHERE doc_id > first)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_OP10 = """
WITH lines AS MATERIALIZED (
    SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')
), seen AS (
    SELECT doc_id, i, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS later FROM lines
), quads AS (
    SELECT doc_id, i, [line, lead(line, 1) OVER w, lead(line, 2) OVER w, lead(line, 3) OVER w] AS four, lead(i, 3) OVER w AS last
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (SELECT doc_id, i, row_number() OVER (PARTITION BY four ORDER BY doc_id, i) > 1 AS later FROM quads WHERE last IS NOT NULL),
gone AS (
    SELECT DISTINCT doc_id, i FROM (
        SELECT doc_id, i FROM seen WHERE later AND length(line) >= 40
        UNION ALL SELECT doc_id, unnest(range(i, i + 4)) AS i FROM runs WHERE later
    )
), heads AS (SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before < i - 1) AS runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_lines, coalesce(h.n, 0)::BIGINT AS n_removed, coalesce(h.runs, 0)::BIGINT AS n_runs,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN heads h USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_OP11 = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format(text="coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS MATERIALIZED (
    SELECT lang, w FROM (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces) WHERE len(w) > 0
), totals AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
    SELECT lang, m, phrase, count(*) AS a FROM (
        SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) t(m) WHERE len(w) >= m)
    ) GROUP BY ALL HAVING count(*) >= 100
), candidates AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inner_ AS (
    SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM candidates, range(2, 5) t(k) WHERE k < m) GROUP BY ALL
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c JOIN totals t ON t.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 : c.m], ' ')
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, (row_number() OVER v)::BIGINT AS "rank", phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest c LEFT JOIN inner_ i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * a
WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER v <= 2000
"""

# Any run holds 16 words in a row that agree with those a period later, so runs are unbroken series of equal 16-word strings at one distance.
_OP13 = f"""
WITH ids AS (
    SELECT doc_id, text, xor(list_reduce(
        list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(c, b)), 4294967295::BIGINT
    ), 4294967295::BIGINT) AS h FROM documents
), plain AS (SELECT doc_id, h, h // 10 AS g, {_WORDS.format(text="coalesce(text, '')")} AS w FROM ids),
d AS MATERIALIZED (
    SELECT doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)),
        lambda i: w[1 + CASE WHEN i < g % len(w) THEN i ELSE g % len(w) + (i - g % len(w)) % (1 + (len(w) - g % len(w)) // (3 + g % 8)) END]) ELSE w END AS w
    FROM plain
), grams AS MATERIALIZED (
    SELECT doc_id, n, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS x FROM (SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM d WHERE n >= 24)
), pairs AS (
    SELECT p.doc_id, p.i, q.i - p.i AS period FROM grams p JOIN grams q ON p.doc_id = q.doc_id AND p.x = q.x AND q.i > p.i AND 3 * (q.i - p.i) <= p.n
), series AS (SELECT doc_id, period, i, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS k FROM pairs),
found AS (SELECT doc_id, period, min(i) AS start, count(*) + 15 + period AS length FROM series GROUP BY doc_id, period, k),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(period) AS period FROM found WHERE length >= greatest(24, 3 * period) GROUP BY ALL),
totals AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id
), best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length * 1000000000000000000::HUGEINT // period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
       (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN totals t USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLES = {
    "op13_periodic_runs": _OP13,
    "op11_collocations": _OP11,
    "op2_suffix_dedup": _OP2, "op3_minhash_groups": _OP3, "op5_exact_topk": _OP5, "op6_decontaminate": _OP6,
    "op8_phrase_dedup": _OP8, "op10_line_dedup": _OP10,
}
