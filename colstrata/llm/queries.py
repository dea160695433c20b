"""The registered queries of the training-data operators: thin contracts over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The second tokenizer version of op5.
SECOND = "byte_bpe_multi_50k"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).drop("kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    out = shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import digest

    return digest(table(spark, sf_dir, "documents"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after each of four batches over all documents (column ``after``).

    Insert every document (``load``), delete those that repeat a text (``repeats``), revise those that hold runs of white
    space by the counts of their cleaned text (``cleaned``), insert what is distinct under a second tokenizer version
    (``second``).  A batch that comes again changes nothing.
    """
    import uuid

    from ._shared import durable, scratch
    from .token_rollup import Rollup, repeats

    docs = table(spark, sf_dir, "documents")
    rollup = Rollup(spark, scratch(spark, f"rollup-{uuid.uuid4().hex}"))
    again = repeats(docs)
    once = docs.join(again, "doc_id", "left_anti")
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    cleaned = once.select("doc_id", plain.alias("text"), "source", "lang", (plain != F.col("text")).alias("differs")).where("differs").drop("differs")
    after = []
    for batch, change in (
        ("load", lambda b: rollup.insert(b, docs)),
        ("repeats", lambda b: rollup.delete(b, again)),
        ("cleaned", lambda b: rollup.revise(b, cleaned)),
        ("second", lambda b: rollup.insert(b, once, SECOND)),
    ):
        change(batch)
        change(batch)  # a retry: committed already
        after.append(rollup.totals().withColumn("after", F.lit(batch)))
    out = after[0]
    for more in after[1:]:
        out = out.unionByName(more)
    return durable(out, "totals")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    flag = F.expr("n_hit > 0 AND 20 * n_hit >= n_words")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), flag.alias("contaminated"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2, width=64)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


SQL = {
    "op1_suffix_dedup": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, s, md5_number(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, greatest(n - 199, 0))) AS s FROM d)),
hit AS (SELECT rid, s FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
marked AS (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 THEN 0 ELSE 1 END AS f FROM hit),
spans AS (SELECT rid, min(s) AS a, max(s) + 200 AS e FROM (SELECT rid, s, sum(f) OVER (PARTITION BY rid ORDER BY s) AS g FROM marked) GROUP BY rid, g),
edges AS (SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS b, a, e FROM spans),
cut AS (SELECT rid, sum(e - a) AS removed, count(*) AS runs, max(e) AS tail FROM spans GROUP BY rid),
kept AS (SELECT rid, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS text FROM edges JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.text, '') || substr(h, 2 * coalesce(tail, 0) + 1, 2 * n))) AS kept_sha256
FROM d LEFT JOIN cut USING (rid) LEFT JOIN kept USING (rid)
""",
    "op3_secrets": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
forms(kind, rank, re) AS (VALUES ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'), ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{16,}'), ('random', 3, '[A-Za-z0-9+/_-]{12,}')),
cut AS (SELECT rid, kind, rank, m, p, generate_subscripts(m, 1) AS i FROM (SELECT rid, kind, rank, regexp_extract_all(t, re) AS m, string_split_regex(t, re) AS p FROM d, forms) WHERE len(m) > 0),
found AS (SELECT rid, kind, rank, m[i] AS match, sum(length(p[i])) OVER w + sum(length(m[i])) OVER w - length(m[i]) AS s, sum(length(p[i])) OVER w + sum(length(m[i])) OVER w AS e FROM cut WINDOW w AS (PARTITION BY rid, kind ORDER BY i)),
base AS (SELECT * FROM found WHERE kind = 'assign' AND length(regexp_extract(match, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 OR kind = 'access' AND length(match) >= 18 OR kind = 'hex' AND length(match) >= 16),
free AS (SELECT * FROM found f WHERE kind = 'random' AND (length(match) >= 20 OR length(match) >= 12 AND regexp_matches(match, '[0-9]')) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = f.rid AND b.s < f.e AND f.s < b.e)),
tok AS (SELECT DISTINCT match AS token, CASE WHEN regexp_full_match(match, '[0-9]+') THEN 'dec' WHEN regexp_full_match(match, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(match, '[A-Z2-7]+') THEN 'b32' ELSE 'b64' END AS enc FROM free),
abc(enc, letters) AS (VALUES ('dec', '0123456789'), ('hex', '0123456789abcdef'), ('b32', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), ('b64', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/')),
sym AS (SELECT token, enc, k, i, instr(letters, core[i]) - 1 AS v FROM (SELECT token, enc, letters, length(letters) AS k, core, unnest(generate_series(1, length(core))) AS i FROM (SELECT token, enc, letters, CASE WHEN enc = 'hex' THEN lower(token) ELSE translate(token, '-_', '+/') END AS core FROM tok JOIN abc USING (enc)))),
mid AS (SELECT *, avg(v) OVER (PARTITION BY token) AS mean, lag(v) OVER (PARTITION BY token ORDER BY i) AS u FROM sym),
sums AS (SELECT token, any_value(enc) AS enc, CAST(any_value(k) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE 2 * v >= k) AS DOUBLE) AS hi, CAST(1 + count(*) FILTER (WHERE u IS NOT NULL AND (2 * v >= k) <> (2 * u >= k)) AS DOUBLE) AS runs, sum((v - mean) * (v - mean)) AS dev, coalesce(sum((v - mean) * (u - mean)), 0) AS lagged FROM mid GROUP BY token),
sq AS (SELECT token, CAST(sum(c * c) AS DOUBLE) AS squares FROM (SELECT token, v, count(*) AS c FROM sym GROUP BY token, v) GROUP BY token),
stat AS (SELECT token, enc, n, (k / n * squares - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS chi, 2 * hi * (n - hi) AS two, hi, runs, dev, lagged FROM sums JOIN sq USING (token)),
z AS (SELECT token, enc, n, chi, CASE WHEN hi < 1 OR n - hi < 1 OR two * (two - n) / (n * n * (n - 1)) <= 0 THEN 8 ELSE abs(runs - two / n - 1) / sqrt(two * (two - n) / (n * n * (n - 1))) END AS run, CASE WHEN dev > 0 THEN abs(lagged / dev + 1 / n) * sqrt(n) ELSE 8 END AS serial FROM stat),
tails AS (SELECT token, enc, n, 1 / (1 + exp(least(600, 1.5976 * chi + 0.07056 * chi * chi * chi))) AS a, least(1, 2 / (1 + exp(least(600, 1.5976 * run + 0.07056 * run * run * run)))) AS b, least(1, 2 / (1 + exp(least(600, 1.5976 * serial + 0.07056 * serial * serial * serial)))) AS c FROM z),
scored AS (SELECT token, enc, CAST(floor(log2(n)) AS INTEGER) AS size, exp(-h) * (1 + h + h * h / 2) AS p FROM (SELECT *, -(ln(greatest(a, 1e-300)) + ln(greatest(b, 1e-300)) + ln(greatest(c, 1e-300))) AS h FROM tails)),
cls AS (SELECT DISTINCT enc, size FROM scored),
pool AS (SELECT c.enc, c.size, s.p FROM cls c JOIN scored s ON s.enc = c.enc AND (s.size = c.size OR (SELECT count(*) FROM scored o WHERE o.enc = c.enc AND o.size = c.size AND floor(o.p * 20) >= 10) < 20)),
upper_ AS (SELECT enc, size, count(*) FILTER (WHERE floor(p * 20) >= 10) AS half, count(*) FILTER (WHERE floor(p * 20) >= 15) AS quarter FROM pool GROUP BY enc, size),
tries AS (SELECT p.enc, p.size, s, count(*) FILTER (WHERE least(19, floor(p.p * 20)) >= s) AS n FROM pool p, (SELECT unnest(generate_series(1, 9)) AS s) GROUP BY p.enc, p.size, s),
least_ AS (SELECT enc, size, min(s) / 20.0 AS least FROM tries JOIN upper_ USING (enc, size) WHERE n > 0 AND n - (CASE WHEN quarter >= half / 2.0 - sqrt(half) THEN half * 2 ELSE quarter * 4 END) * (1 - s / 20.0) <= 0.05 * n GROUP BY enc, size),
flagged AS (SELECT token FROM scored JOIN least_ USING (enc, size) WHERE p >= least),
spans AS (SELECT rid, kind, rank, s, e FROM base UNION ALL SELECT rid, kind, rank, s, e FROM free WHERE match IN (SELECT token FROM flagged)),
lines AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS x, count(*) FILTER (WHERE rank = 2) AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS every FROM spans GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(x, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN lines USING (rid)
""",
    "op9_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, s, m, item_id FROM dw JOIN bw USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_sharding, op3_secrets, op4_media, op5_token_rollup, op6_pii, op7_quality, op8_mixing, op9_decontaminate, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
