"""Secret scan: fixed forms, and a randomness test battery over other tokens; DataFrame functions only.

Tokens of the base-64 alphabets are candidates from 20 characters on, with a digit from 12 on.  The narrowest encoding
that can spell a token is inferred (digits, hex, base 32, base 64), and the token's symbols are tested against it:
chi-squared uniformity of the alphabet, a runs test about the middle of the alphabet and the lag-1 serial
correlation.  Fisher's method combines the three p-values.  Random tokens have p-values spread evenly over 0
to 1, words and identifiers pile up at 0, and how far they reach depends on the length.  So within each
(encoding, length class) the number of random tokens is estimated from the upper half of p, which is no part of what is
decided, and only if p is spread evenly there; else from its last quarter.  The threshold is the smallest p below one
half at which the estimated share of non-random tokens among the flagged is at most ``fdr``; where none is, nothing
is flagged.  A class of under LEAST tokens in the upper half is estimated with all of its encoding.
All tokens of the corpus enter the estimate, each distinct token once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import durable
from ._spans import apart, listed, matches

# fixed values: the base forms; {n,} where a shorter match of the plain form would be dropped and hides no other
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex"]
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+)"
DIGITS = "0123456789"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"dec": DIGITS, "hex": DIGITS + "abcdef", "b32": UPPER + "234567", "b64": UPPER + UPPER.lower() + DIGITS + "+/"}
STEPS = 20
LEAST = 20


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Page's logistic approximation)."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.07056 * z * z * z)))


def battery(tokens: DataFrame) -> DataFrame:
    """``(token, enc, n, p)`` for a table of distinct ``token`` strings: p of the combined tests.  Tokens of under two
    symbols have p = 0."""
    t = F.col("token")
    enc = F.when(t.rlike("^[0-9]+$"), "dec").when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Z2-7]+$"), "b32").otherwise("b64")
    core = F.when(enc == "hex", F.lower(t)).otherwise(F.translate(t, "-_", "+/"))
    letters = F.lit("")
    for name, alphabet in ALPHABETS.items():
        letters = F.when(enc == name, F.lit(alphabet)).otherwise(letters)
    d = tokens.select("token", enc.alias("enc"), core.alias("core"), letters.alias("letters")).withColumn("k", F.length("letters"))
    d = d.withColumn("v", F.expr("transform(filter(split(core, ''), c -> c <> ''), c -> locate(c, letters) - 1)")).withColumn("n", F.size("v"))
    d = d.withColumn("squares", F.expr("aggregate(transform(array_distinct(v), x -> cast(size(filter(v, y -> y = x)) as bigint)), 0L, (a, c) -> a + c * c)"))
    d = d.withColumn("high", F.expr("size(filter(v, x -> 2 * x >= k))"))
    d = d.withColumn("runs", F.expr("1 + size(filter(v, (x, i) -> i > 0 AND (2 * x >= k) <> (2 * v[i - 1] >= k)))"))
    d = d.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / greatest(n, 1)"))
    d = d.withColumn("dev", F.expr("aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
    d = d.withColumn("lag", F.expr("aggregate(transform(v, (x, i) -> CASE WHEN i > 0 THEN (x - mean) * (v[i - 1] - mean) ELSE 0D END), 0D, (a, x) -> a + x)"))
    n, k, hi, lo = F.col("n").cast("double"), F.col("k").cast("double"), F.col("high").cast("double"), (F.col("n") - F.col("high")).cast("double")
    chi = (k / n * F.col("squares") - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    two = 2 * hi * lo
    spread = two * (two - n) / (n * n * (n - 1))
    run = F.when((hi < 1) | (lo < 1) | (spread <= 0), F.lit(8.0)).otherwise(F.abs(F.col("runs") - two / n - 1) / F.sqrt(F.when(spread > 0, spread).otherwise(F.lit(1.0))))
    serial = F.when(F.col("dev") > 0, F.abs(F.col("lag") / F.when(F.col("dev") > 0, F.col("dev")).otherwise(F.lit(1.0)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0))
    ps = [_tail(chi), F.least(F.lit(1.0), 2 * _tail(run)), F.least(F.lit(1.0), 2 * _tail(serial))]
    half = -sum((F.ln(F.greatest(p, F.lit(1e-300))) for p in ps), F.lit(0.0))  # Fisher's statistic over 2, 6 degrees
    p = F.exp(-half) * (1 + half + half * half / 2)
    return d.select("token", "enc", "n", F.when(F.col("n") >= 2, p).otherwise(F.lit(0.0)).alias("p"))


def thresholds(scored: DataFrame, fdr: float = 0.05) -> DataFrame:
    """``(enc, size, least)``: for each encoding and length class (power of two) the p from which tokens are flagged."""
    cls = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int").alias("size")
    cells = scored.groupBy("enc", cls, F.least(F.lit(STEPS - 1), F.floor(F.col("p") * STEPS)).cast("int").alias("step")).count()
    by = cells.groupBy("enc", "size").agg(F.collect_list(F.struct("step", "count")).alias("own"))
    pooled = cells.groupBy("enc", "step").agg(F.sum("count").alias("count")).groupBy("enc").agg(F.collect_list(F.struct("step", "count")).alias("all"))
    above = lambda cells, s: F.aggregate(F.filter(cells, lambda c: c["step"] >= s), F.lit(0).cast("long"), lambda a, c: a + c["count"])
    by = by.join(pooled, "enc").withColumn("cells", F.when(above("own", F.lit(STEPS // 2)) >= LEAST, F.col("own")).otherwise(F.col("all")))
    by = by.withColumn("half", above("cells", F.lit(STEPS // 2))).withColumn("quarter", above("cells", F.lit(3 * STEPS // 4)))
    even = F.col("quarter") >= F.col("half") / 2 - F.sqrt("half")  # within two deviations
    by = by.withColumn("random", F.when(even, F.col("half") * 2).otherwise(F.col("quarter") * 4))
    tries = F.transform(F.sequence(F.lit(1), F.lit(STEPS // 2 - 1)), lambda s: F.struct(s.alias("s"), above("cells", s).alias("n")))
    good = F.filter(tries, lambda t: (t["n"] > 0) & (t["n"] - F.col("random") * (1 - t["s"] / STEPS) <= fdr * t["n"]))
    return by.select("enc", "size", (F.array_min(F.transform(good, lambda t: t["s"])) / STEPS).alias("least")).where("least IS NOT NULL")


def unknown(tokens: DataFrame, fdr: float = 0.05) -> DataFrame:
    """``(token)``: the distinct tokens of ``tokens(token)`` that the battery flags."""
    scored = durable(battery(tokens.select("token").distinct()), "scored")
    limits = thresholds(scored, fdr)  # at most encodings x 31 length classes
    return scored.withColumn("size", F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int")).join(F.broadcast(limits), ["enc", "size"]).where("p >= least").select("token")


def scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """``(rid, doc_id, spans array<struct<start, end, rank, kind>>)``, one row per row of ``docs(doc_id, text)``.

    Kinds: assign, access and hex are the base forms (rank 0 to 2), random are added tokens (rank 3) that overlap no
    base span and pass the battery.  Null and empty texts have no spans; repeated rows are scanned each, rows without doc_id
    too; an empty table gives no rows; other columns are ignored.
    """
    found = matches(docs, {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN})
    value = F.regexp_extract("match", ASSIGN, 1)
    found = durable(found.where((F.coalesce("kind", F.lit("")) != "assign") | (F.length(value) >= 12)), "spans")
    spans = found.where("kind IS NOT NULL").withColumn("free", apart(found, F.col("kind") != "random"))
    tokens = spans.where("kind = 'random' AND free").select("rid", "doc_id", "kind", "start", "end", F.col("match").alias("token"))
    added = tokens.join(unknown(tokens, fdr), "token").select("rid", "doc_id", "kind", "start", "end")
    every = found.where("kind IS NULL OR kind <> 'random'").select("rid", "doc_id", "kind", "start", "end").unionByName(added)
    rank = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "random"]]), F.col("kind")).cast("int") - 1
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "end", rank.alias("rank"), "kind"))
    return every.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(one).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    order = ["start", "rank", "end"]
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(listed(base, order), 256).alias("base_sha256"), listed(F.col("spans"), order).alias("spans"))
