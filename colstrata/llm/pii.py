"""Personal data: fixed forms, and bootstrapped contextual extraction; DataFrame functions only.

The base forms' matches are the seeds.  Each has lexical patterns: the word before, the two words before and the word
after it, whole words of any length.  What fills a pattern's slot anywhere, any blank-separated token of any form, is an
instance of it.  Pattern and instance scores are refined in turns on the bipartite graph: a pattern's confidence for a
kind is the mean score of its distinct instances (smoothed, and with at least ``support`` instances that are seeds or
scored ``accept`` or more in the round before), an instance's score is the noisy-or of its patterns.  Tokens
whose score ends at ``accept`` or more are added as kind ``context``; the patterns that they have elsewhere are gathered
in turn, so discovered values admit patterns that no seed has.

Only patterns that enough seeds or accepted values have are looked for in the texts, and their slots are counted by
sketches first: a common word, which very many tokens follow, is dropped there, before any of its instances is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import durable, small
from ._spans import apart, listed, matches

# fixed values: the base forms.  Possessive repeats and the look-behinds change no match, only the time on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
FORM = "|".join(f"(?:{p})" for p in (EMAIL, IP, PHONE))
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 3
LEAST = 0.1


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("double") <= 255, F.lit(False)))
    twice = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (i % 2 + 1))
    luhn = F.aggregate(twice, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    card = n.between(16, 19) & (F.when(n.between(16, 19), luhn) % 10 == 0)
    return F.when(kind == "ip", parts).when(kind == "card", card).when(kind == "phone", n.between(8, 15)).otherwise(F.lit(True))


def _before(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit("\"'(=:")))


def _after(word: Column) -> Column:
    return F.lower(F.ltrim(word, F.lit("\"')")))


def _named(one: Column, two: Column, next_: Column) -> Column:
    """Patterns of a place, from the words beside it; words without letters or digits make none."""
    some = lambda x: F.length(F.coalesce(x, F.lit(""))) > 0
    named = F.array(F.when(some(one), F.concat(F.lit("1<"), one)), F.when(some(one) & some(two), F.concat(F.lit("2<"), two, F.lit(" "), one)), F.when(some(next_), F.concat(F.lit("1>"), next_)))
    return F.filter(named, lambda p: p.isNotNull())


def _patterns() -> Column:
    """Patterns of a match from ``before`` and ``after``, the words beside it with their blanks as spaces."""
    left = F.filter(F.split(F.rtrim("before", F.lit("\"'(=: ")), " "), lambda x: x != "")
    right = F.filter(F.split(F.ltrim("after", F.lit("\"') ")), " "), lambda x: x != "")
    return _named(_before(F.try_element_at(left, F.lit(-1))), F.lower(F.try_element_at(left, F.lit(-2))), _after(F.get(right, F.lit(0))))


def slots(docs: DataFrame) -> DataFrame:
    """``(value, one, two, next)`` of every token of ``docs(text)``: the token and the words beside it, lower-cased."""
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select(w.alias("w"))
    none = F.array(F.lit(None).cast("string"))
    shifted = lambda k: F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - k)))
    zipped = F.arrays_zip(F.col("w").alias("w"), shifted(1).alias("a"), shifted(2).alias("b"), F.concat(F.slice("w", 2, F.size("w")), none).alias("c"))
    each = rows.select(F.inline(zipped).alias("w", "a", "b", "c")).where("w IS NOT NULL")
    return each.select(F.lower("w").alias("value"), _before(F.col("a")).alias("one"), F.lower("b").alias("two"), _after(F.col("c")).alias("next"))


def fillers(docs: DataFrame, patterns: DataFrame, form: str | None) -> DataFrame:
    """``(pattern, value)`` of the tokens of ``docs`` in the slots of ``patterns(pattern)``, but for tokens that match ``form``.
    One pass: a token is looked up by the word before it, the two before it and the word after it."""
    at = slots(docs)
    held = []
    for kind, word in (("1<", F.col("one")), ("2<", F.concat("two", F.lit(" "), "one")), ("1>", F.col("next"))):
        name = f"p{len(held)}"
        wanted = patterns.where(F.col("pattern").startswith(kind)).select(F.substring("pattern", 3, 1 << 30).alias(f"w{len(held)}"), F.col("pattern").alias(name))
        at = at.join(small(wanted), word == F.col(f"w{len(held)}"), "left")
        held.append(name)
    some = at.where(" OR ".join(f"{x} IS NOT NULL" for x in held))
    some = some.where(~F.col("value").rlike(form)) if form else some
    return some.select("value", F.explode(F.array(*held)).alias("pattern")).where("pattern IS NOT NULL").select("pattern", "value")


def _gather(docs: DataFrame, edges: DataFrame, seen: DataFrame, taken: DataFrame | None, support: int, form: str | None) -> tuple[DataFrame, DataFrame]:
    """(new patterns, the unknown values in their slots): patterns not in ``seen`` with ``support`` seeds or taken values
    and not too many other fillers to reach LEAST.  Fillers are counted by sketches in one pass over the texts; only those of
    patterns that are left are gathered."""
    known = edges.where("kind IS NOT NULL").select("pattern", "value")
    if taken is not None:
        known = known.unionByName(edges.where("kind IS NULL").join(taken, "value", "left_semi").select("pattern", "value"))
    backed = known.groupBy("pattern").agg(F.count_distinct("value").alias("s")).where(F.col("s") >= support)
    backed = durable(backed.join(seen, "pattern", "left_anti"), "backed")
    if backed.isEmpty():
        return backed.select("pattern"), edges.limit(0)
    width = fillers(docs, backed, form).groupBy("pattern").agg(F.approx_count_distinct("value", 0.05).alias("n"))
    left = backed.join(width, "pattern").where(F.col("s") >= 0.8 * LEAST * F.col("n")).select("pattern")
    left = durable(left, "left")
    if left.isEmpty():
        return backed.select("pattern"), edges.limit(0)
    inside = durable(fillers(docs, left, form).distinct().select("value", F.lit(None).cast("string").alias("kind"), "pattern"), "fillers")
    return backed.select("pattern"), inside


def discover(docs: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, support: int = 5, accept: float = 0.8, form: str | None = FORM) -> DataFrame:
    """``(value, kind, score)`` of tokens of ``docs`` that patterns of ``seeds(value, kind, pattern)`` find, directly or through
    other values found; tokens that match ``form`` are known already.  Texts are read again only while there are new patterns."""
    edges = durable(seeds.select("value", "kind", "pattern").distinct(), "seeds")
    seen = edges.select("pattern").limit(0)
    graph, more, taken = None, None, None
    for _ in range(rounds):
        fresh, inside = _gather(docs, edges, seen, taken, support, form)
        seen = seen.unionByName(fresh)
        if inside.isEmpty():
            break
        edges = durable(edges.unionByName(inside).distinct(), "edges")
        live = edges.where("kind IS NULL").select("pattern").distinct()
        graph = durable(edges.join(live.join(seen, "pattern", "left_semi"), "pattern", "left_semi"), "graph")
        more = bootstrap(graph, rounds, support, accept)
        taken = durable(more.select("value").distinct(), "taken")
        if taken.isEmpty():
            break
        # the patterns that accepted values have elsewhere
        at = slots(docs).join(small(taken), "value", "left_semi").select("value", F.explode(_named(F.col("one"), F.col("two"), F.col("next"))).alias("pattern"))
        edges = durable(edges.unionByName(at.distinct().select("value", F.lit(None).cast("string").alias("kind"), "pattern")).distinct(), "edges")
    return more if more is not None else edges.select("value", "kind", F.lit(0.0).alias("score")).limit(0)


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, support: int = 5, accept: float = 0.8) -> DataFrame:
    """``(value, kind, score)`` of values that the patterns find; ``instances(value, kind, pattern)`` with kind null
    where unknown.  Only values without a seed kind come out, with their best kind.  Repeated rows count once; without any
    seeds or any unknown values, or on an empty table, there are none; null values and patterns take part like others."""
    edges = durable(instances.select("value", "kind", "pattern").distinct(), "graph")
    if edges.where("kind IS NULL").isEmpty() or edges.where("kind IS NOT NULL").isEmpty():
        return edges.select("value", "kind", F.lit(0.0).alias("score")).limit(0)
    size = durable(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isNotNull()).alias("seeds")), "sizes")
    seeds = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("sum"))
    unknown = durable(edges.where("kind IS NULL").select("value", "pattern"), "unknown")
    score = None
    for _ in range(rounds):
        mass, live = seeds, size.where(F.col("seeds") >= support)
        if score is not None:
            mass = seeds.unionByName(unknown.join(score, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("sum")))
            mass = mass.groupBy("pattern", "kind").agg(F.sum("sum").alias("sum"))
            taken = score.where(F.col("score") >= accept).select("value").distinct()
            found = unknown.join(taken, "value").groupBy("pattern").agg(F.count("*").alias("found"))
            live = size.join(found, "pattern", "left").where(F.col("seeds") + F.coalesce("found", F.lit(0)) >= support)
        trust = mass.join(live, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("conf")).where(F.col("conf") >= LEAST)
        score = unknown.join(trust, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.col("conf"))))).alias("score"))
        score = durable(score, "scores")
    best = score.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("value", "b.kind", "b.score").where(F.col("score") >= accept)


def scan(docs: DataFrame, rounds: int = ROUNDS, support: int = 5, accept: float = 0.8) -> DataFrame:
    """``(rid, doc_id, spans array<struct<start, end, rank, kind>>)``, one row per row of ``docs(doc_id, text)``.

    Kinds email, ip, card, phone (rank 0 to 3) are the base forms, ``context`` (rank 4) what the patterns add: tokens
    that overlap no base span.  Null and empty texts have no spans; repeated rows are scanned each, rows without doc_id
    too; an empty table gives no rows; other columns are ignored.
    """
    found = matches(docs, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}, words=True)
    found = durable(found.where(F.col("kind").isNull() | _valid(F.col("kind"), F.col("match"))), "pii")
    seeds = found.where("kind IS NOT NULL").select(F.concat_ws("=", "kind", F.lower("match")).alias("value"), "kind", F.explode(_patterns()).alias("pattern"))
    more = durable(discover(docs, seeds, rounds, support, accept).select("value").distinct(), "more")
    every = found.select("rid", "doc_id", "kind", "start", "end")
    if not more.isEmpty():
        # only texts that hold one of the values are cut in tokens, each once, for their places
        spans = matches(holding(docs, more), {"context": WORD}).where("kind IS NOT NULL").withColumn("value", F.lower("match"))
        places = spans.join(small(more), "value", "left_semi").select("doc_id", "h", "kind", "start", "end").alias("p")
        rows = found.where("kind IS NULL").select("rid", "doc_id", "h").alias("r")
        added = rows.join(places, F.expr("r.doc_id <=> p.doc_id AND r.h = p.h")).select("r.rid", "r.doc_id", "p.kind", "p.start", "p.end")
        both = every.where("kind IS NOT NULL").unionByName(added).withColumn("free", apart(every, F.col("kind") != "context"))
        every = every.unionByName(both.where("kind = 'context' AND free").drop("free"))
    rank = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "context"]]), F.col("kind")).cast("int") - 1
    one = F.when(F.col("kind").isNotNull(), F.struct("start", "end", rank.alias("rank"), "kind"))
    return every.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(one).alias("spans"))


def holding(docs: DataFrame, values: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the documents with a token among ``values(value)``; rows of one id and text once."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    w = F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
    ids = base.select("doc_id", "h", F.explode(w).alias("value")).join(small(values), "value", "left_semi").select("doc_id", "h").distinct()
    ids = small(durable(ids, "held")).alias("i")
    held = base.alias("b").join(ids, F.expr("b.doc_id <=> i.doc_id AND b.h = i.h"), "left_semi")
    return held.dropDuplicates(["doc_id", "h"]).select("doc_id", "text")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    order = ["rank", "start", "end"]
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(listed(base, order), 256).alias("base_sha256"), listed(F.col("spans"), order).alias("spans"))
