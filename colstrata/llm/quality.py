"""Quality classifier by weak labels: overlapping heuristic labellers, expectation-maximisation, hashed linear scorers.

Two questions are asked of every document: is it well-formed (quality), is it abusive (toxic).  For each,

1. heuristic labellers vote good, bad or abstain on the whole text of every document;
2. expectation-maximisation on the counts of all vote patterns (at most 3 ** labellers rows, whatever the corpus
   size) estimates the labellers' accuracies and each pattern's posterior;
3. a linear scorer over hashed tokens learns the posteriors on a bounded sample of documents (``train_rows``, taken by
   a hash of the id over the whole corpus) by L1-penalised logistic regression;
4. all documents are scored.

Labelled rows, where given, make one more labeller and the word list of another, from at most ``label_rows`` rows
and only of ids in the fitting half (``held_out`` tells the other half, which is never fitted on).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, durable

BITS = 18
TASKS = ("quality", "toxic")
# fixed values: insults that mark abusive prose
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic disgusting worthless clown clowns imbecile dumb filthy vermin".split())
PLAIN = frozenset(".,;:!?'\"()-\u2019\u00bf\u00a1")
#: Labellers of each task, in the order of the votes.
LABELLERS = {"quality": ("symbols", "variety", "runs", "fences", "words", "sentences", "shouting", "labelled"), "toxic": ("insults", "insulting", "learnt words", "learnt density", "labelled")}


WORD, MARK = re.compile(r"[^\W_]+"), re.compile(r"(?:[^\w\s]|_)+")


def _capitals(text: str, low: str) -> int:
    """Upper-case letters of any script: characters that differ from the lower-cased text."""
    if len(text) != len(low):  # a few capitals become two characters
        return sum(map(str.isupper, text))
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (text, low))
    return int(np.count_nonzero(a != b))


def _marks(found: list[str]) -> int:
    """Characters among runs of marks that plain prose has not: symbols, and repeated stops."""
    return sum(k * (sum(c not in PLAIN for c in m) or (len(m) if len(m) > 1 and m[0] == m[-1] != "." else 0)) for m, k in Counter(found).items())


def votes(text: str | None, learnt: frozenset[str] = frozenset(), label: tuple[int, int] | None = None) -> tuple[list[int], list[int]]:
    """Votes on (quality, toxic): 1 yes, 0 no, -1 abstain."""
    text = text or ""
    low = text.lower()
    words, marks = WORD.findall(low), MARK.findall(text)
    n, chars = len(words), len(text)
    odd = marks.count("|") + sum(k for m, k in Counter(marks).items() if len(m) > 1 and len(set(m)) == 1 and m[0] != ".")
    kinds = len(set(words))
    same = sum(map(eq, words, words[1:]))
    upper = _capitals(text, low)
    stops = text.count(".") + text.count("!") + text.count("?")
    if not n:
        quality = [0, 0, -1, -1, 0, 0, -1]
    else:
        share = _marks(marks) / max(1, chars)
        quality = [
            0 if share > 0.08 else 1 if share < 0.05 else -1,
            -1 if n < 40 else 0 if kinds / n < 1 / math.sqrt(n) else 1,
            0 if same > 0.2 * n and n >= 10 else 1 if same < 0.05 * n else -1,
            0 if odd > 0.05 * n else 1 if odd < 0.01 * n else -1,
            0 if chars / n > 25 else 1 if 2.5 < chars / n < 14 else -1,
            -1 if n < 30 else 0 if stops < n / 150 else 1 if stops < n / 3 else 0,
            -1 if n < 5 else 0 if upper > 0.4 * chars else 1 if upper < 0.15 * chars else -1,
        ]
    bad, found = sum(map(INSULTS.__contains__, words)), sum(map(learnt.__contains__, words))
    often = lambda k: -1 if k == 1 else int(k > 1)  # noqa: E731  one hit alone may be chance
    dense = lambda k: 0 if k < 0.003 * n or not k else 1 if k > 0.005 * n else -1
    toxic = [often(bad), dense(bad) if bad or n >= 20 else -1, often(found) if learnt else -1, dense(found) if learnt else -1]
    return quality + [label[0] if label else -1], toxic + [label[1] if label else -1]


def features(text: str | None) -> np.ndarray:
    """Distinct hashed tokens of a text, and of how repetitive and marked it is."""
    text = text or ""
    low = text.lower()
    words, marks = WORD.findall(low), MARK.findall(text)
    n = max(1, len(words) + len(marks))
    kinds = Counter(words)
    top, same = max(kinds.values(), default=0) / n, sum(map(eq, words, words[1:])) / n
    share, upper = _marks(marks) / max(1, len(text)), _capitals(text, low) / max(1, len(text))
    extra = [f"\0marks{min(20, int(share * 50))}", f"\0top{min(10, int(top * 10))}", f"\0same{min(10, int(same * 10))}", f"\0size{n.bit_length()}", f"\0upper{int(upper * 5)}"]
    h = np.array(list(map(xxhash.xxh32_intdigest, [*kinds, *set(marks), *extra])), np.int64)
    return np.unique(h & ((1 << BITS) - 1))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of 1 for each pattern, P(vote | class) as (labellers, 2, 3), share of class 1).

    ``patterns``: (n, labellers) of -1, 0, 1.  Labellers are taken as independent given the class, abstention tells
    nothing; the start holds each to be right four times in five.  Counts are smoothed by one.
    """
    n, m = patterns.shape
    right = np.tile(np.array([[0.8, 0.2], [0.2, 0.8]]), (m, 1, 1))  # (labeller, class, vote)
    prior = 0.5
    post = np.full(n, 0.5)
    voted = [(patterns[:, k] >= 0, np.maximum(patterns[:, k], 0)) for k in range(m)]
    for _ in range(rounds):
        log = np.tile(np.log([1 - prior, prior]), (n, 1))
        for k, (some, v) in enumerate(voted):
            log += np.where(some[:, None], np.log(right[k][:, v].T), 0.0)
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved, post = np.abs(new - post).max(initial=0), new
        mass = counts * np.stack([1 - post, post])
        prior = float(np.clip((mass[1].sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
        for k, (some, v) in enumerate(voted):
            for c in (0, 1):
                ones, all_ = float((mass[c] * some * v).sum()), float((mass[c] * some).sum())
                # a labeller is held to be right more often than not, else the classes could swap names
                p = (ones + (4 if c else 1)) / (all_ + 5)
                p = max(p, 0.5) if c else min(p, 0.5)
                right[k, c] = 1 - p, p
        if moved < 1e-7:
            break
    return post, right, prior


def fit_linear(rows: list[np.ndarray], target: np.ndarray, penalty: float = 3e-4, support: int = 10, rounds: int = 300) -> tuple[np.ndarray, float]:
    """(weights over 2 ** BITS hashes, bias) of an L1-penalised logistic regression on soft targets; accelerated
    proximal gradient.  Hashes in fewer than ``support`` rows weigh nothing."""
    weights = np.zeros(1 << BITS, np.float32)
    if not len(rows):
        return weights, 0.0
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    seen = np.bincount(flat, minlength=1 << BITS)
    keep = seen[flat] >= min(support, max(1, len(rows) // 50))
    row = np.repeat(np.arange(len(rows)), sizes)[keep]
    used, col = np.unique(flat[keep], return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(seen[used], 1) / len(rows) + 0.01)  # rare tokens move as freely as common ones
    value = scale[col]
    n, d = len(rows), len(used)
    w = z = np.zeros(d)
    bias = zb = float(0)
    norm = np.bincount(row, value**2, n)
    step, t = 4.0 / (1 + np.percentile(norm, 90)), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * z[col], n) + zb, -30, 30)))
        g = (p - target) / n
        grad = np.bincount(col, value * g[row], d)
        moved = z - step * 8 * grad
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * 8 * penalty, 0)
        new_b = zb - step * 8 * float(g.sum())
        if float(((z - new) * (new - w)).sum()) > 0:
            t = 1.0  # restart the momentum where it overshoots
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    weights[used] = w * scale
    return weights, bias


def held_out(doc_id: Column) -> Column:
    """The half of the labelled ids that is never fitted on."""
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)) == 1


def learn_words(labelled: DataFrame, least: float = 0.01) -> frozenset[str]:
    """Words that mark toxic texts, from ``labelled(text, toxic)``.

    A word's weight is the number of different words that it follows: copies of a text add nothing to it.  Words with
    weight in toxic texts of at least 5 and ``least`` times their number, over thirty times that in the others (for
    as many texts).  All of them: the table is a bounded sample of labelled rows, and so is its vocabulary.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                seen = set()
                for text, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = WORD.findall((text or "").lower())
                    seen.update((w, xxhash.xxh32_intdigest(v) - (1 << 31), x) for v, w in zip(["", *words], words) if w[0].isalpha())
                word, before, toxic = zip(*seen) if seen else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(before, pa.int32()), pa.array(toxic, pa.int32())], ["word", "before", "toxic"])

    n = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    yes, no = n.get(1, 0), n.get(0, 0)
    if not yes or not no:
        return frozenset()
    met = labelled.mapInArrow(pairs, "word string, before int, toxic int").distinct()
    by = met.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    marked = by.where((F.col("a") >= max(5.0, least * yes)) & (F.col("a") / yes > 30 * F.greatest(F.col("b"), F.lit(0.1)) / no))
    return frozenset(r.word for r in marked.collect())


def fit(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = 12_000, label_rows: int = 16_000) -> dict[str, tuple[np.ndarray, float]]:
    """The scorers, (weights, bias) by task, fitted on ``docs(doc_id, text)`` as the module's docstring says."""
    text = docs.select("doc_id", "text")
    known = None
    learnt: frozenset[str] = frozenset()
    if labels is not None:
        one = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q2"), F.min("toxic").alias("toxic"), F.max("toxic").alias("t2"))
        one = durable(one.where("quality = q2 AND toxic = t2").where(~held_out(F.col("doc_id"))).select("doc_id", "quality", "toxic"), "labels")
        share = min(1.0, label_rows / max(1, one.count()))
        fit = one.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
        learnt = learn_words(durable(text.join(F.broadcast(fit), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "labelled"))
        known = fit.select("doc_id", F.struct("quality", "toxic").alias("label"))
    base = text if known is None else text.join(F.broadcast(known), "doc_id", "left")

    def poll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            both = [votes(t.as_py(), learnt, (m["quality"], m["toxic"]) if m else None) for t, m in zip(b.column(1), marks)]
            code = [[",".join(map(str, v[k])) for v in both] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code[0], pa.string()), pa.array(code[1], pa.string())], ["doc_id", *TASKS])

    polled = durable(base.mapInArrow(poll, "doc_id long, quality string, toxic string"), "votes")
    belief: dict[str, dict[str, float]] = {}
    for task in TASKS:
        found = polled.groupBy(task).count().collect()  # at most 3 ** labellers rows
        patterns = np.array([[int(x) for x in r[task].split(",")] for r in found], dtype=np.int64).reshape(len(found), len(LABELLERS[task]))
        post, _, _ = expectation_maximisation(patterns, np.array([r["count"] for r in found], float))
        belief[task] = dict(zip((r[task] for r in found), post.tolist()))
    spark = docs.sparkSession
    tables = {t: spark.createDataFrame(list(belief[t].items()), f"{t} string, {t}_vote double") for t in TASKS}
    judged = polled
    for t in TASKS:
        judged = judged.join(F.broadcast(tables[t]), t)
    judged = judged.select("doc_id", *[f"{t}_vote" for t in TASKS])
    total = polled.count()
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < int(min(1.0, train_rows / max(1, total)) * (1 << 30))
    part = judged.where(chosen).dropDuplicates(["doc_id"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()).astype("<i4").tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "hashes"])

    sample = text.where(chosen).mapInArrow(spell, "doc_id long, hashes binary").dropDuplicates(["doc_id"])
    fitted = sample.join(part, "doc_id").select("hashes", *[f"{t}_vote" for t in TASKS]).toPandas()  # about train_rows rows
    rows = [np.frombuffer(h, "<i4") for h in fitted.hashes]
    models = {t: fit_linear(rows, fitted[f"{t}_vote"].to_numpy(dtype=float)) for t in TASKS}
    return models


def scores(texts: list[str | None], models: dict[str, tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(quality, toxic) scores, 0 to 1; texts without words have quality 0."""
    hashed = [features(t) for t in texts]
    raw = [np.array([float(models[t][0][h].astype(np.float64).sum()) + models[t][1] for h in hashed]) for t in TASKS]
    quality, toxic = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in raw)
    return np.where([not (t or "").strip() for t in texts], 0.0, quality), toxic


def classify(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = 12_000, label_rows: int = 16_000) -> DataFrame:
    """``(doc_id, quality_score, toxic_score, keep)``, one row per row of ``docs(doc_id, text)``.

    Scores are the linear scorers', 0 to 1.  keep: quality_score over 0.5 and toxic_score under 0.5.  Null and empty
    texts have no words: quality 0, not kept.  Repeated rows are scored each, rows without doc_id too.  Without
    ``labels(doc_id, quality, toxic)`` the other labellers do; null labels, and ids with several, count as none.
    An empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows, label_rows))  # 2 x 2 ** BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quality, toxic = scores(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(quality, pa.float64()), pa.array(toxic, pa.float64())], ["doc_id", "quality_score", "toxic_score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, quality_score double, toxic_score double")
    return scored.withColumn("keep", F.expr("quality_score > 0.5 AND toxic_score < 0.5"))


def filtered(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = 12_000, label_rows: int = 16_000) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; rows are dropped in place, without a join.

    Nulls, empty texts, repeated rows and empty tables are as in ``classify``; columns may have any name.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows, label_rows))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quality, toxic = scores(b.column(at).to_pylist(), shared.value)
            yield b.filter(pa.array((quality > 0.5) & (toxic < 0.5)))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # any name is allowed
    return plain.mapInArrow(run, plain.schema).toDF(*names)
