"""Token counts: delta-maintained totals by source, language and tokenizer version.

A store is a folder of parts and manifests.  A part holds what one batch of changes adds: signed totals per (source,
lang, tokenizer), and a ledger of signed rows per document, in buckets of the doc_id, from which later deletes and
revisions take what they subtract.  A manifest lists the parts that count and the batches that are in them; a batch is
committed by the creation of the next manifest, which only one writer can create, so retries and reruns change nothing
and of two writers one starts over.

Totals are sums over parts' totals, a few rows each.  An insert costs its own size; a delete or revision also reads the
ledger's buckets that its ids are in.  ``compact`` replaces the parts by one.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import durable, small

#: The pattern that splits text before the merges (fixed value of this family of vocabularies).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Setting of the folder with vocabulary files ``<tokenizer>.tiktoken``, and its value where it is unset.
FOLDER = ("spark.colstrata.tokenizers", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
BUCKETS = 16
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_bytes", "n_tokens"]
ROW = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_bytes long, n_tokens long"


@lru_cache(maxsize=4)
def _encoding(name: str, raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def vocabulary(spark: SparkSession, tokenizer: str = TOKENIZER, ranks: str | None = None) -> bytes:
    """The bytes of the vocabulary file ``ranks``, or of the tokenizer's file in the folder that the setting names."""
    path = ranks or f"{spark.conf.get(*FOLDER)}/{tokenizer}.tiktoken"
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path} on the driver: pass ranks, or set {FOLDER[0]} to the folder that has it")
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = None) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, n_docs, n_bytes, n_tokens)``, one row per row of ``docs(doc_id, text, source,
    lang)``, n_docs = 1.  Null and empty texts have no tokens, null ids, sources and languages stay null, repeated rows are
    counted each, an empty table gives no rows, other columns are ignored.  ``ranks``: a vocabulary file on the driver;
    its bytes (about a megabyte) are broadcast.  ``tokenizer`` names the version in the totals."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(docs.sparkSession, tokenizer, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoding(tokenizer, shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            tokens = pa.array([len(coder.encode_ordinary(t)) for t in texts], pa.int64())
            one = pa.array([1] * len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([tokenizer] * len(texts), pa.string()), one, size, tokens], ["doc_id", *KEYS, *SUMS])

    plain = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), F.col("lang").cast("string"))
    return plain.mapInArrow(run, ROW)


class Rollup:
    """Totals kept in the folder ``path``, which all executors must share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _state(self) -> tuple[int, list[str], list[str]]:
        """(number, parts, batches) of the last manifest."""
        fs, p = self._fs(f"{self.path}/manifests")
        if not fs.exists(p):
            return 0, [], []
        last = max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0)
        if not last:
            return 0, [], []
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{last}").collect())
        try:
            state = json.loads(text)
        except ValueError:
            raise OSError(f"manifest {last} of {self.path} is being written, or its writer has failed: remove it then") from None
        return last, state["parts"], state["batches"]

    def _publish(self, number: int, parts: list[str], batches: list[str]) -> bool:
        """Create manifest ``number``; False if another writer has."""
        fs, p = self._fs(f"{self.path}/manifests/{number}")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise OSError(f"manifest {number} can't be created") from e
        out.write(bytearray(json.dumps({"parts": parts, "batches": batches}).encode()))
        out.close()
        return True

    def has(self, batch: str) -> bool:
        return batch in self._state()[2]

    def _write(self, deltas: DataFrame) -> str:
        part = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        deltas.select("doc_id", *KEYS, *SUMS, bucket).write.partitionBy("bucket").parquet(f"{self.path}/parts/{part}/ledger")
        ledger = self.spark.read.schema(f"{ROW}, bucket int").parquet(f"{self.path}/parts/{part}/ledger")
        ledger.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS]).coalesce(1).write.parquet(f"{self.path}/parts/{part}/totals")
        return part

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add signed ledger rows ``(doc_id, source, lang, tokenizer, n_docs, n_bytes, n_tokens)`` as one batch; False, and
        no change, if the batch has been committed before.  Rows may repeat and have nulls; no rows make an empty batch.
        Rows that depend on the ledger (``delete``, ``revise``) are made anew where another writer was first."""
        return self._commit(batch, lambda parts: deltas)

    def _commit(self, batch: str, made) -> bool:
        written: tuple[list[str], str] | None = None
        while True:
            number, parts, batches = self._state()
            if batch in batches:
                return False
            if written is None or written[0] != parts:
                written = parts, self._write(made(parts))
            if self._publish(number + 1, [*parts, written[1]], [*batches, batch]):
                return True

    def _read(self, parts: list[str], what: str) -> DataFrame | None:
        paths = [f"{self.path}/parts/{p}/{what}" for p in parts]
        if not paths:
            return None
        if what == "totals":
            return self.spark.read.schema(ROW.removeprefix("doc_id long, ")).parquet(*paths)
        out = None
        for p in paths:  # one by one: bucket is a folder of each
            rows = self.spark.read.schema(f"{ROW}, bucket int").parquet(p)
            out = rows if out is None else out.unionByName(rows)
        return out

    def ledger(self, tokenizer: str | None = None) -> DataFrame | None:
        """What stands per document: sums of its signed rows, where any are left."""
        return self._standing(self._state()[1], tokenizer)

    def _standing(self, parts: list[str], tokenizer: str | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        rows = self._read(parts, "ledger")
        if rows is None:
            return None
        rows = rows if tokenizer is None else rows.where(F.col("tokenizer") == tokenizer)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy("doc_id", *KEYS).agg(*[F.sum(x).alias(x) for x in SUMS]).where("n_docs <> 0")

    def insert(self, batch: str, docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = None) -> bool:
        """Count ``docs`` with a tokenizer version and add them; every row is a document, null ids too."""
        return not self.has(batch) and self.commit(batch, count_tokens(docs, tokenizer, ranks))

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """Take out all that stands for the ``doc_id`` of ``ids``, for every tokenizer; ids that are null, repeated or not
        there change nothing."""
        if self.has(batch):
            return False
        return self._commit(batch, lambda parts: self._negated(parts, ids))

    def revise(self, batch: str, docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = None) -> bool:
        """Replace what stands for the documents' ids under ``tokenizer`` by the counts of ``docs``; rows of a null id
        replace nothing and are added, rows of one id are added up."""
        if self.has(batch):
            return False
        counted = durable(count_tokens(docs, tokenizer, ranks), "revised")
        return self._commit(batch, lambda parts: self._negated(parts, counted.select("doc_id"), tokenizer).unionByName(counted))

    def _negated(self, parts: list[str], ids: DataFrame, tokenizer: str | None = None) -> DataFrame:
        known = durable(ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct(), "ids")
        held = [r.b for r in known.select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # at most BUCKETS
        standing = self._standing(parts, tokenizer, held)
        if standing is None:
            return self.spark.createDataFrame([], ROW)
        return standing.join(known, "doc_id", "left_semi").select("doc_id", *KEYS, *[(-F.col(x)).alias(x) for x in SUMS])

    def compact(self) -> None:
        """Replace all parts by one that holds what stands; batches stay known, totals stay the same.  Parts that no longer
        count are left for readers that are under way."""
        while True:
            number, parts, batches = self._state()
            if len(parts) < 2 or self._publish(number + 1, [self._write(self._standing(parts))], batches):
                return

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_bytes, n_tokens)`` over all commits; groups without documents are left out."""
        rows = self._read(self._state()[1], "totals")
        if rows is None:
            return self.spark.createDataFrame([], ROW.removeprefix("doc_id long, "))
        return rows.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS]).where("n_docs <> 0")


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id)`` of documents whose text an earlier doc_id has: all but the least id of each text.  Null ids are left out;
    null and empty texts are one text.  The ids of texts that repeat are joined with these texts by broadcast where a text
    has very many, so no text is a task of its own."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    keyed = durable(keyed, "texts")
    first = durable(keyed.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    return durable(keyed.join(small(first), ["a", "b"]).where("doc_id <> first").select("doc_id").distinct(), "repeats")
