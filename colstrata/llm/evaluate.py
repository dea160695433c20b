"""Measured recall of what the scans add: ``python -m colstrata.llm.evaluate FOLDER`` prints one line an operator.

A hashed half of the base forms' values is hidden: the method gets them as unknown tokens, and what it finds of them again
is counted, beside what it finds that no base form has.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii, secrets
from ._shared import durable
from ._spans import matches


def _hidden(value):
    return F.pmod(F.xxhash64(value, F.lit("hidden")), F.lit(2)) == 0


def masked_secrets(docs: DataFrame, fdr: float = 0.05) -> dict[str, int]:
    """hidden: distinct values hidden; found: of these flagged; other, false: other candidates, and flagged ones."""
    found = matches(docs, {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "random": secrets.TOKEN}).where("kind IS NOT NULL")
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", secrets.ASSIGN, 1)).otherwise(F.col("match"))
    known = durable(found.where("kind <> 'random'").select(value.alias("token")).where("length(token) >= 12").distinct(), "known")
    masked = known.where(_hidden(F.col("token"))).withColumn("hidden", F.lit(True))
    every = found.where("kind = 'random'").select(F.col("match").alias("token")).distinct().join(known, "token", "left_anti").withColumn("hidden", F.lit(False))
    tokens = durable(masked.unionByName(every), "tokens")
    flagged = durable(tokens.join(secrets.unknown(tokens, fdr), "token"), "flagged")
    count = lambda t, h: t.where(F.col("hidden") == h).count()
    return {"hidden": count(tokens, True), "found": count(flagged, True), "other": count(tokens, False), "false": count(flagged, False)}


def masked_personal(docs: DataFrame, rounds: int = pii.ROUNDS, support: int = 5, accept: float = 0.8) -> dict[str, int]:
    """hidden: distinct values of one token hidden; found: of these found by contexts; false: others found."""
    found = matches(docs, {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}, words=True)
    found = durable(found.where("kind IS NOT NULL").where(pii._valid(F.col("kind"), F.col("match"))), "pii")
    value = F.lower("match")
    seeds = found.where(~_hidden(value)).select(F.concat_ws("=", "kind", value).alias("value"), "kind", F.explode(pii._patterns()).alias("pattern"))
    masked = durable(found.where(_hidden(value)).select(value.alias("value")).where("instr(value, ' ') = 0").distinct(), "masked")
    more = durable(pii.discover(docs, seeds, rounds, support, accept, None).select("value").distinct(), "more")
    shown = found.where(~_hidden(value)).select(value.alias("value")).distinct()
    return {"hidden": masked.count(), "found": more.join(masked, "value", "left_semi").count(), "false": more.join(masked, "value", "left_anti").join(shown, "value", "left_anti").count()}


if __name__ == "__main__":
    from ..session import session

    spark = session()
    docs_ = spark.read.parquet(f"{sys.argv[1]}/documents.parquet")
    print("secrets", masked_secrets(docs_))
    print("personal data", masked_personal(docs_))
