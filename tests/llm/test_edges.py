"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pyarrow as pa
import pytest

from colstrata.llm import _shared, decontaminate, media, mixing, pii, quality, secrets, sharding, simhash, suffix_dedup, token_rollup

CLASH = ["rid", "h", "k", "size", "spans", "n", "source_size", "shard", "key", "fp", "start", "end", "kind", "p", "w", "node", "u", "v", "copies", "_copies", "match", "slot", "block", "doc", "token", "_rank", "a.b", "row", "order", "label", "__gone", "cls", "at", "s1", "bits", "n_whole"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
LONG = "the quick brown fox jumps over the lazy dog and runs away. " * 2000
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n", None, "a", 3),
    (4, "short text", "en", None, 10),
    (4, "short text", "en", None, 10),
    (None, "no id here 10.0.0.1", "en", "b", 10),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, "émile wrote to a.b@c-d.org, token = \"aaaabbbbccccdddd1111\" 🙂", "fr", "b", 60),
    (7, "another text under the same id", "fr", "b", 30),
    (8, "A", "en", "", 1),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], SCHEMA)


def items(spark):
    return spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, ""), (4, "another text"), (None, "short text"), (5, "zz")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "suffix": lambda s, d: suffix_dedup.dedup(d),
    "shards": lambda s, d: sharding.shards(d, 24),
    "secrets": lambda s, d: secrets.digest(secrets.scan(d)),
    "media": lambda s, d: media.digest(d),
    "tokens": lambda s, d: token_rollup.count_tokens(d),
    "pii": lambda s, d: pii.digest(pii.scan(d)),
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "quality without labels": lambda s, d: quality.classify(d),
    "mix": lambda s, d: mixing.mix(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
    "no items": lambda s, d: decontaminate.contamination(d, items(s).limit(0)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "simhash wide": lambda s, d: simhash.near_duplicates(d, 5, 24, 128),
}
STAGES = {
    "quality": lambda s, d: quality.filtered(d, labels(s)),
    "near_dedup": lambda s, d: simhash.near_dedup(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, items(s)),
    "mix": lambda s, d: mixing.mixed(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(spark, name):
    out = PER_ROW[name](spark, table(spark)).collect()
    assert len(out) == len(ROWS)
    assert sorted(r["doc_id"] or 0 for r in out) == sorted(r[0] or 0 for r in ROWS)
    repeated = [tuple(r)[1:6] for r in out if r["doc_id"] == 4]
    if name not in ("shards", "mix"):
        assert repeated[0] == repeated[1]


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, table(spark, [])).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns(spark, name):
    docs = table(spark)
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    assert out.count() <= 3 * len(ROWS)
    assert STAGES[name](spark, table(spark, [])).collect() == []


def test_near_dedup_keeps_smallest(spark):
    kept = [r.doc_id for r in simhash.near_dedup(table(spark)).collect()]
    assert 5 in kept and 6 not in kept and kept.count(4) == 1 and {1, 2, 3, 8} <= set(kept) and None in kept


def test_all_null_columns(spark):
    docs = table(spark, [(None, None, None, None, None)] * 3)
    for name, f in PER_ROW.items():
        assert len(f(spark, docs).collect()) == 3, name


VERY_LONG = {
    "suffix": lambda s, d: suffix_dedup.dedup(d).drop("kept"),
    "shards": lambda s, d: sharding.shards(d, 3),
    "secrets": lambda s, d: secrets.digest(secrets.scan(d)),
    "media": lambda s, d: media.digest(d),
    "tokens": lambda s, d: token_rollup.count_tokens(d),
    "pii": lambda s, d: pii.digest(pii.scan(d)),
    "quality": lambda s, d: quality.classify(d),
    "mix": lambda s, d: mixing.mix(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near_dedup": lambda s, d: simhash.near_dedup(d),
}


def test_texts_of_ten_megabytes(spark):
    """Two texts of 10 MB, one the other's near copy, beside short ones; one of a single word."""
    line = "".join(f"w{i * i % 9973} to{i % 113}{'.' if i % 17 == 0 else ''} " for i in range(1_000_000))[: 10 << 20]
    rows = [(1, line, "en", "a"), (2, line[: 5 << 20] + "changed here" + line[5 << 20 :], "en", "a"), (3, "x" * (10 << 20), "en", "b"), (4, "short", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for name, f in VERY_LONG.items():
        out = {r["doc_id"]: r for r in f(spark, docs).collect()}
        if name == "near_dedup":
            assert set(out) == {1, 3, 4}
            continue
        assert set(out) == {1, 2, 3, 4}, name
        if name == "suffix":
            assert out[1].n_removed == 10 << 20 and out[2].n_bytes - out[2].n_removed <= 12 and out[3].n_removed == 10 << 20
        if name == "media":
            assert out[3].n_bytes == 10 << 20 and out[3].media_bytes < 1 << 16


@pytest.mark.parametrize("name", ["quality", "near_dedup"])
def test_batches_for_python_are_bounded_by_bytes(spark, name):
    """Spark's own bound is 10,000 rows: 32 MB of these texts in one batch, of which a worker keeps several copies."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
    few = table(spark, [(i, f"words of text {i}", "en", "a", 10) for i in range(5)])
    many = spark.range(0, 8001, 1, 1).selectExpr("repeat('words and more ', if(id = 0, 300000, 270)) AS text")
    spark.conf.unset(key)
    try:
        STAGES[name](spark, few)
        got = many.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 8001  # the text of 4.5 MB too, whole
        assert all(r.bytes <= _shared.BATCH_BYTES * 1.1 for r in got if r.rows > 1) and max(r.bytes for r in got) >= 4_500_000
        spark.conf.set(key, "1048576")  # a bound of the session's own stays
        STAGES[name](spark, few)
        assert spark.conf.get(key) == "1048576"
    finally:
        spark.conf.unset(key)
