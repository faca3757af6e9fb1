"""Queries against their SQL on a table that has more rows than Spark samples for the cuts of a range shuffle, some of them
without an id or with one that is there twice."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.operators import cleaning
from quillmill.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("large"))
    i = F.col("id")
    rows = spark.range(0, 20_000, 1, 3).select(F.when(i % 997 != 5, F.xxhash64(i - (i % 1000 == 7).cast("int"))).alias("doc_id"), F.lit("a").alias("text"))
    rows.write.parquet(f"file://{path}/documents.parquet")
    return path


def same(spark, name, path):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    df = QUERIES[name](spark, path)
    want = db.sql(ORACLE[name]).project(", ".join(f'"{c}"' for c in df.columns)).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", ["shard_assign", "rank_stride", "resumed_positions", "sampler_batches", "train_val_split"])
def test_places_in_a_larger_table(spark, large, name):
    same(spark, name, large)


@pytest.mark.parametrize("rows", [0, 3, 31, 47, 50])
def test_resuming_in_a_table_shorter_than_what_was_seen(spark, tmp_path, rows):
    spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).write.parquet(f"file://{tmp_path}/documents.parquet")
    same(spark, "resumed_positions", str(tmp_path))


def test_a_histogram_rounds_as_its_sql(spark, tmp_path):
    """Ratios that end in a half by their digits, on either side of it as doubles, and a vertical tab inside a word."""
    texts = [" ".join(str(i % d) for i in range(n)) for d, n in ((203, 400), (207, 400), (1, 2000), (9, 2000), (1009, 2000), (1, 80), (3, 80))]
    rows = [(i, t) for i, t in enumerate([*texts, "a\x0bb a", "\x0b", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    same(spark, "doc_stats_histogram", str(tmp_path))


def test_capitals_of_every_sign(spark, tmp_path):
    """All signs, in texts of 600 that hold hundreds of letters with capitals of several signs, or few or none."""
    signs = "".join(chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000)
    texts = [signs[i : i + 600] for i in range(0, len(signs), 600)] + ["\xdf" * 600, "a\xdfb" * 200, "\xdf" + "x" * 499, "x" * 499 + "\ufb01", "x" * 499, "", None]
    rows = [(i, t, None if i == 7 else "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "1L AS n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    same(spark, "stage_chain", str(tmp_path))


def test_capitals_keep_the_length(spark):
    texts = {"Stra\xdfe \xe9t\xe9": "STRA\u1e9eE \xc9T\xc9", "\xdf\xdfa": "\u1e9e\u1e9eA", "o\ufb03ce": "O\ufb03CE", "\u1fb3": "\u1fbc", "plain": "PLAIN", "": ""}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cleaning.simple_upper(F.col("t"))).collect()
    assert dict(map(tuple, got)) == texts


@pytest.mark.parametrize(("language", "icu"), [("tr", "true"), ("el", "true"), ("lt", "true"), ("en", "false")])
def test_capitals_whatever_the_language(spark, tmp_path, language, icu):
    """Turkish dots a capital I, Greek drops accents, Lithuanian drops dots; without ICU, Java knows fewer letters."""
    texts = ["i\xe9ı " * 200, "άἄΰ " * 200, "i̇\xe9 " * 200, "\U00010597ꟁ " * 200, "i\xdfiﬁά" * 200]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    locale = spark._jvm.java.util.Locale
    before = locale.getDefault()
    try:
        locale.setDefault(locale.forLanguageTag(language))
        spark.conf.set("spark.sql.icu.caseMappings.enabled", icu)
        same(spark, "stage_chain", str(tmp_path))
    finally:
        locale.setDefault(before)
        spark.conf.unset("spark.sql.icu.caseMappings.enabled")
