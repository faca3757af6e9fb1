"""No text ends the JVM by its stack, and work is in proportion to the text."""

import time

import pytest
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.operators import citations, cleaning

#: About a megabyte of what each pattern repeats.
UNITS = {
    "square": "[" + "1, " * 300_000 + "1]",
    "consecutive": "(1)" * 300_000,
    "authors": "(" + "Smith and Jones, Jr. et al., 1999a; " * 25_000 + "Doe, 2000)",
    "open authors": "(" + "Smith, 1999; " * 70_000,
    "email": "a.b" * 300_000 + "@x.org",
    "url": "www." + "a/" * 400_000,
    "doi": "10.1234/" + "ab" * 400_000,
    "dots": "a" + ". " * 400_000 + "1",
    "contents": "word....." * 100_000 + "7",
    "tabs": "a\tb\t" * 200_000,
    "blanks": "a" + " " * 900_000 + "b",
    "capitals": "AB " * 300_000,
    "numbers": "1.5 " * 200_000,
    "maths": "a=b" * 300_000,
    "signs": "—…’" * 200_000,
    "kets": "⟨a|" * 200_000,
}


@pytest.mark.parametrize("name", sorted(UNITS))
def test_a_megabyte_of_a_unit(spark, name):
    df = spark.createDataFrame([(UNITS[name] + "\nThe end.",)], "text string")
    out = cleaning.remove_patterns(df, rules.ARTEFACTS | rules.CITATIONS).withColumn("clean", cleaning.clean_text(F.lit(UNITS[name] + "\nThe end.")))
    row = out.select("text", "clean", *[f"{n}_found" for n in rules.CITATIONS], cleaning.symbols(F.col("text"))["n"].alias("n")).collect()[0]
    assert row.clean.endswith("The end.")
    if name in ("square", "consecutive", "authors"):
        assert row.text == "\nThe end." and sum(row[f"{n}_found"] for n in rules.CITATIONS) == 1


def test_lines_in_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        text = "\n".join(f"line number {i} of this text" if i % 3 else "" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        df.select(cleaning.clean_lines(F.col("text"))).collect()
        began = time.time()
        got = df.select(cleaning.clean_lines(F.col("text")).alias("t")).collect()[0].t
        took.append(time.time() - began)
        assert got == text
    assert took[1] < 10 * took[0] + 1


@pytest.mark.parametrize("name", ["square", "consecutive", "authors", "open authors", "numbers"])
def test_checked_citations_in_a_megabyte(name):
    began = time.time()
    assert citations.scan(UNITS[name] + "\nThe end.")["text"].endswith("The end.")
    assert time.time() - began < 30


def test_tags_in_place_of_removed_text(spark):
    df = spark.createDataFrame([("see (Doe, 2000) at a@b.org\nall rights reserved\nfine here",)], "text string")
    tagged = cleaning.remove_patterns(df, rules.ARTEFACTS | rules.CITATIONS, cleaning.debug_tag("citation"))
    assert tagged.collect()[0].text.startswith("see [DEBUG:citation:author_year_single] at [DEBUG:citation:email_addresses]")
    assert df.select(cleaning.clean_lines(F.col("text"), debug=True).alias("t")).collect()[0].t.split("\n")[1:] == ["[DEBUG:lines:copyright]", "fine here"]
