"""Citations in context, sections and repeated lines: rules on hand-written texts, both modes."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.operators import citations, cleaning, corpus_cleaning, sections


def verdicts(text, **options):
    return [(m["type"], m["match"].strip(), m["accepted"]) for m in citations.scan(text, **options)["matches"]]


@pytest.mark.parametrize(("match", "why"), [
    ("Smith; Jones; Brown", None), ("Smith 2; Jones 3", "few_names"), ("the; Jones", "stopword"), ("Smith;", "number_of_authors"),
    (";".join(["Ann"] * 13), "number_of_authors"), ("Smith; 12", "technical"), ("a" * 31 + "; Smith", "technical"), ("Smith 2; Jones", None),
])
def test_author_lists(match, why):
    assert citations.author_list(match) == why


def test_isolated_numbers():
    filler = "Some words come before the number, and they fill more than one hundred characters of the text that is read here "
    assert verdicts("so (12).")[0] == ("isolated_numeric", "(12)", False)  # fewer than 5 characters before
    assert verdicts("as was shown (12).")[0][2] and not verdicts("as follows: (1)")[0][2]
    assert verdicts("at (25°C) or (100%) or (3) x") == []
    # the slice of the first implementation has nothing before the place, so far from the beginning numbers stay
    assert verdicts(filler * 3 + "(12).")[-1][2] and not verdicts(filler * 3 + "(12).", legacy=True)[-1][2]
    assert verdicts(filler * 3 + "( 12 ).", legacy=True)[-1][2]


def test_references_and_pages():
    assert verdicts("12 ref. 3 45")[0] == ("ref_number", "ref. 3", True) and not verdicts("as in ref 12 the")[0][2]
    assert verdicts("x" * 300 + " in ref 12 the", legacy=True)[0][2]
    assert verdicts("first\np. 12\nsecond")[0][2] is False  # letters on both sides
    assert verdicts("\n" * 16 + "p. 12\n" + "second")[0][2] and not verdicts("see more p. 12")[0][2]
    text = "the model that we use for this, on page 12"
    assert not verdicts(text)[0][2] and verdicts(text, legacy=True)[0][2]


def test_overlaps():
    assert citations.scan("as was shown (1)(2) here and further on")["text"] == "as was shown  here and further on"
    # ends that an overlap has made stale delete text behind the match
    assert citations.scan("as was shown (1)(2).... here", legacy=True)["text"] != "as was shown .... here"
    assert citations.scan("Smith; Jones and (12)", validate=False, replacement="#")["text"] == "#and #"


def test_reports(spark):
    df = spark.createDataFrame([(1, "a@b.org as shown (12). and (3)"), (2, "list: (1)"), (3, None), (4, "")], "doc_id long, text string")
    got = citations.scan_citations(df)
    left = {r.doc_id: r.text for r in got.collect()}
    assert left == {1: " as shown . and ", 2: "list: (1)", 3: None, 4: ""}
    counts = citations.per_document(got)
    assert counts.count() == 3 * (5 + 10)
    total = {r.type: r for r in citations.type_totals(counts).collect()}
    assert (total["isolated_numeric"].found, total["isolated_numeric"].removed, total["isolated_numeric"].risk) == (3, 2, "High")
    assert (total["email_addresses"].found, total["email_addresses"].precision, total["email_addresses"].risk) == (1, 1.0, "Low")
    assert [(r.doc_id, r.match, r.reason) for r in citations.rejected_samples(got).collect()] == [(2, "(1)", "list_item")]
    one = citations.document_totals(counts).first()
    assert (one.docs, one.docs_with, one.found, one.removed, one.rejected) == (3, 1, 4, 3, 1)
    assert citations.document_totals(citations.per_document(got.where("doc_id > 9"))).first().found == 0


def test_custom_patterns(spark):
    assert citations.scan("a <<x>> b", patterns={"angles": "<<.*?>>"})["text"] == "a  b"
    with pytest.raises(Exception, match="unterminated|missing"):
        citations.scan_citations(spark.range(1).selectExpr("'x' as text"), patterns={"bad": "("})


def test_sections(spark):
    table = "GENE SYMBOL TABLE\nAB12 CD34\t1.5\nEF56 GH78\t2.5\nIJ90 KL12\t3.5\nMN34 OP56\t4.5\nQR78 ST90\t5.5"
    prose = "this is again a line of normal prose that has surely more than fifteen words in it and no numbers"
    got = sections.appendix_sections(f"before\n{table}\n{prose}\nafter")
    assert got["text"] == f"before\n{prose}\nafter" and got["sections"][0]["lines"] == 6
    assert sections.appendix_sections("References\nsome words of prose follow here and are kept")["sections"] == []
    assert sections.appendix_sections(table)["text"] == "" and sections.appendix_sections("")["text"] == ""
    assert sections.drop_sections(spark.createDataFrame([(None,), ("x",)], "text string")).count() == 2
    assert sections.without_repeats("a\nb\n\na\nc\nd\ne\nf\nb\na") == "a\nb\n\nc\nd\ne\nf\na"


def symbols(spark, text, **options):
    r = spark.createDataFrame([(text,)], "text string").select(cleaning.normalize_symbols(F.col("text"), **options).alias("t"), cleaning.symbol_count(F.col("text"), **options).alias("n")).first()
    return r.t, r.n


def test_contents_and_lookalikes(spark):
    assert symbols(spark, "Introduction ..... 5 rest") == (" rest", 1) and symbols(spark, "Chapter.....Title x") == (" x", 1)
    assert symbols(spark, "12.....34.....56 x") == ("...56 x", 2) and symbols(spark, "a.....12b.....3 x") == (" x", 2)
    assert symbols(spark, "a\tb\tc\td\n") == ("\n", 1) and symbols(spark, ".\t" * 6) == ("", 1) and symbols(spark, "1 2\t" * 6) == ("", 1)
    assert symbols(spark, "сор") == ("cop", 3) and symbols(spark, "сор", lookalikes=False) == ("сор", 0)
    assert symbols(spark, 'a "b" c') == ('a "b" c', 0) and symbols(spark, 'a "b" — c') == ('a "b" - c', 3)
    assert symbols(spark, "“x”") == ("“x”", 0)
    assert set(rules.LOOKALIKES) & set(rules.SYMBOLS) == set()


def test_whole_chain(spark):
    df = spark.createDataFrame([(1, "Good prose (Smith, 2020) here.\nTable 3: x\n© all", 0.9), (2, "low", 0.1), (3, None, None), (4, "http://a.b", None)], "doc_id long, text string, score double")
    assert [tuple(r) for r in corpus_cleaning.clean_corpus(df, score="score").collect()] == [(1, "Good prose here.", 0.9)]


def test_what_a_pattern_needs():
    from quillmill.functions import citations as fixed

    texts = ["A; B", "[1, 2]", "(1)(2)", "x (3)", "(Ann, 2020; Bob, 2021)", "(Ann, 2020)", "[Ann, 2020]", "[Ann, 2020; Bob, 2021]", "REF 3", "P. 4"]
    for kind, text in zip(fixed.PATTERNS, texts, strict=True):
        assert fixed.NEEDS[kind] in text.lower() and kind in [m["type"] for m in citations.scan(text)["matches"]]
        assert [m["type"] for m in citations.scan(text)["matches"]] == [m["type"] for m in citations.scan(text, patterns=dict(fixed.PATTERNS))["matches"]]
