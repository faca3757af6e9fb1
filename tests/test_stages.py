"""A user's own steps."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions.rewriting import error_counts, without_errors
from quillmill.operators import cleaning, stages


def made():
    """Functions that travel by value, as workers don't know this module."""

    def upper(t):
        if t == "bad":
            raise ValueError("no")
        return t.upper(), {"n": len(t)}

    def tagged(rows, part):
        for r in rows:
            for k in range(r["doc_id"]):
                yield {"doc_id": r["doc_id"], "k": k, "part": part}

    return upper, tagged


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a  b"), (2, "bad"), (3, None), (0, "")], "doc_id long, text string").repartition(3)


def test_errors_stay_with_their_rows(spark, docs):
    upper, _ = made()
    out = stages.cleaner_stage(upper, "n long", errors="error")(docs)
    got = {r.doc_id: (r.text, r.n, r.error) for r in out.collect()}
    assert got == {1: ("A  B", 4, None), 2: (None, None, "ValueError: no"), 3: (None, None, None), 0: ("", 0, None)}
    assert tuple(error_counts(out, "error").first()) == (4, 1)
    assert sorted(r.doc_id for r in without_errors(out, "error").collect()) == [0, 1, 3]
    with pytest.raises(Exception, match="ValueError"):
        stages.cleaner_stage(upper, "n long")(docs).collect()
    assert stages.cleaner_stage(upper, "n long", errors="error")(docs.limit(0)).count() == 0


def test_chains_and_registry(spark, docs):
    config = {"column": {"rule": cleaning.normalize_whitespace}, "keep": {"test": F.length("text") > 0}, "cleaner": None}
    assert sorted((r.doc_id, r.text) for r in stages.built(config)(docs).collect()) == [(1, "a b"), (2, "bad")]
    with pytest.raises(KeyError, match="nothing"):
        stages.built({"nothing": {}})
    with pytest.raises(ValueError, match="keep"):
        stages.registered("keep")(lambda: None)
    assert stages.chain()(docs) is docs


def test_filters_and_steps(spark, docs):
    test = lambda r: (r["doc_id"] != 2, "even") if r["text"] else False
    assert [r.doc_id for r in stages.filter_stage(test, ["doc_id", "text"])(docs).collect()] == [1]
    assert {r.doc_id: r.why for r in stages.filter_stage(test, ["doc_id", "text"], "why")(docs).collect()} == {0: "filtered", 1: None, 2: "even", 3: "filtered"}
    assert stages.filter_stage(test, ["doc_id", "text"])(docs.limit(0)).count() == 0
    _, tagged = made()
    out = stages.step_stage(tagged, "doc_id long, k int, part int")(docs)
    assert sorted((r.doc_id, r.k) for r in out.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    row = stages.adapted(docs, {"text": "text", "id": F.col("doc_id").cast("string")})
    assert row.dtypes == [("text", "string"), ("id", "string")]
