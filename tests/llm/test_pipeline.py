"""The pipeline: each stage's decisions take effect, and the rows that come out are whole."""

import numpy as np
import pytest

import corpus_pipeline as cp
from quillmill.llm.common import materialize


def test_stages_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = [before]
    for name, stage in cp.STAGES[:4]:
        docs = materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        seen.append({r.doc_id: r for r in rows})
        if name != "source mixing":
            assert len(rows) == len(seen[-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([d in seen[1] for d, q in labels.items() if q]) > 0.97 and np.mean([d in seen[1] for d, q in labels.items() if not q]) < 0.5
    texts = {r.text for r in seen[1].values()}
    assert {r.text for r in seen[2].values()} <= texts and len({r.text for r in seen[2].values()}) == len(seen[2]) < len(seen[1])
    assert set(seen[3]) == set(seen[2]) and any("[SECRET]" in r.text for r in seen[3].values())
    assert all(r.n_chars == len(r.text) for r in seen[3].values())
    pieces = cp.pack_sequences(spark, docs, sf).collect()
    assert {p.doc_id for p in pieces} == set(seen[4])
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    assert [p.doc_id for p in order if p.start == 0] == [r.doc_id for r in sorted(docs.selectExpr("*", "_metadata.file_name f", "_metadata.row_index i").collect(), key=lambda r: (r.f, r.i))]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = [(1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (3, "", "", None, 0), (4, "w " * 60_000, "en", "t", 120_000), (5, "password: hunter2hunter2", None, "t", 24)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    out = cp.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= {1, 4, 5} and sum(r.length for r in out) > 1000
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert cp.run(spark, sf).count() == 0


def test_near_copies_go_by_row(spark):
    long = " ".join(f"a{i}" for i in range(100))
    rows = [(1, long), (2, long + " tail"), (2, "another text under the id of a copy"), (3, "one text here"), (3, "and a different one there"), (3, "one text here"), (None, "lone words of no id"), (None, "lone words of no id"), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, long), (2, rows[2][1]), (3, "one text here"), (3, rows[4][1]), (None, "lone words of no id")], key=str)


def test_columns_of_any_name_pass(spark, tmp_path):
    sf, names = f"file://{tmp_path}", ["score", "target", "source_size", "copies", "taken", "positions", "position", "size", "order_key", "__score", "__path", "__copy", "part", "fp", "component_id", "secrets"]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows = [(i, f"text number {i} of a few " * 9 + f"password: hunter2hunter{i}", "en", f"s{i % 2}", 30, *([0.25 + i] * len(names))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} double" for c in names)).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:4]:
        docs = materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert all(set(r[5:]) == {0.25 + r.doc_id} for r in docs.collect())
    assert docs.count() > 20 and {r.doc_id for r in cp.run(spark, sf).collect()} <= set(range(40))


def test_rows_by_their_places(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmill.llm.common import Notes, located

    path = f"file://{tmp_path}/rows"
    spark.range(0, 150_000, 1, 3).withColumn("__path", F.lit("x")).write.parquet(path)
    df, p, r = located(spark.read.parquet(path).where("id % 2 = 0"))
    assert df.columns == ["id", "__path", "__path_", "__row"] and df.select(p, r).distinct().count() == 75_000
    notes = Notes(df.where("id % 3 = 0").select(p, r, F.struct("id").alias("v")), p, r, "v", "test")
    got = df.select("id", notes.of(p, r).alias("v")).collect()
    assert all((x.v is None) == (x.id % 3 > 0) and (x.v is None or x.v.id == x.id) for x in got) and len(got) == 75_000
    made, p, r = located(spark.range(10).join(spark.range(3).withColumnRenamed("id", "b")))
    assert made.select(p, r).distinct().count() == 30


def test_a_scratch_folder_is_named_off_one_machine(spark, monkeypatch):
    from types import SimpleNamespace

    from quillmill.llm.common import scratch_root

    conf = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_root(session("spark://host:7077"))
    assert scratch_root(session("local[4]")).startswith("file:///")
