"""Rules on hand-written texts, and properties."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import rules
from quillmill.operators import cleaning, evals, spans, splits, windows
from quillmill.sources import corpus


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(("name", "text", "n", "left"), [
    ("email_addresses", "to a.b@c.org now", 1, "to  now"),
    ("urls", "see https://x.y/z and www.a.b", 2, "see  and "),
    ("doi_references", "doi: 10.1/ab 10.1234/zz", 2, " "),
    ("isbn_references", "ISBN 978-1-2 x", 1, " x"),
    ("arxiv_references", "arXiv: 1234.5678!", 1, "!"),
    ("square_numeric", "as in [12], [3, 7] and [1-5].", 3, "as in ,  and ."),
    ("consecutive_numeric", "x (1)(2) tail (3)", 1, "x  tail (3)"),
    ("author_year_single", "so (Smith, 2020) and (Smith and Doe et al., 2020a)", 2, "so  and "),
    ("author_year_multi", "so (Smith, 2020; Li et al., 2019)", 1, "so "),
])
def test_patterns(spark, name, text, n, left):
    p = {name: (rules.ARTEFACTS | rules.CITATIONS)[name]}
    r = cleaning.remove_patterns(spark.createDataFrame([(text,)], "text string"), p).first()
    assert (r[f"{name}_found"], r.text) == (n, left)


def test_line_reasons(spark):
    text = "first\nfirst\n\nfirst\na\tb\tc\nd\te\tf\nlone\tx\ty z\nTABLE 3\np. 7\n12, 3.4\nMETHODS long header\nKeywords: alpha, beta\nABC-1 XY2 foo\nDNA\n© 2020 me\nAll Rights Reserved to the press\nplain prose here\n"
    got = {r["line"]: r["reason"] for r in one(spark, text, cleaning.line_reasons)}
    assert got["a\tb\tc"] == got["d\te\tf"] == "tabular" or got["a\tb\tc"] == "tabular"
    assert got["first"] == "repetition" and got[""] is None and got["plain prose here"] is None
    assert got["TABLE 3"] == got["p. 7"] == got["12, 3.4"] == "short"
    assert got["Keywords: alpha, beta"] == got["ABC-1 XY2 foo"] == got["DNA"] == "metadata" and got["© 2020 me"] == got["All Rights Reserved to the press"] == "copyright"
    far = "\n".join(["same", "a a", "b b", "c c", "d d", "same", "e e", "f f", "g g", "h h", "i i", "same"])
    assert [r["reason"] for r in one(spark, far, cleaning.line_reasons) if r["line"] == "same"] == [None, "repetition", None]


def test_figures_symbols_and_white_space(spark):
    assert one(spark, "Fig. 2.1: x\nTable 5\n1 2 3 x\nα 1 2\nx_1 = 2\nprose", cleaning.figure_lines) == "α 1 2\nx_1 = 2\nprose"
    assert one(spark, "→ ⇒ • − … ′ © § «x» “x” .......", cleaning.normalize_symbols) == "-> => * - ... ' (c) section <<x>> “x” ..."
    clean = one(spark, "  a\t\tb\n\n\n\nc.   D \n  e \t", cleaning.normalize_whitespace)
    assert clean == "a b\n\nc. D \ne" and one(spark, clean, cleaning.normalize_whitespace) == clean


def test_cleaning_drops_blank_documents(spark):
    df = spark.createDataFrame([(1, "http://x.y"), (2, "kept text"), (3, ""), (4, None)], "doc_id long, text string")
    assert [tuple(r) for r in cleaning.clean_documents(df).collect()] == [(2, "kept text")]


def test_language_band(spark):
    df = spark.createDataFrame([(0.74999,), (0.75,), (None,), (0.7,), (0.69,)], "s double")
    assert sorted(str(r.s) for r in cleaning.language_gate(df, "s").collect()) == ["0.75", "None"]
    assert sorted(r.s for r in cleaning.recovery_band(df, "s").collect()) == [0.7, 0.74999]


@pytest.mark.parametrize("n", [0, 1, 10, 11, 15, 16, 40])
@pytest.mark.parametrize("overlap", [0.0, 0.5])
@pytest.mark.parametrize("least", [0, 8])
def test_windows_cover_every_token(spark, n, overlap, least):
    df = spark.createDataFrame([(list(range(n)),)], "t array<int>")
    got = windows.token_windows(df, "t", 10, overlap, least).collect()
    assert set().union(*(r.window for r in got), set()) == set(range(n))
    assert all(len(r.window) <= 10 and r.window == list(range(r.start_pos, r.end_pos)) for r in got)
    if least and len(got) > 1:
        assert len(got[-1].window) >= least
    padded = windows.token_windows(df, "t", 10, overlap, least, pad=-1).collect()
    assert all(len(r.window) == 10 for r in padded)


def test_ids_and_hashes(spark):
    rows = [("ABC", "z", "D", "p"), ("NaN", "z", "D", "p"), (None, " none ", "D", "p"), (None, None, "null", "p"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "m string, z string, d string, p string")
    got = [r.i for r in df.select(splits.document_id(F.col("m"), F.col("z"), F.col("d"), F.col("p"), F.lit("f"), F.lit(3)).alias("i")).collect()]
    assert got == ["md5:abc", "zip:z", "doi:d", "src:p::row:3", "file:f::row:3"]
    assert spark.range(1).select(splits.hash_unit(42, F.lit("abc")).alias("u")).first().u == 0.04454331026583446
    with pytest.raises(ValueError):
        splits.check_ratios(0.5, 0.6)


def test_splits_need_a_whole_manifest(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(ValueError, match="lacks"):
        splits.materialize_splits(docs, spark.createDataFrame([(1, "train")], "doc_id long, split string"))
    with pytest.raises(ValueError, match="different"):
        splits.materialize_splits(docs, spark.createDataFrame([(1, "train"), (1, "val"), (2, "val")], "doc_id long, split string"))


def test_global_index_and_ranks(spark):
    df = spark.range(0, 1000, 1, 7).select(F.xxhash64("id").alias("doc_id"))
    want = {v: i for i, v in enumerate(sorted(r.doc_id for r in df.collect()))}
    for parts in (1, 5):
        assert {r.doc_id: r.global_idx for r in splits.global_index(df, "doc_id", partitions=parts).collect()} == want
    got = [{r.doc_id for r in splits.rank_positions(df, 1, k, 3).collect()} for k in range(3)]
    assert len(set().union(*got)) == sum(map(len, got)) == 999


@pytest.mark.parametrize("sizes", [[5, 5, 5], [50], [9, 2, 3, 4], [0, 0], [7, 7, 7, 7]])
def test_fixed_budget(spark, sizes):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    got = [r.chars for r in splits.budget_pick(df, 10, 3).collect()]
    assert got and (sum(got) <= 10 or sum(got) - 10 < 10 - (sum(got) - max(got)) or len(got) == 1)


def test_span_corruption(spark):
    assert spans.solve_length(512) == (568, 114)
    df = spark.createDataFrame([(str(i), list(range(2, 2 + n))) for i, n in enumerate([1, 2, 5, 100, 568, 900])], "id string, t array<int>")
    out = {r.id: r for r in spans.span_corruption(df, "id", "t", 32_100).collect()}
    for i, n in enumerate([1, 2, 5, 100, 568, 900]):
        r = out[str(i)]
        assert len(r.input_ids) == 512 and len(r.labels) == len(r.decoder_input_ids) == 114 and r.decoder_input_ids[0] == 0
        kept, hidden = [x for x in r.input_ids if x > 1], [x for x in r.labels if x > 1]
        at = {s: k for k, s in enumerate(hidden) if s > 31_000}
        back = []
        for x in kept:
            if x > 31_000:
                k = at[x] + 1
                while k < len(hidden) and hidden[k] < 31_000:
                    back.append(hidden[k])
                    k += 1
            else:
                back.append(x)
        assert back == list(range(2, 2 + min(n, 568)))


def test_span_corruption_of_whole_documents(spark):
    sizes = [0, 1, 568, 569, 3000]
    df = spark.createDataFrame([(i, list(range(2, 2 + n))) for i, n in enumerate(sizes)], "id long, t array<int>")
    got = spans.corrupted_windows(df, "id", "t", 32_100).collect()
    for i, n in enumerate(sizes):
        rows = sorted((r for r in got if r.id == i), key=lambda r: r.window_idx)
        assert [r.window_idx for r in rows] == list(range(-(-n // 568)))
        seen = [sorted(x for x in r.input_ids + r.labels if 1 < x < 31_000) for r in rows]
        assert [x for w in seen for x in w] == list(range(2, 2 + n))
    shapes = {tuple(k for k, x in enumerate(r.input_ids) if x > 31_000) for r in got if r.id == 4 and r.window_idx < 5}
    assert len(shapes) == 5  # each window has a mask of its own


def test_span_corruption_query_has_every_window(spark, sf):
    from quillmill.plans.catalog import QUERIES

    whole = QUERIES["window_run_stats"](spark, sf).first()
    assert QUERIES["span_corruption"](spark, sf).count() == whole.windows > whole.short_docs


def test_score_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r.json").write_text(json.dumps({"results": {"t1": {"acc,none": 0.25, "acc_stderr,none": 0.01}, "t2": {"acc,none": 0.5}}}))
    (tmp_path / "bad.json").write_text("{")
    got = sorted((r.task, r.acc, r.acc_stderr) for r in evals.long_scores(corpus.read_json_texts(spark, str(tmp_path))).collect())
    assert got == [("t1", 0.25, 0.01), ("t2", 0.5, None)]
    names = spark.createDataFrame([("clean_best06_52k_ppl1419",), ("flan_step01_25k",), ("t5_original",), ("x",)], "n string").select(evals.checkpoint_name(F.col("n")).alias("c"))
    assert [tuple(r.c) for r in names.collect()] == [("best", 6, 52000, 14.19), ("step", 1, 25000, None), ("baseline", None, None, None), ("unknown", None, None, None)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, " a\nb ", "train"), (2, "", "val"), (3, "c", "train")], "key long, body string, doc_split string")
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    read = corpus.read_corpus(spark, f"{tmp_path}/in", "body", "key", defaults={"score": 1.0})
    assert read.columns == ["id", "text", "doc_split", "score"] and corpus.read_corpus(spark, f"{tmp_path}/in", "body", "key", limit=2).count() == 2
    assert sorted(r.text for r in corpus.tokenizer_texts(read).collect()) == ["a b", "c"]
    assert corpus.with_lineage(spark.read.parquet(f"{tmp_path}/in")).select("source_file", "row_idx_in_file").distinct().count() == 3
    corpus.write_splits(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/train").count() == 2 and spark.read.parquet(f"{tmp_path}/s/test").columns == ["key", "body"]
    corpus.merge_folder(spark, f"{tmp_path}/in", f"{tmp_path}/m")
    with pytest.raises(Exception, match="(?i)exist"):
        corpus.merge_folder(spark, f"{tmp_path}/in", f"{tmp_path}/m")
    corpus.write_with_exclusions(df, F.length("body") > 0, f"{tmp_path}/k", f"{tmp_path}/x")
    assert (spark.read.parquet(f"{tmp_path}/k").count(), spark.read.parquet(f"{tmp_path}/x").count()) == (2, 1)


def test_stream(spark, tmp_path):
    from quillmill.streaming.clean import clean_stream

    spark.createDataFrame([(1, "see http://a.b  now"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    q = clean_stream(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "see now")]


def test_noise_mask_shares():
    for n in (2, 3, 10, 568):
        m = spans.noise_mask(n, 0.15, 3.0, np.random.default_rng(n))
        assert len(m) == n and not m[0] and m.sum() == min(max(round(n * 0.15), 1), n - 1)
