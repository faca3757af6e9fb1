"""Budgets, samplers, readers, statistics and score tables against what they are told to do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import citations, cleaning, evals, spans, splits, stats, windows
from quillmill.sources import corpus


def plain_budget(rows, budget, seed):
    import hashlib

    unit = lambda i: int(hashlib.sha1(f"{seed}:{i}".encode()).hexdigest()[:16], 16) / 2**64
    order = sorted(rows, key=lambda r: (unit(r[0]), str(r[0])))
    used, taken, over = 0, [], None
    for i, n in order:
        if used + n <= budget:
            used += n
            taken.append(i)
        elif over is None or n < over[1]:
            over = (i, n)
    if over and (not taken or used + over[1] - budget < budget - used):
        taken.append(over[0])
    return sorted(taken)


@pytest.mark.parametrize(("budget", "sizes"), [(500, (1, 90)), (3000, (1, 400)), (40, (50, 90)), (10**6, (1, 9)), (777, (0, 30))])
def test_a_budget_is_picked_as_by_one_fold(spark, budget, sizes):
    rng = np.random.default_rng(budget)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(*sizes, 300))]
    df = spark.createDataFrame([(i, "x" * n) for i, n in rows], "doc_id long, text string").repartition(3)
    got = splits.budget_pick(df, budget, 5).collect()
    assert sorted(r.doc_id for r in got) == plain_budget(rows, budget, 5) and all(r.chars == rows[r.doc_id][1] for r in got)


def test_budget_rules(spark):
    assert splits.budget_chars(gigabytes=0.5) == 5 * 10**8 and splits.budget_chars(chars=7) == 7
    for bad in ({}, {"gigabytes": 1, "chars": 2}, {"gigabytes": 0}, {"chars": -1}):
        with pytest.raises(ValueError, match="budget"):
            splits.budget_chars(**bad)
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    with pytest.raises(ValueError, match="not enough"):
        splits.budget_splits(df, {"train": 10}, 1)
    assert {r.doc_id for r in splits.budget_splits(df, {"train": 10}, 1, allow_smaller=True).collect()} == {1, 2}
    with pytest.raises(ValueError, match="not enough"):
        splits.exact_sample(df, 5, 1, allow_smaller=False)
    assert splits.budget_pick(df.limit(0), 10, 1).count() == 0
    late = splits.materialize_splits(df, spark.createDataFrame([(1, "val")], "doc_id long, split string"), eager=False)
    with pytest.raises(Exception, match="lacks 2"):
        late.collect()


def test_sampler_state_and_turns(spark):
    at = splits.resume_position(10, 2, 3, 4, 100)
    assert at == {"seen": 240, "position": 40, "epochs": 2, "coverage": 240.0}
    state = splits.sampler_state(3, 100, 40)
    assert splits.restore_sampler(state, 3, 100) == 40
    with pytest.raises(ValueError, match="seed"):
        splits.restore_sampler(state, 4, 100)
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    turns = sorted((r.turn, r.position) for r in splits.resumed_positions(df, 1, 2, 5, 40).collect())
    assert [p for _, p in turns] == [*range(42, 100, 5), *range(2, 40, 5)] and [t for t, _ in turns] == list(range(20))


def test_files_that_cannot_be_read(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"file://{tmp_path}/t")
    (tmp_path / "t" / "part-bad.parquet").write_bytes(b"PAR1 no footer")
    (tmp_path / "t" / "part-cut.parquet").write_bytes(b"PAR1" + b"\xff\xff\xff\x7f" + b"PAR1")
    df, bad = corpus.read_tolerant(spark, f"file://{tmp_path}/t/part-*.parquet")
    assert bad == 2 and df.count() == 30
    names = corpus.ordered_files(spark, f"file://{tmp_path}/t/part-0*.parquet", 2)
    assert names == sorted(names) and len(names) == 2
    got = corpus.read_files(spark, f"file://{tmp_path}/t/part-0*.parquet", 2)
    assert got.select("source_file").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        corpus.ordered_files(spark, f"file://{tmp_path}/none*")


def test_rows_windows_and_scores_from_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",1k,2k\nmaths,0.25,\nlaw,0.5,0.75\n")
    assert [tuple(r) for r in corpus.read_scores(spark, f"file://{tmp_path}/s.csv").collect()] == [("maths", 0.25, None), ("law", 0.5, 0.75)]
    df = spark.createDataFrame([("a", " 1 2 x ", "legacy_window", "1"), ("b", "text ", "doc", "1")], "id string, text string, document_type string, preprocessing_version string")
    assert [tuple(r) for r in corpus.window_tokens(df).select("text", "tokens").collect()] == [("1 2 x", [1, 2, None]), ("text", None)]
    assert corpus.verify_windows(df, [("doc", "1")]) == 0.5
    with pytest.raises(ValueError, match="known"):
        corpus.verify_windows(df, [("other", "1")])
    row = corpus.canonical(df, ["document_type", "absent"]).collect()[0]
    assert row.metadata.asDict() == {"document_type": "legacy_window", "absent": None}
    corpus.write_report(df, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 2


def test_statistics_by_configuration(spark):
    df = spark.createDataFrame([("ab\nab\n\nlonger line here. And more! End",)], "text string")
    row = df.select(*[c.alias(k) for k, c in stats.selected_stats(F.col("text"), {"line": {"short": (2,)}, "sentence": None}).items()]).collect()[0]
    assert row.n_lines == 4 and row.short_line_ratio_chars_2 == 0.75 and row.line_duplicates == 0.25 and row.n_sentences == 5
    with pytest.raises(ValueError, match="no such"):
        stats.selected_stats(F.col("text"), {"perplexity": {}})


def test_citation_columns_of_a_document(spark):
    df = spark.createDataFrame([(1, "see [1, 2] and (Doe, 2000) at a@b.org"), (2, "nothing"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in citations.document_metadata(citations.scan_citations(df)).collect()}
    assert rows[1].square_numeric_found == 1 and rows[1].email_addresses_removed == 1 and rows[1].citations_removed == 3 and rows[1].had_citations
    assert rows[2].citations_found == 0 and not rows[2].had_citations


def test_older_masks_and_padding(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        mask = spans.drawn_spans(n, 0.15, 3.0, rng)
        assert len(mask) == n and mask.sum() <= int(n * 0.15) + 0
    assert spans.drawn_spans(1000, 0.15, 3.0, rng).sum() >= 140
    df = spark.createDataFrame([([5, 0, 0], [1, 1, 0])], "labels array<int>, attention_mask array<int>")
    assert df.select(spans.label_mask(F.col("labels"))).collect()[0][0] == [5, -100, -100]
    assert tuple(spans.utilisation(df).collect()[0]) == (2 / 3, False)


def test_scores_and_recovery(spark):
    df = spark.createDataFrame([("a", 0.72), ("b", 0.9), ("c", None)], "doc_id string, score double")
    assert [(r.doc_id, r.recovered_score, r.old_threshold) for r in cleaning.with_recovery(df, "score").collect()] == [("a", 0.72, 0.75)]
    order = spark.createDataFrame([("MMLU_x",), ("law",), ("B",), ("z_Average",)], "m string").orderBy(evals.metric_order(F.col("m"), ["B"]), "m")
    assert [r.m for r in order.collect()] == ["B", "MMLU_x", "z_Average", "law"]
    m = spark.createDataFrame([({"acc": 0.5},), ({"f1": 0.25},), ({},)], "m map<string, double>")
    assert [r[0] for r in m.select(evals.first_of(F.col("m"), ["acc", "f1"], 0.0)).collect()] == [0.5, 0.25, 0.0]
    text = spark.createDataFrame([("a  b\r\n c ",)], "t string")
    assert text.select(windows.normalize_window_text(F.col("t"))).collect()[0][0] == "a b c"
