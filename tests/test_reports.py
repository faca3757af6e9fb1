"""Score reports on small tables, against values by hand."""

from pyspark.sql import functions as F

from quillmill.operators import evals, stats


def test_progression_and_groups(spark):
    df = spark.createDataFrame([("a", 1000, 0.2), ("a", 2000, 0.4), ("b", 1000, None)], "subject string, step int, acc double")
    got = {r.subject: (r["1k"], r["2k"], r.AVG and round(r.AVG, 9)) for r in evals.progression(df, "subject", "step", "acc", [1000, 2000]).collect()}
    assert got == {"a": (0.2, 0.4, 0.3), "b": (None, None, None)}
    one = evals.group_stats(df.where("subject = 'a'"), "subject", "acc").first()
    assert (one.n, round(one.range, 9), round(one.std, 9), round(one.std_sample, 9)) == (2, 0.2, 0.1, 0.141421356)


def test_categories_and_names(spark):
    df = spark.createDataFrame([("m", "high_school_Physics", 0.5), ("m", "law", 0.1), ("n", "law", 0.3)], "model string, task string, acc double")
    got = {(r.model, r.category): r["mean"] for r in evals.category_means(df, "task", "acc", {"stem": ["physics"], "law": ["law"]}, "model").collect()}
    assert got == {("m", "stem"): 0.5, ("m", "law"): 0.1, ("n", "stem"): 0.0, ("n", "law"): 0.3}
    known = spark.createDataFrame([("physics",), ("a law text",), ("school",)], "known string")
    assert sorted(tuple(r) for r in evals.fuzzy_names(df, known, "task", "known").collect()) == [("high_school_Physics", "physics"), ("law", "a law text")]


def test_differences(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.1), ("z", 1.0)], "subject string, acc double")
    b = spark.createDataFrame([("x", 0.25), ("y", 0.35)], "subject string, acc double")
    r = evals.difference_stats(a, b, ["subject"], "acc").first()
    assert (r.n, round(r["mean"], 9), round(r.std, 9), r.better, r.worse, r.share_better) == (2, 0.0, 0.25, 1, 1, 0.5)
    assert evals.difference_stats(a.limit(0), b, ["subject"], "acc").first().n == 0
    d = spark.createDataFrame([("x", 0.1), ("x", 0.2), ("y", 0.1), ("y", 0.0), ("z", None)], "subject string, delta double")
    assert [r.subject for r in evals.always_better(d, "subject", "delta").collect()] == ["x"]


def test_rows_by_key_and_priority(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), (None, 1, "c")], "key string, at int, v string")
    assert sorted(r.v for r in evals.deduplicate(df, ["key"], "at").collect()) == ["b", "c"]
    assert sorted(r.v for r in evals.deduplicate(df, ["key"], "at", last=False).collect()) == ["a", "c"]
    assert [r.p for r in df.select(evals.priority(F.col("v"), ["b", "a"]).alias("p")).collect()] == [1, 0, 99]
    got = spark.createDataFrame([(0.5, [0.1]), (None, [0.1, None, 0.3]), (None, [])], "t double, s array<double>").select(evals.official_or_mean(F.col("t"), F.col("s")).alias("x"))
    assert [r.x and round(r.x, 9) for r in got.collect()] == [0.5, 0.2, None]


def test_checkpoints_progress_and_markdown(spark):
    files = spark.createDataFrame([("r", "step-100-val_ppl-9.5.ckpt", 1), ("r", "step-200-val_ppl-8.25.ckpt", 2), ("q", "epoch-1-step-7.ckpt", 5), ("q", "last.ckpt", 3), ("p", "step-step=4", 1)], "run string, path string, modified int")
    best = {r.run: (r.path, r.step, r.ppl) for r in evals.lowest_perplexity(files, "run").collect()}
    assert best == {"r": ("step-200-val_ppl-8.25.ckpt", 200, 8.25), "q": ("last.ckpt", None, None), "p": ("step-step=4", 4, None)}
    log = spark.createDataFrame([("j", "completed_tasks=2/10", 0), ("j", "noise", 5), ("j", "completed_tasks=6/10", 8), ("i", "completed_tasks=1/3", 1)], "job string, line string, at int")
    assert {r.job: (r.done, r.total, r.eta) for r in evals.eta(log, "job", "line", "at").collect()} == {"j": (6, 10, 8.0), "i": (1, 3, None)}
    text = evals.markdown(spark.createDataFrame([("a", 0.5), ("b", None)], "n string, x double").orderBy("n"), "Top")
    assert text == "## Top\n\n| n | x |\n| --- | --- |\n| a | 0.5000 |\n| b |  |"


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([("some words here",), ("",), (None,)], "text string")
    n = len(Tokenizer.from_file(path).encode("some words here", add_special_tokens=False).ids)
    assert [r.n_tokens for r in stats.with_token_count(df, path).collect()] == [n, 0, None]
