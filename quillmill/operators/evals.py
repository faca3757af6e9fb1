"""Score tables: parsing, best per group, baselines, rankings, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_scores(files: DataFrame, value: str = "value") -> DataFrame:
    """(path, task, acc, acc_stderr) of result files read as whole texts; unreadable ones have no rows."""
    parsed = files.withColumn("r", F.from_json(value, "results map<string, map<string, string>>")["results"])
    out = parsed.select("path", F.explode("r").alias("task", "m"))
    return out.select("path", "task", F.col("m")["acc,none"].cast("double").alias("acc"), F.col("m")["acc_stderr,none"].cast("double").alias("acc_stderr"))


def checkpoint_name(name: Column) -> Column:
    """(kind, number, step, ppl) of names such as run_best06_52k_ppl1419 and run_step01_25k."""
    best = r"_best(\d+)_(\d+)k_ppl(\d+)"
    step = r"_step(\d+)_(\d+)k"
    digits = F.regexp_extract(name, best, 3)
    kind = F.when(name.rlike(best), "best").when(name.rlike(step), "step").when(name.rlike("original|baseline"), "baseline").otherwise("unknown")
    pick = lambda g: F.when(name.rlike(best), F.regexp_extract(name, best, g)).when(name.rlike(step), F.regexp_extract(name, step, g)).try_cast("int")
    ppl = F.when(F.length(digits) > 2, digits.try_cast("double") / 100).otherwise(digits.try_cast("double"))
    return F.struct(kind.alias("kind"), pick(1).alias("number"), (pick(2) * 1000).alias("step"), ppl.alias("ppl"))


def best_per_group(df: DataFrame, group: str, score: str, order: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def against_baseline(df: DataFrame, baseline: DataFrame, keys: list[str], score: str) -> DataFrame:
    """delta and percent change; null where the baseline is missing or not above 0."""
    b = baseline.select(*keys, F.col(score).alias("baseline"))
    out = df.join(b, keys, "left")
    ok = F.col("baseline") > 0
    return out.withColumn("delta", F.when(ok, F.col(score) - F.col("baseline"))).withColumn("percent", F.when(ok, (F.col(score) - F.col("baseline")) / F.col("baseline") * 100))


def ranking(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("behind_best", F.first(score).over(w) - F.col(score)).withColumn("behind_previous", F.lag(score).over(w) - F.col(score))


def top_bottom(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    top = df.where(F.col(value).isNotNull()).orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(df.where(F.col(value).isNotNull()).orderBy(F.asc(value), tie).limit(n).withColumn("side", F.lit("bottom")))


def thirds(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Means of the early, middle and late third of each group."""
    n = F.count("*").over(Window.partitionBy(group))
    i = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    third = F.floor(n / 3)
    part = F.when(i < third, "early").when(i < 2 * third, "middle").otherwise("late")
    return df.withColumn("part", part).groupBy(group).pivot("part", ["early", "middle", "late"]).agg(F.avg(value))


def progression(df: DataFrame, row: str, step: str, value: str, steps: list[int]) -> DataFrame:
    """A row for each subject, a column `{step}k` for each of the steps (their list bounds the width) and the mean AVG of
    those present; the first value of a step by value counts, a missing one is null."""
    wide = df.groupBy(row).pivot(step, steps).agg(F.min(value)).withColumnsRenamed({str(s): f"{s // 1000}k" for s in steps})
    cells = F.filter(F.array(*[F.col(f"`{s // 1000}k`") for s in steps]), lambda x: x.isNotNull())
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    return wide.withColumn("AVG", F.when(F.size(cells) > 0, total / F.size(cells)))


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, both deviations (sample and population), lowest, highest and their distance; missing values don't count."""
    v = F.col(value)
    return df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_sample"), F.stddev_pop(v).alias("std"), F.min(v).alias("worst"), F.max(v).alias("best"), (F.max(v) - F.min(v)).alias("range"))


def category_means(df: DataFrame, name: str, value: str, categories: dict[str, list[str]], by: str) -> DataFrame:
    """(by, category, mean): a task belongs to each category of which its name contains a part; 0 where none does."""
    hits = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.lower(name), F.lower(p))), F.lit(c)) for c, parts in categories.items()]))
    means = df.select(by, value, F.explode(hits).alias("category")).groupBy(by, "category").agg(F.avg(value).alias("mean"))
    grid = df.select(by).distinct().select(by, F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    return grid.join(means, [by, "category"], "left").fillna(0.0, ["mean"])


def difference_stats(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row about a - b over the cells that both have."""
    d = a.join(b.select(*keys, F.col(value).alias("__b")), keys).select((F.col(value) - F.col("__b")).alias("d")).where("d is not null")
    n, better = F.count("*"), F.count_if(F.col("d") > 0)
    return d.agg(n.alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), better.alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.when(n > 0, better / n).alias("share_better"), F.max("d").alias("highest"), F.min("d").alias("lowest"))


def always_better(df: DataFrame, group: str, delta: str) -> DataFrame:
    """Groups whose every delta is above 0; a missing one is not."""
    return df.groupBy(group).agg(F.bool_and(F.coalesce(F.col(delta) > 0, F.lit(False))).alias("all")).where("all").select(group)


def fuzzy_names(names: DataFrame, known: DataFrame, name: str, known_name: str) -> DataFrame:
    """(name, known_name): the first known name by code point that contains the name or is contained in it, any case.
    Both sides are lists of task names, a few thousand at most; texts don't belong here."""
    a, b = names.select(name).distinct(), known.select(known_name).distinct()
    low, other = F.lower(name), F.lower(known_name)
    return a.join(b, F.contains(low, other) | F.contains(other, low)).groupBy(name).agg(F.min(known_name).alias(known_name))


def deduplicate(df: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """One row for each key: the last by `order`, or the first. Partial aggregation, so a hot key isn't sorted."""
    row = F.struct(*df.columns)
    pick = F.max_by(row, order) if last else F.min_by(row, order)
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick.alias("__row")).select("__row.*")


def priority(c: Column, order: list[str]) -> Column:
    """The place of a value in a fixed list from 0; 99: not there."""
    at = F.array_position(F.array(*[F.lit(o) for o in order]), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(99)).cast("int")


def official_or_mean(total: Column, tasks: Column) -> Column:
    """The official total, else the mean of the tasks (an array) that have a score."""
    known = F.filter(tasks, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(total, F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)))


def checkpoint_of(path: Column) -> Column:
    """(step, epoch, ppl) of checkpoint files: step-N-val_ppl-X, step-step=N, epoch-E-step-N."""
    part = lambda p, kind: F.regexp_extract(path, p, 1).try_cast(kind)
    step = F.coalesce(part(r"step-step=(\d+)", "int"), part(r"step-(\d+)", "int"))
    return F.struct(step.alias("step"), part(r"epoch-(\d+)-step", "int").alias("epoch"), part(r"val_ppl-(\d+(?:\.\d+)?)", "double").alias("ppl"))


def lowest_perplexity(files: DataFrame, group: str, path: str = "path", modified: str = "modified") -> DataFrame:
    """The checkpoint of each group with the lowest perplexity; without any, the one named last, else the newest."""
    rows = files.withColumn("__c", checkpoint_of(F.col(path)))
    w = Window.partitionBy(group).orderBy(F.col("__c.ppl").asc_nulls_last(), F.when(F.col(path).contains("last"), 0).otherwise(1), F.desc(modified), path)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*files.columns, "__c.step", "__c.ppl")


def eta(log: DataFrame, job: str, line: str, seconds: str) -> DataFrame:
    """(job, done, total, eta): lines `completed_tasks=a/b` with their time; what is left at the speed between the first
    and the last; null where nothing moved."""
    at = log.select(job, F.col(seconds).cast("double").alias("s"), F.regexp_extract(line, r"completed_tasks=(\d+)/", 1).try_cast("long").alias("a"), F.regexp_extract(line, r"completed_tasks=\d+/(\d+)", 1).try_cast("long").alias("b")).where("a is not null")
    out = at.groupBy(job).agg(F.min_by("a", "s").alias("a0"), F.max_by("a", "s").alias("done"), F.max_by("b", "s").alias("total"), (F.max("s") - F.min("s")).alias("took"))
    return out.select(job, "done", "total", F.when(F.col("done") > F.col("a0"), (F.col("total") - F.col("done")) * F.col("took") / (F.col("done") - F.col("a0"))).alias("eta"))


def markdown(df: DataFrame, title: str, rows: int = 10) -> str:
    """The first `rows` rows of a sorted report as a Markdown table."""
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([*head, *["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(rows).collect()]])


def improved(df: DataFrame, group: str, delta: str) -> DataFrame:
    """(group, mean_delta, side): groups whose mean delta is above 0 are improved; others, and those without one, regressed.
    Missing means sort last."""
    means = df.groupBy(group).agg(F.avg(delta).alias("mean_delta"))
    return means.withColumn("side", F.when(F.col("mean_delta") > 0, "improved").otherwise("regressed")).orderBy(F.desc_nulls_last("mean_delta"), group)


def all_names(*tables: DataFrame, name: str) -> DataFrame:
    """The distinct names of several tables."""
    out = tables[0].select(name)
    for t in tables[1:]:
        out = out.union(t.select(name))
    return out.distinct()


def common_names(*tables: DataFrame, name: str) -> DataFrame:
    """The names that all tables have."""
    out = tables[0].select(name)
    for t in tables[1:]:
        out = out.intersect(t.select(name))
    return out.distinct()


def baseline_average(df: DataFrame, baseline: DataFrame, name: str, score: str, default: float = 0.25) -> DataFrame:
    """(name, score, baseline): a group's baseline score, and the chance of a guess where it has none."""
    b = baseline.groupBy(name).agg(F.avg(score).alias("baseline"))
    return df.join(b, name, "left").withColumn("baseline", F.coalesce("baseline", F.lit(default)))


def by_alias(df: DataFrame, name: str, aliases: dict[str, str]) -> DataFrame:
    """df with a name's one spelling in its place; a name without an alias stays. The list is a few names."""
    if not aliases:
        return df
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return df.withColumn(name, F.coalesce(F.element_at(known, F.col(name)), F.col(name)))


def ordered_matrix(df: DataFrame, row: str, column: str, value: str, columns: int = 100) -> DataFrame:
    """A row for each subject, best mean first, and a column for each run, worst mean first; at most `columns` runs."""
    runs = df.groupBy(column).agg(F.avg(value).alias("m")).orderBy(F.asc_nulls_first("m"), column).limit(columns + 1).collect()
    if len(runs) > columns:
        raise ValueError(f"more than {columns} runs")
    wide = df.groupBy(row).pivot(column, [r[column] for r in runs]).agg(F.avg(value))
    means = df.groupBy(F.col(row).alias("__row")).agg(F.avg(value).alias("__mean"))
    return wide.join(means, F.col(row).eqNullSafe(F.col("__row"))).orderBy(F.desc_nulls_last("__mean"), row).drop("__row", "__mean")


def metric_order(name: Column, first: list[str]) -> Column:
    """Sorting key of a metric: those of the fixed list in its order, then other averages and MMLU groups, then the rest."""
    grouped = name.endswith("_Average") | name.startswith("MMLU_")
    at = F.array_position(F.array(*[F.lit(x) for x in first]), name)
    return F.when(at > 0, at).when(grouped, F.lit(len(first) + 1)).otherwise(F.lit(len(first) + 2)).cast("int")


def measures_table(df: DataFrame, row: str, run: str, measures: list[str], runs: list[str]) -> DataFrame:
    """A row for each subject and a column {run}_{measure} for each measure of each run; 0 where there is none."""
    wide = df.groupBy(row).pivot(run, runs).agg(*[F.max(m).alias(m) for m in measures])
    return wide.fillna(0, [f"{r}_{m}" for r in runs for m in measures])


def best_rows(df: DataFrame, row: str, value: str, n: int = 20) -> DataFrame:
    """The `n` subjects with the highest means over all runs."""
    return df.groupBy(row).agg(F.avg(value).alias("mean")).orderBy(F.desc_nulls_last("mean"), row).limit(n)


def run_date(path: Column) -> Column:
    """The time in a path as YYYY-MM-DD_HH-MM-SS; null without one."""
    text = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})", 0)
    return F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit(" "), F.replace(F.substring(text, 12, 8), F.lit("-"), F.lit(":"))), F.lit("yyyy-MM-dd HH:mm:ss"))


def step_of(path: Column) -> Column:
    """The number of a step in a path: step_12k, step-500; 0 without one."""
    digits, k = F.regexp_extract(path, r"step[_-]?(\d+)(k?)", 1), F.regexp_extract(path, r"step[_-]?(\d+)(k?)", 2)
    return F.coalesce(digits.try_cast("long") * F.when(k == "k", 1000).otherwise(1), F.lit(0)).cast("long")


def run_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike("baseline|original"), "baseline").when(low.contains("best"), "best").when(low.contains("step"), "step").otherwise("other")


def baseline_of(df: DataFrame, name: str, path: str, order: str) -> DataFrame:
    """The one row that is the baseline: the first whose path names t5-base or whose name says baseline or original, else
    the first of all. A list of models, not of texts."""
    known = F.col(path).contains("t5-base") | F.lower(name).rlike("baseline|original")
    return df.orderBy(F.when(known, 0).otherwise(1), order).limit(1)


def result_status(df: DataFrame, run: str, task: str, acc: str, total: str, subsets: list[str]) -> DataFrame:
    """(run, score, tasks, status) from long scores: the score of the task `total`, else the mean of the subsets there
    are; success where all subsets have a score, partial where some have, failed where none has and there is no total."""
    part = F.col(task).isin(subsets) & F.col(acc).isNotNull()
    out = df.groupBy(run).agg(F.max(F.when(F.col(task) == total, F.col(acc))).alias("t"), F.avg(F.when(part, F.col(acc))).alias("m"), F.count_distinct(F.when(part, F.col(task))).alias("tasks"))
    status = F.when(F.col("tasks") >= len(subsets), "success").when((F.col("tasks") > 0) | F.col("t").isNotNull(), "partial").otherwise("failed")
    return out.select(run, F.coalesce("t", "m").alias("score"), "tasks", status.alias("status"))


def wide_results(df: DataFrame, run: str, task: str, acc: str, tasks: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """A row for each run: subtask_{task} and category_{name} (the mean of its tasks that are there) as text with four
    digits, the empty string where there is none."""
    text = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit(""))
    shown = lambda c: F.when(c.isNotNull(), text(c)).otherwise(F.lit(""))
    one = [shown(F.max(F.when(F.col(task) == t, F.col(acc)))).alias(f"subtask_{t}") for t in tasks]
    more = [shown(F.avg(F.when(F.col(task).isin(parts), F.col(acc)))).alias(f"category_{c}") for c, parts in categories.items()]
    return df.groupBy(run).agg(*one, *more)


def summary_by_type(df: DataFrame, kind: str, value: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.max(value).alias("best"), F.min(value).alias("worst"))


def prefixed(df: DataFrame, column: str, prefix: str, skip: list[str] = ()) -> DataFrame:
    """(…, subject, value): the entries of a map whose keys begin with a prefix, without it; keys of `skip` go."""
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, F.explode(column).alias("k", "value")).where(F.col("k").startswith(prefix) & ~F.col("k").isin(*skip))
    return out.select(*rest, F.substring("k", len(prefix) + 1, 1 << 20).alias("subject"), "value")


def first_of(struct: Column, names: list[str], default: float | None = None) -> Column:
    """The first of several metrics, by their order of priority, that a map has."""
    return F.coalesce(*[F.try_element_at(struct, F.lit(n)) for n in names], F.lit(default))
