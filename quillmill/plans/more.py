"""Further registered queries: windows, statistics, budgets, samplers, reports of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import cleaning, evals, spans, splits, stages, stats, windows
from ..sources import corpus
from .catalog import _EV, _LINES, D, _ev, _fold, _found, _q, _SPLIT, _split, _t, _tokens, _unit, query


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _docs(s, sf) -> DataFrame:
    return _t(s, sf, "documents")


@query("window_normalize", "SELECT doc_id, regexp_replace(regexp_replace(text, '[\\s\u00a0]+', ' ', 'g'), '^ +| +$', '', 'g') AS text FROM documents")
def window_normalize(s, sf):
    return _docs(s, sf).select("doc_id", windows.normalize_window_text(F.col("text")).alias("text"))


_WINDOWS = D + ", w AS (SELECT doc_id, CAST(i AS INTEGER) AS window_idx, tokens[i * 75 + 1:i * 75 + 100] AS win, i = k - 1 AS is_last FROM (SELECT *, unnest(range(k)) AS i FROM (SELECT *, CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= 100 THEN 1 ELSE 1 + CAST(ceil((len(tokens) - 100) / 75.0) AS BIGINT) END AS k FROM d))) "


def _cut(s, sf) -> DataFrame:
    return windows.token_windows(_tokens(s, sf), "tokens", 100, 0.25)


@query("window_filters", _WINDOWS + f", t AS (SELECT doc_id, window_idx, len(win) AS n, array_to_string(win, ' ') AS text FROM w) SELECT doc_id, window_idx FROM t WHERE n >= 90 AND length(text) >= 500 AND len(regexp_extract_all(text, {_q(rules.PUNCTUATION)})) / greatest(length(text), 1) <= 0.02 AND len(regexp_extract_all(text, '[^\\p{{L}}\\p{{Nd}}]')) / greatest(length(text), 1) <= 0.2 AND len(regexp_extract_all(text, '\\p{{Lu}}')) / greatest(len(regexp_extract_all(text, '\\p{{L}}')), 1) <= 0.05")
def window_filters(s, sf):
    cut = _cut(s, sf).select("doc_id", F.col("window_idx"), F.array_join("window", " ").alias("text"), F.size("window").alias("n"))
    return windows.filter_windows(cut, "text", "n", 90, 500, 0.02, 0.2, 0.05).select("doc_id", "window_idx")


@query("window_ids", _WINDOWS + "SELECT doc_id, window_idx, CAST(doc_id AS VARCHAR) || '_window_' || CAST(window_idx AS VARCHAR) AS window_id, CAST(len(win) AS INTEGER) AS n_tokens, is_last FROM w")
def window_ids(s, sf):
    return windows.window_ids(_cut(s, sf), "doc_id").select("doc_id", "window_idx", "window_id", "n_tokens", "is_last")


@query("window_padded", _WINDOWS + "SELECT doc_id, window_idx, array_to_string(list_concat(win, list_resize(CAST([] AS VARCHAR[]), 100 - len(win), '_')), ' ') AS text FROM w")
def window_padded(s, sf):
    return windows.token_windows(_tokens(s, sf), "tokens", 100, 0.25, pad="_").select("doc_id", "window_idx", F.array_join("window", " ").alias("text"))


def _part_sql(unit: str, parts: str, short: tuple[int, ...], long: tuple[int, ...], repeats: bool = True) -> str:
    n, chars = "greatest(len(ps), 1)", "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    cols = [f"CAST(len(ps) AS BIGINT) AS n_{unit}s", f"round({chars.format('ps')} / {n}, 6) AS avg_{unit}_length"]
    cols += [f"round(len(list_filter(ps, lambda x: length(x) <= {k})) / {n}, 6) AS short_{unit}_ratio_chars_{k}" for k in short]
    cols += [f"round(len(list_filter(ps, lambda x: length(x) >= {k})) / {n}, 6) AS long_{unit}_ratio_chars_{k}" for k in long]
    if repeats:
        cols += [f"round((len(ps) - len(list_distinct(ps))) / {n}, 6) AS {unit}_duplicates", f"round(({chars.format('ps')} - {chars.format('list_distinct(ps)')}) / greatest(length(text), 1), 6) AS {unit}_char_duplicates"]
    return f"SELECT doc_id, {', '.join(cols)} FROM (SELECT doc_id, text, {parts} AS ps FROM documents)"


def _stat_query(name: str, columns, sql: str) -> None:
    @query(name, sql)
    def run(s, sf):
        return _rounded(_docs(s, sf).select("doc_id", *[c.alias(k) for k, c in columns(F.col("text")).items()]))


_stat_query("line_stats", stats.line_stats, _part_sql("line", "string_split(text, chr(10))", (10, 30), (2000, 10_000)))
_stat_query("line_stats_full", lambda c: stats.line_stats(c, ignore_empty=True), _part_sql("line", "list_filter(string_split(text, chr(10)), lambda x: length(x) > 0)", (10, 30), (2000, 10_000)))
_stat_query("paragraph_stats", stats.paragraph_stats, _part_sql("paragraph", "string_split(text, chr(10) || chr(10))", (100,), (1000,)))
_stat_query("sentence_stats", stats.sentence_stats, _part_sql("sentence", "list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: length(x) > 0)", (20,), (75,), repeats=False))


@query("selected_stats", "SELECT p.*, l.* EXCLUDE (doc_id) FROM (" + _part_sql("paragraph", "string_split(text, chr(10) || chr(10))", (50,), (1000,)) + ") p JOIN (" + _part_sql("line", "string_split(text, chr(10))", (10, 30), (2000, 10_000)) + ") l USING (doc_id)")
def selected_stats(s, sf):
    columns = stats.selected_stats(F.col("text"), {"paragraph": {"short": (50,)}, "line": {}})
    return _rounded(_docs(s, sf).select("doc_id", *[c.alias(k) for k, c in columns.items()]))


@query("change_metrics", f"WITH a AS (SELECT doc_id, {_found(rules.ARTEFACTS)} FROM documents), w AS (SELECT doc_id, length(d.text) AS x, length(a.text) AS y, len(regexp_extract_all(d.text, '\\S+')) AS u, len(regexp_extract_all(a.text, '\\S+')) AS v FROM documents d JOIN a USING (doc_id)) SELECT doc_id, CAST(x AS INTEGER) AS original_length, CAST(y AS INTEGER) AS cleaned_length, CAST(x - y AS INTEGER) AS length_reduction, round(CASE WHEN x > 0 THEN (x - y) / x ELSE 0 END, 6) AS length_reduction_ratio, CAST(u AS INTEGER) AS original_words, CAST(v AS INTEGER) AS cleaned_words, CAST(u - v AS INTEGER) AS word_reduction, round(CASE WHEN u > 0 THEN (u - v) / u ELSE 0 END, 6) AS word_reduction_ratio FROM w")
def change_metrics(s, sf):
    from ..operators.citations import change_metrics as metrics

    both = cleaning.remove_patterns(_docs(s, sf).select("doc_id", F.col("text").alias("raw"), "text"), rules.ARTEFACTS)
    return _rounded(both.select("doc_id", *[c.alias(k) for k, c in metrics(F.col("raw"), F.col("text")).items()]))


@query("line_top_docs", _LINES + ", c AS (SELECT doc_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, 'combined', count(*) FROM r WHERE reason IS NOT NULL GROUP BY ALL) SELECT reason, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY n DESC, doc_id) AS k FROM c) WHERE k <= 50")
def line_top_docs(s, sf):
    from pyspark.sql import Window

    found = _docs(s, sf).select("doc_id", F.explode(F.filter(cleaning.line_reasons(F.col("text")), lambda x: x["reason"].isNotNull())).alias("l"))
    each = found.groupBy("doc_id", F.col("l.reason").alias("reason")).agg(F.count("*").alias("n"))
    both = each.unionByName(each.groupBy("doc_id").agg(F.sum("n").alias("n")).withColumn("reason", F.lit("combined")))
    w = Window.partitionBy("reason").orderBy(F.desc("n"), "doc_id")
    return both.withColumn("k", F.row_number().over(w)).where("k <= 50").select("reason", "doc_id", "n")


@query("debug_lines", _LINES + "SELECT doc_id, coalesce(string_agg(CASE WHEN reason IS NULL THEN line ELSE '[DEBUG:lines:' || reason || ']' END, chr(10) ORDER BY i), '') AS text FROM r GROUP BY doc_id")
def debug_lines(s, sf):
    return _docs(s, sf).select("doc_id", cleaning.clean_lines(F.col("text"), debug=True).alias("text"))


@query("recovery_report", f"WITH d AS (SELECT {_unit('score', 'doc_id')} AS score FROM documents) SELECT count(*) AS n, count(*) FILTER (score >= 0.7 AND score < 0.75) AS recovered, count(*) FILTER (score >= 0.75) AS too_high, count(*) FILTER (score < 0.7) AS too_low FROM d")
def recovery_report(s, sf):
    return cleaning.recovery_report(_docs(s, sf).withColumn("score", splits.hash_unit("score", F.col("doc_id"))), "score")


@query("language_report", f"WITH d AS (SELECT doc_id, {_unit('score', 'doc_id')} AS score FROM documents) SELECT * FROM (SELECT doc_id, score, 'removed' AS side FROM d WHERE score < 0.75 ORDER BY score DESC, doc_id LIMIT 20) UNION ALL SELECT * FROM (SELECT doc_id, score, 'kept' AS side FROM d WHERE score >= 0.75 ORDER BY score, doc_id LIMIT 20)")
def language_report(s, sf):
    return stats.language_report(_docs(s, sf).withColumn("score", splits.hash_unit("score", F.col("doc_id"))), "score")


@query("char_sums", f"SELECT split, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents JOIN ({_SPLIT}) USING (doc_id) GROUP BY split")
def char_sums(s, sf):
    return splits.char_sums(_docs(s, sf).join(_split(s, sf), "doc_id"), "split")


@query("split_samples", " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, split FROM ({_SPLIT}) WHERE split = '{n}' ORDER BY {_unit(str(5 + splits.SPLIT_SEEDS[n]), 'doc_id')}, doc_id LIMIT {k})" for n, k in (("train", 50), ("val", 5), ("test", 7))))
def split_samples(s, sf):
    return splits.split_samples(_split(s, sf), {"train": 50, "val": 5, "test": 7}, 5).select("doc_id", "split")


@query("char_budget_split", f"SELECT doc_id, CASE WHEN {_unit('4', 'doc_id')} < 0.8 THEN 'train' WHEN {_unit('4', 'doc_id')} < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM documents WHERE {_unit('9', 'doc_id')} < 300000 / (SELECT sum(length(text))::DOUBLE FROM documents)")
def char_budget_split(s, sf):
    return splits.ratio_budget_split(_docs(s, sf), 300_000, 9, 4, 0.8, 0.1, 0.1).select("doc_id", "split")


def _left(*tables: str) -> str:
    return "(SELECT * FROM documents WHERE " + " AND ".join(f"doc_id NOT IN (SELECT doc_id FROM {t}picked)" for t in tables) + ")"


@query("char_budget_splits", f"WITH RECURSIVE {_fold('documents', 20_000, 6 + 101, 'v')}, {_fold(_left('v'), 20_000, 6 + 202, 'x')}, {_fold(_left('v', 'x'), 60_000, 6 + 303, 'r')} SELECT *, 'val' AS split FROM vpicked UNION ALL SELECT *, 'test' FROM xpicked UNION ALL SELECT *, 'train' FROM rpicked")
def char_budget_splits(s, sf):
    return splits.budget_splits(_docs(s, sf), {"train": 60_000, "val": 20_000, "test": 20_000}, 6)


@query("train_val_split", f"SELECT doc_id, CASE WHEN i < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY {_unit('42', 'doc_id')}, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)")
def train_val_split(s, sf):
    return splits.train_val_split(_docs(s, sf).select("doc_id"), 0.9)


@query("resumed_positions", f"SELECT doc_id, position, CAST(floor((((position - 48) % m) + m) % m / 4) AS BIGINT) AS turn FROM (SELECT doc_id, row_number() OVER (ORDER BY {_unit('3', 'doc_id')}, doc_id) - 1 AS position, count(*) OVER () // 4 * 4 AS m FROM documents) WHERE position % 4 = 1 AND position < m")
def resumed_positions(s, sf):
    length = _docs(s, sf).count() // 4 * 4  # what the ranks go round: the incomplete last round is dropped
    start = 0 if not length else splits.restore_sampler(splits.sampler_state(3, length, splits.resume_position(3, 4, 4, 1, length)["position"]), 3, length)
    return splits.resumed_positions(_docs(s, sf).select("doc_id"), 3, 1, 4, start)


@query("sampler_batches", f"SELECT doc_id, CAST(position // 32 AS BIGINT) AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY {_unit('3', 'doc_id')}, doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) WHERE position // 32 < n // 32")
def sampler_batches(s, sf):
    docs = _docs(s, sf).select("doc_id")
    placed = splits.global_index(docs.withColumn("h", splits.hash_unit(3, F.col("doc_id"))), "h", "doc_id", name="position")
    return splits.batches(placed, 32, "position", docs.count()).select("doc_id", "batch")


@query("subsplit_report", f"SELECT split, count(*) AS docs, CAST(sum(b) AS BIGINT) AS bytes, round(sum(b) / 1073741824, 4) AS gib, count(*) AS docs_seen, CAST(sum(t) AS BIGINT) AS tokens, CAST(min(t) AS INTEGER) AS least, CAST(max(t) AS INTEGER) AS most, round(avg(t), 6) AS mean FROM (SELECT split, strlen(text) AS b, len(regexp_extract_all(text, '\\S+')) AS t FROM documents JOIN ({_SPLIT}) USING (doc_id)) GROUP BY split")
def subsplit_report(s, sf):
    docs = _docs(s, sf).join(_split(s, sf), "doc_id").withColumn("tokens", cleaning.word_count(F.col("text")))
    return _rounded(splits.subsplit_report(docs))


@query("split_conflicts", f"SELECT doc_id, count(DISTINCT split) AS n_splits FROM (SELECT doc_id, split FROM ({_SPLIT}) UNION ALL SELECT doc_id, 'train' FROM documents WHERE doc_id % 3 = 0) GROUP BY doc_id HAVING count(DISTINCT split) > 1")
def split_conflicts(s, sf):
    m = _split(s, sf).select("doc_id", "split")
    return splits.conflicts(m.unionByName(m.where("doc_id % 3 = 0").withColumn("split", F.lit("train"))))


@query("split_summary", f"SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_SPLIT}) GROUP BY split")
def split_summary(s, sf):
    return _rounded(corpus.split_summary(_split(s, sf)))


@query("excluded_docs", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_SPLIT}) WHERE split = 'val')")
def excluded_docs(s, sf):
    return splits.excluded(_docs(s, sf).select("doc_id"), _split(s, sf).where("split = 'val'"))


_NORMAL = "CASE WHEN lower(regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')) IN ('', 'none', 'null', 'nan') THEN '' ELSE regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g') END"


@query("document_ids", "WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ABC' || doc_id || ' ' WHEN doc_id % 5 = 1 THEN 'None' END AS m, CASE WHEN doc_id % 3 = 0 THEN 'a.zip' ELSE ' nan ' END AS z, CASE WHEN doc_id % 2 = 0 THEN '10.1/X' || doc_id END AS d, CASE WHEN doc_id % 7 < 5 THEN lang END AS p FROM documents), n AS (SELECT doc_id, " + ", ".join(f"{_NORMAL.format(c)} AS {c}" for c in "mzdp") + " FROM v) SELECT doc_id, CASE WHEN m <> '' THEN 'md5:' || lower(m) WHEN z <> '' THEN 'zip:' || z WHEN d <> '' THEN 'doi:' || lower(d) WHEN p <> '' THEN 'src:' || p || '::row:' || doc_id ELSE 'file:x::row:' || doc_id END AS name FROM n")
def document_ids(s, sf):
    i = F.col("doc_id")
    m = F.when(i % 5 == 0, F.concat(F.lit(" ABC"), i.cast("string"), F.lit(" "))).when(i % 5 == 1, "None")
    z, d = F.when(i % 3 == 0, "a.zip").otherwise(" nan "), F.when(i % 2 == 0, F.concat(F.lit("10.1/X"), i.cast("string")))
    return _docs(s, sf).select("doc_id", splits.document_id(m, z, d, F.when(i % 7 < 5, F.col("lang")), F.lit("x"), i).alias("name"))


@query("stats_report", f"WITH d AS (SELECT doc_id, {_unit('score', 'doc_id')} AS score FROM documents) SELECT count(*) AS n, min(score) AS lowest, max(score) AS highest, round(avg(score), 6) AS mean, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM d ORDER BY doc_id LIMIT 20)) AS samples FROM d")
def stats_report(s, sf):
    out = corpus.stats_report(_docs(s, sf).withColumn("score", splits.hash_unit("score", F.col("doc_id"))), "score")
    return out.select("n", "lowest", "highest", F.round("mean", 6).alias("mean"), F.array_join(F.transform("samples", lambda x: x["id"].cast("string")), ",").alias("samples"))


@query("normaliser_top", "WITH n AS (SELECT doc_id, length(text) AS a, length(regexp_replace(regexp_replace(text, '[\\s\u00a0]+', ' ', 'g'), '^ +| +$', '', 'g')) AS b FROM documents) SELECT doc_id, CAST(a - b AS INTEGER) AS reduction FROM n ORDER BY a - b DESC, doc_id LIMIT 20")
def normaliser_top(s, sf):
    cut = _docs(s, sf).select("doc_id", (F.length("text") - F.length(windows.normalize_window_text(F.col("text")))).alias("reduction"))
    return cut.orderBy(F.desc("reduction"), "doc_id").limit(20)


@query("eval_improved", _EV + ", b AS (SELECT subject, acc FROM e WHERE model = 'src0'), m AS (SELECT e.model, avg(e.acc - b.acc) AS d FROM e JOIN b USING (subject) GROUP BY 1) SELECT model, round(d, 6) AS mean_delta, CASE WHEN d > 0 THEN 'improved' ELSE 'regressed' END AS side FROM m")
def eval_improved(s, sf):
    e = _ev(s, sf)
    b = e.where("model = 'src0'").select("subject", F.col("acc").alias("b"))
    return _rounded(evals.improved(e.join(b, "subject").withColumn("delta", F.col("acc") - F.col("b")), "model", "delta"))


@query("eval_all_subjects", _EV + "SELECT DISTINCT subject FROM e WHERE model IN ('src0', 'src1')")
def eval_all_subjects(s, sf):
    e = _ev(s, sf)
    return evals.all_names(e.where("model = 'src0'"), e.where("model = 'src1'"), name="subject")


@query("eval_common_subjects", _EV + "SELECT subject FROM e WHERE model = 'src0' INTERSECT SELECT subject FROM e WHERE model = 'src1' AND acc > 0.5")
def eval_common_subjects(s, sf):
    e = _ev(s, sf)
    return evals.common_names(e.where("model = 'src0'"), e.where("model = 'src1' and acc > 0.5"), name="subject")


@query("eval_baseline_average", _EV + "SELECT e.model, e.subject, round(e.acc, 6) AS acc, round(coalesce(b.acc, 0.25), 6) AS baseline FROM e LEFT JOIN (SELECT subject, avg(acc) AS acc FROM e WHERE model = 'src0' AND subject <> 'fr' GROUP BY 1) b USING (subject)")
def eval_baseline_average(s, sf):
    e = _ev(s, sf)
    return _rounded(evals.baseline_average(e, e.where("model = 'src0' and subject <> 'fr'"), "subject", "acc").select("model", "subject", "acc", "baseline"))


@query("eval_aliases", _EV + "SELECT model, CASE subject WHEN 'de' THEN 'german' WHEN 'en' THEN 'english' ELSE subject END AS subject, n FROM e")
def eval_aliases(s, sf):
    return evals.by_alias(_ev(s, sf), "subject", {"de": "german", "en": "english"}).select("model", "subject", "n")


@query("eval_matrix", _EV + "SELECT subject, " + ", ".join(f"round(avg(acc) FILTER (model = 'src{k}'), 6) AS src{k}" for k in range(3)) + " FROM e WHERE model IN ('src0', 'src1', 'src2') GROUP BY subject")
def eval_matrix(s, sf):
    return _rounded(evals.ordered_matrix(_ev(s, sf).where("model in ('src0', 'src1', 'src2')"), "subject", "model", "acc"))


@query("eval_measures", _EV + "SELECT subject, " + ", ".join(f"round(coalesce(max({m}) FILTER (model = 'src{k}'), 0), 6) AS src{k}_{m}" for k in (1, 2) for m in ("acc", "half")) + " FROM (SELECT *, acc / 2 AS half FROM e) GROUP BY subject")
def eval_measures(s, sf):
    return _rounded(evals.measures_table(_ev(s, sf).withColumn("half", F.col("acc") / 2), "subject", "model", ["acc", "half"], ["src1", "src2"]))


@query("eval_best_rows", _EV + "SELECT model, round(avg(acc), 6) AS mean FROM e GROUP BY model ORDER BY avg(acc) DESC NULLS LAST, model LIMIT 5")
def eval_best_rows(s, sf):
    return _rounded(evals.best_rows(_ev(s, sf), "model", "acc", 5))


@query("eval_status", _EV + "SELECT model, round(avg(acc) FILTER (subject IN ('de', 'en', 'xx')), 6) AS score, count(DISTINCT subject) FILTER (subject IN ('de', 'en', 'xx') AND acc IS NOT NULL) AS tasks, CASE WHEN count(DISTINCT subject) FILTER (subject IN ('de', 'en', 'xx') AND acc IS NOT NULL) > 0 THEN 'partial' ELSE 'failed' END AS status FROM e GROUP BY model")
def eval_status(s, sf):
    return _rounded(evals.result_status(_ev(s, sf), "model", "subject", "acc", "all", ["de", "en", "xx"]))


@query("eval_wide", _EV + "SELECT model, " + ", ".join(f"coalesce(printf('%.4f', max(acc) FILTER (subject = '{t}')), '') AS subtask_{t}" for t in ("de", "xx")) + ", coalesce(printf('%.4f', avg(acc) FILTER (subject IN ('fr', 'es'))), '') AS category_romance FROM e GROUP BY model")
def eval_wide(s, sf):
    return evals.wide_results(_ev(s, sf), "model", "subject", "acc", ["de", "xx"], {"romance": ["fr", "es"]})


_PATHS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/r/step_' || doc_id || 'k/2025-01-02_03-04-05.json' WHEN 1 THEN '/r/best-' || doc_id WHEN 2 THEN '/r/original' ELSE '/r/step-' || doc_id END AS path FROM documents"


def _paths(s, sf) -> DataFrame:
    i = F.col("doc_id")
    n = i.cast("string")
    path = F.when(i % 4 == 0, F.concat(F.lit("/r/step_"), n, F.lit("k/2025-01-02_03-04-05.json"))).when(i % 4 == 1, F.concat(F.lit("/r/best-"), n)).when(i % 4 == 2, "/r/original")
    return _docs(s, sf).select("doc_id", path.otherwise(F.concat(F.lit("/r/step-"), n)).alias("path"))


@query("run_names", f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '2025-01-02 03:04:05' END AS at, CAST(CASE doc_id % 4 WHEN 0 THEN doc_id * 1000 WHEN 3 THEN doc_id ELSE 0 END AS BIGINT) AS step, CASE doc_id % 4 WHEN 1 THEN 'best' WHEN 2 THEN 'baseline' ELSE 'step' END AS kind FROM ({_PATHS})")
def run_names(s, sf):
    p = F.col("path")
    return _paths(s, sf).select("doc_id", F.date_format(evals.run_date(p), "yyyy-MM-dd HH:mm:ss").alias("at"), evals.step_of(p).alias("step"), evals.run_type(p).alias("kind"))


@query("eval_baseline_row", f"SELECT path FROM ({_PATHS}) ORDER BY CASE WHEN lower(path) LIKE '%original%' THEN 0 ELSE 1 END, path LIMIT 1")
def eval_baseline_row(s, sf):
    return evals.baseline_of(_paths(s, sf).withColumn("name", F.col("path")), "name", "path", "path").select("path")


@query("eval_run_types", _EV + "SELECT kind, count(*) AS runs, round(avg(acc), 6) AS mean, round(max(acc), 6) AS best, round(min(acc), 6) AS worst FROM (SELECT *, CASE WHEN model = 'src0' THEN 'baseline' ELSE 'other' END AS kind FROM e) GROUP BY kind")
def eval_run_types(s, sf):
    named = _ev(s, sf).withColumn("kind", evals.run_type(F.when(F.col("model") == "src0", "original").otherwise(F.coalesce("model", F.lit("")))))
    return _rounded(evals.summary_by_type(named, "kind", "acc"))


@query("eval_prefixed", _EV + "SELECT model, substr(k, 6) AS subject, round(acc, 6) AS value FROM (SELECT model, 'mmlu_' || subject AS k, acc FROM e) WHERE k <> 'mmlu_de'")
def eval_prefixed(s, sf):
    maps = _ev(s, sf).groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("mmlu_"), F.col("subject")), "acc"))).alias("m"))
    return _rounded(evals.prefixed(maps.withColumn("m", F.map_concat("m", F.create_map(F.lit("other"), F.lit(1.0)))), "m", "mmlu_", ["mmlu_de"]))


@query("eval_deduplicated", _EV + "SELECT subject, model, round(acc, 6) AS acc FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY model DESC) AS r FROM e WHERE model IS NOT NULL) WHERE r = 1")
def eval_deduplicated(s, sf):
    return _rounded(evals.deduplicate(_ev(s, sf).where("model is not null"), ["subject"], "model").select("subject", "model", "acc"))


@query("eval_priority", _EV + "SELECT model, subject, CAST(CASE subject WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 99 END AS INTEGER) AS place FROM e")
def eval_priority(s, sf):
    return _ev(s, sf).select("model", "subject", evals.priority(F.col("subject"), ["fr", "de"]).alias("place"))


@query("eval_always_better", _EV + ", d AS (SELECT e.model, e.acc - b.acc AS d FROM e JOIN (SELECT subject, min(acc) - 0.01 AS acc FROM e GROUP BY 1) b USING (subject) WHERE e.model IS NOT NULL) SELECT model FROM d GROUP BY model HAVING bool_and(coalesce(d > 0, false))")
def eval_always_better(s, sf):
    e = _ev(s, sf).where("model is not null")
    b = _ev(s, sf).groupBy("subject").agg((F.min("acc") - 0.01).alias("b"))
    return evals.always_better(e.join(b, "subject").withColumn("d", F.col("acc") - F.col("b")), "model", "d")


@query("eval_fuzzy", _EV + "SELECT n.name, min(k.known) AS known FROM (SELECT DISTINCT 'X_' || upper(subject) AS name FROM e) n JOIN (SELECT DISTINCT subject AS known FROM e) k ON contains(lower(n.name), lower(k.known)) OR contains(lower(k.known), lower(n.name)) GROUP BY 1")
def eval_fuzzy(s, sf):
    e = _ev(s, sf)
    return evals.fuzzy_names(e.select(F.concat(F.lit("X_"), F.upper("subject")).alias("name")), e.select(F.col("subject").alias("known")), "name", "known")


@query("span_utilisation", D + ", w AS (SELECT least(568, n - i * 568) AS raw FROM (SELECT len(tokens) AS n, unnest(range(CASE WHEN len(tokens) = 0 THEN 0 ELSE CAST(ceil(len(tokens) / 568.0) AS BIGINT) END)) AS i FROM d)), h AS (SELECT raw, CASE WHEN raw < 2 THEN 0 ELSE least(greatest(CAST(round_even(raw * 0.15, 0) AS BIGINT), 1), raw - 1) END AS hid FROM w), p AS (SELECT raw, hid, CASE WHEN hid = 0 THEN 0 ELSE least(greatest(CAST(round_even(hid / 3.0, 0) AS BIGINT), 1), hid, raw - hid) END AS sp FROM h) SELECT round(avg((raw - hid + sp + 1) / 512.0), 6) AS utilisation, avg((raw - hid + sp + 1) / 512.0) >= 0.9 AS enough FROM p")
def span_utilisation(s, sf):
    ids = _tokens(s, sf).select("doc_id", F.transform("tokens", lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(30_000)).cast("int") + 2).alias("ids"))
    return _rounded(spans.utilisation(spans.corrupted_windows(ids, "doc_id", "ids", 32_100)))


@query("stage_chain", "SELECT doc_id, upper(text) AS text FROM documents WHERE length(text) >= 500 AND lang <> 'de'")
def stage_chain(s, sf):
    config = {"keep": {"test": (F.length("text") >= 500) & (F.col("lang") != "de")}, "column": {"rule": cleaning.simple_upper}, "cleaner": None}
    return stages.built(config)(_docs(s, sf)).select("doc_id", "text")


def _first_line(text: str) -> tuple[str, dict]:
    if not text:
        raise ValueError("no text")
    return text.split("\n", 1)[0], {"n_lines": text.count("\n") + 1}


def _by_words(rows, part):
    for r in rows:
        for at, word in enumerate(r["text"].split(" ")):
            if word:
                yield {"doc_id": r["doc_id"], "place": at, "word": word}


@query("stage_cleaner", "SELECT doc_id, CASE WHEN text <> '' THEN string_split(text, chr(10))[1] END AS text, CASE WHEN text <> '' THEN CAST(len(string_split(text, chr(10))) AS BIGINT) END AS n_lines, CASE WHEN text = '' THEN 'ValueError: no text' END AS error FROM documents WHERE n_chars % 2 = 1")
def stage_cleaner(s, sf):
    odd = stages.filter_stage(lambda r: (r["n_chars"] or 0) % 2 == 1, ["n_chars"])
    return stages.chain(odd, stages.cleaner_stage(_first_line, "n_lines long", errors="error"))(_docs(s, sf)).select("doc_id", "text", "n_lines", "error")


@query("stage_steps", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) WHERE w[i] <> ''")
def stage_steps(s, sf):
    return stages.step_stage(_by_words, "doc_id long, place int, word string")(_docs(s, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
