"""Every registered query of the engine's own operators, with its DuckDB equivalent."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import citations, cleaning, corpus_cleaning, evals, sections, spans, splits, stats, windows
from ..sources import corpus

QUERIES: dict = {}
ORACLE: dict = {}
D = "WITH d AS (SELECT doc_id, text, lang, source, n_chars, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS tokens FROM documents)"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return corpus.spread(df) if name == "documents" else df


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _q(p: str) -> str:
    """A pattern as DuckDB has it, which knows no possessive repetition and needs none."""
    return "'" + re.sub(r"(?<=[+*}?])\+", "", p).replace("'", "''") + "'"


def _removed(patterns: dict[str, str], text: str = "text") -> str:
    for p in patterns.values():
        text = f"regexp_replace({text}, {_q(p)}, '', 'g')"
    return text


def _unit(seed: str, key: str) -> str:
    return f"(CAST(('0x' || substr(sha1('{seed}:' || {key}), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0)"


def _found(patterns: dict[str, str]) -> str:
    out, text = [], "text"
    for n, p in patterns.items():
        out.append(f"CAST(len(regexp_extract_all({text}, {_q(p)})) AS BIGINT) AS {n}_found")
        text = f"regexp_replace({text}, {_q(p)}, '', 'g')"
    return ", ".join([*out, f"{text} AS text"])


@query("artefact_clean", f"SELECT doc_id, {_found(rules.ARTEFACTS)} FROM documents")
def artefact_clean(s, sf):
    return cleaning.remove_patterns(_t(s, sf, "documents").select("doc_id", "text"), rules.ARTEFACTS)


@query("citation_clean", f"SELECT doc_id, {_found(rules.CITATIONS)} FROM documents")
def citation_clean(s, sf):
    return cleaning.remove_patterns(_t(s, sf, "documents").select("doc_id", "text"), rules.CITATIONS)


_FOUND = [*rules.ARTEFACTS, *rules.CITATIONS]


def _types(s, sf) -> DataFrame:
    df = cleaning.remove_patterns(_t(s, sf, "documents").select("doc_id", "text"), rules.ARTEFACTS | rules.CITATIONS)
    return df.select("doc_id", F.explode(F.create_map(*[x for n in _FOUND for x in (F.lit(n), F.col(f"{n}_found"))])).alias("type", "n"))


_TYPES = f"WITH c AS (SELECT doc_id, {_found(rules.ARTEFACTS | rules.CITATIONS)} FROM documents), t AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS type, {n}_found AS n FROM c" for n in _FOUND) + ") "


@query("citation_type_totals", _TYPES + "SELECT type, CAST(sum(n) AS BIGINT) AS found, count(*) FILTER (n > 0) AS docs_with FROM t GROUP BY type")
def citation_type_totals(s, sf):
    return _types(s, sf).groupBy("type").agg(F.sum("n").alias("found"), F.count_if(F.col("n") > 0).alias("docs_with"))


@query("citation_distribution", _TYPES + "SELECT type, n, count(*) AS docs FROM t GROUP BY type, n")
def citation_distribution(s, sf):
    return _types(s, sf).groupBy("type", "n").agg(F.count("*").alias("docs"))


@query("top_citation_docs", _TYPES + "SELECT type, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, doc_id) AS r FROM t WHERE n > 0) WHERE r <= 50")
def top_citation_docs(s, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("type").orderBy(F.desc("n"), "doc_id")
    return _types(s, sf).where("n > 0").withColumn("r", F.row_number().over(w)).where("r <= 50").drop("r")


_WS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(^|\\.)[ ]{2,}([A-Z])', '\\1 \\2', 'g'), '(?m)^[ ]+', '', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("whitespace_normalize", f"SELECT doc_id, {_WS} AS clean FROM documents")
def whitespace_normalize(s, sf):
    return _t(s, sf, "documents").select("doc_id", cleaning.normalize_whitespace(F.col("text")).alias("clean"))


@query("norm_change_flags", f"SELECT doc_id, regexp_matches(text, '[ \\t]{{2,}}|\\t') AS multiple_spaces, regexp_matches(text, '\\n{{3,}}') AS multiple_newlines, text <> {_WS} AS changed, CAST(length(text) - length({_WS}) AS INTEGER) AS length_reduction FROM documents")
def norm_change_flags(s, sf):
    return cleaning.whitespace_changes(_t(s, sf, "documents")).select("doc_id", "multiple_spaces", "multiple_newlines", "changed", "length_reduction")


def _symbol_tables(docs: str) -> tuple[str, str, str, str]:
    """The tables of the symbol rules, rule by rule; the last one's name, its text, and the number of single signs."""
    found = []
    invisible = "[" + "".join(k for k, v in rules.SYMBOLS.items() if not v) + "]"
    steps = [(invisible, ""), *rules.CONTENTS.values(), (rules.MANY_DOTS, "..."), (rules.SPACED_DOTS, " ... ")]
    ctes = [f"s0 AS (SELECT doc_id, text AS raw, text AS t, 0 AS n FROM {docs})"]
    for i, (p, r) in enumerate(steps, 1):
        r = r.replace("$1", "\\1")
        ctes.append(f"s{i} AS (SELECT doc_id, raw, regexp_replace(t, {_q(p)}, '{r}', 'g') AS t, n + len(regexp_extract_all(t, {_q(p)})) AS n FROM s{i - 1})")
    text = "t"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for k, v in (rules.LOOKALIKES | {k: v for k, v in rules.SYMBOLS.items() if v}).items():
        text = f"replace({text}, {quoted(k)}, {quoted(v)})"
        found.append(f"(length(t) - length(replace(t, {quoted(k)}, ''))) // {len(k)}")
    return ", ".join(ctes), f"s{len(steps)}", text, " + ".join([*found, "length(t) - length(replace(t, '\"', ''))"])


def _symbols() -> str:
    """The normalised text and the number of matches."""
    ctes, last, text, marks = _symbol_tables("documents")
    return f"WITH {ctes} SELECT doc_id, {text} AS clean, CAST(CASE WHEN raw <> {text} THEN n + {marks} ELSE 0 END AS BIGINT) AS n FROM {last}"


@query("symbol_normalize", _symbols())
def symbol_normalize(s, sf):
    both = cleaning.symbols(F.col("text"))
    return _t(s, sf, "documents").select("doc_id", F.explode(F.array(both)).alias("s")).select("doc_id", F.col("s.text").alias("clean"), "s.n")


def _line_tables(docs: str, p: str = "") -> str:
    """Tables {p}l, {p}f, {p}n and {p}r: the lines of a table's texts with what the line rules say of them."""
    return f"""{p}l AS (
  SELECT doc_id, i, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s, length(line) - length(replace(line, chr(9), '')) AS tabs
  FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM {docs})))
), {p}f AS (
  SELECT doc_id, i, s IN (lag(s, 1) OVER w, lag(s, 2) OVER w, lag(s, 3) OVER w, lag(s, 4) OVER w, lag(s, 5) OVER w) AS again
  FROM {p}l WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), {p}n AS (
  SELECT {p}l.*, coalesce({p}f.again, false) AS again, coalesce(lag(tabs) OVER w, 0) >= 2 OR coalesce(lead(tabs) OVER w, 0) >= 2 AS beside, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) AS words
  FROM {p}l LEFT JOIN {p}f USING (doc_id, i) WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), {p}r AS (
  SELECT *, CASE WHEN s = '' THEN NULL WHEN again THEN 'repetition' WHEN tabs >= 2 AND beside THEN 'tabular'
    WHEN words <= 3 AND length(s) <= 15 AND regexp_matches(s, {_q(rules.SHORT_LINE)}) THEN 'short'
    WHEN regexp_matches(s, {_q(rules.METADATA_KEYWORDS)}) OR (words <= 8 AND regexp_matches(s, {_q(rules.METADATA_CODE)})) OR (regexp_matches(s, {_q(rules.METADATA_CAPS)}) AND length(replace(s, ' ', '')) < 8) THEN 'metadata'
    WHEN regexp_matches(s, {_q(rules.COPYRIGHT)}) THEN 'copyright' END AS reason FROM {p}n
)"""


_LINES = f"WITH {_line_tables('documents')} "


@query("line_reasons", _LINES + "SELECT doc_id, reason, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM r WHERE reason IS NOT NULL GROUP BY doc_id, reason")
def line_reasons(s, sf):
    rows = _t(s, sf, "documents").select("doc_id", F.explode(F.filter(cleaning.line_reasons(F.col("text")), lambda x: x["reason"].isNotNull())).alias("l"))
    return rows.groupBy("doc_id", F.col("l.reason").alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("l.line")).alias("chars"))


@query("fused_line_clean", _LINES + "SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (reason IS NULL), '') AS text FROM r GROUP BY doc_id")
def fused_line_clean(s, sf):
    return _t(s, sf, "documents").select("doc_id", cleaning.clean_lines(F.col("text")).alias("text"))


#: A caption, or a short line of numbers without mathematics.
_CAPTION = f"s <> '' AND (regexp_matches(s, {_q(rules.CAPTION)}) OR (NOT regexp_matches(s, {_q(rules.MATHS)}) AND words BETWEEN 2 AND 5 AND len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: regexp_matches(w, {_q(rules.NUMERIC_WORD)}))) >= 0.6 * words))"


@query("figure_table_lines", _LINES + f"SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT ({_CAPTION})), '') AS text FROM r GROUP BY doc_id")
def figure_table_lines(s, sf):
    return _t(s, sf, "documents").select("doc_id", cleaning.figure_lines(F.col("text")).alias("text"))


def _cited(s, sf) -> DataFrame:
    """The documents, with lines at their ends that hold citations of each verdict, as the invented prose has few."""
    n = F.pmod("doc_id", F.lit(90)).cast("string")
    lines = F.concat(F.lit("\nas in ref "), n, F.lit(" the\nAnn; Bob; the\nits page "), n, F.lit(" is one\nso:\n("), n, F.lit(") one"))
    return _t(s, sf, "documents").select("doc_id", F.concat("text", lines).alias("text"))


def _scan(s, sf, docs: DataFrame | None = None, **options) -> DataFrame:
    return citations.scan_citations(_t(s, sf, "documents").select("doc_id", "text") if docs is None else docs, **options)


@query("citation_validated")
def citation_validated(s, sf):
    return _scan(s, sf).select("doc_id", "text", F.size("matches").alias("n_matches"), F.size(F.filter("matches", lambda m: m["accepted"])).alias("n_accepted"))


@query("citation_validated_legacy")
def citation_validated_legacy(s, sf):
    return _scan(s, sf, legacy=True).select("doc_id", "text", F.size("matches").alias("n_matches"), F.size(F.filter("matches", lambda m: m["accepted"])).alias("n_accepted"))


@query("citation_precision")
def citation_precision(s, sf):
    return citations.type_totals(citations.per_document(_scan(s, sf)))


@query("citation_rejections")
def citation_rejections(s, sf):
    return citations.rejected_samples(_scan(s, sf, _cited(s, sf)))


@query("citation_document_totals")
def citation_document_totals(s, sf):
    return citations.document_totals(citations.per_document(_scan(s, sf)))


@query("appendix_sections")
def appendix_sections(s, sf):
    return sections.drop_sections(_t(s, sf, "documents").select("doc_id", "text")).select("doc_id", "text", F.size("sections").alias("n_sections"))


@query("repetition_clean", """WITH RECURSIVE l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
), m AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l), f AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, false AS goes, CAST('' AS VARCHAR) AS line FROM documents
  UNION ALL
  SELECT m.doc_id, m.i, CASE WHEN m.s = '' OR list_contains(f.held, m.s) THEN f.held ELSE list_append(f.held, m.s)[-5:] END,
    m.s <> '' AND list_contains(f.held, m.s) AND NOT regexp_matches(m.s, '^\\[DEBUG:.*\\]$'), m.line
  FROM f JOIN m ON m.doc_id = f.doc_id AND m.i = f.i + 1
) SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i > 0 AND NOT goes), '') AS text FROM f GROUP BY doc_id""")
def repetition_clean(s, sf):
    return sections.drop_repeats(_t(s, sf, "documents").select("doc_id", "text"))


@query("corpus_clean")
def corpus_clean(s, sf):
    return corpus_cleaning.clean_corpus(_t(s, sf, "documents")).select("doc_id", "text")


def _clean_summary() -> str:
    """The whole chain of columns, step by step."""
    ctes, last, text, _ = _symbol_tables("fig")
    chain = f"raw AS (SELECT doc_id, {_removed(rules.ARTEFACTS | rules.CITATIONS)} AS text FROM documents), {_line_tables('raw', 'a')}, "
    chain += "kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (reason IS NULL), '') AS text FROM ar GROUP BY doc_id), "
    chain += f"{_line_tables('kept', 'b')}, fig AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT ({_CAPTION})), '') AS text FROM bn GROUP BY doc_id), "
    chain += f"{ctes}, sym AS (SELECT doc_id, {text} AS text FROM {last}), done AS (SELECT doc_id, {_WS} AS text FROM sym WHERE length({_WS}) > 0) "
    return f"WITH {chain} SELECT lang, count(*) AS docs, CAST(sum(length(documents.text)) AS BIGINT) AS chars_before, CAST(sum(length(done.text)) AS BIGINT) AS chars_after FROM done JOIN documents USING (doc_id) GROUP BY lang"


@query("clean_summary", _clean_summary())
def clean_summary(s, sf):
    docs = _t(s, sf, "documents").withColumn("before", F.length("text"))
    return cleaning.clean_documents(docs).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("before").alias("chars_before"), F.sum(F.length("text")).alias("chars_after"))


def _scored(s, sf) -> DataFrame:
    return _t(s, sf, "documents").withColumn("score", splits.hash_unit("score", F.col("doc_id")))


_SCORED = f"WITH d AS (SELECT *, {_unit('score', 'doc_id')} AS score FROM documents) "


@query("language_gate", _SCORED + "SELECT doc_id FROM d WHERE score >= 0.75")
def language_gate(s, sf):
    return cleaning.language_gate(_scored(s, sf), "score").select("doc_id")


@query("recovery_band", _SCORED + "SELECT doc_id FROM d WHERE score >= 0.7 AND score < 0.75")
def recovery_band(s, sf):
    return cleaning.recovery_band(_scored(s, sf), "score").select("doc_id")


@query("language_score_report", _SCORED + "SELECT count(*) AS n, count(*) FILTER (score >= 0.75) AS kept, count(*) FILTER (score < 0.75) AS removed, CAST(sum(length(text)) FILTER (score >= 0.75) AS BIGINT) AS kept_chars, CAST(sum(length(text)) FILTER (score < 0.75) AS BIGINT) AS removed_chars, round(avg(score), 6) AS mean_score, round(avg(score) FILTER (score >= 0.75), 6) AS mean_kept, round(avg(score) FILTER (score < 0.75), 6) AS mean_removed, min(score) AS lowest, max(score) AS highest FROM d")
def language_score_report(s, sf):
    out = stats.score_report(_scored(s, sf), "score")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "mean_kept", "mean_removed")})


_METRICS = ["length", "n_words", "n_lines", "n_paragraphs", "n_sentences", "type_token_ratio", "short_word_ratio", "long_word_ratio", "short_line_ratio", "long_line_ratio", "short_paragraph_ratio"]
_STATS = D + """, l AS (SELECT *, string_split(text, chr(10)) AS ls, string_split(text, chr(10) || chr(10)) AS ps FROM d), m AS (
  SELECT doc_id, CAST(length(text) AS BIGINT) AS length, CAST(len(tokens) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ps) AS BIGINT) AS n_paragraphs,
    CAST(len(regexp_extract_all(text, '[.!?]+(?:\\s|$)')) AS BIGINT) AS n_sentences, coalesce(len(list_distinct(tokens)) / nullif(len(tokens), 0), 0) AS type_token_ratio,
    coalesce(len(list_filter(tokens, lambda w: length(w) <= 3)) / nullif(len(tokens), 0), 0) AS short_word_ratio, coalesce(len(list_filter(tokens, lambda w: length(w) >= 7)) / nullif(len(tokens), 0), 0) AS long_word_ratio,
    len(list_filter(ls, lambda x: length(x) <= 30)) / len(ls) AS short_line_ratio, len(list_filter(ls, lambda x: length(x) >= 2000)) / len(ls) AS long_line_ratio, len(list_filter(ps, lambda x: length(x) <= 100)) / len(ps) AS short_paragraph_ratio
  FROM l) """


def _stats(s, sf) -> DataFrame:
    return _t(s, sf, "documents").select("doc_id", *[c.alias(k) for k, c in stats.doc_stats(F.col("text")).items()])


@query("doc_stats", _STATS + "SELECT doc_id, length, n_words, n_lines, n_paragraphs, n_sentences, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS[5:]) + " FROM m")
def doc_stats(s, sf):
    return _stats(s, sf).withColumns({m: F.round(m, 6) for m in _METRICS[5:]})


@query("doc_stats_summary", _STATS + " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, round(sum({m})::DOUBLE, 4) AS total, round(min({m})::DOUBLE, 6) AS lowest, round(max({m})::DOUBLE, 6) AS highest, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS deviation FROM m" for m in _METRICS))
def doc_stats_summary(s, sf):
    out = stats.summary(_stats(s, sf), _METRICS)
    return out.withColumn("total", F.round("total", 4)).withColumns({c: F.round(c, 6) for c in ("lowest", "highest", "mean", "deviation")})


@query("doc_stats_histogram", _STATS + "SELECT round(type_token_ratio, 3) AS value, count(*) AS n FROM m GROUP BY 1")
def doc_stats_histogram(s, sf):
    return stats.histogram(_stats(s, sf), "type_token_ratio")


_CHARS = {"white_space_ratio": r"\s", "digit_ratio": r"\p{Nd}", "punctuation_ratio": rules.PUNCTUATION, "non_alpha_digit_ratio": r"[^\p{L}\p{Nd}]"}


@query("char_quality", "SELECT doc_id, CAST(greatest(length(text), 1) AS INTEGER) AS length, " + ", ".join(f"round(len(regexp_extract_all(text, {_q(p)})) / greatest(length(text), 1), 6) AS {n}" for n, p in _CHARS.items()) + ", round(len(regexp_extract_all(text, '\\p{Lu}')) / greatest(len(regexp_extract_all(text, '\\p{L}')), 1), 6) AS uppercase_ratio FROM documents")
def char_quality(s, sf):
    return _t(s, sf, "documents").select("doc_id", *[(c if n == "length" else F.round(c, 6)).alias(n) for n, c in stats.char_quality(F.col("text")).items()])


def _tokens(s, sf) -> DataFrame:
    return _t(s, sf, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("tokens"))


@query("window_starts", D + ", k AS (SELECT doc_id, len(tokens) AS n, CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= 64 THEN 1 ELSE 1 + CAST(ceil((len(tokens) - 64) / 32.0) AS BIGINT) END AS k FROM d) SELECT doc_id, CAST(i AS INTEGER) AS window_idx, CASE WHEN k > 1 AND n - (k - 1) * 32 < 48 THEN CAST(round_even(i * (n - 64) / (k - 1), 0) AS BIGINT) ELSE i * 32 END AS start_pos FROM (SELECT *, unnest(range(k)) AS i FROM k)")
def window_starts(s, sf):
    return windows.token_windows(_tokens(s, sf), "tokens", 64, 0.5, min_last=48).select("doc_id", "window_idx", "start_pos")


@query("token_windows", D + " SELECT doc_id, CAST(i AS INTEGER) AS window_idx, array_to_string(tokens[i * 75 + 1:i * 75 + 100], ' ') AS window, least(i * 75 + 100, len(tokens)) AS end_pos FROM (SELECT *, unnest(range(CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= 100 THEN 1 ELSE 1 + CAST(ceil((len(tokens) - 100) / 75.0) AS BIGINT) END)) AS i FROM d)")
def token_windows(s, sf):
    out = windows.token_windows(_tokens(s, sf), "tokens", 100, 0.25)
    return out.select("doc_id", "window_idx", F.array_join("window", " ").alias("window"), "end_pos")


@query("window_legacy_count", D + " SELECT doc_id, CAST(greatest(1, floor((len(tokens) - 256) / 256.0) + 1) AS BIGINT) AS n FROM d")
def window_legacy_count(s, sf):
    return _tokens(s, sf).select("doc_id", windows.legacy_window_count(F.size("tokens")).alias("n"))


@query("window_run_stats", D + ", k AS (SELECT len(tokens) AS n, CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= 568 THEN 1 ELSE 1 + CAST(ceil((len(tokens) - 568) / 568.0) AS BIGINT) END AS k FROM d) SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(k) AS BIGINT) AS windows, count(*) FILTER (k = 1) AS short_docs, count(*) FILTER (k <> 1) AS long_docs FROM k")
def window_run_stats(s, sf):
    n = F.size("tokens").cast("long")
    k = _tokens(s, sf).select(n.alias("n"), windows.window_count(n, 568, 0.0).alias("k"))
    return k.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("k").alias("windows"), F.count_if(F.col("k") == 1).alias("short_docs"), F.count_if(F.col("k") != 1).alias("long_docs"))


_SPLIT = f"SELECT doc_id, {_unit('42', 'doc_id')} AS u, CASE WHEN {_unit('42', 'doc_id')} < 0.8 THEN 'train' WHEN {_unit('42', 'doc_id')} < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM documents"


def _split(s, sf) -> DataFrame:
    u = splits.hash_unit(42, F.col("doc_id"))
    return _t(s, sf, "documents").select("doc_id", u.alias("u"), splits.split_of(u, 0.8, 0.1, 0.1).alias("split"))


@query("hash_split", _SPLIT)
def hash_split(s, sf):
    return _split(s, sf)


@query("split_manifest_summary", f"SELECT split, count(*) AS n, count(DISTINCT doc_id) AS ids FROM ({_SPLIT}) GROUP BY split")
def split_manifest_summary(s, sf):
    return _split(s, sf).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("materialize_splits", f"SELECT d.doc_id, length(d.text) AS chars, s.split AS doc_split FROM documents d JOIN ({_SPLIT}) s USING (doc_id)")
def materialize_splits(s, sf):
    return splits.materialize_splits(_t(s, sf, "documents"), _split(s, sf)).select("doc_id", F.length("text").cast("long").alias("chars"), "doc_split")


@query("sample_exact_n", f"SELECT doc_id FROM documents ORDER BY {_unit('7', 'doc_id')}, doc_id LIMIT 100")
def sample_exact_n(s, sf):
    return splits.exact_sample(_t(s, sf, "documents"), 100, 7).select("doc_id")


@query("char_budget_ratio", f"SELECT doc_id FROM documents WHERE {_unit('9', 'doc_id')} < 100000 / (SELECT sum(length(text))::DOUBLE FROM documents)")
def char_budget_ratio(s, sf):
    return splits.ratio_budget(_t(s, sf, "documents"), 100_000, 9).select("doc_id")


def _fold(docs: str, budget: int, seed: int, p: str = "") -> str:
    """Tables {p}o, {p}f and {p}picked: a fixed budget as it is told, one document after the other."""
    return f"""{p}o AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, row_number() OVER (ORDER BY {_unit(str(seed), 'doc_id')}, CAST(doc_id AS VARCHAR)) AS i FROM {docs}),
{p}f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, false AS took UNION ALL SELECT {p}o.i, CASE WHEN used + chars <= {budget} THEN used + chars ELSE used END, used + chars <= {budget} FROM {p}f JOIN {p}o ON {p}o.i = {p}f.i + 1),
{p}over AS (SELECT {p}o.* FROM {p}o JOIN {p}f USING (i) WHERE NOT took ORDER BY chars, i LIMIT 1),
{p}picked AS (SELECT doc_id, chars FROM {p}o JOIN {p}f USING (i) WHERE took UNION ALL
  SELECT doc_id, chars FROM {p}over WHERE (SELECT count(*) FROM {p}f WHERE took) = 0 OR (SELECT max(used) FROM {p}f) + chars - {budget} < {budget} - (SELECT max(used) FROM {p}f))"""


@query("char_budget_fixed", f"WITH RECURSIVE {_fold('documents', 100_000, 11)} SELECT * FROM picked")
def char_budget_fixed(s, sf):
    return splits.budget_pick(_t(s, sf, "documents"), 100_000, 11)


@query("shard_assign", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS global_idx, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 8 AS INTEGER) AS shard_id FROM documents")
def shard_assign(s, sf):
    return splits.global_index(_t(s, sf, "documents").select("doc_id"), "doc_id").withColumn("shard_id", splits.shard_of(F.col("global_idx"), 8))


@query("rank_stride", f"SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY {_unit('3', 'doc_id')}, doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) WHERE position % 4 = 1 AND position < n // 4 * 4")
def rank_stride(s, sf):
    return splits.rank_positions(_t(s, sf, "documents").select("doc_id"), 3, 1, 4)


@query("span_corruption")
def span_corruption(s, sf):
    ids = _tokens(s, sf).select("doc_id", F.transform("tokens", lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(30_000)).cast("int") + 2).alias("ids"))
    return spans.corrupted_windows(ids, "doc_id", "ids", 32_100)


_EV = "WITH e AS (SELECT source AS model, lang AS subject, avg(quality) AS acc, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) "


def _ev(s, sf) -> DataFrame:
    return _t(s, sf, "documents").join(_t(s, sf, "labels"), "doc_id").groupBy(F.col("source").alias("model"), F.col("lang").alias("subject")).agg(F.avg("quality").alias("acc"), F.count("*").alias("n"))


@query("eval_best_per_group", _EV + "SELECT model, subject, round(acc, 6) AS acc, n FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY acc DESC, model) AS r FROM e) WHERE r = 1")
def eval_best_per_group(s, sf):
    return evals.best_per_group(_ev(s, sf), "subject", "acc", "model").select("model", "subject", F.round("acc", 6).alias("acc"), "n")


@query("eval_baseline_delta", _EV + "SELECT e.model, e.subject, round(CASE WHEN b.acc > 0 THEN e.acc - b.acc END, 6) AS delta, round(CASE WHEN b.acc > 0 THEN (e.acc - b.acc) / b.acc * 100 END, 6) AS percent FROM e LEFT JOIN (SELECT subject, acc FROM e WHERE model = 'src0') b USING (subject)")
def eval_baseline_delta(s, sf):
    e = _ev(s, sf)
    return evals.against_baseline(e, e.where("model = 'src0'"), ["subject"], "acc").select("model", "subject", F.round("delta", 6).alias("delta"), F.round("percent", 6).alias("percent"))


@query("eval_ranking", _EV + "SELECT model, subject, CAST(row_number() OVER w AS INTEGER) AS rank, round(first_value(acc) OVER w - acc, 6) AS behind_best, round(lag(acc) OVER w - acc, 6) AS behind_previous FROM e WINDOW w AS (PARTITION BY subject ORDER BY acc DESC, model)")
def eval_ranking(s, sf):
    out = evals.ranking(_ev(s, sf), "subject", "acc", "model")
    return out.select("model", "subject", "rank", F.round("behind_best", 6).alias("behind_best"), F.round("behind_previous", 6).alias("behind_previous"))


@query("eval_pivot", _EV + "SELECT model, round(max(acc) FILTER (subject = 'de'), 6) AS de, round(max(acc) FILTER (subject = 'en'), 6) AS en, round(max(acc) FILTER (subject = 'es'), 6) AS es, round(max(acc) FILTER (subject = 'fr'), 6) AS fr FROM e GROUP BY model")
def eval_pivot(s, sf):
    langs = ["de", "en", "es", "fr"]
    return _ev(s, sf).groupBy("model").pivot("subject", langs).agg(F.first("acc")).select("model", *[F.round(c, 6).alias(c) for c in langs])


@query("eval_top_bottom", _EV + ", k AS (SELECT model || '/' || subject AS k, round(acc, 6) AS acc FROM e), t AS (SELECT k, acc, 'top' AS side FROM k ORDER BY acc DESC, k LIMIT 10), b AS (SELECT k, acc, 'bottom' AS side FROM k ORDER BY acc, k LIMIT 10) SELECT * FROM t UNION ALL SELECT * FROM b")
def eval_top_bottom(s, sf):
    e = _ev(s, sf).select(F.concat_ws("/", "model", "subject").alias("k"), F.round("acc", 6).alias("acc"))
    return evals.top_bottom(e, "acc", "k")


@query("eval_thirds", _EV + ", t AS (SELECT subject, acc, CASE WHEN i < n // 3 THEN 'early' WHEN i < 2 * (n // 3) THEN 'middle' ELSE 'late' END AS part FROM (SELECT subject, acc, row_number() OVER (PARTITION BY subject ORDER BY model) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM e)) SELECT subject, round(avg(acc) FILTER (part = 'early'), 6) AS early, round(avg(acc) FILTER (part = 'middle'), 6) AS middle, round(avg(acc) FILTER (part = 'late'), 6) AS late FROM t GROUP BY subject")
def eval_thirds(s, sf):
    out = evals.thirds(_ev(s, sf), "subject", "model", "acc")
    return out.select("subject", *[F.round(c, 6).alias(c) for c in ("early", "middle", "late")])


@query("tokenizer_texts", "SELECT substr(t, 1, 20000) AS text FROM (SELECT regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> ''")
def tokenizer_texts(s, sf):
    from ..sources.corpus import tokenizer_texts as texts

    return texts(_t(s, sf, "documents"))


@query("eval_group_stats", _EV + "SELECT subject, count(acc) AS n, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS std_sample, round(stddev_pop(acc), 6) AS std, round(min(acc), 6) AS worst, round(max(acc), 6) AS best, round(max(acc) - min(acc), 6) AS range FROM e GROUP BY subject")
def eval_group_stats(s, sf):
    out = evals.group_stats(_ev(s, sf), "subject", "acc")
    return out.select("subject", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std_sample", "std", "worst", "best", "range")])


_STEPS = [1000, 2000, 3000]


def _steps(s, sf) -> DataFrame:
    """Scores by subject and a step that a label's id stands for."""
    step = (F.col("doc_id") % 3 + 1) * 1000
    return _t(s, sf, "documents").join(_t(s, sf, "labels"), "doc_id").groupBy(F.col("lang").alias("subject"), step.cast("int").alias("step")).agg(F.avg("quality").alias("acc"))


_ST = "WITH e AS (SELECT lang AS subject, CAST((doc_id % 3 + 1) * 1000 AS INTEGER) AS step, avg(quality) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) "
_CELL = ", ".join(f'round(max(acc) FILTER (step = {n}), 6) AS "{n // 1000}k"' for n in _STEPS)


@query("eval_progression", _ST + f'SELECT subject, {_CELL}, round(avg(acc), 6) AS "AVG" FROM e GROUP BY subject')
def eval_progression(s, sf):
    out = evals.progression(_steps(s, sf), "subject", "step", "acc", _STEPS)
    return out.select("subject", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in out.columns if c != "subject"])


@query("eval_difference_stats", _EV + "SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse, round(count(*) FILTER (d > 0) / count(*), 6) AS share_better, round(max(d), 6) AS highest, round(min(d), 6) AS lowest FROM (SELECT a.acc - b.acc AS d FROM e a JOIN e b USING (subject) WHERE a.model = 'src1' AND b.model = 'src0')")
def eval_difference_stats(s, sf):
    e = _ev(s, sf)
    out = evals.difference_stats(e.where("model = 'src1'"), e.where("model = 'src0'"), ["subject"], "acc")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("eval_category_means", _EV + "SELECT m.model, c.category, round(coalesce(avg(e.acc) FILTER (list_contains(c.parts, e.subject)), 0), 6) AS mean FROM (SELECT DISTINCT model FROM e) m CROSS JOIN (VALUES ('germanic', ['de', 'en']), ('romance', ['fr', 'es']), ('none', ['zz'])) c(category, parts) JOIN e ON e.model IS NOT DISTINCT FROM m.model GROUP BY ALL")
def eval_category_means(s, sf):
    out = evals.category_means(_ev(s, sf).where("model is not null"), "subject", "acc", {"germanic": ["de", "en"], "romance": ["fr", "es"], "none": ["zz"]}, "model")
    return out.withColumn("mean", F.round("mean", 6))


@query("token_count_summary")
def token_count_summary(s, sf):
    import public_tokenizers

    docs = stats.with_token_count(_t(s, sf, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return stats.summary(docs, ["n_tokens"])


from . import more  # noqa: E402, F401  registers its queries here
