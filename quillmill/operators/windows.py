"""Overlapping token windows of a document, as arrays: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def stride(length: int, overlap: float) -> int:
    if not 0 <= overlap < 1 or length < 1:
        raise ValueError("a window needs a length of 1 or more and an overlap from 0 to below 1")
    return max(1, length - int(length * overlap))


def window_count(n: Column, length: int, overlap: float) -> Column:
    return F.when(n <= 0, 0).when(n <= length, 1).otherwise(1 + F.ceil((n - length) / stride(length, overlap))).cast("long")


def legacy_window_count(n: Column, length: int = 512, overlap: int = 256) -> Column:
    return F.greatest(F.lit(1), F.floor((n - overlap) / (length - overlap)) + 1).cast("long")


def window_starts(n: Column, length: int, overlap: float, min_last: int = 0) -> Column:
    """Starts i * stride; if the last window would be shorter than `min_last`, starts spread evenly instead."""
    s, k = stride(length, overlap), window_count(n, length, overlap)
    index = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<long>"))
    fixed = F.transform(index, lambda i: i * s)
    if not min_last:
        return fixed
    spread = F.transform(index, lambda i: F.bround(i * (n - length) / (k - 1)).cast("long"))
    return F.when((k > 1) & (n - (k - 1) * s < min_last), spread).otherwise(fixed)


def token_windows(df: DataFrame, tokens: str, length: int, overlap: float, min_last: int = 0, pad=None) -> DataFrame:
    """A row for each window: window_idx, start_pos, end_pos, window (array), padded to `length` if a pad is given."""
    n = F.size(tokens).cast("long")
    out = df.select("*", F.posexplode(window_starts(n, length, overlap, min_last)).alias("window_idx", "start_pos"))
    window = F.slice(tokens, (F.col("start_pos") + 1).cast("int"), length)
    if pad is not None:
        window = F.concat(window, F.array_repeat(F.lit(pad), length - F.size(window)))
    return out.withColumn("end_pos", F.least(F.col("start_pos") + length, n)).withColumn("window", window)


def normalize_window_text(c: Column) -> Column:
    """No-break spaces and line ends as spaces, runs of white space as one, none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(c, "\u00a0\r\n", "   "), r"(?U)\s+", " "))


def window_metrics(text: Column) -> dict[str, Column]:
    """Shares of a window's characters that are punctuation, neither letters nor digits, and of its letters that are capitals."""
    share = lambda p: F.regexp_count(text, F.lit(p)) / F.greatest(F.length(text), F.lit(1))
    return {
        "punctuation": share(rules.PUNCTUATION),
        "non_alphanumeric": share(r"[^\p{L}\p{Nd}]"),
        "uppercase": F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1)),
    }


def filter_windows(df: DataFrame, text: str, tokens: str, min_tokens: int = 530, min_chars: int = 800, max_punctuation: float = 0.20, max_non_alphanumeric: float = 0.35, max_uppercase: float = 0.15) -> DataFrame:
    """Windows of at least so many tokens (the column `tokens` is a number) and characters whose shares are no higher;
    the limits themselves pass. A null text goes."""
    m = window_metrics(F.col(text))
    enough = (F.col(tokens) >= min_tokens) & (F.length(text) >= min_chars)
    return df.where(enough & (m["punctuation"] <= max_punctuation) & (m["non_alphanumeric"] <= max_non_alphanumeric) & (m["uppercase"] <= max_uppercase))


def window_ids(df: DataFrame, id_col: str, file: str | None = None) -> DataFrame:
    """df with `window_id`, {id}_window_{index}, and the metadata of a window: n_tokens and whether it is the last."""
    last = F.col("window_idx") == F.max("window_idx").over(Window.partitionBy(id_col, *([file] if file else [])))
    return df.withColumns({"window_id": F.concat_ws("_window_", F.col(id_col).cast("string"), F.col("window_idx").cast("string")), "n_tokens": F.size("window"), "is_last": last})
