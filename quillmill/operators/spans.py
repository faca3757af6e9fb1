"""Span corruption: training pairs of a sequence with spans replaced by sentinels, and those spans."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import token_windows


def lengths(raw: int, noise: float, mean_span: float) -> tuple[int, int]:
    """(input, target) lengths with sentinels and an end id, for `raw` tokens."""
    hidden = round(raw * noise)
    spans = round(hidden / mean_span)
    return raw - hidden + spans + 1, hidden + spans + 1


def solve_length(input_length: int, noise: float = 0.15, mean_span: float = 3.0) -> tuple[int, int]:
    """(raw, target): the most raw tokens whose corrupted input fits."""
    raw = input_length
    while lengths(raw + 1, noise, mean_span)[0] <= input_length:
        raw += 1
    return raw, lengths(raw, noise, mean_span)[1]


def noise_mask(n: int, noise: float, mean_span: float, rng: np.random.Generator) -> np.ndarray:
    """True where a token is hidden; spans alternate and the first is kept."""
    if n < 2:
        return np.zeros(n, dtype=bool)
    hidden = min(max(round(n * noise), 1), n - 1)
    spans = min(max(round(hidden / mean_span), 1), hidden, n - hidden)

    def cut(total: int) -> np.ndarray:
        places = np.sort(rng.choice(total - 1, spans - 1, replace=False)) + 1 if spans > 1 else np.zeros(0, dtype=int)
        return np.diff(np.r_[0, places, total])

    both = np.stack([cut(n - hidden), cut(hidden)], axis=1).ravel()
    return np.repeat(np.arange(2 * spans) % 2 == 1, both)


def drawn_spans(n: int, noise: float, mean_span: float, rng: np.random.Generator, most: int = 10) -> np.ndarray:
    """An older mask: spans of Poisson lengths (1 to `most`) at random starts, until the share of noise is hidden."""
    mask, goal = np.zeros(n, dtype=bool), int(n * noise)
    for _ in range(20 * max(1, goal)):
        if mask.sum() >= goal:
            break
        size = int(min(max(1, rng.poisson(mean_span)), most, goal - mask.sum()))
        at = int(rng.integers(0, max(1, n - size + 1)))
        # spans neither meet nor touch
        if not mask[max(0, at - 1) : at + size + 1].any():
            mask[at : at + size] = True
    return mask


def label_mask(labels: Column, pad: int = 0) -> Column:
    """Labels with -100 in place of padding."""
    return F.transform(labels, lambda x: F.when(x == pad, F.lit(-100)).otherwise(x))


def utilisation(df: DataFrame, mask: str = "attention_mask", least: float = 0.90) -> DataFrame:
    """One row: the mean share of positions that aren't padding, and whether it is as high as it should be."""
    share = F.aggregate(mask, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(mask), F.lit(1))
    return df.agg(F.avg(share).alias("utilisation")).withColumn("enough", F.col("utilisation") >= least)


def corrupt(tokens: np.ndarray, mask: np.ndarray, vocab: int, eos: int) -> tuple[list[int], list[int]]:
    """(input, target): each hidden span is one sentinel, counted down from vocab - 1."""

    def side(hide: np.ndarray) -> list[int]:
        first = hide & ~np.r_[False, hide[:-1]]
        out = np.where(first, vocab - np.cumsum(first), tokens)
        return [*out[~hide | first].tolist(), eos]

    return side(mask), side(~mask)


def span_corruption(df: DataFrame, id_col: str, tokens: str, vocab: int, input_length: int = 512, noise: float = 0.15, mean_span: float = 3.0, pad: int = 0, eos: int = 1, seed: int = 42) -> DataFrame:
    """id, input_ids, attention_mask, labels (-100 on padding), decoder_input_ids; the mask is seeded by the id.

    A row is one example: of more tokens than solve_length() the first go in. corrupted_windows() takes whole documents."""
    raw, target = solve_length(input_length, noise, mean_span)

    @F.pandas_udf("struct<input_ids:array<int>,labels:array<int>>")
    def build(ids: pd.Series, rows: pd.Series) -> pd.DataFrame:
        out = []
        for i, row in zip(ids, rows, strict=True):
            t = np.asarray(row, dtype=np.int64)[:raw]
            out.append(corrupt(t, noise_mask(len(t), noise, mean_span, np.random.default_rng([seed, zlib.crc32(str(i).encode())])), vocab, eos))
        return pd.DataFrame({"input_ids": [x for x, _ in out], "labels": [y for _, y in out]})

    made = df.select(F.col(id_col), build(F.col(id_col).cast("string"), F.col(tokens)).alias("r")).select(id_col, "r.*")
    full = lambda c, n, p: F.concat(F.slice(c, 1, n), F.array_repeat(F.lit(p), n - F.least(F.size(c), F.lit(n))))
    shifted = F.concat(F.array(F.lit(pad)), F.slice(full("labels", target, pad), 1, target - 1))
    mask = F.transform(full("input_ids", input_length, pad), lambda x: (x != pad).cast("int"))
    return made.select(id_col, full("input_ids", input_length, pad).alias("input_ids"), mask.alias("attention_mask"), full("labels", target, -100).alias("labels"), shifted.alias("decoder_input_ids"))


def corrupted_windows(df: DataFrame, id_col: str, tokens: str, vocab: int, input_length: int = 512, noise: float = 0.15, mean_span: float = 3.0, **more) -> DataFrame:
    """id, window_idx and the columns of span_corruption() for each window of a document; the masks are seeded by both.

    Windows are as long as an example takes and do not overlap, so each token is in one of them."""
    cut = token_windows(df.select(id_col, tokens), tokens, solve_length(input_length, noise, mean_span)[0], 0.0)
    cut = cut.select(F.struct(F.col(id_col), F.col("window_idx")).alias("__id"), "window")
    return span_corruption(cut, "__id", "window", vocab, input_length, noise, mean_span, **more).select("__id.*", *"input_ids attention_mask labels decoder_input_ids".split())
