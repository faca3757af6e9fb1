"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A shuffle of all rows sends from partition p to place range r a number of rows that follows the multivariate
hypergeometric law. That matrix is drawn from the partitions' row counts alone, by halves: of a set of partitions, the
counts of its first half are drawn given those of the set, from a seed of their own, so a task draws the row of its
partition from the totals on the way to it and nobody holds the matrix. Each partition permutes its rows and deals them
out by its row of the matrix, rows are exchanged once, and each range permutes what it got. Shards are cut into ranges of
places (`cells`), one for each reduce task, so no task holds a whole shard and a row's slot is its range's first place
plus its rank there.

A partition is up to SHEET rows of a file, which any task can name by the place of a row: no row moves to be dealt out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SHEET, Notes, fresh, group_slices, located, materialize, table

SHARDS, SEED = 16, 20260
#: numpy draws from populations below this; a larger one is drawn by its law.
LARGE = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart."""
    return rows // shards + (np.arange(shards) < rows % shards)


def _cells(rows: int, shards: int, per_shard: int) -> np.ndarray:
    return np.concatenate([shard_sizes(int(n), per_shard) for n in shard_sizes(rows, shards)])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws are good. In a large population, the law around its mode: ratios of neighbouring probabilities
    are summed as logarithms over 14 deviations on each side."""
    if not good or not n:
        return 0
    total = good + bad
    if total < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    mode = int((n + 1) * (good + 1) // (total + 2))
    spread = 14 * int(np.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))) + 2)
    lo, hi = max(0, n - bad, mode - spread), min(good, n, mode + spread)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    log = np.r_[0.0, np.cumsum(steps)]
    p = np.cumsum(np.exp(log - log.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def _drawn(rng: np.random.Generator, cells: np.ndarray, n: int) -> np.ndarray:
    """How many of n draws without replacement are of each cell."""
    rest = int(cells.sum())
    if rest < LARGE:
        return rng.multivariate_hypergeometric(cells, n, method="marginals")
    out = np.zeros_like(cells)
    for c, size in enumerate(cells.tolist()):  # one range after the other: the count in it among the places that remain
        rest -= size
        out[c] = k = _hypergeometric(rng, size, rest, n)
        n -= k
    return out


def matrix_row(p: int, totals: list[int], cells: np.ndarray, seed: int) -> np.ndarray:
    """The counts from partition p to the cells; `totals`: the rows of all, of the half that p lies in, and so on to p."""
    have, levels = cells.astype(np.int64), len(totals) - 1
    for k in range(1, levels + 1):
        right = p >> (levels - k) & 1
        parent = (1 << (k - 1)) + (p >> (levels - k + 1))
        first = _drawn(np.random.Generator(np.random.Philox(key=[seed, parent])), have, totals[k - 1] - totals[k] if right else totals[k])
        have = have - first if right else first
    return have


def communication_matrix(parts: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Exact counts from partitions of `parts` rows to ranges of `cells` places, drawn as a uniform shuffle has them."""
    levels = max(0, (len(parts) - 1).bit_length())
    padded = np.zeros(1 << levels, dtype=np.int64)
    padded[: len(parts)] = parts
    sums = [padded.reshape(1 << k, -1).sum(axis=1) for k in range(levels + 1)]
    return np.array([matrix_row(p, [int(sums[k][p >> (levels - k)]) for k in range(levels + 1)], cells, seed) for p in range(len(parts))])


def uniform_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, cells: int | None = None) -> DataFrame:
    """df with `shard` (int) and `slot` (long, gapless from 0 in each shard); columns of these names are replaced.

    Shard sizes differ by one row at most, and every order of the rows is equally likely but for the generator. Nulls,
    empty texts and repeated rows are rows like others; an empty table gives an empty result. Rows are named by their
    places in files (a frame that doesn't read files is written first), so a lost executor changes no assignment, and
    another run over the same files makes the same one. The driver holds two numbers.
    """
    spark = df.sparkSession
    rows, path, row = located(df.drop("shard", "slot"), whole=True)
    kept = [c for c in rows.columns if c not in (path, row)]
    counts = rows.groupBy(F.col(path).alias("path"), F.floor(F.col(row) / SHEET).cast("long").alias("sheet")).agg(F.count("*").alias("n"))
    # a row for each partition
    parts = materialize(counts.withColumn("p", F.row_number().over(Window.orderBy("path", "sheet")).cast("long") - 1), "parts")
    number, n = parts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_shard, levels = max(1, -(-(cells or int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards)), max(0, (number - 1).bit_length())
    # the rows of each half that a partition lies in, from all of them to the partition itself
    level = parts.select("path", "sheet", "p", "n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k")).withColumn("node", F.expr(f"shiftright(p, {levels} - k)"))
    sums = level.groupBy("k", "node").agg(F.sum("n").alias("total"))
    way = level.join(sums, ["k", "node"]).groupBy("path", "sheet", "p").agg(F.array_sort(F.collect_list(F.struct("k", "total"))).alias("way"))
    notes = Notes(way.select("path", "sheet", F.struct("p", F.transform("way", lambda x: x["total"]).alias("totals")).alias("part")), "path", "sheet", "part", "parts")
    known: dict = {}

    def dealt(p: int, totals: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Cell and order of each row of a partition."""
        if p not in known:
            known.clear()
            rng = np.random.Generator(np.random.Philox(key=[seed, (1 << 62) + p]))
            send = matrix_row(p, totals, _cells(n, shards, per_shard), seed)
            cell = rng.permutation(np.repeat(np.arange(len(send), dtype=np.int32), send))
            known[p] = cell, rng.integers(0, 2**63 - 1, len(cell), dtype=np.int64)
        return known[p]

    def assign(part: pa.Array, row: pa.Array) -> pa.Array:
        at, p = row.to_numpy() % SHEET, part.field("p").to_numpy()
        cell, key = np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=np.int64)
        for lo, hi in itertools.pairwise(group_slices([p]).tolist() if len(p) else [0]):
            cells_, keys = dealt(int(p[lo]), part[lo]["totals"].as_py())
            cell[lo:hi], key[lo:hi] = cells_[at[lo:hi]], keys[at[lo:hi]]
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(key)], names=["cell", "key"])

    sheet, to = fresh(rows, "__sheet"), fresh(rows, "__to")
    noted = rows.withColumn(sheet, F.floor(F.col(row) / SHEET).cast("long"))
    noted = noted.withColumn(to, F.arrow_udf(assign, "struct<cell:int,key:bigint>").asNondeterministic()(notes.of(path, sheet), F.col(row)))
    cell = F.col(to)["cell"]
    place = Window.partitionBy(cell).orderBy(F.col(to)["key"], path, row)
    # the first place of a range, by the rule of shard_sizes()
    shard, part = F.floor(cell / per_shard).cast("int"), (cell % per_shard).cast("long")
    size = F.lit(n // shards) + (shard < n % shards).cast("long")
    begin = part * F.floor(size / per_shard) + F.least(part, size % per_shard)
    ranked = noted.withColumn("slot", F.row_number().over(place).cast("long") - 1 + begin)
    return ranked.withColumn("shard", shard).select(*kept, "slot", "shard")


def op10_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place under the law `rows`; a null text has the size 1 and the checksum of nothing."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    done = uniform_shards(slim)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_hypergeometric": op10_hypergeometric}
