"""Deterministic ids, splits, samples, budgets and shards, all from hashes of ids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_unit(seed: int | str, key: Column) -> Column:
    """The first 64 bits of sha1("{seed}:{key}") as a share of 2^64."""
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def normal_value(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(s).isin("", "none", "null", "nan"), "").otherwise(s)


def document_id(md5: Column, archive: Column, doi: Column, path: Column, file: Column, row: Column) -> Column:
    """The first source that says something names the document."""
    row = row.cast("string")
    m, z, d, p = (normal_value(x) for x in (md5, archive, doi, path))
    return (
        F.when(m != "", F.concat(F.lit("md5:"), F.lower(m)))
        .when(z != "", F.concat(F.lit("zip:"), z))
        .when(d != "", F.concat(F.lit("doi:"), F.lower(d)))
        .when(p != "", F.concat(F.lit("src:"), p, F.lit("::row:"), row))
        .otherwise(F.concat(F.lit("file:"), file, F.lit("::row:"), row))
    )


def check_ratios(*ratios: float) -> None:
    if abs(sum(ratios) - 1) > 1e-9 or min(ratios) < 0:
        raise ValueError(f"ratios must be 0 or more and sum to 1: {ratios}")


def split_of(unit: Column, train: float, val: float, test: float) -> Column:
    check_ratios(train, val, test)
    return F.when(unit < train, "train").when(unit < train + val, "val").otherwise("test")


def conflicts(manifest: DataFrame, id_col: str = "doc_id", split_col: str = "split") -> DataFrame:
    return manifest.groupBy(id_col).agg(F.countDistinct(split_col).alias("n_splits")).where("n_splits > 1")


def materialize_splits(docs: DataFrame, manifest: DataFrame, id_col: str = "doc_id", eager: bool = True) -> DataFrame:
    """docs with doc_split; an id that the manifest lacks, or has twice with different splits, is an error. It is raised
    at once, after one pass over ids alone; or, without `eager`, when the row is read, and no pass is made before."""
    known = manifest.groupBy(F.col(id_col).alias("__id")).agg(F.min("split").alias("doc_split"), F.max("split").alias("__other"))
    join = lambda df: df.join(known, df[id_col] == F.col("__id"), "left")
    missing, twice = F.col("doc_split").isNull(), F.col("doc_split") != F.col("__other")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("a null id"))
    if eager:
        clash = known.where(twice).limit(1).count()
        lost = join(docs.select(id_col)).where(missing).select(name.alias("id")).limit(1).collect()
        if clash:
            raise ValueError("the manifest gives one id different splits")
        if lost:
            raise ValueError(f"the manifest lacks {lost[0]['id']}")
    wrong = F.when(missing, F.raise_error(F.concat(F.lit("the manifest lacks "), name)).cast("string"))
    wrong = wrong.when(twice, F.raise_error(F.concat(F.lit("the manifest gives one id different splits: "), name)).cast("string"))
    return join(docs).withColumn("doc_split", wrong.otherwise(F.col("doc_split"))).drop("__id", "__other")


def exact_sample(df: DataFrame, n: int, seed: int, id_col: str = "doc_id", allow_smaller: bool = True) -> DataFrame:
    """`n` rows without replacement, the ones with the smallest hashes; -1: all. Slim ids are chosen, then joined. Fewer
    rows than asked for are an error unless `allow_smaller`."""
    if n < 0:
        return df
    if not allow_smaller:
        enough(df.limit(n).count(), n, "rows")
    chosen = df.select(id_col).orderBy(hash_unit(seed, F.col(id_col)), id_col).limit(n)
    return df.join(chosen, id_col, "left_semi")


#: What each split adds to a seed, in the order in which splits are drawn.
SPLIT_SEEDS = {"val": 101, "test": 202, "train": 303}


def split_samples(df: DataFrame, sizes: dict[str, int], seed: int, split: str = "split", id_col: str = "doc_id", allow_smaller: bool = False) -> DataFrame:
    """An exact sample of each split, by a seed of its own; -1: all of it."""
    parts = [exact_sample(df.where(F.col(split) == name), n, seed + SPLIT_SEEDS.get(name, 0), id_col, allow_smaller) for name, n in sizes.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def enough(have: float, want: float, what: str, allow_smaller: bool = False) -> None:
    if have < want and not allow_smaller:
        raise ValueError(f"not enough data: {have} {what} where {want} are asked for")


def budget_chars(gigabytes: float | None = None, chars: int | None = None) -> int:
    """A budget in characters from one of its two forms; a gigabyte is 1e9 characters."""
    if (gigabytes is None) == (chars is None):
        raise ValueError("give a budget either in gigabytes or in characters")
    if (gigabytes if chars is None else chars) <= 0:
        raise ValueError("a budget must be above 0")
    return int(round(gigabytes * 1e9)) if chars is None else int(chars)


def char_sums(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """(group, docs, chars) of each group; a null text has none."""
    return df.groupBy(group).agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0).cast("long")).alias("chars"))


def ratio_budget(df: DataFrame, budget: int, seed: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose hash is below the share of the characters that the budget is; one pass for the total."""
    total = df.agg(F.sum(F.length(text)).cast("double")).first()[0] or 0.0
    return df.where(hash_unit(seed, F.col(id_col)) < F.lit(budget / total if total else 1.0))


def global_index(df: DataFrame, *keys: str, partitions: int | None = None, name: str = "global_idx") -> DataFrame:
    """df with each row's place in the order of `keys`, from 0, nulls last: ranges are counted and sorted apart, so no task
    sees all. Spark cuts the ranges of each range shuffle anew, from a sample; so one shuffle of the keys alone tells the
    ranges by their least keys and their counts, and rows are put into them by comparing, never by a partition's number."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(x for k in keys for x in (F.col(k).isNull(), F.col(k)))])
    dealt = df.select(key.alias("least")).repartitionByRange(n, "least").withColumn("p", F.spark_partition_id())
    ranges = dealt.groupBy("p").agg(F.min("least").alias("least"), F.count("*").alias("n"))  # a row for each partition
    ranges = ranges.select(F.struct("least", (F.sum("n").over(Window.orderBy("least")) - F.col("n")).alias("before")).alias("r"))
    table, steps = F.col("__t"), F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(table, lo + s)["least"] <= key, lo + s).otherwise(lo))
    placed = df.withColumn("__t", ranges.agg(F.array_sort(F.collect_list("r"))).scalar()).withColumn("__base", F.get(table, at)["before"]).drop("__t")
    own = F.row_number().over(Window.partitionBy("__base").orderBy(*[F.col(k).asc_nulls_last() for k in keys]))
    return placed.withColumn(name, (F.col("__base") + own - 1).cast("long")).drop("__base")


def shard_of(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards)).cast("int")


def rank_positions(df: DataFrame, seed: int, rank: int, world: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of one rank in a seeded permutation; the incomplete last round is dropped."""
    key = df.withColumn("__h", hash_unit(seed, F.col(id_col)))
    placed = global_index(key, "__h", id_col, name="position").drop("__h")
    whole = df.count() // world * world
    return placed.where((F.col("position") % world == rank) & (F.col("position") < whole))


def ratio_budget_split(df: DataFrame, budget: int, keep_seed: int, split_seed: int, train: float, val: float, test: float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """ratio_budget(), and the split of each document that is kept by a seed of its own."""
    kept = ratio_budget(df, budget, keep_seed, id_col, text)
    return kept.withColumn("split", split_of(hash_unit(split_seed, F.col(id_col)), train, val, test))


#: Ranges of the hash over which sums run.
RANGES = 1024


def _running(df: DataFrame, value: str) -> DataFrame:
    """df (h in 0..1, key, ...) with `upto`, the sum of `value` up to each row in the order of h and key: ranges of h are
    summed apart, then the sums of the ranges, so no task sees all rows."""
    cut = df.withColumn("__r", F.least(F.floor(F.col("h") * RANGES), F.lit(RANGES - 1)))
    bases = cut.groupBy("__r").agg(F.sum(value).alias("__n"))
    bases = bases.select("__r", (F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).alias("__base"))  # a row for each range
    w = Window.partitionBy("__r").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(bases, "__r").withColumn("upto", F.col("__base") + F.sum(value).over(w)).drop("__r", "__base")


def budget_pick(df: DataFrame, budget: int, seed: int, id_col: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """(id, chars) of a fixed budget: by hash, take what fits, skip what doesn't, and add the smallest overshoot if that
    comes closer; never empty. Rows are named by `key`, the id unless another column is given, which must be unique.

    All up to the first document that doesn't fit is taken at once, by sums over ranges of the hash. What follows is
    smaller than the rest of the budget or never fits, so a round sees fewer and smaller documents than the one before
    it. The driver holds a few numbers for each round.
    """
    named = df.select(F.col(id_col), F.col(key or id_col).cast("string").alias("key"), F.length(text).cast("long").alias("chars"))
    slim = named.select(id_col, "key", hash_unit(seed, F.col("key")).alias("h"), F.coalesce("chars", F.lit(0)).alias("chars"))
    place, left, last, taken = F.struct("h", "key"), budget, None, F.lit(False)
    slim = slim.persist()  # numbers and ids: the texts are read once
    while True:
        after = slim if last is None else slim.where(place > last)
        sums = _running(after.where(F.col("chars") <= left), "chars")
        stop = sums.agg(F.min(F.when(F.col("upto") > left, place)).alias("s")).first()["s"]
        # a document too large for the rest of the budget stops no one: it is skipped, as all like it are
        fits = F.col("chars") <= left
        if last is not None:
            fits = fits & (place > last)
        if stop is not None:
            fits = fits & (place < F.struct(F.lit(stop["h"]).alias("h"), F.lit(stop["key"]).alias("key")))
        taken = taken | fits
        left -= slim.where(fits).agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
        if stop is None:
            break
        last = F.struct(F.lit(stop["h"]).alias("h"), F.lit(stop["key"]).alias("key"))
    over = slim.where(~taken).agg(F.min(F.struct("chars", "h", "key")).alias("o")).first()["o"]
    if over is not None and (slim.where(taken).isEmpty() or over["chars"] - left < left):
        taken = taken | (F.col("key") == F.lit(over["key"]))
    slim.unpersist()
    return slim.where(taken).select(id_col, "chars")


def budget_splits(df: DataFrame, budgets: dict[str, int], seed: int, id_col: str = "doc_id", text: str = "text", allow_smaller: bool = False) -> DataFrame:
    """(id, chars, split): a fixed budget for val, then test, then train, each by a seed of its own and without the
    documents that an earlier one has taken; ids must be unique."""
    total = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    enough(total, sum(budgets.values()), "characters", allow_smaller)
    left, out = df, None
    for name in [n for n in SPLIT_SEEDS if n in budgets]:
        part = budget_pick(left, budgets[name], seed + SPLIT_SEEDS[name], id_col, text).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
        left = left.join(part.select(id_col), id_col, "left_anti")
    return out


def excluded(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df without the ids of another table."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti")


def train_val_split(df: DataFrame, ratio: float, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """df with `part`: the first int(n * ratio) rows in the order of the hash are train, the rest val."""
    placed = global_index(df.withColumn("__h", hash_unit(seed, F.col(id_col))), "__h", id_col, name="__i").drop("__h")
    return placed.withColumn("part", F.when(F.col("__i") < int(df.count() * ratio), "train").otherwise("val")).drop("__i")


def resume_position(steps: int, batch: int, world: int, accumulate: int, length: int) -> dict[str, float]:
    """Where training goes on after so many steps: samples seen, the place in the data, epochs done and the coverage in percent."""
    if min(steps, batch, world, accumulate) < 0 or length < 1:
        raise ValueError("steps and sizes are 0 or more, and there is some data")
    seen = steps * batch * world * accumulate
    return {"seen": seen, "position": seen % length, "epochs": seen // length, "coverage": 100.0 * seen / length}


def sampler_state(seed: int, length: int, position: int) -> str:
    return json.dumps({"seed": seed, "length": length, "position": position}, sort_keys=True)


def restore_sampler(state: str, seed: int, length: int) -> int:
    """The position of a saved state; seed and length must be those of now, ranks may have changed."""
    got = json.loads(state)
    if (got["seed"], got["length"]) != (seed, length):
        raise ValueError(f"the state is of seed {got['seed']} and {got['length']} rows, not of {seed} and {length}")
    return got["position"]


def resumed_positions(df: DataFrame, seed: int, rank: int, world: int, start: int = 0, id_col: str = "doc_id") -> DataFrame:
    """rank_positions() from the global place `start` on, round the end: `turn` is the place in the rank's own order."""
    whole = df.count() // world * world
    out = rank_positions(df, seed, rank, world, id_col)
    ahead = F.pmod(F.col("position") - F.lit(start), F.lit(max(1, whole)))
    return out.withColumn("turn", F.floor(ahead / world).cast("long"))


def batches(df: DataFrame, size: int, position: str, rows: int, drop_last: bool = True) -> DataFrame:
    """df with the number of its batch in the order of `position` (from 0, gapless, `rows` of them); an incomplete last
    batch goes with `drop_last`."""
    out = df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))
    return out.where(F.col("batch") < rows // size) if drop_last else out


def subsplit_report(df: DataFrame, split: str = "split", tokens: str = "tokens", text: str = "text", sample: int | None = None) -> DataFrame:
    """(split, docs, bytes, gib, docs_seen, tokens, least, most, mean): tokens are counted over all rows, none (0) or the
    first `sample` by hash; `tokens` is a column of numbers."""
    size = F.octet_length(text).cast("long")
    base = df.groupBy(split).agg(F.count("*").alias("docs"), F.sum(size).alias("bytes"))
    some = df if sample is None else df.withColumn("__n", F.row_number().over(Window.partitionBy(split).orderBy(F.xxhash64(text), text))).where(F.col("__n") <= sample)
    seen = some.groupBy(F.col(split).alias("__s")).agg(F.count("*").alias("docs_seen"), F.sum(tokens).alias("tokens"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.avg(tokens).alias("mean"))
    return base.join(seen, F.col(split) == F.col("__s"), "left").select(split, "docs", "bytes", gib(F.col("bytes")).alias("gib"), F.coalesce("docs_seen", F.lit(0)).alias("docs_seen"), "tokens", "least", "most", "mean")


def gib(size: Column) -> Column:
    return F.round(size / 1073741824, 4)
