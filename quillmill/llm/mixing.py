"""Mixing sources to target weights by a curriculum that changes over training time.

Each source has a weight and a schedule: its rate at training time t in [0, 1], as straight lines between knots. Targets
share all words by weight, limited by a number of epochs. The rate is integrated to the words that the source has given
by time t; a document whose copy begins after c words of its source is due when that integral reaches c, which is the
root of a quadratic in closed form. Copies are sorted by that time over ranges. Words before a document are prefix sums
over ranges of a hash, in two passes, so no task sees a whole source.

Texts take no part in that: mix_documents() works on narrow rows with the places of the documents, notes the times of
each document's copies, and shuffles the texts once, by the partition of the training order that their time lies in.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Notes, discard, fresh, located, materialize, table

WEIGHTS, EPOCHS, SEED = (5.0, 2.0, 1.0), 3, 7
#: Rates at (time, rate) by weight class: strong sources early, weak ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
#: Documents of one range of the hash, on average and at most; there are some ranges for each task at least, so that the
#: ranges of a source with a third of all documents are many and small.
RANGE_ROWS, TASK_RANGES = 20_000, 4
#: Bytes of a partition of the training order; pieces of training time, for each partition, that it is put together from.
PART_BYTES, PIECES = 1 << 27, 16


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) with rank, weight and target: shares of the total by weight, none above `epochs` times its
    source's size, the excess shared again by weight among the rest until none is above.

    With r = epochs * size / weight, the sources that stop are the first in ascending r: those whose r is below the
    level that all later ones then share. So one sorted pass decides what repeated sharing would. Rows are sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * float(epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    later = by_level.rowsBetween(0, Window.unboundedFollowing)
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(later))
    stops = level.withColumn("stops", F.col("cap") / F.col("weight") <= F.col("level"))
    # the level that holds is the one of the first source that doesn't stop
    final = stops.withColumn("at", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    goal = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * F.col("at"))
    return final.select("source", "source_size", "rank", "weight", goal.cast("double").alias("target"))


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """The schedule as (share of the words before, start, end, rate at start, change of rate), rates scaled to integrate to 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if area <= 0 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)) or min(r for _, r in knots) < 0:
        raise ValueError(f"a schedule needs ascending times, rates of 0 or more and some demand: {knots}")
    rows, done = [], 0.0
    for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
        rows.append((done, t0, t1, r0 / area, (r1 - r0) / area / (t1 - t0)))
        done += (t1 - t0) * (r0 + r1) / 2 / area
    names = ("done", "t0", "t1", "rate", "slope")
    return F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])


def due_time(share: Column, segments: Column) -> Column:
    """The time at which the integral of the schedule reaches `share`."""

    def within(s: Column) -> Column:
        need = F.greatest(share - s["done"], F.lit(0.0))
        root = F.sqrt(F.greatest(s["rate"] * s["rate"] + 2 * s["slope"] * need, F.lit(0.0)))
        # 2 need / (rate + root) is the root without cancellation
        step = F.when(s["rate"] + root > 0, 2 * need / (s["rate"] + root)).otherwise(F.lit(0.0))
        return F.least(s["t0"] + step, s["t1"])

    return within(F.element_at(F.filter(segments, lambda s: s["done"] <= share), -1))


def curriculum_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, schedules: Sequence = SCHEDULES, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, source, size: long, order_key: string, ...) with source_size, target, copies, taken and positions.

    `order_key` is a hex hash that orders the documents of a source; `copies` how often the mix takes the document,
    `positions` the times (0 to 1) at which each copy is due. A source's documents go round in the order of the hash
    until its target is reached; the copy at the cut is taken if its middle lies before it. A null source is one
    source, the last. Documents of size 0 are taken in no copy. Null ids, repeated rows and ties of the hash are
    allowed: rows alike share the same places. Further columns go along; those named above are replaced.
    """
    docs = docs.drop("source_size", "target", "copies", "taken", "positions")
    own = docs.withColumn("__range", F.conv(F.substring("order_key", 1, 13), 16, 10).cast("long"))
    own = materialize(own, "mix")
    n = own.count()
    ranges = max(1, -(-n // range_rows), min(n, TASK_RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = own.withColumn("__range", F.floor(F.col("__range") * ranges / float(1 << 52)).cast("int"))
    per_range = materialize(own.groupBy("source", "__range").agg(F.sum("size").alias("words")), "ranges")
    sizes = per_range.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = materialize(targets(sizes, weights, epochs), "targets")
    before = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_range.withColumn("__base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    known = materialize(bases.join(goal, bases.source.eqNullSafe(goal.source)).select(bases.source, "__range", "__base", "source_size", "target", "rank"), "bases")
    a, b = own.alias("a"), known.withColumnRenamed("source", "__s").withColumnRenamed("__range", "__r").alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.__s")) & (F.col("a.__range") == F.col("b.__r"))).drop("__s", "__r")
    inside = Window.partitionBy("source", "__range").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("__base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = joined.withColumn("__begin", at)
    size, total, target = F.col("size"), F.col("source_size"), F.col("target")
    rounds = F.floor(target / F.greatest(total, F.lit(1)))
    rest = target - rounds * total
    extra = (F.col("__begin") + size / 2.0 < rest).cast("long")
    copies = F.when(size > 0, F.least(rounds + extra, F.lit(epochs).cast("long"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * size)
    kinds = F.array(*[_segments(s) for s in schedules])
    segments = F.element_at(kinds, (F.col("rank") % len(schedules) + 1).cast("int"))
    share = lambda k: F.least((F.col("__begin") + k * total) / target, F.lit(1.0))
    due = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: due_time(share(k), segments))
    placed = placed.withColumn("positions", F.when(F.col("copies") > 0, due).otherwise(F.array().cast("array<double>")))
    return placed.drop("__begin", "__base", "__range", "rank")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy with its `position`, sorted by it over ranges: partitions and the rows in them ascend."""
    copies = mixed.withColumn("position", F.explode("positions")).drop("positions")
    keys = ["position", "order_key", "doc_id"]
    return copies.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mix_documents(docs: DataFrame, part_bytes: int = PART_BYTES, **options) -> DataFrame:
    """docs (doc_id, source, text, ...) in training order: a row for each copy that curriculum_mix() takes, its own columns
    unchanged whatever their names. Partitions and the rows in them ascend by the time of the copy, then by id and text.

    A null or blank text has no words and so no copy. An empty table gives an empty result.
    """
    columns = docs.columns
    docs, path, row = located(docs)
    own = docs.select(F.col(path).alias("path"), F.col(row).alias("row"), "doc_id", "source", "text")
    mixed = curriculum_mix(with_order_key(own).withColumn("bytes", F.octet_length("text") + 64).drop("text"), **options)
    due = materialize(mixed.where("copies > 0").select("path", "row", "bytes", "positions"), "due")
    total = due.agg(F.sum(F.col("bytes") * F.size("positions"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    pieces = PIECES * parts
    at = due.select("bytes", F.explode("positions").alias("t")).groupBy(F.least(F.floor(F.col("t") * pieces), F.lit(pieces - 1)).alias("piece")).agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("piece")) - F.col("bytes")
    part = at.select("piece", F.least(F.floor(before / (total or 1) * parts), F.lit(parts - 1)).cast("int").alias("part"))
    first = part.groupBy("part").agg(F.min("piece").alias("piece")).toArrow().sort_by("piece")  # a row for each partition
    bounds, numbers = first.column("piece").to_numpy(), first.column("part").to_numpy().astype(np.int32)

    def dealt(times: pa.Array) -> pa.Array:
        t = times.flatten().to_numpy()
        piece = np.minimum(np.floor(t * pieces), pieces - 1)
        part = numbers[np.searchsorted(bounds, piece, side="right") - 1] if len(t) else np.zeros(0, dtype=np.int32)
        sizes = np.r_[0, np.cumsum(times.value_lengths().fill_null(0).to_numpy())].astype(np.int32)
        copies = pa.StructArray.from_arrays([pa.array(part), pa.array(t)], names=["part", "t"])
        return pa.ListArray.from_arrays(pa.array(sizes), copies)

    notes = Notes(due, "path", "row", "positions", "due")
    discard(due)
    copy = fresh(docs, "__copy")
    texts = docs.withColumn(copy, F.explode(notes.of(path, row, dealt, "array<struct<part:int,t:double>>")))
    placed = texts.repartitionById(parts, F.col(copy)["part"])
    order = [F.col(copy)["t"], F.col("doc_id"), F.xxhash64("text")]
    return placed.sortWithinPartitions(*order).select(columns)


def with_order_key(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with size and order_key; a null text is empty, a null id the empty string."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))))
    return docs.withColumn("size", words("text")).withColumn("order_key", key)


def op7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix, by the time of its first copy; see curriculum_mix() for odd rows."""
    docs = with_order_key(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    mixed = curriculum_mix(docs).withColumn("first_due", F.round(F.get("positions", F.lit(0)), 9))
    sort = mixed.repartitionByRange(F.col("first_due").asc_nulls_last(), "order_key").sortWithinPartitions(F.col("first_due").asc_nulls_last(), "order_key")
    return sort.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_due")


ORACLE = {
    "op7_curriculum": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), r AS (
  SELECT 0 AS step, source, source_size, rank, weight, cap, false AS stopped, (SELECT sum(source_size) FROM w)::DOUBLE AS total FROM w
  UNION ALL
  SELECT step + 1, source, source_size, rank, weight, cap,
         stopped OR weight * (total - coalesce(sum(cap) FILTER (stopped) OVER (), 0)) / nullif(sum(weight) FILTER (NOT stopped) OVER (), 0) > cap, total
  FROM r WHERE step < 40
), t AS (
  SELECT source, source_size, rank,
         CASE WHEN stopped THEN cap ELSE weight * (total - coalesce(sum(cap) FILTER (stopped) OVER (), 0)) / sum(weight) FILTER (NOT stopped) OVER () END AS target
  FROM r WHERE step = 40
), b AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun,
         floor(t.target / greatest(t.source_size, 1)) AS rounds
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN least(rounds + CASE WHEN begun + size / 2.0 < target - rounds * source_size THEN 1 ELSE 0 END, 3) ELSE 0 END AS BIGINT) AS copies,
         least(begun / target, 1.0::DOUBLE) AS share
  FROM b
)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * copies AS taken,
       round(CASE WHEN copies > 0 THEN CASE rank % 3
         WHEN 0 THEN least(2 * share / (1.5 + sqrt(greatest(1.5 * 1.5 - 2 * share, 0))), 1)
         WHEN 1 THEN share
         ELSE CASE WHEN share < 0.25 / 0.875 THEN share * 0.875 / 0.5
                   ELSE 0.5 + 2 * (share - 0.25 / 0.875) / (0.5 / 0.875 + sqrt((0.5 / 0.875) * (0.5 / 0.875) + 2 * (1.5 / 0.875 / 0.5) * (share - 0.25 / 0.875))) END END END, 9) AS first_due
FROM c
"""
}
QUERIES = {"op7_curriculum": op7_curriculum}
