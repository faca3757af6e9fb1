"""Concatenate and cut: documents end to end in windows of a fixed length.

First pass: every partition encodes its documents, notes for each how many ids stand before it in the partition, and
writes them. The totals of the partitions, one number each, are summed to offsets. Second pass: with its partition's
offset each document knows its place among all ids, and is cut where that place crosses a multiple of the window. No
document is shuffled. Only the last window is shorter.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table
from .tokens import encoder

LENGTH = 4096


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, order: tuple[str, str] | None = None) -> DataFrame:
    """First pass, written: (file, run, doc_id, before, n_tokens, ids: binary).

    A run is what is counted through: a partition, or with `order` (the columns of a file's name and of a row's place
    in it) the rows of one file that follow each other in a partition.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, before, last = encoder(tokenizer), 0, ("", TaskContext.get().partitionId(), None)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(b.column("text").to_pylist())]
            n = [len(x) // enc.dtype.itemsize for x in ids]
            places = zip(b.column("__file").to_pylist(), b.column("__row").to_pylist(), strict=True) if order else itertools.repeat(None, len(n))
            runs, starts = [], []
            for place, k in zip(places, n, strict=True):
                if place and (place[0] != last[0] or place[1] != last[2]):
                    last, before = (place[0], place[1], place[1]), 0
                if place:
                    last = (last[0], last[1], place[1] + 1)
                runs.append(last[:2])
                starts.append(before)
                before += k
            cols = [pa.array([r[0] for r in runs], type=pa.string()), pa.array([r[1] for r in runs], type=pa.int64()), b.column("doc_id"), pa.array(starts, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "run", "doc_id", "before", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = [F.col(order[0]).alias("__file"), F.col(order[1]).cast("long").alias("__row")] if order else []
    return materialize(map_arrow(docs.select("doc_id", "text", *placed), run, f"file string, run bigint, doc_id {kind}, before bigint, n_tokens bigint, ids binary"), "ids")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = 2, keep_ids: bool = False, order: tuple[str, str] | None = None) -> DataFrame:
    """A row for each piece of (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, ids (array of int).

    Documents follow each other as in their partitions, or with `order` by file and place in it. A null or empty text
    is the end id alone. Repeated rows and null ids are documents like others; further columns are
    ignored; an empty table has no pieces.
    """
    first = tokenized(docs, tokenizer, end_id, order)
    totals = first.groupBy("file", "run").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file", "run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    bases = materialize(totals.select("file", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    placed = first.join(bases, ["file", "run"]).select("doc_id", (F.col("base") + F.col("before")).alias("place"), "n_tokens", "ids")

    def cut(batches):
        for b in batches:
            place, n = b.column("place").to_numpy(), b.column("n_tokens").to_numpy()
            raw = b.column("ids").to_pylist()
            pieces = (place + n - 1) // length - place // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = np.repeat(place // length - np.cumsum(pieces) + pieces, pieces) + np.arange(int(pieces.sum()))
            lo, hi = np.maximum(place[row], seq * length), np.minimum((place + n)[row], (seq + 1) * length)
            start = lo - place[row]
            wide = []
            for r, s, k in zip(row.tolist(), start.tolist(), (hi - lo).tolist(), strict=True):
                size = len(raw[r]) // int(n[r])
                wide.append(np.frombuffer(raw[r], dtype=f"<u{size}", count=k, offset=s * size).astype("<u4"))
            cols = [b.column("doc_id").take(pa.array(row)), *map(pa.array, (start, hi - lo)), pa.array([zlib.crc32(x.tobytes()) for x in wide], type=pa.int64()), *map(pa.array, (n[row], seq, lo - seq * length))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                cols.append(pa.array([x.astype(np.int32) for x in wide], type=pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(placed, cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint" + ", ids array<int>" * keep_ids)


def op9_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document; see pack() for odd rows."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_concat_cut": op9_concat_cut}
