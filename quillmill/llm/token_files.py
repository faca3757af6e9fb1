"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by ranges of doc_id and sorted. Each task writes files of its own: record batches of one column
`ids` (fixed-size list of unsigned 16-bit integers, 32-bit for larger vocabularies) and one column `mask` (fixed-size
list of booleans, false on padding). All batches of a file hold the same number of sequences but the last, so sequence i
is row i % per_batch of batch i // per_batch, and a memory map gives it without a copy. Beside each file stands an index
(doc_id, start, n_tokens) of its documents. A file has a bounded size; its last sequence is padded.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, map_arrow, materialize, scratch_path, table
from .tokens import encoder

#: Ids of a sequence, sequences of a batch, and ids of a file after which the next one starts.
SEQUENCE, PER_BATCH, FILE_IDS = 2048, 512, 1 << 25
MANIFEST = "part int, file int, path string, n_docs bigint, n_tokens bigint"


class _File:
    """One file of sequences with its index, written under a name of its own and then renamed: a task that is run
    again, or twice at once, leaves whole files only."""

    def __init__(self, root: str, part: int, number: int, dtype: np.dtype, length: int, per_batch: int):
        self.fs, self.path = filesystem(f"{root}/part-{part:06d}-{number:04d}.arrow")
        self.uri = f"{root}/part-{part:06d}-{number:04d}.arrow"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.length, self.per_batch, self.dtype = length, per_batch, dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"per_batch": str(per_batch)})
        self.temp = f"{self.path}.{uuid.uuid4().hex}"
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.n = 0
        self.docs: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.held.append(ids)
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= self.length * self.per_batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, dtype=self.dtype)
        whole = self.length * self.per_batch
        at = 0
        while len(flat) - at >= whole or (last and at < len(flat)):
            piece = flat[at : at + whole]
            at += len(piece)
            rows = -(-len(piece) // self.length)
            mask = np.arange(rows * self.length) < len(piece)
            ids = np.zeros(rows * self.length, dtype=self.dtype)
            ids[: len(piece)] = piece
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.held, self.waiting = [flat[at:]], len(flat) - at

    def close(self, id_type: pa.DataType) -> tuple[str, int, int]:
        self._flush(True)
        self.out.close()
        self.sink.close()
        ids, starts, sizes = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        index = pa.table({"doc_id": pa.array(ids, type=id_type), "start": pa.array(starts, type=pa.int64()), "n_tokens": pa.array(sizes, type=pa.int64())})
        with self.fs.open_output_stream(f"{self.temp}.docs") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index, max_chunksize=65_536)
        self.fs.move(f"{self.temp}.docs", f"{self.path}.docs")
        self.fs.move(self.temp, self.path)
        return self.uri, len(self.docs), self.n


def write_token_files(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int = 1, length: int = SEQUENCE, per_batch: int = PER_BATCH, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of (doc_id, text) under `root`, in ascending doc_id order, and return the manifest of the files.

    A null or empty text has the end id alone. Null ids come first; rows of one id are ordered by their texts; repeated
    rows are written each. Further columns are ignored. An empty table writes no file and has an empty manifest. `root`
    is a URI of a store that all executors share and pyarrow can open.
    """

    def write(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype)
        file, number, rows = None, 0, []
        for b in batches:
            ids = b.column("doc_id")
            for doc_id, raw in zip(ids.to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                if file is None:
                    file = _File(root, part, number, enc.dtype, length, per_batch)
                file.add(doc_id, np.r_[np.frombuffer(raw, dtype=enc.dtype), end])
                if file.n >= file_ids:
                    rows.append((part, number, *file.close(ids.type)))
                    file, number = None, number + 1
        if file is not None:
            rows.append((part, number, *file.close(ids.type)))
        names = ["part", "file", "path", "n_docs", "n_tokens"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kinds[k]) for k in range(5)], names=names)

    # the text itself breaks ties of the range and of the sort, so that one id with very many rows is split too
    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return materialize(map_arrow(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"), write, MANIFEST), "manifest")


def _open(uri: str) -> pa.ipc.RecordBatchFileReader:
    store, path = filesystem(uri)
    return pa.ipc.open_file(pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path))


def sequence(uri: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i of a file; the ids are a view of the file where it is mapped."""
    reader = _open(uri)
    per_batch = int(reader.schema.metadata[b"per_batch"])
    batch, row = reader.get_batch(i // per_batch), i % per_batch
    length = batch.schema.field("ids").type.list_size
    ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
    mask = batch.column("mask").flatten().slice(row * length, length).to_numpy(zero_copy_only=False)
    return ids[row * length : (row + 1) * length], mask


def _file_documents(uri: str) -> Iterator[tuple[list, list, list, list]]:
    """The documents of one file (ids, starts, lengths, checksums), some at a time, read from its sequences."""
    reader, index = _open(uri), _open(f"{uri}.docs")
    held, first, batch = np.zeros(0, dtype=np.uint16), 0, 0  # the ids from place `first` on that are in memory
    for k in range(index.num_record_batches):
        docs = index.get_batch(k)
        starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
        sums = []
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            crc = 0
            while n:
                if s >= first + len(held):
                    got = reader.get_batch(batch)
                    flat, mask = got.column("ids").flatten().to_numpy(zero_copy_only=True), got.column("mask").flatten()
                    first, held, batch = first + len(held), flat[: mask.true_count], batch + 1
                    continue
                piece = held[s - first : s - first + n]
                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                s, n = s + len(piece), n - len(piece)
            sums.append(crc)
        yield docs.column("doc_id"), starts, sizes, sums


def read_token_files(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids of all documents
    before it, padding not counted."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches):
        for b in batches:
            for uri, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                for ids, starts, sizes, sums in _file_documents(uri):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts + base), pa.array(sizes), pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return files.select("path", "base").repartition(int(parts), "path").mapInArrow(read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the files have it; see write_token_files() for odd rows."""
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, scratch_path(spark, "sequences")), docs.schema["doc_id"].dataType.simpleString())


QUERIES = {"op3_arrow_sequences": op3_arrow_sequences}
