"""What the operators share: scratch tables, Arrow batches, segment arithmetic."""

from __future__ import annotations

import contextvars
import itertools
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

#: A word, wherever one is counted: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch at most, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 400, 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is named and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = f"file://{tempfile.mkdtemp(prefix='quillmill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: The scratch folders that the work inside swept() has made.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def swept(spark: SparkSession, work: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of `work` as a written table; all other scratch folders that it has made are deleted."""
    token = _made.set([])
    try:
        made = _made.get()
        out = materialize(work(), name)
        for path in made:
            if path != out._scratch:
                _delete(spark, path)
    finally:
        _made.reset(token)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch; a lower number of rows of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem(uri: str):
    """The store of a URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


#: What lies between a scan and a frame whose rows still stand where the files have them.
_IN_PLACE = {"Project", "Filter", "SubqueryAlias"}


def located(df: DataFrame, whole: bool = False) -> tuple[DataFrame, str, str]:
    """df with the place of each row, and the names of its two columns: a hash of the file's path, and the row's number
    there. A frame that is more than columns and filters over one scan of Parquet files is written first; with `whole`,
    one with a filter too, so that the numbers of a file have no gaps."""

    def placed(df: DataFrame) -> tuple[DataFrame, str, str]:
        meta, path, row = df.metadataColumn("_metadata"), fresh(df, "__path"), fresh(df, "__row")
        return df.withColumns({path: F.xxhash64(meta["file_path"]), row: meta["row_index"].cast("long")}), path, row

    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _IN_PLACE and not (whole and plan.nodeName() == "Filter"):
        plan = plan.children().head()
    if plan.children().isEmpty():
        try:
            return placed(df)
        except AnalysisException:  # rows of other sources have no number
            pass
    return placed(materialize(df, "rows"))


#: Rows of a file that share a sheet of notes.
SHEET = 1 << 16


class Notes:
    """A value for some rows of files, looked up where the rows are read: nothing but the notes is ever shuffled.

    Notes are dealt out by the file and the sheet, written as one Arrow file each in the shared folder, under a name of
    their own and then renamed. A task that reads rows opens the sheets of those rows alone.
    """

    def __init__(self, rows: DataFrame, path: str, row: str, value: str, name: str):
        """rows: (path, row, value), each place once at most; `value` must not be null."""
        spark = rows.sparkSession
        self.root = root = scratch_path(spark, name)
        self.kind = rows.schema[value].dataType
        out = rows.select(F.col(path).alias("path"), F.col(row).alias("row"), F.floor(F.col(row) / SHEET).cast("long").alias("sheet"), F.col(value).alias("value"))
        schema = to_arrow_schema(out.select("row", "value").schema)

        def write(batches):
            store, folder = filesystem(root)
            store.create_dir(folder, recursive=True)
            n = 0
            for t in whole_groups(batches, ["path", "sheet"], 1):
                cuts = group_slices([t.column("path").to_numpy(), t.column("sheet").to_numpy()]).tolist()
                for lo, hi in itertools.pairwise(cuts):
                    place = f"{folder}/{t.column('path')[lo].as_py()}.{t.column('sheet')[lo].as_py()}"
                    temp = f"{place}.{uuid.uuid4().hex}"
                    with store.open_output_stream(temp) as sink, pa.ipc.new_stream(sink, schema) as to:
                        to.write_table(t.slice(lo, hi - lo).select(["row", "value"]).cast(schema))
                    store.move(temp, place)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64())], names=["n"])

        keys = ["path", "sheet"]
        out.repartition(*keys).sortWithinPartitions(*keys, "row").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()

    def of(self, path: str, row: str, read: Callable[[pa.Array], pa.Array] | None = None, kind: str | None = None) -> Column:
        """The value of each row, null where there is none; `read` makes another one, of the type `kind`, of it."""
        root, schema = self.root, to_arrow_type(self.kind)
        held: dict = {}

        def sheet(key: tuple[int, int]):
            if key not in held:
                store, folder = filesystem(root)
                held.clear()
                try:
                    with store.open_input_stream(f"{folder}/{key[0]}.{key[1]}") as source:
                        t = pa.ipc.open_stream(source).read_all().combine_chunks()
                except FileNotFoundError:
                    t = None
                held[key] = t and (t.column("row").to_numpy(), t.column("value").combine_chunks())
            return held[key]

        def look(path: pa.Array, row: pa.Array) -> pa.Array:
            p, r = path.to_numpy(), row.to_numpy()
            found = []
            for lo, hi in itertools.pairwise(group_slices([p, r // SHEET]).tolist() if len(p) else [0]):
                notes = sheet((int(p[lo]), int(r[lo] // SHEET)))
                if notes is None:
                    found.append(pa.nulls(hi - lo, type=schema))
                    continue
                at = np.minimum(np.searchsorted(notes[0], r[lo:hi]), len(notes[0]) - 1)
                values = notes[1] if isinstance(notes[1], pa.Array) else pa.concat_arrays(notes[1].chunks)
                found.append(values.take(pa.array(at, mask=notes[0][at] != r[lo:hi])))
            out = pa.concat_arrays(found) if found else pa.nulls(0, type=schema)
            return read(out) if read else out

        return F.arrow_udf(look, kind or self.kind).asNondeterministic()(F.col(path), F.col(row))


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What `fit` makes of a sample of bounded size: it runs in one task, so the driver gets the model alone."""
    def run(batches):
        t = pa.Table.from_batches(list(batches), schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(t))], type=pa.large_binary())], names=["model"])

    schema = to_arrow_schema(sample.schema)
    got = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got["model"])


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the rows from which nothing is learnt; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; a null is an empty text."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def group_slices(keys: list[np.ndarray]) -> np.ndarray:
    """Bounds of the runs of equal keys: n + 1 places for n runs."""
    n = len(keys[0])
    change = np.zeros(n + 1, dtype=bool)
    change[0] = change[n] = True
    for k in keys:
        change[1:n] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows at least from a sorted partition, cut only between groups."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held)
            cuts = group_slices([t.column(k).to_numpy() for k in keys])
            if len(cuts) > 2:
                last = int(cuts[-2])
                yield t.slice(0, last).combine_chunks()
                held = t.slice(last).combine_chunks().to_batches()
                count -= last
            rows = max(rows, 2 * count)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class LocalForest:
    """Union of links inside one task, over arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        return self.parent[x]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            ra, rb = p[a], p[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                q = p[p]
                if np.array_equal(q, p):
                    break
                p[:] = q
