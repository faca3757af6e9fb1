"""Readers and writers of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: A table of fewer bytes is dealt out to all cores before costly work on its rows.
SMALL = 1 << 28


def spread(df: DataFrame) -> DataFrame:
    """A small table that has fewer files than there are cores is dealt out to all of them: a file of one row group is
    one task however many there are. Its size is checked; a larger one stays as its files have it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def read_corpus(spark: SparkSession, path: str, text: str = "text", key: str = "id", pattern: str | None = None, limit: int = -1, defaults: dict | None = None) -> DataFrame:
    """Parquet documents as (text, id, ...); `limit` is of the whole corpus; defaults fill absent or null columns."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    df = reader.parquet(path).withColumnsRenamed({text: "text", key: "id"})
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df.limit(limit) if limit >= 0 else df


def with_lineage(df: DataFrame) -> DataFrame:
    """The file of each row and its place there."""
    return df.withColumns({"source_file": F.col("_metadata.file_name"), "row_idx_in_file": F.col("_metadata.row_index")})


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def tokenizer_texts(df: DataFrame, text: str = "text", chars: int = 20_000) -> DataFrame:
    """Texts for tokenizer training: one line each, stripped, cut at `chars`; blank ones go."""
    flat = F.regexp_replace(F.translate(F.col(text), "\n\r", "  "), r"(?U)^\s+|\s+$", "")
    return df.select(F.substring(flat, 1, chars).alias("text")).where(F.length("text") > 0)


def write_splits(df: DataFrame, path: str, split: str = "doc_split", names: tuple[str, ...] = ("train", "val", "test"), mode: str = "errorifexists") -> None:
    """A folder for each split, with a schema even if the split is empty."""
    for name in names:
        df.where(F.col(split) == name).drop(split).write.mode(mode).parquet(f"{path}/{name}")


def write_with_exclusions(df: DataFrame, keep, path: str, excluded: str) -> None:
    df.where(keep).write.parquet(path)
    df.where(~F.coalesce(keep, F.lit(False))).write.parquet(excluded)


def merge_folder(spark: SparkSession, path: str, out: str, clean: bool = False) -> None:
    """One file of all; an output that is there is an error unless it may be replaced."""
    spark.read.parquet(path).coalesce(1).write.mode("overwrite" if clean else "errorifexists").parquet(out)


def write_scores(df: DataFrame, path: str) -> None:
    """CSV with a header; doubles with four digits."""
    cols = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(cols).coalesce(1).write.mode("overwrite").csv(path, header=True)


def ordered_files(spark: SparkSession, pattern: str, most: int | None = None) -> list[str]:
    """The files that a pattern names, in the order of their paths; no more than `most`. The names, not the data, are on
    the driver, as they are for every scan."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(place) or []
    paths = sorted(f.getPath().toString() for f in found)
    if not paths:
        raise FileNotFoundError(pattern)
    return paths[:most] if most is not None and most >= 0 else paths


def read_files(spark: SparkSession, pattern: str, most: int | None = None) -> DataFrame:
    """The files of a pattern as one table, each row with its file and place there."""
    return with_lineage(spark.read.parquet(*ordered_files(spark, pattern, most)))


def readable_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, ok, bytes): which Parquet files have their marks at both ends and a footer that fits between them. Heads and
    ends alone are read, in as many tasks as there are files."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.substring("content", 1, 4).alias("a"), F.expr("substring(content, -8, 8)").alias("z"))
    size = F.conv(F.concat(*[F.substring(F.hex("z"), 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("long")
    marks = (F.col("a") == F.lit(b"PAR1")) & (F.substring("z", 5, 4) == F.lit(b"PAR1"))
    return files.select("path", (marks & (size + 12 <= F.col("bytes"))).alias("ok"), "bytes")


def read_tolerant(spark: SparkSession, pattern: str) -> tuple[DataFrame, int]:
    """The rows of the files that can be read, and the number of those that cannot."""
    bad = readable_files(spark, pattern).where(~F.col("ok")).count()
    return spark.read.option("ignoreCorruptFiles", True).parquet(pattern), bad


def read_scores(spark: SparkSession, path: str, index: str = "subject") -> DataFrame:
    """A CSV of scores with a header; the first column is named `index`."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumnRenamed(df.columns[0], index)


def canonical(df: DataFrame, columns: list[str], id_col: str = "id", text: str = "text") -> DataFrame:
    """(text, id, metadata): a row as writers have it, the other columns named as one struct in a fixed order; a column
    that is missing is null."""
    meta = F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    return df.select(F.col(text).alias("text"), F.col(id_col).alias("id"), meta.alias("metadata"))


def verify_windows(df: DataFrame, known: list[tuple[str, str]], rows: int = 5) -> float:
    """The share of the first rows whose (document_type, preprocessing_version) is a known pair; none is an error."""
    got = [(r["document_type"], r["preprocessing_version"]) for r in df.select("document_type", "preprocessing_version").limit(rows).collect()]
    share = sum(g in known for g in got) / len(got) if got else 0.0
    if not share:
        raise ValueError(f"no window is of a known kind: {sorted(set(map(str, got)))}")
    return share


def window_tokens(df: DataFrame, text: str = "text", kind: str = "document_type") -> DataFrame:
    """df with its text stripped, and `tokens` decoded from the texts of legacy windows, which are numbers and spaces."""
    own = F.btrim(text)
    numbers = F.transform(F.split(own, r"\s+"), lambda x: x.try_cast("int"))
    return df.withColumn(text, own).withColumn("tokens", F.when(F.col(kind) == "legacy_window", numbers))


def write_report(df: DataFrame, path: str) -> None:
    """The rows of a small report as JSON, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def stats_report(df: DataFrame, score: str, id_col: str = "doc_id", samples: int = 20) -> DataFrame:
    """One row: n, lowest, highest, mean of a score, and the `samples` rows with the lowest ids as an array. Partial
    aggregates hold the smallest ids alone."""
    some = df.orderBy(id_col).limit(samples).agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(score).alias("score")))).alias("samples"))
    return df.agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.max(score).alias("highest"), F.avg(score).alias("mean")).join(some)


def split_summary(manifest: DataFrame, split: str = "split") -> DataFrame:
    """(split, n, share) of a manifest."""
    total = manifest.groupBy(split).agg(F.count("*").alias("n"))
    return total.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
