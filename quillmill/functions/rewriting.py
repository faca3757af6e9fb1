"""Rewriting one text column by Python code, an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows whose results are held at once.
ROWS = 500


def rewrite(df: DataFrame, text: str, work: Callable[[str], dict], extra: str = "", errors: str | None = None) -> DataFrame:
    """df with work(text)["text"] in place of its text, and the columns of the schema `extra` from the same result.

    Columns of df that are named in `extra` are replaced; a null text gives nulls. It is a step of its own in the plan:
    the optimizer can't copy the work into each use of its results, nor move it into an expression that can't run it.

    What work() raises ends the job, unless `errors` names a column: it then holds the kind and message of what was raised
    for a row (null: nothing), whose text and further results are null; see without_errors().
    """
    added = StructType.fromDDL(", ".join([*[extra] * bool(extra), *[f"`{errors}` string"] * bool(errors)])) if extra or errors else StructType()
    own = df.drop(*added.names)
    schema = StructType([*own.schema.fields, *added.fields])
    fresh = {text: pa.string()} | {f.name: to_arrow_type(f.dataType) for f in added.fields}
    names = schema.names

    def result(t: str) -> dict:
        if not errors:
            return work(t)
        try:
            return work(t) | {errors: None}
        except Exception as e:  # noqa: BLE001 - the row goes on with its error
            return {errors: f"{type(e).__name__}: {e}"}

    def value(result: dict, name: str):
        v = result.get(name if name != text else "text") if errors else result["text" if name == text else name]
        return list(v.items()) if isinstance(v, dict) else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                results = [None if t is None else result(t) for t in batch.column(text).to_pylist()]
                new = {n: pa.array([None if r is None else value(r, n) for r in results], type=t) for n, t in fresh.items()}
                yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)

    return own.mapInArrow(run, schema)


def without_errors(df: DataFrame, errors: str) -> DataFrame:
    """The rows for which nothing was raised. How many others there are tells error_counts()."""
    return df.where(F.col(errors).isNull()).drop(errors)


def error_counts(df: DataFrame, errors: str) -> DataFrame:
    """One row: documents, and those whose work raised something (processing_errors)."""
    return df.agg(F.count("*").alias("docs"), F.count(errors).alias("processing_errors"))
