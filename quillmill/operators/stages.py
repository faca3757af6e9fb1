"""A user's own steps: text cleaners, document filters, steps of one row to many, chains of them, and a registry by name.

A stage is a function from a DataFrame to a DataFrame, so every operator of the engine is one. What a user writes on Python
values is wrapped into a stage that runs on Arrow batches; a rule that can be said as a column should be, since Spark plans
that and it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.rewriting import ROWS, rewrite

Stage = Callable[[DataFrame], DataFrame]
#: Builders of stages by name; see registered() and built().
REGISTRY: dict[str, Callable[..., Stage]] = {}


def chain(*stages: Stage) -> Stage:
    """The stages one after the other. Nothing runs between them: Spark plans the whole chain as one."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = stage(df)
        return df

    return run


def registered(name: str) -> Callable:
    """Decorator: a builder of stages under a name. A name that is taken raises."""

    def add(builder: Callable[..., Stage]) -> Callable[..., Stage]:
        if name in REGISTRY:
            raise ValueError(f"a stage {name} is there already")
        REGISTRY[name] = builder
        return builder

    return add


def built(config: dict[str, dict | None]) -> Stage:
    """The chain that a configuration names, in its order: {stage: its arguments}; a stage with None is left out. An
    unknown name raises before anything runs."""
    unknown = [n for n in config if n not in REGISTRY]
    if unknown:
        raise KeyError(f"no stages {unknown}; there are {sorted(REGISTRY)}")
    return chain(*[REGISTRY[n](**options) for n, options in config.items() if options is not None])


@registered("column")
def column_stage(rule: Callable[[Column], Column], text: str = "text") -> Stage:
    """A rule on the text's column."""
    return lambda df: df.withColumn(text, rule(F.col(text)))


@registered("keep")
def keep_stage(test: Callable[..., Column] | Column) -> Stage:
    """The documents for which a column is true; null doesn't keep."""
    return lambda df: df.where(test if isinstance(test, Column) else test(df))


@registered("cleaner")
def cleaner_stage(clean: Callable[[str], tuple[str, dict]], stats: str = "", text: str = "text", errors: str | None = None) -> Stage:
    """clean(text) -> (text, stats) on every document; `stats` is the schema of the columns that it fills. `errors`: see
    rewrite()."""

    def work(t: str) -> dict:
        new, found = clean(t)
        return {**found, "text": new}

    return lambda df: rewrite(df, text, work, stats, errors)


@registered("filter")
def filter_stage(test: Callable[[dict], bool], columns: Iterable[str], reason: str | None = None) -> Stage:
    """The documents for which test(the named columns as a dict) holds; a test may answer (False, why). With `reason`, all
    documents go on, with that column: null for those that are kept, so that they can be split by it afterwards."""
    columns = list(columns)

    def answer(row: dict) -> str | None:
        got = test(row)
        kept, why = got if isinstance(got, tuple) else (got, "filtered")
        return None if kept else str(why)

    def run(df: DataFrame) -> DataFrame:
        out = reason or "__reason"
        schema = StructType([*df.drop(out).schema.fields, *StructType.fromDDL(f"`{out}` string").fields])

        def judge(batches):
            for whole in batches:
                for at in range(0, max(whole.num_rows, 1), ROWS):
                    b = whole.slice(at, ROWS)
                    why = pa.array([answer(r) for r in b.select(columns).to_pylist()], type=pa.string())
                    yield pa.RecordBatch.from_arrays([*b.columns, why], names=[*b.schema.names, out])

        judged = df.drop(out).mapInArrow(judge, schema)
        return judged if reason else judged.where(F.col(out).isNull()).drop(out)

    return run


@registered("step")
def step_stage(step: Callable[[Iterable[dict], int], Iterable[dict]], schema: str) -> Stage:
    """step(rows of a partition, its number) -> rows of `schema`, as many as it likes. Rows come and go as streams: a step
    that keeps none needs no memory. A partition may be run again, so a step must not act outside of what it gives."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(df: DataFrame) -> DataFrame:
        def work(batches):
            from pyspark import TaskContext

            rows = (r for whole in batches for at in range(0, whole.num_rows, ROWS) for r in whole.slice(at, ROWS).to_pylist())
            held = []
            for made in step(rows, TaskContext.get().partitionId()):
                held.append(made)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=kind)

        return df.mapInArrow(work, schema)

    return run


def adapted(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """What a writer expects: its columns in their order, each from a column of df."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
