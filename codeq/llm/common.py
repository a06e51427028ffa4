"""What the operators share: reading, writing tables in between, and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from codeq.session import shared_folder

Batches = Iterator[pa.RecordBatch]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table into the shared folder and read it from there.

    Cuts the lineage, so a lost executor costs no recomputation, and freezes ids that depend on how
    rows were dealt out. What was shuffled for it leaves the disk when it is written.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"llm-{purpose}")
    for paths in _recorders:
        paths.append(path)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


_recorders: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Put the folders of all tables settled inside into ``paths``, for ``drop`` when they have served."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.pop()


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete these folders and empty the list. Nothing may still read them."""
    while paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_text() -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents with a row number in column ``name``, which no later run of a task changes."""
    return settle(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return name


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most so many texts at once; a setting of the session.

    Workers that wait for their next task, and there may be several to a core, keep what a batch took.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


@contextmanager
def larger_batches(spark: SparkSession, rows: int = 1 << 14) -> Iterator[None]:
    """Let Python workers get so many rows at once while a table of numbers is settled inside."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


_kept: dict[str, object] = {}


def kept_by_worker(name: str, make: Callable[[], object]):
    """An object that a Python worker keeps from task to task; see ``through_arrow``."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def release(keeps: str = "") -> None:
    """Drop what this worker keeps, but for the object of that name."""
    for name in [n for n in _kept if n != keeps]:
        del _kept[name]


def trim() -> None:
    """Give memory that is free back to the machine: a worker that waits for its next task needs none."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back is not None:
        give_back(0)


def through_arrow(df: DataFrame, rows: Callable[[Batches], Iterator[dict[str, list]]],
                  schema: str | StructType, keeps: str = "") -> DataFrame:
    """``mapInArrow`` for a function that yields columns as a dict of lists or arrays.

    A worker serves the tasks of one job after the other: what it keeps for others than ``keeps`` goes.
    """
    small_batches(df.sparkSession)
    fields = schema if isinstance(schema, StructType) else DataType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Batches) -> Batches:
        release(keeps)
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array)
                 else pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
        release(keeps)
        trim()
    return df.mapInArrow(run, fields)


def chunks(batches: Batches, *columns: str, chars: int = 1 << 20,
           rows: int = 256) -> Iterator[tuple[list, ...]]:
    """The rows in lists of at most so many rows, and so many characters of the last column or one row.

    Only the rows of a list become Python objects, not a whole batch.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            lists = [batch.column(c).slice(low, rows).to_pylist() for c in columns]
            start = held = 0
            for i, text in enumerate(lists[-1]):
                held += len(text) + 100
                if held >= chars:
                    yield tuple(x[start:i + 1] for x in lists)
                    start, held = i + 1, 0
            if start < len(lists[-1]):
                yield tuple(x[start:] for x in lists)
