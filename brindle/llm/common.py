"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
MAX_ID = (1 << 63) - 1


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session shares.

    The folder is the session's ``spark.checkpoint.dir``. Only where none is set and the
    master is local, as in tests, a temporary one is used, and removed with the session; on a cluster
    that would be another folder on every machine, so it is an error there.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is run inside; a session that asks for fewer keeps its number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column is so named."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def order_id(doc_id: Column) -> Column:
    """The id for comparisons: a null id comes after every other."""
    return F.coalesce(doc_id.cast("long"), F.lit(MAX_ID))


def pieces_of(batches, rows: int = 512):
    """Slices of at most so many rows, so that decoded rows stay small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Tables that an operator keeps in a worker from task to task; tasks of other operators empty them.
KEPT: list[dict] = []


def give_back(own: dict | None = None) -> None:
    """Return freed memory to the system, and what other operators than the one of `own` keep here. Python workers
    are kept between tasks, and what an allocator holds on to counts against the executor."""
    for table_ in KEPT:
        if table_ is not own:
            table_.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def trimmed(run):
    """A group function that gives memory back when it is done."""

    def wrapped(*tables):
        out = run(*tables)
        give_back()
        return out

    return (lambda t: wrapped(t)) if run.__code__.co_argcount == 1 else (lambda t, u: wrapped(t, u))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl_df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_df_schema)
