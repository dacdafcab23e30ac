"""The latest row of each key in a parquet table of buckets: a batch rewrites only the buckets that it touches.

A table holds `v=<batch>/<bucket folder>` and `manifest/batch=<batch>`, which names the buckets that the batch wrote. A
bucket's rows are those of the last batch that names it. The manifest is written after the rows, so a
batch that fails between leaves the table as it was, and one that is repeated gives the same table.
Folders of batches that no bucket stands in any more aren't deleted here, as readers may still be in them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import upsert_latest

BUCKET = "_bucket"
MANIFEST = "bucket int, buckets int, batch long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _standing(manifest: DataFrame) -> dict[int, int]:
    """The batch in which each bucket stands; as many entries as the table has buckets."""
    return {r.bucket: r.batch for r in manifest.where("bucket is not null").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _rows(spark: SparkSession, path: str, standing: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/v={batch}/{BUCKET}={bucket}" for bucket, batch in sorted(standing.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, number: int, path: str, key: list[str], order: list[str], buckets: int = 256) -> None:
    """Merge a batch into the table: of each key the last row in `order` stays, of equal ones the batch's.

    Batch 0 starts the table. A later one fails where the batch before it is missing, as its history is
    lost, and where the table has another number of buckets. A null is a key like others.
    """
    if BUCKET in batch.columns:
        raise ValueError(f"{BUCKET} is the name of the buckets' folders")
    spark = batch.sparkSession
    before = _manifest(spark, path).where(F.col("batch") < number)
    last = before.agg(F.max("batch").alias("batch"), F.min("buckets").alias("least"), F.max("buckets").alias("most")).first()
    if number and last.batch != number - 1:
        raise ValueError(f"batch {number - 1} of {path} is missing")
    if number and (last.least, last.most) != (buckets, buckets):
        raise ValueError(f"{path} has {last.most} buckets")
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    touched = [r[0] for r in batch.select(place).distinct().collect()]  # at most `buckets` numbers
    standing = _standing(before)
    old = _rows(spark, path, {b: standing[b] for b in touched if b in standing}, batch.schema)
    merged = upsert_latest(old, batch, key, order).withColumn(BUCKET, place)
    merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/v={number}")
    named = spark.createDataFrame([(b, buckets) for b in touched] or [(None, buckets)], "bucket int, buckets int")
    named.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")


def latest_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of the last batch that was finished."""
    return _rows(spark, path, _standing(_manifest(spark, path)), schema)


def latest_into_buckets(events: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 256):
    """A stream's writer that merges each micro-batch into the table."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read for its buckets and for its rows
        try:
            merge_batch(held, number, path, key, order, buckets)
        finally:
            held.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
