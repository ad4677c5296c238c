"""Inspection results that keep arriving: each id is taken once, across batches and restarts.

The sink is parted by a hash of the id and by the batch that wrote. A batch looks at the parts of its own
ids only, and a batch that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.library import reusable
from ..sources.io import durable, release

BUCKETS = 64


def read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def placed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def append_once(results: DataFrame, sink: str, checkpoint: str, key: str = "uuid", buckets: int = BUCKETS, previews: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Appends rows whose key the sink has not, and ends when what is there is read.

    With ``previews`` (path), what the sink has counts only while ``reusable``: a result whose preview
    is gone is taken anew, and ``current`` reads the later one.
    """
    whole = placed(results.schema)
    results.sparkSession.createDataFrame([], whole).write.mode("append").parquet(sink)  # so that it can be read

    def add(batch: DataFrame, number: int) -> None:
        rows = durable(batch.dropDuplicates([key]).withColumns({"bucket": bucket_of(key, buckets), "batch": F.lit(number).cast("long")}))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # numbers of parts
        known = batch.sparkSession.read.schema(whole).parquet(sink).filter(F.col("bucket").isin(*touched) & (F.col("batch") < number))
        if previews:
            known = reusable(latest(known, key), previews())
        fresh = durable(rows.join(known.select(key), key, "left_anti"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(sink)
        release(rows, fresh)

    return results.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: str) -> DataFrame:
    values = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("_last")).select(key, "_last.*").select(rows.columns)


def current(spark: SparkSession, sink: str, schema: T.StructType, key: str = "uuid") -> DataFrame:
    """The one result of each key that counts."""
    return latest(spark.read.schema(placed(schema)).parquet(sink), key).drop("bucket", "batch")
