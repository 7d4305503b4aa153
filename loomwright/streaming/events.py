"""Unbounded inputs: windows over event time, and deduplicating ingestion of arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import dedup
from loomwright.runtime import cut, remove_at_exit, shared_folder


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; state older than the watermark goes."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of users that a gap of silence ends."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over everything available and read its last result."""
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/loomwright/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/{'out' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    remove_at_exit(spark, where)
    return spark.read.schema(stream.schema).parquet(f"{where}/out" if mode == "complete" else f"{where}/[0-9]*")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    # watermarks need instants; the table has wall-clock times, which are UTC here
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ingest_batch(batch: DataFrame, known: str, number: int) -> None:
    """Write the rows of a micro-batch whose identities no other batch has, and their identities.

    There is no event time to forget by, so the state is a table of identities and not the
    stream's. It holds no texts and lies in folders by the digests' first two digits, of which a
    batch reads those that it has. Both outputs stand in the batch's own folder, so that a batch
    which is run again after a failure replaces what it wrote and meets all others but itself.
    """
    spark = batch.sparkSession
    rows = dedup.survivors(dedup.identified(batch), "source")
    identities = f"{known}.identities"
    bucket = F.substring("content_sha256", 1, 2)
    if _there(spark, identities):
        buckets = [r[0] for r in rows.select(bucket.alias("bucket")).distinct().collect()]  # 256 at most
        seen = spark.read.schema("content_sha256 string, license string, batch_no bigint, bucket string").parquet(identities)
        rows = dedup.without_seed(rows, seen.filter(F.col("bucket").isin(buckets) & (F.col("batch_no") != number)))
    rows = cut(rows)
    rows.write.mode("overwrite").parquet(f"{known}/batch_no={number}")
    rows.select(*dedup.KEY, bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{identities}/batch_no={number}")


def ingest_stream(stream: DataFrame, known: str, checkpoint: str):
    """Deduplicating ingestion of a stream of (source, text, license); ends when all is read."""
    return stream.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, known, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
