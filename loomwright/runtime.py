"""Session helpers shared by every operator: shipping code, spreading work, cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Contexts that already hold the package archive.
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory; executors get this package before they need it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a context, so that Arrow functions import there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        target = os.path.join(tempfile.mkdtemp(), "loomwright.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(target)
    _shipped.add(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores; leave any other alone.

    Only for CPU-heavy Python stages over a small file: a scan with a split a core or more is
    never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a local one only where it is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file://" + os.path.join(tempfile.gettempdir(), "loomwright-shared")).rstrip("/")


def _drop(path, conf) -> None:
    try:
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone by then
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the cluster's shared folder and read it back.

    Computed once, complete when this returns, and readable after any executor is lost. Unlike
    ``checkpoint()`` it doesn't compute the plan twice, and later joins know the table's size.
    The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/loomwright/{uuid.uuid4().hex}"
    df.write.parquet(where)
    remove_at_exit(spark, where)
    return spark.read.schema(df.schema).parquet(where)


def remove_at_exit(spark: SparkSession, where: str) -> None:
    """Delete a folder when the driver's process ends."""
    atexit.register(_drop, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where), spark.sparkContext._jsc.hadoopConfiguration())


def running_before(df: DataFrame, order: list[str], value: Column, out: str, by: list[str] = ()) -> DataFrame:
    """Sum of ``value`` over the rows before each one, within ``by``, in ``order``; no task sorts a whole group.

    Rows are range-partitioned by (by, order), so that a hot group is many partitions; partitions
    are summed, the sums are accumulated over the few partitions, and rows are ordered within
    their partition only. Rows with equal keys share a partition.
    """
    by = list(by)
    # written before the ranges are sampled, so that what is above runs once
    once = cut(df.withColumn("__value", value))
    placed = cut(once.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part", *by).agg(F.sum("__value").alias("__sum"))
    over_parts = F.sum("__sum").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("__part", *[F.col(k).alias(f"__by_{k}") for k in by], F.coalesce(over_parts, F.lit(0)).alias("__start"))
    same = F.col("p.__part") == F.col("s.__part")
    for k in by:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"s.__by_{k}"))
    inner = F.sum("__value").over(Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.withColumn("__inner", F.coalesce(inner, F.lit(0)))
    total = (F.col("p.__inner") + F.col("s.__start")).alias(out)
    return ranked.alias("p").join(starts.alias("s"), same).select(*[F.col(f"p.{c}") for c in df.columns], total)


def slices(batch: pa.RecordBatch, column: int, most_rows: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded rows and text bytes; a row is never parted, so one over the bound is a part of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == most_rows or held + size > most_bytes):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """Python strings of an Arrow column; bytes that aren't UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def one_blas_thread() -> None:
    """Keep a task's matrix products on its own core; threads that BLAS starts beside it only spin."""
    import ctypes
    import glob
    import sys

    numpy = sys.modules.get("numpy")
    for library in glob.glob(os.path.join(os.path.dirname(numpy.__file__) + ".libs", "*openblas*")) if numpy else ():
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(library), name)(1)
                break
            except (OSError, AttributeError):
                continue


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` after the package has been shipped; every result column may be null."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        yield from function(batches)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
