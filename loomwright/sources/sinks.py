"""Canonical Parquet objects, JSON lines and their verification."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.runtime import ship

#: Limits and encodings of an object.
ROW_GROUP_BYTES, OBJECT_BYTES, MOST_OBJECT_BYTES, PAGE_BYTES, ZSTD_LEVEL = 64 << 20, 256 << 20, 512 << 20, 1 << 20, 6
PLAIN_COLUMNS = ("text", "source", "meta")
PREFIX = "loomwright."


def write_parquet(rows: DataFrame, path: str) -> None:
    """Spark's own writer with the canonical encodings."""
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(ZSTD_LEVEL), "parquet.page.size": str(PAGE_BYTES), "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.writer.version": "v2"}
    rows.write.options(**options).parquet(path)


def assigned(rows: DataFrame, order: list[str], target: int = OBJECT_BYTES) -> DataFrame:
    """Rows with the number of their object: ranges of the order key of about ``target`` bytes.

    The number of objects follows from the total; ranges come from a sampled range partitioning,
    so no task sees more than its own range.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.repartitionByRange(max(1, -(-int(total) // target)), *order).withColumn("object_no", F.spark_partition_id())


class ObjectWriter:
    """One object at a time: row groups of ``ROW_GROUP_BYTES`` logical bytes, a new object from ``OBJECT_BYTES`` encoded ones on.

    Totals go to the footer when an object closes; it then moves to the name of its digest. An
    object that is there already is hashed again and kept; other content under its name is an error.
    """

    def __init__(self, folder: str, kind: str, most: int = OBJECT_BYTES, group: int = ROW_GROUP_BYTES):
        self.folder, self.kind, self.most, self.group = folder, kind, most, group
        self.done: list[tuple] = []
        self._held: list[pa.RecordBatch] = []
        self._size, self._writer = 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        self._held.append(batch)
        self._size += batch.nbytes
        if self._size >= self.group:
            self._flush()

    def _flush(self) -> None:
        if not self._held:
            return
        body = pa.Table.from_batches(self._held).combine_chunks()
        self._held, self._size = [], 0
        if self._writer is None:
            os.makedirs(self.folder, exist_ok=True)
            self._path = os.path.join(self.folder, f".{os.getpid()}-{uuid.uuid4().hex}.tmp")
            self._totals = {"bytes": 0, "records": 0, "tokens": 0}
            self._licenses: set[str] = set()
            self._writer = pq.ParquetWriter(
                self._path, body.schema.remove_metadata(), compression="zstd", compression_level=ZSTD_LEVEL, data_page_size=PAGE_BYTES, data_page_version="2.0",
                use_dictionary=[c for c in body.column_names if c not in PLAIN_COLUMNS], write_statistics=[c for c in body.column_names if c not in PLAIN_COLUMNS],
            )
        self._writer.write_table(body.replace_schema_metadata(None), row_group_size=body.num_rows)
        self._totals["records"] += body.num_rows
        self._totals["bytes"] += pc.sum(pc.binary_length(body.column("text"))).as_py() or 0
        if "token_count" in body.column_names:
            self._totals["tokens"] += pc.sum(body.column("token_count")).as_py() or 0
        if "license" in body.column_names:
            self._licenses.update(x for x in pc.unique(body.column("license")).to_pylist() if x)
        if os.path.getsize(self._path) >= self.most:
            self.close()

    def close(self) -> None:
        self._flush()
        if self._writer is None:
            return
        bom = {**self._totals, "licenses": sorted(self._licenses)}
        keys = {"record_kind": self.kind, "record_schema": "2", "records": str(bom["records"]), "tokens": str(bom["tokens"]), "content_bytes": str(bom["bytes"]), "bom": json.dumps(bom, sort_keys=True)}
        self._writer.add_key_value_metadata({PREFIX + k: v for k, v in keys.items()})
        self._writer.close()
        self._writer = None
        size = os.path.getsize(self._path)
        if size > MOST_OBJECT_BYTES:
            os.remove(self._path)
            raise ValueError(f"an object of {size} bytes is over the limit")
        digest = _digest(self._path)
        final = os.path.join(self.folder, digest[:2], digest[2:4], digest)
        os.makedirs(os.path.dirname(final), exist_ok=True)
        if os.path.exists(final):
            os.remove(self._path)
            if _digest(final) != digest:
                raise ValueError(f"{final} holds other content")
        else:
            os.replace(self._path, final)
        self.done.append((final, bom["records"], size, digest))


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_objects(rows: DataFrame, folder: str, order: list[str], kind: str = "text", target: int = OBJECT_BYTES) -> DataFrame:
    """Content-addressed Parquet objects with aggregates in their footers: (object, records, bytes, sha256).

    ``folder`` is a file system path that all executors share. A task streams its range of the
    order into row groups and objects, under a temporary name that becomes the digest, so a
    repeated task gives the same objects.
    """
    return stream_objects(assigned(rows, order, target).drop("object_no").sortWithinPartitions(*order), folder, kind, target)


def stream_objects(placed: DataFrame, folder: str, kind: str = "text", target: int = OBJECT_BYTES) -> DataFrame:
    """``write_objects`` for rows that stand in their order and partitions already."""
    spark = placed.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ObjectWriter(folder, kind, target)
        for batch in batches:
            if batch.num_rows:
                writer.add(batch)
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*writer.done)], names=["object", "records", "bytes", "sha256"])

    written = placed.mapInArrow(run, "object string, records bigint, bytes bigint, sha256 string")
    # a row an object (of 256 MiB); collected, so that the objects are written exactly once
    return spark.createDataFrame(written.collect(), written.schema)


def footers(paths: DataFrame) -> DataFrame:
    """(path, rows, row_groups, columns, keys) from Parquet footers; no page is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf.path:
                m = pq.ParquetFile(p.removeprefix("file:")).metadata
                keys = {k.decode(): v.decode("utf-8", "replace") for k, v in (m.metadata or {}).items() if k.startswith(PREFIX.encode())}
                out.append((p, m.num_rows, m.num_row_groups, m.schema.to_arrow_schema().names, keys))
            yield pd.DataFrame(out, columns=["path", "rows", "row_groups", "columns", "keys"])

    return paths.select("path").mapInPandas(run, "path string, rows bigint, row_groups int, columns array<string>, keys map<string,string>")


def verified(objects: DataFrame, found: DataFrame) -> DataFrame:
    """Objects whose size or digest isn't what was declared; ``found`` comes from the binary source."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    now = found.select(name.alias("sha256"), F.col("length").alias("now_bytes"), F.sha2("content", 256).alias("now_sha256"))
    return objects.join(now, "sha256", "left").filter(~F.col("sha256").eqNullSafe(F.col("now_sha256")) | ~F.col("bytes").eqNullSafe(F.col("now_bytes")))


def footer_differences(objects: DataFrame, columns: list[str]) -> DataFrame:
    """(object, difference): objects whose footer doesn't have the declared rows, the columns in their order, or keys that agree with its rows."""
    foot = footers(objects.select(F.col("object").alias("path")))
    both = objects.select("object", "records").join(foot, F.col("object") == F.col("path"))
    key = lambda k: F.try_element_at("keys", F.lit(PREFIX + k))
    rules = {
        "rows": F.col("rows") != F.col("records"), "columns": F.col("columns") != F.array(*map(F.lit, columns)),
        "footer-records": ~key("records").eqNullSafe(F.col("rows").cast("string")), "bom": ~F.get_json_object(key("bom"), "$.records").eqNullSafe(F.col("rows").cast("string")),
    }
    broken = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return both.select("object", F.explode(broken).alias("difference"))


def summarized(objects: DataFrame, tokens_of=None) -> DataFrame:
    """(object, records, tokens, content_bytes) from footers where they hold all of it, else from a scan of that object."""
    spark = objects.sparkSession
    foot = footers(objects.select(F.col("object").alias("path")))
    key = lambda k: F.try_element_at("keys", F.lit(PREFIX + k)).cast("bigint")
    told = foot.select(F.col("path").alias("object"), key("records").alias("records"), key("tokens").alias("tokens"), key("content_bytes").alias("content_bytes"))
    whole = told.filter("records IS NOT NULL AND tokens IS NOT NULL AND content_bytes IS NOT NULL")
    lacking = [r.object for r in told.filter("records IS NULL OR tokens IS NULL OR content_bytes IS NULL").select("object").limit(100_001).collect()]
    if len(lacking) > 100_000:
        raise ValueError("more than 100,000 objects without totals")
    if not lacking:
        return whole
    rows = spark.read.parquet(*lacking)
    tokens = tokens_of(rows) if tokens_of else F.col("token_count")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    scanned = rows.groupBy(path.alias("object")).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("content_bytes"))
    return whole.unionByName(scanned)


def export_native(objects: DataFrame, folder: str) -> DataFrame:
    """(object, sha256, bytes, intact): verified objects copied under their digests, a task an object; a copy that is there is hashed again."""
    ship(objects.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, digest in zip(pdf.object, pdf.sha256):
                os.makedirs(folder, exist_ok=True)
                final = os.path.join(folder, f"{digest}.parquet")
                if not os.path.exists(final):
                    temporary = f"{final}.{uuid.uuid4().hex}.tmp"
                    shutil.copyfile(path, temporary)
                    os.replace(temporary, final)
                out.append((final, digest, os.path.getsize(final), _digest(final) == digest))
            yield pd.DataFrame(out, columns=["object", "sha256", "bytes", "intact"])

    return objects.select("object", "sha256").mapInPandas(run, "object string, sha256 string, bytes bigint, intact boolean")


# ---- JSON lines ---------------------------------------------------------------------------------------


def json_string(value: Column) -> Column:
    """Canonical JSON string: only quotes, backslashes and control characters are escaped; null stays null."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    for code in (0x7F, 0x2028, 0x2029):
        quoted = F.replace(quoted, F.lit(f"\\u{code:04x}"), F.lit(chr(code)))
    return F.when(value.isNotNull(), F.replace(quoted, F.lit("\\/"), F.lit("/")))


def jsonl_lines(rows: DataFrame) -> DataFrame:
    """Rows with their canonical line: fixed key order, empty optional values left out, meta as it stands."""
    present = set(rows.columns)
    pieces = [F.concat(F.lit('{"sha256":"'), F.sha2("text", 256), F.lit('","text":'), json_string(F.col("text")))]
    for name, key in (("source", "source"), ("source_name", "source_name"), ("license", "license"), ("license_raw", "license_raw"), ("language", "lang"), ("date", "date")):
        if name in present:
            value = F.nullif(name, F.lit(""))
            pieces.append(F.coalesce(F.concat(F.lit(f',"{key}":'), json_string(value)), F.lit("")))
    for name, key in (("language_score", "lang_score"), ("token_count", "tokens")):
        if name in present:
            pieces.append(F.when(F.coalesce(name, F.lit(0)) != 0, F.concat(F.lit(f',"{key}":'), F.col(name).cast("string"))).otherwise(F.lit("")))
    if "meta" in present:
        pieces.append(F.coalesce(F.concat(F.lit(',"meta":'), F.nullif("meta", F.lit(""))), F.lit("")))
    return rows.withColumn("line", F.concat(*pieces, F.lit("}")))


def write_jsonl(rows: DataFrame, path: str, order: list[str], declared: tuple[int, int] | None = None) -> DataFrame:
    """Write the lines in order and return their totals; ``declared`` ones, a manifest's (docs, tokens), have to agree."""
    jsonl_lines(rows).orderBy(*order).select("line").write.text(path)
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    if declared is not None and tuple(totals.first()) != tuple(declared):
        raise ValueError(f"exported {tuple(totals.first())}, the manifest declares {tuple(declared)}")
    return totals


def single_record(rows: DataFrame, digest: str) -> DataFrame:
    """The record of a digest; none or several is an error when the result is read."""
    one = rows.filter(F.sha2("text", 256) == digest).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    if one.limit(2).count() != 1:
        raise ValueError(f"{digest} isn't the digest of exactly one record")
    return one.drop("n")


def calibration_text(sample: DataFrame, order: list[str]) -> str:
    """The bounded calibration sample as one text."""
    return "\n\n".join(r.sample for r in sample.orderBy(*order).select("sample").toLocalIterator())


def append_telemetry(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def read_telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def worker_lines(begin: dict, records: DataFrame, order: list[str], evaluation: DataFrame | None = None, schema: int = 1) -> Iterator[str]:
    """Frames of a worker's input: begin, evaluation records, records, end; rows stream partition by partition."""

    def frame(kind: str, **more) -> str:
        return json.dumps({"kind": kind, "schema": schema, **more}, ensure_ascii=False, separators=(",", ":"), default=str)

    yield frame("begin", begin=begin)
    for kind, rows in (("evaluation_record", evaluation), ("record", records)):
        if rows is not None:
            for r in rows.orderBy(*order).toLocalIterator(prefetchPartitions=True):
                yield frame(kind, record=r.asDict(recursive=True))
    yield frame("end")
