"""File enumeration, fingerprints and format detection."""

from __future__ import annotations

import gzip
import io
import json
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.runtime import ship

#: Leading bytes of compressions and containers, as hex.
COMPRESSIONS = {"gzip": "1F8B", "zstd": "28B52FFD", "zip": "504B0304", "bzip2": "425A68", "xz": "FD377A585A00"}
MEDIA = {"png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "pdf": "25504446", "wav": "52494646", "ogg": "4F676753", "flac": "664C6143"}
SAMPLE = 65_536


def distinct_roots(roots: Iterable[str]) -> list[str]:
    """Roots in order, each once and none below another, so that the source lists a file once."""
    plain = sorted({r.rstrip("/") or "/" for r in roots})
    return [r for r in plain if not any(r != other and r.startswith(other.rstrip("/") + "/") for other in plain)]


def rejected_links(roots: Iterable[str]) -> list[str]:
    """Symbolic links under roots of the local file system; other stores have none."""
    found = []
    for root in roots:
        local = root.removeprefix("file://")
        if "://" in local:
            continue
        walk = [(os.path.dirname(local), [], [os.path.basename(local)])] if not os.path.isdir(local) else os.walk(local)
        found += [os.path.join(folder, name) for folder, folders, names in walk for name in (*folders, *names) if os.path.islink(os.path.join(folder, name))]
    return sorted(found)


def files(spark: SparkSession, *roots: str, pattern: str | None = None) -> DataFrame:
    """Regular files under the roots: path, length, content; a file once. Links are an error; the source leaves out files without a byte.

    Content is read where it is selected and never shuffled: roots are made distinct on the driver.
    """
    ship(spark)
    links = rejected_links(roots)
    if links:
        raise ValueError(f"symbolic links among the inputs: {links[:3]}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(distinct_roots(roots))


def compression(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 6))
    out = F.when(F.length(content) == 0, F.lit(None).cast("string"))
    for name, magic in COMPRESSIONS.items():
        out = out.when(head.startswith(magic), name)
    return out


def sniff_json(text: str, complete: bool) -> str | None:
    """``json`` for one whole document, ``jsonl`` for two valid lines or more."""
    if complete and text[:1] in "{[":
        try:
            json.loads(text)
            return "json"
        except ValueError:
            pass
    good = 0
    for line in io.StringIO(text):
        if not line.strip():
            continue
        try:
            good += isinstance(json.loads(line), dict)
        except ValueError:
            return None if good < 2 else "jsonl"
        if good == 3:
            break
    return "jsonl" if good >= 2 else None


def sniff_text(text: str, complete: bool, path: str = "") -> str:
    """Format of decoded content, most specific first."""
    trimmed = text.lstrip("﻿ \t\r\n")
    low = trimmed[:512].lower()
    names = ("from:", "date:", "subject:", "message-id:")
    if text.startswith("From ") and any(line.lower().startswith(names) for line in text.splitlines()[1:40]):
        return "mbox"
    if low.startswith("warc/"):
        return "warc"
    if low.startswith(("<!doctype html", "<html")) or "<html" in low and low.startswith("<"):
        return "html"
    if low.startswith("<?xml") or (low.startswith("<") and low[1:2].isalpha() and ">" in low):
        return "xml"
    found = sniff_json(trimmed, complete)
    if found:
        return found
    if path.lower().endswith(".json") and trimmed[:1] in ("{", "[") and not complete:
        return "json"
    if "\x00" in text:
        return "unknown"
    return "markdown" if path.lower().endswith((".md", ".markdown")) else "text"


def _inflate(content: bytes, kind: str | None, most: int = SAMPLE) -> bytes | None:
    try:
        if kind == "gzip":
            with gzip.open(io.BytesIO(content)) as f:
                return f.read(most)
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor(max_window_size=1 << 28).stream_reader(io.BytesIO(content)).read(most)
    except (OSError, EOFError, ValueError, ImportError):
        return None
    except Exception as e:  # noqa: BLE001 - the decoder's own error type
        if type(e).__module__.startswith("zstandard"):
            return None
        raise
    return None


def detect_one(path: str, sample: bytes, length: int, kind: str | None) -> str:
    """Detected format of a file by its first bytes."""
    if not length:
        return "empty"
    if sample.startswith(b"PAR1"):
        return "parquet"
    if kind:
        inner = _inflate(sample, kind)
        if inner:
            found = sniff_text(inner.decode("utf-8", "replace"), False)
            return found if found in ("jsonl", "mbox") else "compressed"
        return "compressed"
    head = sample[:8].hex().upper()
    if any(head.startswith(m) for m in MEDIA.values()):
        return "media"
    complete = len(sample) >= length
    for cut in range(4):
        try:
            return sniff_text(sample[: len(sample) - cut].decode("utf-8"), complete, path)
        except UnicodeDecodeError:
            if complete:
                break
    return "unknown"


def probed(found: DataFrame) -> DataFrame:
    """(path, sha256, bytes, compression, format) of every file, with only a sample leaving the JVM."""

    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for path, sample, length, kind in batches:
            yield pd.Series([detect_one(p, bytes(s), n, k if isinstance(k, str) else None) for p, s, n, k in zip(path, sample, length, kind)])

    detect = F.pandas_udf(judge, "string")
    flat = found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), compression(F.col("content")).alias("compression"), F.substring("content", 1, SAMPLE).alias("sample"))
    return flat.select("path", "sha256", "bytes", "compression", detect("path", "sample", "bytes", "compression").alias("format"))


def changed(planned: DataFrame, now: DataFrame) -> DataFrame:
    """Planned files whose digest or size differs now, or that are gone."""
    other = now.select("path", F.col("sha256").alias("now_sha256"), F.col("bytes").alias("now_bytes"))
    return planned.join(other, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now_sha256")) | ~F.col("bytes").eqNullSafe(F.col("now_bytes")))
