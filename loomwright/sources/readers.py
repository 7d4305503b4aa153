"""Adapters from files to rows of (text, source, position, meta).

Line and record formats are read as streams: a task opens a file by its path, hashes it, decodes it
piece by piece and gives rows in batches of ``ROWS``, so that neither a file nor its inflated
content is ever one value. A file is read twice, once for the digest that its rows name, and it is
an error when it changes in between. Whole-document formats (XML, bounded text) hold one document.
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import hashlib
import io
import json
import lzma
import re
from collections.abc import Iterator
from html import unescape
from html.entities import name2codepoint
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.runtime import ship
from loomwright.sources import probe

ZSTD_WINDOW = 1 << 28
#: Rows of a batch, and bytes read at a time.
ROWS, PIECE = 1_000, 1 << 20


def opened(path: str):
    """A file as a stream of its bytes, on any file system that Arrow knows."""
    from pyarrow import fs

    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" not in local:
        return open(local, "rb")
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inside)


def inflated(stream) -> io.BufferedIOBase:
    """A stream of the decompressed bytes, by the leading ones."""
    ahead = io.BufferedReader(stream if isinstance(stream, io.RawIOBase) else _Raw(stream), PIECE)
    head = ahead.peek(6)[:6].hex().upper()
    if head.startswith(probe.COMPRESSIONS["gzip"]):
        return gzip.GzipFile(fileobj=ahead)
    if head.startswith(probe.COMPRESSIONS["bzip2"]):
        return bz2.BZ2File(ahead)
    if head.startswith(probe.COMPRESSIONS["xz"]):
        return lzma.LZMAFile(ahead)
    if head.startswith(probe.COMPRESSIONS["zstd"]):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW).stream_reader(ahead, read_across_frames=True), PIECE)
    return ahead


class _Raw(io.RawIOBase):
    """Any object with ``read`` as a raw stream."""

    def __init__(self, stream):
        self._stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self._stream.read(len(into))
        into[: len(data)] = data
        return len(data)


def inflate(content: bytes) -> bytes:
    """Whole content, decompressed by its leading bytes."""
    return inflated(io.BytesIO(content)).read()


def digest_of(path: str) -> str:
    out = hashlib.sha256()
    with opened(path) as f:
        while piece := f.read(PIECE):
            out.update(piece)
    return out.hexdigest()


class _Watched:
    """A stream that hashes what is read through it."""

    def __init__(self, stream):
        self._stream, self.digest = stream, hashlib.sha256()

    def read(self, size: int = -1) -> bytes:
        data = self._stream.read(size)
        self.digest.update(data)
        return data


def text_lines(stream) -> Iterator[str]:
    """Lines between line feeds of a byte stream, decoded; bytes that aren't UTF-8 are replaced."""
    decoder, left = codecs.getincrementaldecoder("utf-8")("replace"), []
    while True:
        piece = stream.read(PIECE)
        parts = decoder.decode(piece, final=not piece).split("\n")
        if len(parts) > 1:
            yield "".join(left) + parts[0]
            yield from parts[1:-1]
            left = [parts[-1]]
        else:
            left.append(parts[0])
        if not piece:
            yield "".join(left)
            return


def _rows(found: DataFrame, split, schema: str) -> DataFrame:
    """Apply a splitter of (path, digest, stream of the file) to every file; only paths travel to it."""
    ship(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf.path:
                digest, held = digest_of(path), []
                with opened(path) as f:
                    watched = _Watched(f)
                    for row in split(path, digest, watched):
                        held.append(row)
                        if len(held) == ROWS:
                            yield pd.DataFrame(held)
                            held = []
                    while watched.read(PIECE):
                        pass
                if watched.digest.hexdigest() != digest:
                    raise ValueError(f"{path} changed while it was read")
                if held:
                    yield pd.DataFrame(held)

    return found.select("path").mapInPandas(run, schema)


TEXT_ROWS = "path string, source string, position bigint, text string, meta string"


def text_files(found: DataFrame) -> DataFrame:
    """One file, one row; content that isn't NUL-free UTF-8 has a null text."""
    body = F.try_validate_utf8(F.col("content").cast("string"))
    clean = F.when(F.instr(body, "\x00") == 0, body)
    return found.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source"), F.lit(0).cast("bigint").alias("position"), clean.alias("text"), F.lit(None).cast("string").alias("meta"))


def chunk_bounds(data: bytes, most: int) -> list[tuple[int, int]]:
    """Byte ranges of at most ``most`` bytes that end between characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append((at, end if end > at else min(at + most, len(data))))
        at = out[-1][1]
    return out


def chunked_text(found: DataFrame, most: int) -> DataFrame:
    """Texts over the record size in chunks, each telling its number and file."""

    def split(path, digest, stream):
        body = inflated(stream)
        # every chunk tells how many there are, so they are counted before
        with opened(path) as again:
            count = sum(1 for _ in _pieces(inflated(again), most))
        for i, piece in enumerate(_pieces(body, most), 1):
            meta = {"chunk": i, "chunks": count, "representation": "text-chunk", "source_path": path.rsplit("/", 1)[-1]}
            yield {"path": path, "source": f"sha256:{digest}#chunk={i}" if count > 1 else f"sha256:{digest}", "position": i, "text": piece.decode("utf-8", "replace"), "meta": json.dumps(meta, separators=(",", ":"), sort_keys=True) if count > 1 else None}

    return _rows(found, split, TEXT_ROWS)


def _pieces(stream, most: int) -> Iterator[bytes]:
    """Byte pieces of at most ``most`` that end between characters."""
    left = b""
    while True:
        data = left + stream.read(most - len(left))
        if not data:
            return
        bounds = chunk_bounds(data, most)
        end = bounds[0][1]
        if len(data) == most:
            # a character may go on behind the piece
            start = end
            while start > max(0, end - 4) and data[start - 1] & 0xC0 == 0x80:
                start -= 1
            lead = data[start - 1] if start else 0
            needs = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            if start and end - (start - 1) < needs and start - 1 > 0:
                end = start - 1
        yield data[:end]
        left = data[end:]


def json_lines(found: DataFrame) -> DataFrame:
    """A row a line that isn't blank, compressed or not: (path, source, position, text = the line)."""

    def split(path, digest, stream):
        for i, line in enumerate(text_lines(inflated(stream)), 1):
            if line.strip():
                yield {"path": path, "source": f"sha256:{digest}#line={i}", "position": i, "text": line.rstrip("\r"), "meta": None}

    return _rows(found, split, TEXT_ROWS)


def parsed_lines(lines: DataFrame, text_path: str = "text") -> DataFrame:
    """JSON lines with their document and, where it can't be read or lacks text, the reason."""
    doc = lines.withColumn("doc", F.expr("try_parse_json(text)"))
    # an object or an array is no text
    kind = F.schema_of_variant(F.try_variant_get("doc", f"$.{text_path}", "variant"))
    value = F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get("doc", f"$.{text_path}", "string"))
    reason = F.when(F.col("doc").isNull() | ~F.schema_of_variant("doc").startswith("OBJECT"), "malformed").when(value.isNull(), "mapping").when(F.trim(value) == "", "empty")
    return doc.select("path", "source", "position", value.alias("text"), "doc", reason.alias("reject_reason"))


def json_values(stream) -> Iterator[str | None]:
    """JSON texts of a top-level object, or of the values of a top-level array, one at a time; a last None where the rest can't be read."""
    decoder, reader = json.JSONDecoder(), codecs.getreader("utf-8")(stream)
    buffer, at, ended = "", 0, False

    def more() -> bool:
        nonlocal buffer, at, ended
        piece = reader.read(PIECE)
        ended = not piece
        buffer, at = buffer[at:] + piece, 0
        return not ended

    def blank() -> str:
        """The next character that isn't white space, '' at the end."""
        nonlocal at
        while True:
            while at < len(buffer) and buffer[at] in " \t\r\n\ufeff":
                at += 1
            if at < len(buffer) or not more():
                return buffer[at : at + 1]

    try:
        listed = blank() == "["
        if listed:
            at += 1
            if blank() == "]":
                at += 1
                if blank():
                    yield None
                return
        while True:
            if not blank():
                yield None
                return
            while True:
                try:
                    _, end = decoder.raw_decode(buffer, at)
                    if end < len(buffer) or ended:
                        break
                except ValueError:
                    if ended:
                        yield None
                        return
                more()
            value, at = buffer[at:end], end
            yield value
            following = blank()
            if listed and following == ",":
                at += 1
                continue
            if listed and following == "]":
                at += 1
                following = blank()
                if following:
                    yield None
                return
            if following or listed:
                yield None
            return
    except UnicodeDecodeError:
        yield None


def json_documents(found: DataFrame) -> DataFrame:
    """A top-level object, or the objects of a top-level array: a row each, as JSON text; what can't be read is a row with a null text."""

    def split(path, digest, stream):
        for i, value in enumerate(json_values(inflated(stream)), 1):
            yield {"path": path, "source": f"sha256:{digest}#record={i}", "position": i, "text": value, "meta": None}

    return _rows(found, split, TEXT_ROWS)


def parquet_text(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One text column of Parquet files with each row's position; other columns aren't read."""
    rows = spark.read.parquet(path).select(F.col(column).alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("position"))
    return rows.select("path", F.concat(F.col("path"), F.lit("#row="), F.col("position").cast("string")).alias("source"), "position", "text")


def text_column(columns: list[str], wanted: str | None = None) -> str:
    """The text column: the one asked for, or the only usual one."""
    usual = [c for c in ("text", "content", "document") if c in columns]
    if wanted:
        if wanted not in columns:
            raise ValueError(f"no column {wanted!r}")
        return wanted
    if len(usual) != 1:
        raise ValueError(f"text column isn't clear among {usual}")
    return usual[0]


def rows_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Rows of one file by position; the positions (a sample) are the small side by measured size."""
    rows = spark.read.parquet(path).withColumn("row_index", F.col("_metadata.row_index"))
    return rows.join(positions, "row_index", "left_semi")


def text_sizes_at(spark: SparkSession, path: str, positions: DataFrame, column: str = "text") -> DataFrame:
    """(row_index, bytes) of texts by position; one column is read."""
    sizes = spark.read.parquet(path).select(F.col("_metadata.row_index").alias("row_index"), F.coalesce(F.octet_length(column), F.lit(0)).alias("bytes"))
    return sizes.join(positions.select("row_index"), "row_index", "left_semi")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet file or folder; Spark counts from the footers, no column is read."""
    return spark.read.parquet(path).count()


def split_mbox(lines: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Messages of a mailbox without their envelope lines, from its lines; content before the first envelope is an error."""
    number, held = 0, []
    for line in lines:
        if line.startswith("From "):
            if number:
                yield number, "\n".join([*held, ""])
            elif any(x.strip() for x in held):
                raise ValueError("content before the first envelope")
            number, held = number + 1, []
        else:
            held.append(line)
    if number:
        yield number, "\n".join(held)
    elif any(x.strip() for x in held):
        raise ValueError("content before the first envelope")


def mailboxes(found: DataFrame) -> DataFrame:
    def split(path, digest, stream):
        for i, message in split_mbox(text_lines(inflated(stream))):
            yield {"path": path, "source": f"sha256:{digest}#message={i}", "position": i, "text": message, "meta": None}

    return _rows(found, split, TEXT_ROWS)


def bounded_text(body: Column, start: str, stop: str) -> Column:
    """Text strictly between the first match of one pattern and the next match of the other, and a line feed."""
    found = F.regexp_extract(body, f"(?s)\\A.*?(?:{start})(.*?)(?:{stop})", 1) if not re.search(r"(?<!\\)\((?!\?)", start) else None
    if found is None:
        raise ValueError("bounds may not hold capturing groups")
    trimmed = F.regexp_replace(found, r"^\s+|\s+\z", "")
    return F.when(trimmed != "", F.concat(trimmed, F.lit("\n")))


def opaque_chunks(found: DataFrame, size: int = 256 << 10) -> DataFrame:
    """Binary files as base64 chunks: (path, chunk, data), chunks from 0."""
    import base64

    def split(path, digest, stream):
        chunk = 0
        while data := stream.read(size):
            yield {"path": path, "chunk": chunk, "data": base64.b64encode(data).decode()}
            chunk += 1

    return _rows(found, split, "path string, chunk int, data string")


# ---- XML records --------------------------------------------------------------------------------


def parse_xml(content: bytes) -> ElementTree.Element:
    """Tolerant parse: named HTML entities are known, a broken tail is cut at the last closed element."""
    text = content.decode("utf-8", "replace")
    text = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m.group() if m.group(1) in ("amp", "lt", "gt", "quot", "apos") or m.group(1) not in name2codepoint else unescape(m.group()), text)
    return ElementTree.fromstring(text)


def _steps(selector: str) -> tuple[list[tuple[bool, str]], str | None]:
    attribute = None
    if "@" in selector.rsplit("/", 1)[-1]:
        selector, _, attribute = selector.rpartition("/@")
    steps = []
    for deep, name in re.findall(r"(//?)((?:\{[^}]*\})?[^/{]+)", selector):
        steps.append((deep == "//", name if name.startswith("{") else name.rpartition(":")[2]))
    return steps, attribute


def _fits(tag: str, name: str) -> bool:
    return name == "*" or tag == name or (not name.startswith("{") and tag.rpartition("}")[2] == name)


def _match(path: list[str], steps: list[tuple[bool, str]]) -> bool:
    if not steps:
        return not path
    deep, name = steps[-1]
    if not path or not _fits(path[-1], name):
        return False
    rest = path[:-1]
    return any(_match(rest[:k], steps[:-1]) for k in range(len(rest), -1, -1)) if deep else _match(rest, steps[:-1])


def select_xml(root: ElementTree.Element, selector: str, excludes: list[str] = ()) -> list[str]:
    """Values of a path subset: names, ``*``, ``//``, ``{namespace}name``, a final ``@attribute``; white space collapsed."""
    steps, attribute = _steps(selector)
    barred = [_steps(e)[0] for e in excludes]
    out: list[str] = []

    def said(node, path) -> Iterator[str]:
        yield node.text or ""
        for child in node:
            below = [*path, child.tag]
            if not any(_match(below, b) for b in barred):
                yield from said(child, below)
            yield child.tail or ""

    def walk(node, path):
        if any(_match(path, b) for b in barred):
            return
        if _match(path, steps):
            value = node.get(attribute) if attribute else " ".join("".join(said(node, path)).split())
            if value:
                out.append(value)
        for child in node:
            walk(child, [*path, child.tag])

    walk(root, [root.tag])
    return out


def xml_records(found: DataFrame, fields: dict[str, str], excludes: list[str] = (), source_prefix: str = "", skip_malformed: bool = True) -> DataFrame:
    """One file, one record: text, and further fields as JSON in ``meta``."""

    def split(path, digest, stream):
        try:
            root = parse_xml(inflated(stream).read())
        except ElementTree.ParseError:
            if not skip_malformed:
                raise
            return
        values = {name: select_xml(root, sel, excludes) for name, sel in fields.items()}
        body = "\n\n".join(values.pop("text", []))
        names = values.pop("source", [])
        meta = {k: v[0] if len(v) == 1 else v for k, v in sorted(values.items()) if v}
        yield {"path": path, "source": source_prefix + (names[0] if names else f"sha256:{digest}"), "position": 1, "text": body + "\n" if body else None, "meta": json.dumps(meta, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if meta else None}

    return _rows(found, split, TEXT_ROWS)
