"""Queries that read files and documents made of the test tables, and their SQL counterparts.

Files are written whole into the cluster's shared folder, a task a file, read back through the
readers and removed with the driver's process.
"""

from __future__ import annotations

import atexit
import gzip
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import glob, text
from loomwright.operators import audit, catalog, filters, forecast, mapping, telemetry, training
from loomwright.plans import ingest
from loomwright.runtime import cut, shared_folder, ship, table
from loomwright.sources import probe, readers, sinks

# ---- files of the tables ------------------------------------------------------------------------


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one, as a path of the file system; it goes with the driver's process."""
    path = os.path.join(shared_folder(spark).removeprefix("file://").removeprefix("file:"), "loomwright", uuid.uuid4().hex)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def put(rows: DataFrame, where: str, packing: Column | None = None) -> None:
    """Write (name, content) rows as files; ``packing`` names a compression: '' , gzip or zstd."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content, packed in zip(pdf.name, pdf.content, pdf.packing):
                data = content.encode("utf-8", "surrogatepass")
                if packed == "gzip":
                    data = gzip.compress(data, mtime=0)
                elif packed == "zstd":
                    import zstandard

                    data = zstandard.compress(data)
                path = os.path.join(where, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)
            yield pd.DataFrame({"n": [len(pdf)]})

    ready = rows.select("name", "content", (F.lit("") if packing is None else packing).alias("packing"))
    ready.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def _number(path: Column) -> Column:
    """The number at the start of a file's name."""
    return F.regexp_extract(path, r"(\d+)[^/]*$", 1).cast("bigint")


def _items(spark, d) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "benchmark", "text")


def _stream_files(spark, d) -> tuple[DataFrame, str]:
    """The raw files as lines, every third plain, gzip and zstd."""
    lines = table(spark, d, "raw_rows").filter("payload IS NOT NULL").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "payload"))).alias("l"))
    content = F.concat(F.array_join(F.transform("l", lambda x: x["payload"]), "\n"), F.lit("\n"))
    where = folder(spark)
    put(lines.select(F.format_string("%d.jsonl", "file_id").alias("name"), content.alias("content"), "file_id"), where, F.element_at(F.array(F.lit(""), F.lit("gzip"), F.lit("zstd")), (F.col("file_id") % 3 + 1).cast("int")))
    return probe.files(spark, where), where


# ---- scans --------------------------------------------------------------------------------------


def scan_text_files(spark, d):
    where = folder(spark)
    put(table(spark, d, "lang_samples").filter("text <> ''").select(F.format_string("%d.txt", "sample_id").alias("name"), F.col("text").alias("content")), where)
    rows = readers.text_files(probe.files(spark, where))
    return rows.select(_number(F.col("path")).alias("sample_id"), F.sha2("text", 256).alias("text_sha256"), "source", "position")


def probe_formats(spark, d):
    """Fingerprints and formats of files of six kinds."""
    kind = (F.col("item_id") % 6).cast("int")
    clean = F.regexp_replace("text", r'[<>&"\\\n\r\t]', " ")
    line = F.concat(F.lit('{"text":"'), clean, F.lit('"}'))
    content = F.when(kind == 0, clean).when(kind.isin(1, 5), F.concat(line, F.lit("\n"), line, F.lit("\n"))).when(kind == 2, line).when(kind == 3, F.concat(F.lit('<?xml version="1.0"?><d><p>'), clean, F.lit("</p></d>"))).when(kind == 4, F.concat(F.lit("<!doctype html><html><p>"), clean, F.lit("</p></html>")))
    where = folder(spark)
    put(_items(spark, d).select(F.format_string("%d.bin", "item_id").alias("name"), F.coalesce(content, F.lit("")).alias("content"), "item_id"), where, F.when(F.col("item_id") % 6 == 5, "gzip").otherwise(""))
    out = probe.probed(probe.files(spark, where))
    plain = F.when(F.col("compression").isNull(), F.col("sha256"))
    return out.select(_number(F.col("path")).alias("item_id"), "format", "compression", plain.alias("sha256"))


def scan_jsonl(spark, d):
    found, _ = _stream_files(spark, d)
    return readers.json_lines(found).select(_number(F.col("path")).alias("file_id"), "position", F.sha2("text", 256).alias("line_sha256"))


def scan_jsonl_rejections(spark, d):
    """Lines by the reason for which they are rejected, the text being at ``text``."""
    found, _ = _stream_files(spark, d)
    out = readers.parsed_lines(readers.json_lines(found))
    return out.groupBy(_number(F.col("path")).alias("file_id"), F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def scan_json_documents(spark, d):
    """Arrays of the readable payloads of each file, read back as records."""
    rows = table(spark, d, "raw_rows").filter(F.schema_of_variant(F.expr("try_parse_json(payload)")).startswith("OBJECT"))
    lists = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "payload"))).alias("l"))
    where = folder(spark)
    put(lists.select(F.format_string("%d.json", "file_id").alias("name"), F.concat(F.lit("[\n"), F.array_join(F.transform("l", lambda x: x["payload"]), " ,\n"), F.lit("\n]\n")).alias("content")), where)
    return readers.json_documents(probe.files(spark, where)).select(_number(F.col("path")).alias("file_id"), "position", F.sha2("text", 256).alias("record_sha256"))


def scan_parquet_text(spark, d):
    rows = readers.parquet_text(spark, f"{d}/documents.parquet", readers.text_column(table(spark, d, "documents").columns, "text"))
    return rows.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("rows"), F.min(F.octet_length("text")).alias("bytes"), F.count_distinct("position").alias("positions"))


def parquet_row_counts(spark, d):
    return spark.createDataFrame([(name, readers.row_count(spark, f"{d}/{name}.parquet")) for name in ("documents", "text_rows", "shards", "raw_rows")], "name string, rows bigint")


def _held_positions(spark, d) -> DataFrame:
    """Row positions of the held-out documents."""
    from loomwright import registry

    held = registry.heldout_lowest_sha256(spark, d)
    at = table(spark, d, "documents").select(F.col("_metadata.row_index").alias("row_index"), F.col("doc_id").cast("string").alias("selection_id"))
    return at.join(held, "selection_id", "left_semi").select("row_index")


def rows_by_position(spark, d):
    return readers.rows_at(spark, f"{d}/documents.parquet", _held_positions(spark, d)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def text_sizes_by_position(spark, d):
    sizes = readers.text_sizes_at(spark, f"{d}/documents.parquet", _held_positions(spark, d))
    return sizes.agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))


def scan_mailboxes(spark, d):
    """A mailbox a benchmark, every second one gzipped."""
    item = F.concat(F.lit("From x@y.example Mon\nSubject: "), F.col("item_id").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    boxes = _items(spark, d).groupBy("benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", item.alias("m")))).alias("l"))
    where = folder(spark)
    put(boxes.select(F.concat(F.hex("benchmark"), F.lit(".mbox")).alias("name"), F.array_join(F.transform("l", lambda x: x["m"]), "").alias("content"), "benchmark"), where, F.when(F.length("benchmark") % 2 == 0, "gzip").otherwise(""))
    rows = readers.mailboxes(probe.files(spark, where))
    return rows.select(F.unhex(F.regexp_extract("path", r"([0-9A-F]+)\.mbox$", 1)).cast("string").alias("benchmark"), "position", F.sha2("text", 256).alias("message_sha256"))


def _xml(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def scan_xml_records(spark, d):
    """A document an item: text without its figure, source by prefix, an attribute as metadata."""
    doc = F.concat(F.lit('<?xml version="1.0"?><r:doc xmlns:r="urn:x" r:kind="'), F.col("benchmark"), F.lit('"><head><id>'), F.col("item_id").cast("string"), F.lit("</id></head><body><p>"), _xml(F.col("text")), F.lit("<fig>left out</fig></p><p>End.</p></body></r:doc>"))
    where = folder(spark)
    put(_items(spark, d).select(F.format_string("%d.xml", "item_id").alias("name"), doc.alias("content")), where)
    fields = {"text": "/doc/body//p", "source": "/doc/head/id", "kind": "/doc/@kind"}
    rows = readers.xml_records(probe.files(spark, where), fields, ["//fig"], "item:")
    return rows.select("source", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("bytes"))


def scan_bounded_text(spark, d):
    where = folder(spark)
    put(_items(spark, d).select(F.format_string("%d.txt", "item_id").alias("name"), F.concat(F.lit("head\n=== START ===\n\n"), F.col("text"), F.lit("\n\n=== END ===\n=== END ===\nfoot")).alias("content")), where)
    rows = readers.text_files(probe.files(spark, where))
    body = readers.bounded_text(F.col("text"), "=== START ===", "=== END ===")
    return rows.select(_number(F.col("path")).alias("item_id"), F.sha2(body, 256).alias("body_sha256"))


def scan_chunked_text(spark, d):
    """Texts in chunks of 300 bytes at most, put together again."""
    where = folder(spark)
    put(_items(spark, d).select(F.format_string("%d.txt", "item_id").alias("name"), F.col("text").alias("content")), where)
    each = readers.chunked_text(probe.files(spark, where), 300).groupBy(_number(F.col("path")).alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("l"))
    whole = F.array_join(F.transform("l", lambda x: x["text"]), "")
    return each.select("item_id", F.sha2(whole, 256).alias("text_sha256"), F.forall("l", lambda x: F.octet_length(x["text"]) <= 300).alias("bounded"), (F.size("l") > 1).alias("several"))


def scan_opaque_chunks(spark, d):
    where = folder(spark)
    put(_items(spark, d).select(F.format_string("%d.bin", "item_id").alias("name"), F.col("text").alias("content")), where)
    each = readers.opaque_chunks(probe.files(spark, where), 150).groupBy(_number(F.col("path")).alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("l"))
    whole = F.aggregate("l", F.lit(b""), lambda acc, x: F.concat(acc, F.unbase64(x["data"])))
    return each.select("item_id", F.sha2(whole, 256).alias("content_sha256"), F.size("l").alias("chunks"))


def canonical_layouts(spark, d):
    """An older layout's columns read into the canonical ones."""
    old = table(spark, d, "text_rows").select(F.hex("content_sha256").alias("sha256"), "text", "source", "license", F.col("language").alias("lang"), F.col("language_score").alias("lang_score"), F.col("token_count").alias("tokens"), "meta")
    rows = ingest.canonical_view(old)
    return rows.groupBy("language", "main_content", "email_addresses").agg(F.count(F.lit(1)).alias("rows"), F.sum("token_count").alias("tokens"), F.sum(F.coalesce("language_score", F.lit(0))).alias("scores"), F.sum("redacted_credentials").alias("redacted"), F.min(F.lower(F.hex("content_sha256"))).alias("least_sha256"))


# ---- mapping ------------------------------------------------------------------------------------


def mapped_license_sets(spark, d):
    """Licences that records declare, alone or as arrays, against the source's default."""
    rows = table(spark, d, "corpora").select("corpus", F.to_json(F.struct(F.col("licenses").alias("lic"))).alias("body"))
    declared, raw = mapping.declared_licenses(F.expr("parse_json(body)"), "lic")
    return rows.select("corpus", F.coalesce(F.nullif(declared, F.lit("")), F.lit("LicenseRef-Default")).alias("license"), raw.alias("license_raw"))


def dialogue_pairs(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"')).alias("q"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("c"), F.concat(F.lit("<é\\"), F.col("o_custkey").cast("string"), F.lit(">\n&")).alias("a"))).alias("body"))
    doc = F.expr("parse_json(body)")
    said = lambda p: mapping.mapped_text(doc, [p])
    messages = mapping.dialogue_pair(said("q"), said("a"), said("c"))
    return rows.select("o_orderkey", F.sha2(mapping.encode_conversation(messages), 256).alias("payload_sha256"), mapping.valid_conversation(messages).alias("valid"))


def chat_messages_mapped(spark, d):
    """Turns with aliased roles as aligned arrays, a system message before them."""
    from loomwright import registry

    turns = registry._turns(spark, d).withColumn("role", F.when(F.col("role") == "user", " Human ").otherwise("MODEL"))
    conv = mapping.turns_to_conversations(turns, "conv_id", "turn")
    body = F.to_json(F.struct(F.col("messages"), F.when(F.col("conv_id") % 3 == 0, F.lit("Be kind.")).alias("sys")))
    doc = F.expr("parse_json(body)")
    first = F.get(mapping.path_values(doc, "sys"), 0)
    messages = mapping.chat_messages(mapping.path_values(doc, "messages[].role"), mapping.path_values(doc, "messages[].content"), {"human": "user", "model": "assistant"}, first)
    return conv.select("conv_id", body.alias("body")).select("conv_id", F.when(mapping.valid_conversation(messages), F.sha2(mapping.encode_conversation(messages), 256)).alias("payload_sha256"))


def ranked_tree_paths(spark, d):
    """Orders as questions, their lines as ranked answers: the lowest rank is taken, ties by order of the lines."""
    answers = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: F.struct(F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("text"), (x["l_suppkey"] % 3).alias("rank"), F.lit("assistant").alias("role"))).alias("replies"))
    body = F.to_json(F.struct(F.concat(F.lit(" order "), F.col("l_orderkey").cast("string")).alias("text"), F.lit("user").alias("role"), F.col("replies")))
    messages = mapping.ranked_trees(body, "text", "replies", "rank", False, "role", "assistant")
    return answers.select("l_orderkey", messages.alias("m")).select("l_orderkey", F.col("m")[0]["content"].alias("question"), F.col("m")[1]["content"].alias("answer"))


def conversation_assessment(spark, d):
    """Contents of encoded conversations, joined for assessment."""
    from loomwright import registry

    conv = mapping.turns_to_conversations(registry._turns(spark, d), "conv_id", "turn")
    said = mapping.conversation_text(mapping.encode_conversation(F.col("messages")))
    return conv.select("conv_id", F.sha2(said, 256).alias("said_sha256"), text.boilerplate(said).alias("boilerplate_content"), F.coalesce(text.has_email(said), F.lit(False)).alias("email_addresses"))


def loss_masks(spark, d):
    """Masks of rendered conversations, a digit a token."""
    from loomwright import registry

    conv = mapping.turns_to_conversations(registry._turns(spark, d), "conv_id", "turn")
    bits = lambda t: F.sha2(F.array_join(F.transform(training.loss_mask(F.col("messages"), t, ["assistant"]), lambda x: F.when(x, "1").otherwise("0")), ""), 256)
    return conv.select("conv_id", bits("chatml-v1").alias("markup_sha256"), bits("user-assistant-v1").alias("plain_sha256"))


def decoded_conversations(spark, d):
    """Encoded conversations decoded again; every fifth has a member that none may have."""
    from loomwright import registry

    conv = mapping.turns_to_conversations(registry._turns(spark, d), "conv_id", "turn")
    payload = mapping.encode_conversation(F.col("messages"))
    spoiled = F.when(F.col("conv_id") % 5 == 0, F.replace(payload, F.lit('{"role":"user"'), F.lit('{"name":"x","role":"user"'))).otherwise(payload)
    decoded = conv.select("conv_id", mapping.decoded_conversation(spoiled).alias("m"))
    return decoded.select("conv_id", F.size(F.coalesce("m", F.array().cast("array<struct<role:string,content:string,context:string>>"))).alias("messages"), F.sha2(F.array_join(F.transform("m", lambda x: x["content"]), "\n"), 256).alias("contents_sha256"))


def parquet_nested_records(spark, d):
    """Nested records of a Parquet file mapped by leaf paths; other columns aren't read."""
    from loomwright.plans.profile import Input, Plan, Profile

    where = folder(spark)
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select(F.struct(F.col("text").alias("body"), F.col("lang"), F.col("n_chars")).alias("doc"), F.struct(F.struct(F.array(F.col("license")).alias("ids")).alias("terms")).alias("info"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("unused"))
    rows.coalesce(1).write.parquet(where)
    profile = Profile("record-map", {"text": "doc.body", "id": "id", "license": "info.terms.ids[]", "meta": {"lang": "doc.lang"}})
    scan = ingest.scan_plan(spark, Plan((Input(where, "parquet", "LicenseRef-D", profile),)))
    return scan.select(F.col("source").alias("id"), F.sha2("text", 256).alias("text_sha256"), "license", "meta", "reject_reason")


def conversation_redaction(spark, d):
    """A mail address in each message redacted by message; roles and order stay."""
    from loomwright import registry
    from loomwright.functions import privacy

    turns = registry._turns(spark, d).withColumn("content", F.concat(F.lit('He said:\n"mail a.'), F.col("turn").cast("string"), F.lit('@b.example" & left.')))
    conv = mapping.turns_to_conversations(turns, "conv_id", "turn")
    r = privacy.redacted_payload(mapping.encode_conversation(F.col("messages")), F.lit(True))
    return conv.select("conv_id", r.alias("r")).select("conv_id", F.sha2("r.text", 256).alias("payload_sha256"), "r.email_addresses", "r.phone_numbers")


def training_view(spark, d):
    """Training records of canonical rows by shard and position, shards in reading order."""
    rows = table(spark, d, "text_rows").join(table(spark, d, "shards").filter("sha256 IS NOT NULL").groupBy("shard_id").agg(F.min("sha256").alias("shard_sha256")), "shard_id")
    view = training.training_records(rows.withColumns({"position": F.col("row_id"), "corpus": F.col("source")}))
    return view.select("selection_id", "id", "source", "license", "language", "corpus", "unreadable").distinct()


def shard_order(spark, d):
    return training.ordered_shards(table(spark, d, "shards").filter("sha256 IS NOT NULL").select("sha256", F.col("url").alias("path")).distinct()).select("sha256", "path", F.col("position").cast("bigint").alias("position"))


# ---- sinks --------------------------------------------------------------------------------------


def _canonical(spark, d) -> DataFrame:
    from loomwright import registry

    rows = registry.first_rows(spark, d, "text", "source", "license", "token_count", "meta").filter("text IS NOT NULL")
    return rows.withColumns({"license": F.coalesce("license", F.lit("")), "token_count": F.coalesce("token_count", F.lit(0))})


def objects_written(spark, d):
    """Objects of canonical rows: sums of their footers, and how many differ from what they declare."""
    rows = _canonical(spark, d)
    where = folder(spark)
    objects = sinks.write_objects(rows, where, ["row_id"], target=1 << 18)
    told = sinks.summarized(objects)
    wrong = sinks.footer_differences(objects, rows.columns).count() + sinks.verified(objects, probe.files(spark, where)).count()
    return told.agg(F.sum("records").cast("bigint").alias("records"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("content_bytes").cast("bigint").alias("content_bytes")).withColumn("wrong", F.lit(wrong).cast("bigint"))


def footers_or_scan(spark, d):
    """Totals of objects with footers and of a plain file without, half of the licences each."""
    rows = _canonical(spark, d)
    where = folder(spark)
    objects = sinks.write_objects(rows.filter("license LIKE 'C%'"), where + "/with", ["row_id"])
    plain = where + "/without"
    rows.filter("license NOT LIKE 'C%'").coalesce(1).write.parquet(plain)
    listed = objects.select("object").unionByName(spark.read.format("binaryFile").load(plain).select(F.regexp_replace("path", "^file:(//)?", "").alias("object")))
    return sinks.summarized(listed).agg(F.sum("records").cast("bigint").alias("records"), F.sum("tokens").cast("bigint").alias("tokens"), F.sum("content_bytes").cast("bigint").alias("content_bytes"))


def attestation_states(spark, d):
    """How far objects vouch for themselves, and whether their content is what their names say."""
    where = folder(spark)
    objects = sinks.write_objects(_canonical(spark, d), where, ["row_id"])
    foot = sinks.footers(objects.select(F.col("object").alias("path"))).groupBy(audit.attestation(F.col("keys")).alias("state")).agg(F.sum("rows").alias("records"))
    broken = audit.scrub(probe.files(spark, where)).filter("NOT intact").count()
    return foot.withColumn("broken", F.lit(broken).cast("bigint"))


def native_export(spark, d):
    """Objects copied under their digests, the export's document, and what a check of it finds."""
    from loomwright.plans import contribution

    where = folder(spark)
    objects = sinks.write_objects(_canonical(spark, d), where + "/objects", ["row_id"])
    copies = cut(sinks.export_native(objects, where + "/export"))
    named = copies.select(F.regexp_extract("object", r"([^/]+)$", 1).alias("path"), "sha256", "bytes")
    document = contribution.export_document("all", named, [{"name": "made"}])
    contribution.write_export(where + "/export", document)
    found = probe.probed(probe.files(spark, where + "/export", pattern="*.parquet")).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "sha256", "bytes")
    faults = contribution.export_faults(document, found).count()
    records = spark.read.parquet(where + "/export/*.parquet").agg(F.count(F.lit(1)).alias("records"), F.sum("token_count").alias("tokens"))
    return records.withColumns({"broken": F.lit(copies.filter("NOT intact").count()).cast("bigint"), "faults": F.lit(faults).cast("bigint")})


def jsonl_written(spark, d):
    """JSON lines written in order with declared totals, and read back."""
    rows = _canonical(spark, d)
    where = folder(spark)
    totals = rows.agg(F.count(F.lit(1)), F.sum("token_count")).first()
    sinks.write_jsonl(rows, where, ["row_id"], tuple(totals))
    back = spark.read.schema("sha256 string, text string, source string, license string, tokens bigint, meta string").json(where)
    return back.select("sha256", (F.sha2("text", 256) == F.col("sha256")).alias("intact"), "source", "license", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def telemetry_file(spark, d):
    """Telemetry appended in two parts and read by its header's names."""
    where = folder(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    sinks.append_telemetry(rows.filter("event_id % 2 = 0"), where)
    sinks.append_telemetry(rows.filter("event_id % 2 = 1"), where)
    back = sinks.read_telemetry(spark, where, "event_id bigint, user_id bigint, event_type string, value double")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


def contribution_applied(spark, d):
    """Manifests of the corpora staged beside an index, applied and compared with it; then one file is changed."""
    from loomwright.plans import contribution

    where = folder(spark)
    # the fixed list of corpora: one small document each
    rows = table(spark, d, "corpora").select("corpus", "title", "license").limit(10_001).collect()
    files = {f"{r.corpus}.json": {"name": r.corpus, "title": r.title, "license": r.license} for r in rows}
    staged = contribution.stage(where + "/index", where + "/staging", files)
    contribution.apply(where + "/index", staged)
    held = lambda digests: spark.createDataFrame(sorted(digests.items()), "path string, sha256 string")
    same = catalog.tree_difference(held(staged["files"]), held(contribution.tree(where + "/index")), held(staged["files"])).count()
    with open(where + "/index/" + sorted(files)[0], "a", encoding="utf-8") as f:
        f.write(" ")
    changed = catalog.tree_difference(held(staged["files"]), held(contribution.tree(where + "/index")), held(staged["files"]))
    return changed.select("path", "state").withColumn("before", F.lit(same).cast("bigint"))


# ---- joins, totals, audits ----------------------------------------------------------------------


def artifact_sources(spark, d):
    roots = spark.createDataFrame([(p, i) for i, p in enumerate(("web/openpages", "web", "mail", "books", "civic", "science", "archive"))], "root string, position int")
    inside = table(spark, d, "text_rows").select(F.concat("source", F.lit("/part.parquet")).alias("path"), "source").filter(F.split("source", "/")[0].isin("web", "mail", "books", "civic", "science", "archive"))
    return catalog.source_of_artifact(inside.select("path").distinct(), roots)


def resolved_selection(spark, d):
    selected = table(spark, d, "corpora").select(F.explode(F.array(F.concat("corpus", F.lit(".yaml")), F.when(F.col("record_schema") == 1, F.concat("corpus", F.lit(".json"))))).alias("path")).filter("path IS NOT NULL")
    declared = table(spark, d, "text_rows").select(F.col("source").alias("declared")).union(table(spark, d, "corpora").select(F.concat("corpus", F.lit(".yaml")))).filter("declared IS NOT NULL").distinct()
    return catalog.resolved_paths(declared, selected)


def source_contexts(spark, d):
    """Corpora that meet an earlier context by title or by domain."""
    corpora = table(spark, d, "corpora").filter("title IS NOT NULL AND domain IS NOT NULL")
    fresh = corpora.select(F.col("title").alias("name"), F.col("domain").alias("url"))
    by_name = corpora.select(F.col("title").alias("name"), F.concat("domain", F.lit("/old")).alias("url"), F.col("corpus").alias("context"), F.col("corpus").alias("position"))
    by_url = corpora.select(F.concat("title", F.lit(" (old)")).alias("name"), F.col("domain").alias("url"), F.col("corpus").alias("context"), F.col("corpus").alias("position"))
    return catalog.preserved_context(fresh.distinct(), by_name.unionByName(by_url)).select("name", "url", "context")


def calibrated_profiles(spark, d):
    from loomwright import registry

    profiles = table(spark, d, "orders").select(F.col("o_orderpriority").alias("accelerator"), (F.col("o_custkey") % 6).alias("gpus")).distinct()
    out = forecast.calibrated(profiles, registry.forecast_calibration(spark, d))
    return out.select("accelerator", "gpus", F.round("calibrated_flops_per_second", 6).alias("speed"))


def license_totals_with_usage(spark, d):
    from loomwright import registry

    several = table(spark, d, "corpora").select("corpus", "licenses")
    shards = registry.shards_once(spark, d).withColumn("corpus", F.get("sources", 0)).join(several, "corpus", "left").select("shard_id", F.coalesce("licenses", F.array("license")).alias("licenses"), "docs", "tokens", "bytes")
    return catalog.totals_with_usage(shards, registry.license_usage_totals(spark, d).filter("license IS NOT NULL"))


def pruned_objects(spark, d):
    """Objects to remove until a third of all bytes is left, oldest first, those of one format in use."""
    from loomwright import registry

    objects = registry.shards_once(spark, d).filter("sha256 IS NOT NULL AND bytes IS NOT NULL AND created_at IS NOT NULL").select("sha256", "bytes", F.col("created_at").alias("used_at"), F.coalesce(F.col("format") == "jsonl", F.lit(False)).alias("in_use"))
    objects = objects.groupBy("sha256").agg(F.min("bytes").alias("bytes"), F.max("used_at").alias("used_at"), F.bool_or("in_use").alias("in_use"))
    total = objects.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return catalog.prune_oldest(objects, int(total) // 3).select("sha256")


def attempts_seconds(spark, d):
    """Active seconds of each user's days, from the day's first to its last event."""
    spans = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").cast("timestamp").alias("started"), F.max("ts").cast("timestamp").alias("finished"))
    runs = spans.groupBy("user_id").agg(F.collect_list(F.struct("started", "finished")).alias("attempts"), F.min("started").alias("a"), F.max("finished").alias("b"))
    return runs.select("user_id", F.round(telemetry.active_seconds(F.col("attempts"), F.col("a"), F.col("b")), 3).alias("seconds"))


def run_advice_table(spark, d):
    """Advice on runs made of the events of each user: losses from their values, states from their types."""
    ends = telemetry.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_type"])
    state = F.element_at(F.array(*map(F.lit, ("running", "failed", "complete", "planned"))), (F.col("user_id") % 4 + 1).cast("int"))
    runs = ends.select(
        F.col("user_id").alias("run"), state.alias("state"), F.when(F.col("user_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("last_value")).alias("loss"), F.col("first_value").alias("first_heldout"), F.col("last_value").alias("last_heldout"),
        F.when(F.col("user_id") % 5 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("observed_at"), (F.col("user_id") % 100).alias("step"), F.lit(100).alias("planned_steps"),
        F.when(F.col("user_id") % 7 == 0, F.lit("out of memory")).otherwise(F.lit("")).alias("error"),
    )
    return telemetry.run_advice(runs, F.lit("2024-02-01 00:05:00").cast("timestamp"))


def observation_bounds(spark, d):
    seen = table(spark, d, "lineitem").select(
        F.format_string("%d-%d", "l_orderkey", "l_linenumber").alias("run"), F.col("l_quantity").cast("bigint").alias("steps"), F.lit(45).alias("planned_steps"), F.col("l_partkey").alias("consumed_tokens"), F.col("l_suppkey").alias("planned_tokens"),
        F.when(F.col("l_linenumber") == 7, F.lit(float("inf"))).otherwise(F.col("l_tax") - 0.01).alias("final_loss"), F.col("l_shipdate").alias("started_at"), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz").alias("finished_at"),
    )
    return telemetry.observation_faults(seen).groupBy("rule").agg(F.count(F.lit(1)).alias("runs"))


def evaluation_windows(spark, d):
    """Windows of each item's own byte tokens."""
    tokens = training.byte_tokens(F.col("text"))
    rows = table(spark, d, "eval_items").filter("text <> ''").select("item_id", training.record_windows(tokens, 64).alias("w"))
    return rows.select("item_id", F.posexplode("w").alias("n", "t")).select("item_id", "n", F.size("t").alias("tokens"), F.aggregate("t", F.lit(0), lambda a, x: a + x).alias("sum"))


def packed_windows(spark, d):
    """Items packed into one stream of tokens with ends, in windows; targets by window."""
    tokens = table(spark, d, "eval_items").filter("text IS NOT NULL").select("item_id", F.octet_length("text").cast("bigint").alias("tokens"), "text")
    placed = training.token_offsets(tokens, ["item_id"])
    each = placed.select("offset", F.posexplode(F.concat(training.byte_tokens(F.col("text")), F.array(F.lit(training.EOS)))).alias("i", "token")).select((F.col("offset") + F.col("i")).alias("position"), "token", F.lit(True).alias("supervised"))
    out = training.windows(each, 256)
    return out.select("window", F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum"), F.size(F.filter("mask", lambda x: x)).alias("targets"))


def corpus_consumption(spark, d):
    """Supervised targets of packed windows by the benchmark that they start in."""
    lengths = table(spark, d, "eval_items").filter("text IS NOT NULL").select("benchmark", F.octet_length("text").alias("n"))
    packed = lengths.select(F.col("benchmark").alias("corpus"), F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda i: (i % 3 != 0) & (F.col("n") > 0)).alias("mask"))
    return training.consumption(packed)


def recommended_presets(spark, d):
    presets = table(spark, d, "part").select(F.col("p_name").alias("name"), (F.col("p_size").cast("bigint") * 1000 + F.col("p_partkey") % 1000).alias("parameters"))
    tokens = table(spark, d, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return forecast.recommended(presets, tokens).select("name", "parameters")


def model_names(spark, d):
    """Part names that one of several patterns matches."""
    keep = glob.matches(F.col("p_name"), ["*green*", "a*[a-m]", "?lue*"])
    return table(spark, d, "part").filter(keep).select("p_partkey")


def referential_inner_join(spark, d):
    """Rows of shards that exist, and those of none, which are errors."""
    shards = table(spark, d, "shards").select("shard_id", "format").groupBy("shard_id").agg(F.min("format").alias("format"))
    rows = table(spark, d, "text_rows").select("row_id", "shard_id")
    return rows.join(shards, "shard_id", "left").groupBy("format").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("shard_id").isNull()).alias("without_shard"))


def filter_faults(spark, d):
    """Which of the licence patterns of the corpora are valid as filters."""
    patterns = ["CC*", "[a-", "MIT\\", "", "a?", "[]", "Apache-[0-9]*"]

    def fault(p: str) -> bool:
        try:
            filters.ValueFilter((p,)).validate(p)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(p, fault(p)) for p in patterns], "pattern string, fault boolean")


# ---- ingestion, indexes, stores ---------------------------------------------------------------


def _record_plan(spark, d):
    """Items as records of two line files, the second repeating the first with other addresses, and a text file each."""
    from loomwright.plans.profile import Input, Plan, Profile

    where = folder(spark)
    base = _items(spark, d)
    doc = lambda address: F.to_json(F.struct(F.struct(F.concat(F.col("text"), F.lit(f" Write to {address}.")).alias("text"), F.col("item_id").cast("string").alias("id")).alias("body"), F.array(F.lit("MIT License"), F.when(F.col("item_id") % 2 == 0, "CC BY 4.0")).alias("lic"), (F.col("item_id") % 3 == 0).alias("main"), F.col("benchmark").alias("from")))
    for name, address in (("a", "one@first.example"), ("b", "two@second.example")):
        lines = base.groupBy(F.lit(name).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", doc(address).alias("j")))), lambda x: x["j"]), "\n").alias("content"))
        put(lines.select(F.concat("n", F.lit(".jsonl")).alias("name"), F.concat("content", F.lit('\n\n{broken\n{"body":{"text":" "}, "main":false}\n')).alias("content")), where, F.lit("gzip" if name == "b" else ""))
    profile = Profile("record-map", {"text": "body.text", "id": "body.id", "license": "lic", "meta": {"origin": "from", "ids": "body.id"}}, main_content={"main": False})
    return ingest.scan_plan(spark, Plan(tuple(Input(f"{where}/{n}.jsonl", "jsonl", "LicenseRef-D", profile) for n in ("a", "b"))))


def ingest_records(spark, d):
    """Line files through mapping, redaction, deduplication by licence and assessment."""
    kept = ingest.ingested(_record_plan(spark, d))
    return kept.select(F.lower(F.hex("content_sha256")).alias("sha256"), "source", "license", "license_raw", "meta", "main_content", "email_addresses", "redacted_email_addresses", "token_count")


def ingest_report(spark, d):
    held = ingest.written(_record_plan(spark, d))
    told = ingest.report(held, ingest.ingested(held))
    return told.select("input", "seen", "retained", "duplicate", F.col("rejected")["malformed"].alias("malformed"), F.col("rejected")["empty"].alias("empty"))


def planned_formats(spark, d):
    """Formats that a plan finds in a folder of text and line files."""
    where = folder(spark)
    clean = F.regexp_replace("text", r'[<>&"\\\n\r\t]', " ")
    line = F.concat(F.lit('{"text":"'), clean, F.lit('"}\n'))
    put(_items(spark, d).filter("text <> ''").select(F.format_string("%d.bin", "item_id").alias("name"), F.when(F.col("item_id") % 2 == 0, clean).otherwise(F.concat(line, line)).alias("content")), where)
    plan = ingest.planned(spark, [where], "MIT", text_column="text")
    return spark.createDataFrame([(i.format, os.path.basename(i.path)) for i in plan.inputs], "format string, name string")


def _index(spark, d, spoil: bool = False) -> str:
    """An index of the corpora on disk: a manifest of its shards for each that has any."""
    import json

    from loomwright import registry

    where = folder(spark)
    shards = registry.shards_once(spark, d).filter("sha256 IS NOT NULL").select("sha256", F.get("sources", 0).alias("corpus"), "docs", "tokens", "bytes", "license").filter("corpus IS NOT NULL")
    one = shards.groupBy("corpus", "sha256").agg(*[F.max(F.coalesce(m, F.lit(0))).alias(m) for m in catalog.MEASURES], F.max("license").alias("license"))
    # the catalogue is of driver size: its manifests are documents
    rows = one.orderBy("corpus", "sha256").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("more than 1,000,000 shards in an index")
    manifests: dict[str, list] = {}
    for r in rows:
        manifests.setdefault(r.corpus, []).append({"sha256": r.sha256, "docs": r.docs, "tokens": r.tokens, "bytes": r.bytes, "licenses": [r.license] if r.license else [], "sources": [r.corpus]})
    names = [c.replace("/", "-") + ".json" for c in sorted(manifests)]
    os.makedirs(where)
    with open(f"{where}/index.json", "w", encoding="utf-8") as f:
        json.dump({"entries": sorted(names)}, f)
    for corpus, held in manifests.items():
        body = {"name": corpus, "sources": [{"name": corpus}], "shards": held, "docs": sum(h["docs"] for h in held) + (1 if spoil else 0)}
        if spoil and len(corpus) % 2:
            body["sources"] = [{"name": corpus, "category": "web-crawl"}]
        with open(f"{where}/{corpus.replace('/', '-')}.json", "w", encoding="utf-8") as f:
            json.dump(body, f)
    return where


def index_bom(spark, d):
    """Totals of a loaded index by manifest and licence, by manifest, and over all."""
    from loomwright.operators import index

    out = index.bom(index.shard_rows(spark, _index(spark, d)))
    return out.select("level", "manifest", "license", "shards", "docs", "tokens", "bytes")


def index_faults(spark, d):
    """Faults of a sound index, none, and of one with wrong sums and sources without acquisition."""
    from loomwright.operators import index

    sound = index.verify(_index(spark, d))
    found = index.verify(_index(spark, d, spoil=True))
    rows = [(f.split(": ", 1)[0], f.split(": ", 1)[1].rsplit(": ", 1)[-1]) for f in found]
    return spark.createDataFrame(rows, "manifest string, fault string").withColumn("sound", F.lit(len(sound)).cast("bigint"))


def disclosure_gaps(spark, d):
    from loomwright.operators import index

    sources = table(spark, d, "corpora").select(F.col("corpus").alias("name"), "license", "collected_from", "collected_to", F.array_join("languages", ",").alias("languages"))
    return index.disclosure_gaps(sources)


def store_round_trip(spark, d):
    """Items published to a store under their digests, journaled, fetched through a mirror that lacks them, and listed."""
    import hashlib

    from loomwright.sources import objects

    where = folder(spark)
    os.makedirs(where + "/local")
    held = []
    # the fixed held-out items: a few thousand small objects at most
    for r in _items(spark, d).filter("text <> ''").limit(10_001).collect():
        digest = hashlib.sha256(r.text.encode()).hexdigest()
        with open(f"{where}/local/{r.item_id}", "wb") as f:
            f.write(r.text.encode())
        held.append((f"{where}/local/{r.item_id}", digest))
    store, empty = objects.Store(spark, f"file://{where}/store"), objects.Store(spark, f"file://{where}/none")
    objects.publish_all(held, store, objects.Journal(f"{where}/journal", "plan"))
    fetched = {digest: os.path.getsize(objects.fetch_any([empty, store], digest, where + "/cache")) for _, digest in held}
    there = dict(objects.available([empty, store], sorted(fetched.items())))
    listed = objects.inventory(spark, f"{where}/store")
    fetched_rows = spark.createDataFrame([(k, v, there[k]) for k, v in sorted(fetched.items())], "sha256 string, fetched bigint, available boolean")
    return listed.join(fetched_rows, "sha256", "full_outer").select("sha256", "bytes", "fetched", "available")


def objects_against_index(spark, d):
    """Declared totals of shards against those of their rows, some objects missing or broken."""
    shards = table(spark, d, "shards").filter("sha256 IS NOT NULL AND docs IS NOT NULL AND tokens IS NOT NULL AND bytes IS NOT NULL")
    declared = shards.select(F.lit("m").alias("manifest"), "sha256", "docs", "tokens", "bytes")
    told = declared.groupBy("sha256").agg(F.min("docs").alias("records"), (F.min("tokens") + F.min("docs") % 2).alias("tokens"), F.min("bytes").alias("content_bytes"))
    found = declared.select(F.col("sha256").alias("name"), (F.substring("sha256", 1, 1) > "3").alias("intact")).distinct().filter(F.substring("name", 1, 1) != "f")
    return audit.object_faults(declared, told, found)


def handoff_inventory(spark, d):
    """A hand-off manifest of item files against their folder, where one is gone, one is new and one differs."""
    from loomwright.plans import contribution

    where = folder(spark)
    content = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    put(_items(spark, d).select(F.format_string("%d.txt", "item_id").alias("name"), content.alias("content")), where)
    probed = lambda: probe.probed(probe.files(spark, where)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "sha256", "bytes")
    manifest = {"name": "items", **contribution.export_document("items", probed(), [])}
    names = sorted(f["path"] for f in manifest["files"])
    os.remove(f"{where}/{names[0]}")
    with open(f"{where}/{names[1]}", "a") as f:
        f.write("!")
    with open(f"{where}/new.txt", "w") as f:
        f.write("new")
    return contribution.handoff_faults(manifest, probed())


def worker_frames(spark, d):
    """Frames of a worker's input over the items."""
    items = _items(spark, d).filter("text IS NOT NULL")
    lines = list(sinks.worker_lines({"run": 1}, items, ["item_id"]))  # the fixed held-out items
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n bigint, line string").select("n", F.sha2("line", 256).alias("line_sha256"))


def calibration_text_digest(spark, d):
    """The calibration sample as one text, bounded by its budget."""
    from loomwright import registry
    from loomwright.functions import hashing
    from loomwright.operators import sampling

    rows = registry.documents(spark, d).withColumn("score", hashing.evaluation_score(sampling.CALIBRATION_SEED, F.col("doc_id").cast("string")))
    sample = sampling.calibration_sample(rows.select("doc_id", "text", "score"), ["score", "doc_id"])
    return spark.createDataFrame([(sinks.calibration_text(sample, ["score", "doc_id"]),)], "body string").select(F.sha2("body", 256).alias("sha256"), F.octet_length("body").alias("bytes"))


def manifest_document(spark, d):
    """The manifest of written objects, read back."""
    from loomwright.plans.profile import Input, Plan

    objects = sinks.write_objects(_canonical(spark, d), folder(spark), ["row_id"])
    body = ingest.manifest(Plan((Input("a", "text", "MIT"),)), objects, "all")
    one = spark.createDataFrame([(body,)], "body string").select(F.from_json("body", "name string, plan string, records bigint, shards array<struct<sha256: string, records: bigint>>").alias("m"))
    return one.select("m.name", F.length("m.plan").alias("plan_digits"), "m.records", F.aggregate("m.shards", F.lit(0).cast("bigint"), lambda a, x: a + x["records"]).alias("shard_records"))


def disclosure_corpora(spark, d):
    """Corpora that the data plans weigh, once each, with their uses and policies."""
    from loomwright.operators import index

    uses = table(spark, d, "data_plans").select(F.explode("corpus_weights").alias("corpus", "w"), F.coalesce("order_policy", F.lit("")).alias("stage"))
    return index.disclosed_corpora(uses.select(F.sha2("corpus", 256).alias("bom_sha256"), "corpus", "stage"))


def disclosure_gap_counts(spark, d):
    from loomwright.operators import index

    return index.gap_counts(disclosure_gaps(spark, d))


def publication_states(spark, d):
    """Shards of the older half published, those that rows use assembled."""
    from loomwright.operators import index

    shards = table(spark, d, "shards").filter("sha256 IS NOT NULL").groupBy("shard_id").agg(F.min("sha256").alias("sha256"), F.min("url").alias("url"), F.min("created_at").alias("created_at"))
    middle = shards.agg(F.percentile_approx(F.col("created_at").cast("timestamp").cast("double"), 0.5, 1_000_000).alias("m"))
    old = shards.join(middle, F.col("created_at").cast("timestamp").cast("double") < F.col("m")).select("sha256", F.coalesce("url", F.lit("")).alias("url"))
    used = shards.join(table(spark, d, "text_rows").select("shard_id").distinct(), "shard_id", "left_semi")
    return index.kept_publications(old, used).groupBy("state").agg(F.count(F.lit(1)).alias("objects"))


def assessment_sums(spark, d):
    """Flags and redactions of rows summed by source, against the sums of their shards."""
    rows = table(spark, d, "text_rows")
    shards = catalog.shard_summary(rows, ["source", "shard_id"]).drop("licenses")
    declared = shards.groupBy("source").agg(*[F.sum(c).alias(c) for c in shards.columns if c not in ("source", "shard_id")])
    # the manifest of one source tells another number
    spoiled = declared.withColumn("email_addresses_records", F.col("email_addresses_records") + (F.col("source") == "web/openpages").cast("bigint"))
    computed = catalog.shard_summary(rows, ["source"])
    return catalog.reconcile(spoiled, computed, "source", ["records", "email_addresses_records", "repetitive_content_records", "redacted_email_addresses", "redacted_credentials"])


def resolved_parameters(spark, d):
    """Steps, capacity and defaults that each data plan's token budget resolves to."""
    from loomwright.plans import parameters

    rows = table(spark, d, "data_plans").select("plan_id", "requested_tokens", "shuffle_buffer_records").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 plans")
    out = []
    for r in rows:
        if r.requested_tokens:
            x = parameters.resolve(parameters.Parameters(4, 256, 1e-3, tokens=r.requested_tokens, shuffle_records=r.shuffle_buffer_records, profile="balanced"))
            out.append((r.plan_id, x.steps, x.epochs, x.token_capacity, x.warmup_steps, x.checkpoint_every, x.shuffle_records, x.order, round(x.rate_at(0), 12), round(x.rate_at(x.steps), 12)))
    return spark.createDataFrame(out, "plan_id bigint, steps bigint, epochs bigint, token_capacity bigint, warmup_steps bigint, checkpoint_every bigint, shuffle_records bigint, policy string, first_rate double, last_rate double")


_NO_QUERIES = {"folder", "put", "table", "cut", "ship", "shared_folder"}


def queries() -> dict:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _NO_QUERIES}
    own.pop("queries", None)
    return own
