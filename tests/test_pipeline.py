import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomwright import registry
from loomwright.plans import ingest
from loomwright.plans.profile import Input, Plan, Profile, choose_format
from loomwright.sources import probe, readers, sinks
from loomwright.streaming import events


def _write(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


def test_probe(spark, tmp_path):
    mbox = "From a@b Mon\nFrom: a\nSubject: s\n\nbody\n"
    made = {
        "a.txt": ("plain words", "text"), "b.md": ("# head", "markdown"), "d": (b"PAR1xxxx", "parquet"), "e.json": ('{"a": 1}', "json"), "f": ('{"a":1}\n{"a":2}\n', "jsonl"), "g": (mbox, "mbox"),
        "h": ("<!DOCTYPE html><p>x", "html"), "i": ("<?xml version='1.0'?><a/>", "xml"), "j.gz": (gzip.compress(b'{"a":1}\n{"a":2}\n'), "jsonl"), "k": (b"\x89PNG\r\n", "media"), "l": (b"\xff\xfe\x00", "unknown"), "m.gz": (gzip.compress(b"words"), "compressed"), "n": ("WARC/1.0\r\n", "warc"),
    }
    for name, (data, _) in made.items():
        _write(tmp_path, name, data)
    got = {r.path.rsplit("/", 1)[1]: r for r in probe.probed(probe.files(spark, str(tmp_path))).collect()}
    assert {n: r.format for n, r in got.items()} == {n: f for n, (_, f) in made.items()}
    assert got["a.txt"].sha256 == hashlib.sha256(b"plain words").hexdigest() and got["j.gz"].compression == "gzip"
    assert probe.detect_one("c", b"", 0, None) == "empty"
    before = probe.probed(probe.files(spark, str(tmp_path)))
    planned = spark.createDataFrame(before.collect(), before.schema)
    _write(tmp_path, "a.txt", "other words")
    assert [r.path.rsplit("/", 1)[1] for r in probe.changed(planned, probe.probed(probe.files(spark, str(tmp_path)))).collect()] == ["a.txt"]


def test_readers(spark, tmp_path):
    _write(tmp_path, "box", "From x\nSubject: a\n\none\nFrom y\nSubject: b\n\ntwo\n")
    rows = readers.mailboxes(probe.files(spark, str(tmp_path))).orderBy("position").collect()
    assert [r.text for r in rows] == ["Subject: a\n\none\n", "Subject: b\n\ntwo\n"] and rows[1].source.endswith("#message=2")
    with pytest.raises(ValueError):
        list(readers.split_mbox("no envelope\nFrom x\n".split("\n")))
    assert readers.chunk_bounds("aé€😀".encode(), 4) == [(0, 3), (3, 6), (6, 10)]
    xml = b'<r xmlns:x="u"><head lic="MIT"><title>A &eacute;</title></head><body><p>One <b>two</b>.</p><fig><p>no</p></fig><p>Three.</p></body></r>'
    root = readers.parse_xml(xml)
    assert readers.select_xml(root, "/r/body/p", ["/r/body/fig"]) == ["One two.", "Three."]
    assert readers.select_xml(root, "//p") == ["One two.", "no", "Three."] and readers.select_xml(root, "/r/head/@lic") == ["MIT"] and readers.select_xml(root, "//title") == ["A é"] and readers.select_xml(root, "/*/body/*/p") == ["no"]
    df = spark.createDataFrame([("head\n=== START\n Document text. \n=== END\nfoot",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(readers.bounded_text(F.col("t"), "=== START", "=== END")).collect()] == ["Document text.\n", None]
    assert readers.text_column(["id", "content"]) == "content"
    with pytest.raises(ValueError):
        readers.text_column(["text", "content"])


def test_profiles_are_strict():
    Profile("record-map", {"text": "a"}).checked()
    for bad in (Profile("record-map", {}), Profile("record-map", {"text": "a", "response": "b"}), Profile("other", {"text": "a"}), Profile("xml-record", {"text": "a/b"}), Profile("record-map", {"text": "a"}, on_empty="no")):
        with pytest.raises(ValueError):
            bad.checked()
    with pytest.raises(ValueError):
        Profile.parse('{"kind":"record-map","kind":"record-map"}')
    with pytest.raises(ValueError):
        Profile.parse('{"kind":"record-map","options":{"text":"a"},"more":1}')
    assert Profile.parse('{"kind":"record-map","options":{"text":"a"}}').replaces_nul
    with pytest.raises(ValueError):
        Plan((Input("p", "json", "MIT"),)).checked()
    with pytest.raises(ValueError):
        Plan((Input("p", "jsonl", "MIT", Profile("dialogue-pair", {"text": "a", "response": "b"})), Input("q", "text", "MIT"))).checked()
    assert choose_format("html", source_code=True) == "text" and choose_format("text", "jsonl", "mbox") == "mbox"


def test_ingest_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"body": "Contact first@example.org", "lic": "MIT License"}, {"body": "Contact second@example.org", "lic": "MIT License"}, {"body": " "}, {"body": "Contact third@example.org", "lic": "CC BY 4.0", "m": {"k": "v"}}]
    _write(source, "a.jsonl", "\n".join(map(json.dumps, lines)) + "\n{broken\n\n")
    _write(source, "b.txt", "plain\x20text")
    profile = Profile("record-map", {"text": "body", "license": "lic", "meta": {"k": "m.k"}})
    plan = Plan((Input(str(source / "a.jsonl"), "jsonl", "LicenseRef-D", profile), Input(str(source / "b.txt"), "text", "LicenseRef-D")))
    scan = ingest.scan_plan(spark, plan).persist()
    kept = ingest.ingested(scan).persist()
    assert kept.columns == list(ingest.CANONICAL)
    rows = sorted(((r.text, r.license, r.redacted_email_addresses, r.meta, r.email_addresses) for r in kept.collect()), key=str)
    assert rows == [("Contact <EMAIL_ADDRESS>", "CC-BY-4.0", 1, '{"k":"v"}', False), ("Contact <EMAIL_ADDRESS>", "MIT", 1, None, False), ("plain text", "LicenseRef-D", 0, None, False)]
    told = ingest.report(scan, kept).first()
    assert (told.input, told.seen, told.retained, told.duplicate, told.rejected) == (6, 4, 3, 1, {"empty": 1, "malformed": 1})
    objects = sinks.write_objects(kept, str(tmp_path / "objects"), ["content_sha256"], target=1 << 20)
    listed = objects.collect()
    assert sum(r.records for r in listed) == 3
    for r in listed:
        with open(r.object, "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r.sha256
    foot = sinks.footers(objects.select(F.col("object").alias("path"))).collect()
    assert sum(int(f["keys"]["loomwright.records"]) for f in foot) == 3
    assert sinks.verified(objects, probe.files(spark, str(tmp_path / "objects"))).count() == 0
    again = ingest.canonical_view(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "objects")))
    assert again.exceptAll(kept).count() == 0
    assert json.loads(ingest.manifest(plan, objects, "n"))["records"] == 3 and len(plan.identity()) == 64


def test_old_layouts(spark):
    old = spark.createDataFrame([("ab" * 32, "t", "s", "en", 900, 5)], "sha256 string, text string, source string, lang string, lang_score bigint, tokens bigint")
    row = ingest.canonical_view(old).first()
    assert row.language == "en" and row.token_count == 5 and row.main_content is True and row.email_addresses is None and bytes(row.content_sha256).hex() == "ab" * 32


def test_jsonl_lines(spark):
    df = spark.createDataFrame([('a "q" \\   \u007f é\n', "s", None, "", "MIT", 0, '{"a":1}')], "text string, source string, source_name string, language string, license string, token_count bigint, meta string")
    line = sinks.jsonl_lines(df).first().line
    read = json.loads(line)
    assert read["text"] == 'a "q" \\   \u007f é\n' and list(read) == ["sha256", "text", "source", "license", "meta"] and " " in line and "\\u00" not in line


def test_streaming_ingest_forgets_nothing(spark, tmp_path):
    source, known = tmp_path / "in", str(tmp_path / "known")
    source.mkdir()
    schema = "source string, text string, license string"
    for n, rows in enumerate(([("1", "a", "MIT"), ("2", "a", "MIT")], [("3", "a", "MIT"), ("4", "b", "MIT"), ("5", "a", "CC0-1.0")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        events.ingest_stream(stream, known, str(tmp_path / "state")).awaitTermination()
        assert sorted(r.source for r in spark.read.parquet(known).collect()) == [["1"], ["1", "4", "5"]][n]


def test_entry_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("test tables aren't here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    df = __spark_entry__.queries()[name](spark, d)
    out = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    mine = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    theirs = sorted(repr([plain(v) for _, v in sorted(zip(names, r))]) for r in out.fetchall())
    assert mine == theirs
