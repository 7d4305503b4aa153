"""Streaming readers, written scans, objects, exports and contributions."""

import gzip
import io
import json
import os

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.plans import contribution, ingest
from loomwright.plans.profile import Input, Plan, Profile
from loomwright.sources import probe, readers, sinks


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé€😀\n"), max_size=60), st.integers(4, 20))
def test_pieces_end_between_characters(text, most):
    pieces = list(readers._pieces(io.BytesIO(text.encode()), most))
    assert b"".join(pieces) == text.encode() and all(0 < len(p) <= most for p in pieces)
    assert "".join(p.decode() for p in pieces) == text


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_json_values_are_read_one_at_a_time(monkeypatch, piece):
    monkeypatch.setattr(readers, "PIECE", piece)
    read = lambda t: list(readers.json_values(io.BytesIO(t.encode())))
    assert read(' [ {"a": "é]"} ,\n {"b":[1,2]}, 3 ] ') == ['{"a": "é]"}', '{"b":[1,2]}', "3"]
    assert read('{"a":{"b":"}"}}') == ['{"a":{"b":"}"}}'] and read("[]") == [] and read("12345") == ["12345"]
    assert read("") == [None] and read('{"a":1} {"b":2}') == ['{"a":1}', None] and read('[{"a":1}, {broken]')[-1] is None and read("[1] 2")[-1] is None and read('[{"a":1}')[-1] is None
    assert list(readers.text_lines(io.BytesIO("a\nbé\n\nc".encode()))) == ["a", "bé", "", "c"]


def test_a_large_compressed_file_is_read_in_batches(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt", compresslevel=1) as f:
        for i in range(200_000):
            f.write(json.dumps({"text": f"line {i} " + "x" * 300}) + "\n")
    rows = readers.json_lines(probe.files(spark, str(tmp_path)))
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString().split("Scan")[-1].split("ReadSchema")[-1]
    assert rows.agg(F.count(F.lit(1)), F.max("position")).first()[:] == (200_000, 200_000)


def test_a_file_that_changes_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 10)
    assert readers.digest_of(str(tmp_path / "a.txt")) == readers.digest_of(f"file://{tmp_path}/a.txt")

    def grows(path, digest, stream):
        with open(path.removeprefix("file:").removeprefix("//"), "a") as f:
            f.write("more")
        yield {"path": path, "source": digest, "position": 0, "text": "", "meta": None}

    with pytest.raises(Exception, match="changed while it was read"):
        readers._rows(probe.files(spark, str(tmp_path)), grows, readers.TEXT_ROWS).collect()


def test_links_and_nested_roots(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one")
    assert probe.distinct_roots(["/a/b", "/a", "/ab", "/a/"]) == ["/a", "/ab"]
    assert probe.files(spark, str(tmp_path), str(tmp_path / "d"), str(tmp_path / "d" / "a.txt")).count() == 1
    os.symlink(tmp_path / "d" / "a.txt", tmp_path / "d" / "b.txt")
    with pytest.raises(ValueError, match="symbolic links"):
        probe.files(spark, str(tmp_path))


def _plan(folder, lines, **more):
    (folder / "a.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    profile = Profile("record-map", {"text": "body", "license": "lic"}, **more.pop("profile", {}))
    return Plan((Input(str(folder / "a.jsonl"), "jsonl", "LicenseRef-D", profile),), **more)


def test_licence_arrays_of_records(spark, tmp_path):
    lines = [{"body": "one", "lic": ["MIT License", "CC BY-SA 4.0", ""]}, {"body": "two", "lic": "cc by 4.0"}, {"body": "three", "lic": []}, {"body": "four"}, {"body": "five", "lic": ["ISC License"]}]
    rows = {r.text: (r.license, r.license_raw) for r in ingest.ingested(ingest.scan_plan(spark, _plan(tmp_path, lines))).collect()}
    assert rows == {
        "one": ("CC-BY-SA-4.0 AND MIT", '["MIT License","CC BY-SA 4.0"]'), "two": ("CC-BY-4.0", "cc by 4.0"), "three": ("LicenseRef-D", None), "four": ("LicenseRef-D", None), "five": ("ISC", "ISC License"),
    }


def test_scans_are_redacted_once(spark, tmp_path):
    scan = ingest.scan_plan(spark, _plan(tmp_path, [{"body": "mail a@b.example"}, {"body": " "}, "{"]))
    held = ingest.written(scan)
    kept = ingest.ingested(held)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") <= 1  # the assessment alone
    assert ingest.report(held, kept).first().rejected == {"empty": 1, "malformed": 1}
    assert [r.text for r in kept.collect()] == ["mail <EMAIL_ADDRESS>"]
    assert held.filter("reject_reason IS NOT NULL AND text IS NOT NULL").count() == 0


def test_empty_and_oversized_records(spark, tmp_path):
    lines = [{"body": "fits"}, {"body": " "}, {"body": "much too long for the record size"}]
    rows = ingest.scan_plan(spark, _plan(tmp_path, lines, record_bytes=20))
    assert {r.reject_reason for r in rows.collect()} == {None, "empty", "oversized"}
    with pytest.raises(Exception, match="empty record"):
        ingest.scan_plan(spark, _plan(tmp_path, lines, direct=True)).collect()
    assert ingest.scan_plan(spark, _plan(tmp_path, lines, direct=True, profile={"on_empty": "skip"})).count() == 3
    (tmp_path / "t.txt").write_text("é" * 30)
    chunks = ingest.scan_plan(spark, Plan((Input(str(tmp_path / "t.txt"), "text", "MIT"),), record_bytes=16)).collect()
    assert len(chunks) == 4 and "".join(r.text for r in sorted(chunks, key=lambda r: r.position)) == "é" * 30 and json.loads(chunks[0].meta)["chunks"] == 4


def test_objects_rotate_and_are_kept(spark, tmp_path):
    rows = spark.range(4_000).selectExpr("id", "sha2(cast(id AS string), 512) AS text", "'MIT' AS license", "id AS token_count")
    writer = sinks.ObjectWriter(str(tmp_path / "w"), "text", most=60_000, group=50_000)
    for batch in rows.toArrow().to_batches(max_chunksize=200):
        writer.add(batch)
    writer.close()
    assert len(writer.done) > 2 and sum(d[1] for d in writer.done) == 4_000
    assert pq.ParquetFile(writer.done[0][0]).metadata.num_row_groups >= 1
    first = sinks.write_objects(rows, str(tmp_path / "o"), ["id"]).collect()
    again = sinks.write_objects(rows, str(tmp_path / "o"), ["id"]).collect()
    assert first == again
    with open(first[0].object, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="holds other content"):
        sinks.write_objects(rows, str(tmp_path / "o"), ["id"])
    objects = spark.createDataFrame([(d[0], d[1] + (i == 0)) for i, d in enumerate(writer.done)], "object string, records bigint")
    wrong = sinks.footer_differences(objects, ["id", "text", "license", "token_count"]).collect()
    assert [(r.object, r.difference) for r in wrong] == [(writer.done[0][0], "rows")]
    assert sinks.footer_differences(objects, ["text"]).filter("difference = 'columns'").count() == len(writer.done)


def test_declared_totals_of_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ("b", 3)], "text string, token_count bigint")
    sinks.write_jsonl(rows, str(tmp_path / "ok"), ["text"], (2, 5))
    with pytest.raises(ValueError, match="declares"):
        sinks.write_jsonl(rows, str(tmp_path / "bad"), ["text"], (2, 6))


def test_contributions_roll_back(tmp_path):
    index, staging = str(tmp_path / "index"), str(tmp_path / "staging")
    contribution._write(f"{index}/a.json", b'{\n "n": 0\n}\n')
    with pytest.raises(ValueError, match="another a.json"):
        contribution.stage(index, staging, {"a.json": {"n": 1}})
    with pytest.raises(ValueError, match="outside"):
        contribution.stage(index, index + "/x", {"b.json": {}})
    with pytest.raises(ValueError, match="leaves"):
        contribution.stage(index, staging, {"../b.json": {}})
    staged = contribution.stage(index, staging, {"b.json": {"n": 1}, "z/c.json": {"n": 2}})
    contribution._write(f"{index}/z/c.json", b"other")
    with pytest.raises(ValueError, match="another z/c.json"):
        contribution.apply(index, staged)
    assert sorted(contribution.tree(index)) == ["a.json", "z/c.json"]  # b.json is taken back
    assert contribution.apply(index, staged, replace=True) == ["b.json", "z/c.json"]


def test_exports_and_handoffs_are_checked(spark, tmp_path):
    files = spark.createDataFrame([("a", "1" * 64, 3), ("b", "2" * 64, 4)], "path string, sha256 string, bytes bigint")
    document = contribution.export_document("n", files, [{"name": "s"}])
    contribution.write_export(str(tmp_path), document)
    found = spark.createDataFrame([("a", "1" * 64, 5), ("c", "3" * 64, 1)], "path string, sha256 string, bytes bigint")
    assert {tuple(r) for r in contribution.export_faults(document, found).collect()} == {("a", "differs"), ("b", "missing"), ("c", "unexpected")}
    assert contribution.handoff_faults(document, files).count() == 0
    with pytest.raises(ValueError):
        contribution.handoff_faults({"schema": 2}, files)
    with pytest.raises(ValueError):
        contribution.write_export(str(tmp_path), {"files": []})


def test_plans_follow_the_probe(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain words")
    (tmp_path / "b.data").write_text('{"body":"one"}\n{"body":"two"}\n')
    (tmp_path / "c.md").write_text("# title")
    plan = ingest.planned(spark, [str(tmp_path)], "MIT", {"jsonl": Profile("record-map", {"text": "body"})}, declared={".md": "text"})
    assert [(os.path.basename(i.path), i.format) for i in plan.inputs] == [("a.txt", "text"), ("b.data", "jsonl"), ("c.md", "text")]
    assert {r.text for r in ingest.ingested(ingest.scan_plan(spark, plan)).collect()} == {"plain words", "one", "two", "# title"}
    with pytest.raises(ValueError, match="more than 2"):
        ingest.planned(spark, [str(tmp_path)], "MIT", most=2)


def test_index_against_its_objects(spark):
    from loomwright.operators import audit

    declared = spark.createDataFrame([("m1", "a", 1, 2, 3), ("m2", "a", 1, 2, 3), ("m1", "b", 1, 2, 3), ("m1", "c", 1, 2, 3), ("m2", "c", 9, 2, 3), ("m1", "d", 1, 2, 3)], "manifest string, sha256 string, docs bigint, tokens bigint, bytes bigint")
    told = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 5, 3), ("c", 1, 2, 3)], "sha256 string, records bigint, tokens bigint, content_bytes bigint")
    found = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "name string, intact boolean")
    assert {tuple(r) for r in audit.object_faults(declared, told, found).collect()} == {("b", "tokens"), ("c", "broken"), ("c", "conflict"), ("d", "missing")}


def test_recounted_tokens(spark):
    from loomwright.operators import audit

    rows = spark.createDataFrame([(1, "abc", 3), (2, "abcd", 3)], "id bigint, text string, token_count bigint").withColumns({"content_sha256": F.sha2("text", 256), "language_score": F.lit(1), "meta": F.lit(None).cast("string")})
    assert [tuple(r) for r in audit.violations(rows, "id", recount=F.octet_length("text")).collect()] == [(2, "tokens-differ")]


def test_nested_records_read_their_leaves_alone(spark, tmp_path):
    row = "struct(struct('t' AS body, 1 AS n) AS doc, array(struct('MIT' AS id)) AS lic, 'x' AS unused)"
    spark.range(1).selectExpr(f"inline(array({row}))").write.parquet(str(tmp_path / "p"))
    profile = Profile("record-map", {"text": "doc.body", "license": "lic[].id"})
    scan = ingest.scan_plan(spark, Plan((Input(str(tmp_path / "p"), "parquet", "LicenseRef-D", profile),)))
    schema = scan._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert "unused" not in schema and "doc:struct<body:string>" in schema and ":int" not in schema
    assert [(r.text, r.license) for r in scan.collect()] == [("t", "MIT")]


def test_masks_and_strict_decoding(spark):
    from loomwright.operators import mapping, training

    messages = "array(named_struct('role', 'user', 'content', 'é'), named_struct('role', 'assistant', 'content', 'ab'))"
    row = spark.range(1).selectExpr(f"{messages} AS m")
    for template in ("chatml-v1", "user-assistant-v1"):
        total, trained = training.supervised_bytes(F.col("m"), template, ["assistant"])
        mask = training.loss_mask(F.col("m"), template, ["assistant"])
        r = row.select(total.alias("total"), trained.alias("trained"), F.size(mask).alias("n"), F.size(F.filter(mask, lambda x: x)).alias("on")).first()
        assert (r.n, r.on) == (r.total, r.trained)
    payload = mapping.encode_conversation(F.col("m"))
    bad = [F.lit("{"), F.lit(None).cast("string"), F.lit("[]"), F.replace(payload, F.lit('"messages"'), F.lit('"x":1,"messages"')), F.replace(payload, F.lit('"content":"ab"'), F.lit('"content":"ab","more":1')), F.replace(payload, F.lit('"assistant"'), F.lit('"user"'))]
    got = row.select(mapping.decoded_conversation(payload).alias("good"), *[mapping.decoded_conversation(b).alias(f"b{i}") for i, b in enumerate(bad)]).first()
    assert [m.content for m in got.good] == ["é", "ab"] and all(x is None for x in got[1:])


def test_batches_are_sliced_by_rows_and_bytes():
    import pyarrow as pa

    from loomwright.runtime import slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a", None, "b" * 50, "", "cc", "dd"])], names=["id", "text"])
    assert [p.column(0).to_pylist() for p in slices(batch, 1, 3, 10)] == [[0, 1], [2], [3, 4, 5]]
    assert [p.num_rows for p in slices(batch, 1, 2, 1_000)] == [2, 2, 2] and list(slices(batch.slice(0, 0), 1, 2)) == []
