import hashlib
import json
import os

import pytest

from loomwright.operators import index
from loomwright.plans.parameters import Parameters, resolve
from loomwright.sources import objects, sinks


def test_parameters():
    base = {"batch_size": 4, "sequence_length": 8, "learning_rate": 1e-3}
    r = resolve(Parameters(**base, tokens=100))
    assert (r.steps, r.token_capacity, r.warmup_steps, r.checkpoint_every, r.order) == (4, 128, 1, 4, "bounded-shuffle-v1")
    r = resolve(Parameters(**base, steps=10_000, profile="balanced", evaluation_bytes=0))
    assert (r.warmup_steps, r.checkpoint_every, r.selection, r.evaluation_fraction, r.evaluation_records) == (100, 500, "stratified-lowest-sha256-v1", 0.0, 0)
    assert r.rate_at(0) == pytest.approx(1e-5) and r.rate_at(100) == pytest.approx(1e-3) and r.rate_at(10_000) == pytest.approx(0)
    assert resolve(Parameters(**base, epochs=2), derived_steps=7).steps == 7
    for bad in (Parameters(**base), Parameters(**base, tokens=1, steps=1), Parameters(**base, epochs=2), Parameters(**base, steps=1 << 62), Parameters(**base, steps=5, warmup_steps=6), Parameters(**base, steps=5, profile="x"), Parameters(4, 8, float("nan"), steps=1), Parameters(**base, steps=5, evaluation_fraction=1.0)):
        with pytest.raises(ValueError):
            resolve(bad)


def test_store_and_journal(spark, tmp_path):
    data = {hashlib.sha256(x).hexdigest(): x for x in (b"one", b"two", b"three")}
    local = []
    for digest, x in data.items():
        (tmp_path / digest).write_bytes(x)
        local.append((str(tmp_path / digest), digest))
    store, empty = objects.Store(spark, f"file://{tmp_path}/store"), objects.Store(spark, f"file://{tmp_path}/empty")
    journal = objects.Journal(str(tmp_path / "journal"), "plan")
    objects.publish_all(local[:2], store, journal)
    assert json.loads((tmp_path / "journal").read_text())["state"] == "published"
    urls = objects.publish_all(local, store, objects.Journal(str(tmp_path / "journal"), "plan"))
    assert set(urls) == set(data) and objects.publish_all(local[:1], store, objects.Journal(str(tmp_path / "journal"), "plan")).keys() == {local[0][1]}
    with pytest.raises(ValueError):
        objects.Journal(str(tmp_path / "journal"), "other")
    with pytest.raises(ValueError):
        store.publish(local[0][0], local[1][1])
    got = objects.fetch_any([empty, store], local[0][1], str(tmp_path / "cache"), len(data[local[0][1]]))
    with open(got, "rb") as f:
        assert f.read() == data[local[0][1]]
    with open(got, "wb") as f:
        f.write(b"broken")
    with open(objects.fetch_any([store], local[0][1], str(tmp_path / "cache")), "rb") as f:
        assert f.read() == data[local[0][1]]  # a broken cached copy is fetched anew
    with pytest.raises(FileNotFoundError):
        objects.fetch_any([empty], "0" * 64, str(tmp_path / "cache"))
    with pytest.raises(ValueError):
        objects.object_key("ABC")
    assert dict(objects.available([empty, store], [(d, len(x)) for d, x in data.items()])) == dict.fromkeys(data, True)
    assert {r.sha256 for r in objects.inventory(spark, f"{tmp_path}/store").collect()} == set(data)


def _index(folder):
    def put(name, body):
        os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
        with open(os.path.join(folder, name), "w") as f:
            json.dump(body, f)

    shard = lambda c, n: {"sha256": c * 64, "docs": n, "tokens": n, "bytes": n, "licenses": ["MIT"], "sources": ["s"]}
    put("index.json", {"entries": ["a.json", "sub"]})
    put("a.json", {"name": "a", "docs": 3, "sources": [{"name": "s", "category": "public"}], "shards": [shard("a", 1), shard("b", 2)]})
    put("sub/index.json", {"entries": ["m.json"]})
    put("sub/m.json", {"name": "m", "rollup": {"manifests": ["parts/p.json"], "docs": 4}})
    put("sub/parts/p.json", {"shards": [shard("c", 4)]})
    put("sub/unlisted.json", {"name": "hidden"})
    return put


def test_index(spark, tmp_path):
    put = _index(str(tmp_path))
    rows = index.shard_rows(spark, str(tmp_path)).collect()
    assert sorted((r.sha256[0], r.docs) for r in rows) == [("a", 1), ("b", 2), ("c", 4)]
    totals = {(r.level, r.license): r.docs for r in index.bom(index.shard_rows(spark, str(tmp_path))).collect() if r.level == 3}
    assert totals == {(3, None): 7}
    assert index.verify(str(tmp_path)) == []
    put("a.json", {"docs": 9, "sources": [{"name": "t", "category": "web-crawl"}], "shards": [{"sha256": "b", "docs": 1, "sources": ["s"]}, {"sha256": "a"}]})
    assert len(index.verify(str(tmp_path))) == 4
    put("sub/parts/p.json", {"rollup": {"manifests": ["p.json"]}})
    with pytest.raises(ValueError, match="itself"):
        index.shard_rows(spark, str(tmp_path))
    assert index.source_faults({"category": "synthetic", "acquisition": {"basis": "x", "service": "y"}}) == ["synthetic needs generator", "service belongs to user-data"]
    assert index.source_faults({"category": "other", "collected_from": "2020-05", "collected_to": "2020"}) == []
    gaps = spark.createDataFrame([("s", "u", None), ("t", None, "MIT")], "name string, url string, license string")
    assert [tuple(r) for r in index.disclosure_gaps(gaps).collect()] == [("data", "license", "s"), ("data", "url", "t")]


def test_worker_lines(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, text string")
    lines = [json.loads(x) for x in sinks.worker_lines({"run": "r"}, rows, ["id"], rows.limit(1))]
    assert [x["kind"] for x in lines] == ["begin", "evaluation_record", "record", "record", "end"] and lines[2]["record"] == {"id": 1, "text": "a"}
