import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import audit, catalog, dedup, drift, filters, forecast, mapping, sampling, telemetry, training


def test_same_text_under_two_licenses_is_kept_twice(spark):
    rows = spark.createDataFrame([(1, "t", "MIT"), (2, "t", "CC0-1.0"), (3, "t", "MIT"), (4, "u", "MIT")], "id int, text string, license string")
    kept = dedup.survivors(dedup.identified(rows), "id")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4]
    assert dedup.totals(dedup.identified(rows)).first().asDict() == {"seen": 4, "kept": 3, "duplicate": 1}
    seed = dedup.identified(rows.filter("id = 2"))
    assert sorted(r.id for r in dedup.without_seed(kept, seed).collect()) == [1, 4]


def test_filters(spark):
    rows = spark.createDataFrame(
        [("CC-BY-4.0", "en", "p-a", "2024-02-03", True), ("CC-BY-NC-4.0", "en", "p-a", "2024", True), ("CC-BY-4.0", "fr", "p-a", "2024", True), ("CC-BY-4.0", "en", "o", "2024", True), ("CC-BY-4.0", "en", "p-a", "1999", True), ("CC-BY-4.0", None, None, None, None)],
        "license string, language string, source_name string, date string, main_content boolean",
    ).withColumn("source", F.lit(None).cast("string")).withColumn("corpus", F.lit("books"))
    V = filters.ValueFilter
    policy = filters.Policy(filters.RecordFilter(licenses=V(("CC-*",), ("CC-BY-NC-*",))), {"books": filters.RecordFilter(languages=V(("en",)), sources=V(("p-*",)), date=filters.DateFilter("2000", "2025-06"))})
    policy.validate(["books"])
    assert [r[0] for r in rows.select(policy.column()).collect()] == [True, False, False, False, False, False]
    with pytest.raises(ValueError):
        policy.validate(["other"])
    with pytest.raises(ValueError):
        filters.Policy().validate([])
    with pytest.raises(ValueError):
        filters.RecordFilter(exclude=filters.Exclusion(licenses=("CC-*",)), licenses=V((), ("CC0-*",))).validate()
    flagged = spark.createDataFrame([(True, "CC0-1.0"), (False, "CC0-1.0"), (None, "CC0-1.0"), (False, "X-1")], "repetitive_content boolean, license string")
    assert [r[0] for r in flagged.select(filters.Exclusion({"repetitive_content": True}, ("X-*",)).column()).collect()] == [True, False, False, True]


def test_greedy_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([50, 10, 10, 10])], "id int, text string")
    held = sampling.held_out(rows, "id", 7, fraction=1.0, most_records=3, most_bytes=25)
    sizes = {str(r.id): len(r.text) for r in rows.collect()}
    ids = [r.selection_id for r in held.collect()]
    assert 0 < len(ids) <= 3 and sum(sizes[i] for i in ids) <= 25
    left = sampling.training_part(rows, held, "id")
    assert left.count() + len(ids) == 4
    assert sampling.desired(100) == 1 and sampling.desired(1) == 0 and sampling.desired(100_000) == 256 and sampling.desired(2, 1.0) == 1


def test_calibration_fills_the_budget_with_whole_characters(spark):
    rows = spark.createDataFrame([("a", "ééé"), ("b", "x€"), ("c", "yz")], "score string, text string")
    got = {r.score: r.sample for r in sampling.calibration_sample(rows, ["score"], 7).collect()}
    assert got == {"a": "ééé", "b": "x"}
    assert {r.score: r.sample for r in sampling.calibration_sample(rows, ["score"], 5).collect()} == {"a": "éé"}


def test_interleave_is_the_greedy_merge(spark):
    random.seed(3)
    for _ in range(3):
        weights = {"a": random.randint(1, 5), "b": random.randint(1, 5), "c": random.randint(1, 5)}
        rows = [(c, i, random.randint(1, 9)) for c in weights for i in range(12)]
        queue = {c: [r for r in rows if r[0] == c] for c in weights}
        emitted, wanted = dict.fromkeys(weights, 0), []
        while any(queue.values()):
            c = min((c for c in queue if queue[c]), key=lambda c: (emitted[c] / weights[c], c))
            r = queue[c].pop(0)
            emitted[c] += r[2] + 1
            wanted.append(r[:2])
        df = spark.createDataFrame(rows, "corpus string, i int, tokens bigint")
        w = spark.createDataFrame(list(weights.items()), "corpus string, weight bigint")
        got = training.weighted_rank(training.interleaved(df, w, ["i"]), ["i"]).orderBy("position").collect()
        assert [(r.corpus, r.i) for r in got] == wanted


def test_targets_and_windows(spark):
    rows = spark.createDataFrame([("A",), ("é",)], "text string")
    assert training.byte_targets(rows).first()[0] == 4
    assert training.byte_targets(rows).select(training.byte_targets_for(F.col("targets"), 2)).first()[0] == 9
    assert training.partition_targets(rows).first()[0] == 3
    assert training.byte_targets(rows.limit(0)).first()[0] == 0
    assert [r[0] for r in rows.select(training.byte_tokens(F.col("text"))).collect()] == [[68], [198, 172]]
    stream = spark.createDataFrame([(i, 10 + i, i != 3) for i in range(7)], "position bigint, token int, supervised boolean")
    got = {r.window: (r.tokens, r["mask"]) for r in training.windows(stream, 4).collect()}
    assert got == {0: ([10, 11, 12, 13, 14], [True, True, False, True]), 1: ([14, 15, 16, 0, 0], [True, True, False, False])}
    counts = spark.createDataFrame([(1,), (2,), (5,), (6,)], "n bigint")
    assert [r[0] for r in counts.select(training.packed_sequences(F.col("n"), 4)).collect()] == [0, 1, 1, 2]


def test_bounded_shuffle_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "g", i % 7 * 10) for i in range(200)], "id bigint, g string, bytes bigint")
    out = training.bounded_shuffled(rows, "g", ["id"], 5, most_records=8, most_bytes=50, parts=3).collect()
    assert sorted(r.id for r in out) == list(range(200))
    again = training.bounded_shuffled(rows, "g", ["id"], 5, most_records=8, most_bytes=50, parts=3).collect()
    assert sorted((r.position, r.id) for r in out) == sorted((r.position, r.id) for r in again)
    assert sorted(r.position for r in out) == list(range(200))  # one order over the whole group
    assert [r.id for r in sorted(out, key=lambda r: r.position)] != sorted(r.id for r in out)
    other = training.bounded_shuffled(rows, "g", ["id"], 5, epoch=1, most_records=8, most_bytes=50, parts=3).collect()
    assert sorted((r.position, r.id) for r in out) != sorted((r.position, r.id) for r in other)


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a <x> & y"), (2, 1, "user", "only")], "c int, t int, role string, content string")
    conv = mapping.turns_to_conversations(turns, "c", "t")
    got = {r.c: (r.ok, r.p) for r in conv.select("c", mapping.valid_conversation(F.col("messages")).alias("ok"), mapping.encode_conversation(F.col("messages")).alias("p")).collect()}
    assert got[1] == (True, '{"messages":[{"role":"user","content":"a \\u003cx\\u003e \\u0026 y"},{"role":"assistant","content":"b"}]}') and not got[2][0]
    one = conv.filter("c = 1")
    assert one.select(training.rendered(F.col("messages"), "user-assistant-v1")).first()[0] == "User: a <x> & y\n\nAssistant:b"
    tools = training.with_tools(F.col("messages"), F.lit("[1]"))
    assert one.select(tools).first()[0][0].content == "Available tools:\n[1]"
    total, trained = training.supervised_bytes(F.col("messages"), "chatml-v1", ["assistant"])
    markup = "<|im_start|>user\na <x> & y<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert tuple(one.select(total, trained).first()) == (len(markup) + 1, len("b<|im_end|>\n") + 1)


def test_chat_messages_and_trees(spark):
    df = spark.createDataFrame([(["Human", "model"], ["q", "a"], "sys"), (["human"], ["q", "a"], None)], "r array<string>, c array<string>, s string")
    got = [r[0] for r in df.select(mapping.chat_messages(F.col("r"), F.col("c"), {"human": "user", "model": "assistant"}, F.col("s"))).collect()]
    assert [(m.role, m.content) for m in got[0]] == [("system", "sys"), ("user", "q"), ("assistant", "a")] and got[1] is None
    tree = '{"text":"q","replies":[{"text":"no","rank":1},{"text":"yes","rank":0,"replies":[{"text":"more","rank":0}]}]}'
    trees = spark.createDataFrame([(tree,), ("{",), ('{"text":"q"}',)], "d string")
    out = [r[0] for r in trees.select(mapping.ranked_trees(F.col("d"))).collect()]
    assert [m.content for m in out[0]] == ["q", "yes", "more"] and out[1] is None and out[2] is None


def test_paths_text_and_meta(spark):
    doc = '{"title":"T","body":{"parts":[{"t":"A"},{"t":" "},{"t":"B"}]},"n":1.50,"tags":["x","y"],"none":null}'
    df = spark.createDataFrame([(doc,)], "j string").select(F.expr("parse_json(j)").alias("d"))
    assert df.select(mapping.mapped_text(F.col("d"), ["title", "body.parts[].t"])).first()[0] == "T\n\nA\n\nB"
    assert df.select(mapping.mapped_text(F.col("d"), ["absent", "none"], ["title"])).first()[0] == "T"
    assert df.select(mapping.mapped_meta(F.col("d"), {"z": "title", "a": "tags[]", "q": "absent"})).first()[0] == '{"a":["x","y"],"z":"T"}'
    assert df.select(mapping.mapped_meta(F.col("d"), {"q": "absent"})).first()[0] is None
    assert df.select(mapping.main_content(F.col("d"), {"title": "T"})).first()[0] is True
    with pytest.raises(Exception, match="absent"):
        df.select(mapping.main_content(F.col("d"), {"title": "other", "absent": "x"})).collect()


def test_catalogue(spark):
    shards = spark.createDataFrame([(1, ["MIT", "CC0-1.0"], 2, 20, 200), (2, ["MIT"], 3, 30, 300), (3, [], 1, 1, 1), (4, None, 1, 1, 1)], "shard_id int, licenses array<string>, docs bigint, tokens bigint, bytes bigint")
    got = {r.license: (r.shards, r.docs) for r in catalog.totals_by_license(shards).collect()}
    assert got == {"MIT": (2, 5), "CC0-1.0": (1, 2), "(none declared)": (2, 2)}
    paths = spark.createDataFrame([("a/b/c",), ("a/bx",), ("z",)], "path string")
    sel = spark.createDataFrame([("a",), ("a/b",), ("a/b",)], "selection string")
    assert {r.path: r.selection for r in catalog.longest_prefix(paths, sel).collect()} == {"a/b/c": "a/b", "a/bx": "a"}
    maps = spark.createDataFrame([("m", {"x": 1, "y": 2}), ("m", {"y": 3}), ("n", {})], "k string, v map<string,bigint>")
    assert [(r.k, r.v) for r in catalog.map_sums(maps, ["k"], "v").collect()] == [("m", {"x": 1, "y": 5})]
    objects = spark.createDataFrame([("a", 5, datetime.datetime(2024, 1, 1), False), ("b", 5, datetime.datetime(2024, 1, 2), False), ("c", 5, datetime.datetime(2023, 1, 1), True)], "sha256 string, bytes bigint, used_at timestamp, in_use boolean")
    assert [r.sha256 for r in catalog.prune_oldest(objects, 10).collect()] == ["a"]
    fresh = spark.createDataFrame([("n1", "u1"), ("n2", "u2"), ("n3", "u3")], "name string, url string")
    prior = spark.createDataFrame([("n1", "x", "c1", 1), ("q", "u2", "c2", 2), ("n2", "y", "c3", 3)], "name string, url string, context string, position int")
    assert {r.name: r.context for r in catalog.preserved_context(fresh, prior).collect()} == {"n1": "c1", "n2": "c2", "n3": None}


def test_audit_and_telemetry(spark):
    rows = spark.createDataFrame([(1, "t", b"x", 1, 0, "{}"), (2, "t", b"x", None, 2000, "[]"), (3, None, None, 1, None, None)], "id int, text string, content_sha256 binary, token_count bigint, language_score int, meta string")
    rules = {(r.id, r.rule) for r in audit.violations(rows, "id").collect()}
    assert {(1, "digest-differs"), (1, "content-repeated"), (2, "tokens-missing"), (2, "score-out-of-range"), (2, "meta-not-an-object"), (3, "text-missing")} <= rules
    sha = "ab" * 32
    paths = spark.createDataFrame([(f"o/ab/ab/{sha}",), (f"o/{sha}",), (f"o/cd/ab/{sha}",)], "p string")
    assert [r[0].canonical for r in paths.select(audit.object_path(F.col("p"))).collect()] == [True, False, False]
    series = spark.createDataFrame([("r", 1, 10, 2.0), ("r", 2, None, 3.0), ("r", 3, 9, None)], "run string, at int, step int, loss double")
    last = telemetry.latest(series, ["run"], ["at"], ["step", "loss"]).first()
    assert (last.last_step, last.first_step, last.last_loss, last.first_loss) == (9, 10, 3.0, 2.0)
    assert [r.before for r in audit.not_increasing(series.filter("step IS NOT NULL"), ["run"], "at", "step").collect()] == [10]


def test_forecasts(spark):
    runs = spark.createDataFrame([(1, 1e9, 2e10, 16.0)], "run int, parameters double, tokens double, bytes_per_parameter double")
    machines = spark.createDataFrame([("x", 100.0, 2, 8e9, 0.0), ("y", 100.0, 2, 8e10, 1e15)], "accelerator string, tflops double, gpus int, memory_bytes double, calibrated_flops_per_second double")
    got = {r.accelerator: (round(r.seconds), r.fits) for r in forecast.forecasts(runs, machines).collect()}
    assert got == {"x": (round(6 * 1e9 * 2e10 / 2e14 * 1.08), False), "y": (120_000, True)}
    presets = spark.createDataFrame([("s", 10), ("m", 100), ("l", 1000)], "name string, parameters bigint")
    assert [r.name for r in forecast.recommended(presets, 2500).collect()] == ["m"]


# ---- schema drift ---------------------------------------------------------------------------------


def _drift(spark, files):
    rows = [(f, i, p) for f, payloads in files.items() for i, p in enumerate(payloads)]
    table = spark.createDataFrame(rows, "file_id bigint, line_no bigint, payload string").withColumn("value", F.lit(1)).withColumn("type", F.lit("x"))
    known = spark.createDataFrame([(f, "s", f) for f in files], "file_id bigint, stream string, file_seq int").withColumn("path", F.lit("p"))
    return table, known, drift.statistics_once(table)


def test_drift(spark):
    long = "some longer text that tells its content by itself, number "
    table, known, stats = _drift(spark, {
        1: [f'{{"text":"{long}1","n":1,"gone":true,"meta":{{"a":1,"b":"x"}}}}', f'{{"n":2,"text":"{long}2","gone":false}}', "{broken", None, "[]"],
        2: [f'{{"body":"{long}3","n":1.5,"n2":null,"meta":"{{\\"a\\":1,\\"c\\":[1]}}"}}', f'{{"body":"{long}4","n":2,"fresh":"x"}}'],
        3: ["not json"],
        4: [f'{{"body":"{long}5","n":2.5,"fresh":"y","meta":null}}'],
    })
    got = {(r.file_id, r.change, r.old_field, r.new_field) for r in drift.changes(known, stats).collect()}
    assert got == {
        (2, "renamed", "text", "body"), (2, "retyped", "n", "n"), (2, "removed", "gone", ""), (2, "added", "", "fresh"), (2, "retyped", "meta", "meta"), (2, "removed", "meta.b", ""), (2, "added", "", "meta.c"),
        (4, "removed", "meta", ""), (4, "removed", "meta.a", ""), (4, "removed", "meta.c", ""),
    }
    out = drift.Projection(stats, drift.changes(known, stats)).table(table)
    names = set(out.columns)
    assert {"n", "fresh", "meta_a"} <= names and len({"text", "body"} & names) == 1
    assert out.count() == 5 and all(r.failed_casts == [] for r in out.collect())


def test_failed_casts_are_told(spark):
    table, known, stats = _drift(spark, {1: ['{"n":1}', '{"n":2}', '{"n":"many"}']})
    rows = drift.Projection(stats, drift.changes(known, stats)).table(table).collect()
    assert [(r.n, [(f.field, f.raw) for f in r.failed_casts]) for r in sorted(rows, key=lambda r: r.line_no)] == [(1, []), (2, []), (None, [("n", '"many"')])]


def test_drift_of_nothing(spark):
    table, known, stats = _drift(spark, {1: [None]})
    assert drift.changes(known, stats).count() == 0
    assert drift.changes(known.limit(0), drift.statistics_once(table.limit(0))).count() == 0
