"""Queries of the core operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import dates, glob, hashing, privacy, text
from loomwright.functions import license as licenses
from loomwright.operators import audit, catalog, dedup, drift, filters, forecast, mapping, sampling, telemetry, training
from loomwright.runtime import spread, table
from loomwright.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]

DEFAULT_LICENSE = "LicenseRef-Default"
EVALUATION_SEED = 42
SEQUENCE, BATCH = 1024, 8


# ---- canonical views of the test tables -------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text, identified by content and effective licence."""
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull() & (F.col("text") != ""))
    return dedup.identified(rows.withColumn("license", licenses.effective(F.col("license"), DEFAULT_LICENSE)))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a text, spread where the scan has fewer splits than the cluster has cores."""
    return spread(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))


def first_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rows of text_rows, each row id as it arrived first."""
    rows = table(spark, d, "text_rows").select("row_id", "ingested_at", *columns)
    first = F.min(F.struct("ingested_at", *columns)).alias("f")
    return rows.groupBy("row_id").agg(first).select("row_id", *[F.col("f")[c].alias(c) for c in columns])


def shards_once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "shards")
    first = F.min(F.struct("indexed_at", *[c for c in rows.columns if c not in ("shard_id", "indexed_at")])).alias("f")
    return rows.groupBy("shard_id").agg(first).select("shard_id", "f.*").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


# ---- exact deduplication ----------------------------------------------------------------------


def exact_dedup_by_license(spark, d):
    return dedup.unique_totals(documents(spark, d))


def duplicate_groups(spark, d):
    return dedup.groups(documents(spark, d), "doc_id")


def dedup_survivors(spark, d):
    return dedup.survivors(documents(spark, d), "doc_id").select("doc_id", "content_sha256", "license")


def dedup_copy_numbers(spark, d):
    return dedup.ranked(documents(spark, d).select("doc_id", *dedup.KEY), "doc_id").select("doc_id", "copy_no")


def dedup_totals(spark, d):
    return dedup.totals(documents(spark, d))


def dedup_seed_anti_join(spark, d):
    seed = documents(spark, d).filter("source LIKE 'web/%'")
    return dedup.without_seed(documents(spark, d), seed).select("doc_id", "license")


def seed_semi_join(spark, d):
    seed = documents(spark, d).filter("source LIKE 'web/%'").select(*dedup.KEY).distinct()
    return documents(spark, d).join(seed, dedup.KEY, "left_semi").select("doc_id")


def union_of_selections(spark, d):
    parts = [table(spark, d, "raw_files").filter(F.col("stream").startswith(p)).select("path") for p in ("a", "abstracts", "m")]
    return catalog.unique_paths(*parts)


# ---- licences ------------------------------------------------------------------------------------


def license_normalize(spark, d):
    raw = table(spark, d, "text_rows").select("license_raw").union(table(spark, d, "text_rows").select("license")).distinct()
    return raw.select("license_raw", licenses.normalize(F.col("license_raw")).alias("license"))


def license_set_join(spark, d):
    return table(spark, d, "corpora").select("corpus", licenses.normalize_set(F.coalesce("licenses", F.array().cast("array<string>"))).alias("license"))


def license_policy_filter(spark, d):
    shards = table(spark, d, "corpora").select("corpus", "licenses").filter("licenses IS NOT NULL")
    return shards.filter(filters.license_policy(F.col("licenses"), ["CC*", "MIT"])).select("corpus")


def license_usage_totals(spark, d):
    return catalog.license_usage(first_rows(spark, d, "shard_id", "license", "token_count"))


def totals_by_license(spark, d):
    return catalog.totals_by_license(shards_once(spark, d).withColumn("licenses", F.array("license")))


# ---- filters --------------------------------------------------------------------------------------


def glob_include_exclude(spark, d):
    keep = filters.ValueFilter(("web/*", "mail/*", "civic/m?nutes"), ("web/harbor*",))
    return table(spark, d, "text_rows").filter(keep.column("source")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def date_interval_filter(spark, d):
    rows = table(spark, d, "text_rows").filter(dates.overlaps(F.coalesce("date", F.lit("")), "2010-03", "2019-06-15"))
    return rows.groupBy(F.length("date").alias("precision")).agg(F.count(F.lit(1)).alias("rows"))


def exclusion_tristate(spark, d):
    out = filters.Exclusion({"repetitive_content": True, "boilerplate_content": True}, ("LicenseRef-*", "Public*"))
    rows = table(spark, d, "text_rows").withColumn("excluded", out.column())
    return rows.groupBy("repetitive_content", "boilerplate_content", "license", "excluded").agg(F.count(F.lit(1)).alias("rows"))


RECORD_POLICY = filters.Policy(
    filters.RecordFilter(licenses=filters.ValueFilter(("CC*", "MIT", "Apache-*")), exclude=filters.Exclusion({"repetitive_content": True})),
    {"web/openpages": filters.RecordFilter(languages=filters.ValueFilter(("en*",)), date=filters.DateFilter("2000", "2025-06")), "books/manuals": filters.RecordFilter(main_content=True)},
)


def record_filter_policy(spark, d):
    RECORD_POLICY.validate(["web/openpages", "books/manuals"])
    return table(spark, d, "text_rows").filter(RECORD_POLICY.column("source")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def language_corpora(spark, d):
    return table(spark, d, "corpora").filter(filters.languages_any(F.col("languages"), ["DE", "th"])).select("corpus")


def rejection_summary(spark, d):
    reason = filters.rejection("text", glob.matches(F.coalesce("license", F.lit("")), ["CC*", "MIT", "Apache*"]))
    return filters.rejections(table(spark, d, "documents"), reason)


def unassessed_corpora(spark, d):
    return filters.unassessed(table(spark, d, "corpora"), ["repetitive_content"]).select("corpus", "record_schema")


def skip_completed(spark, d):
    done = table(spark, d, "text_rows").select(F.col("source").alias("corpus"))
    return filters.skip_completed(table(spark, d, "corpora").select("corpus"), done)


# ---- assessment and privacy ---------------------------------------------------------------------


def email_flag(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.has_email(F.col("text")), F.lit(False)).alias("email_addresses"))


def email_redaction_counts(spark, d):
    return texts(spark, d).select("doc_id", F.regexp_count("text", F.lit(text.EMAIL)).alias("n")).filter("n > 0")


def phone_candidates(spark, d):
    found = F.regexp_extract_all("text", F.lit(privacy.PHONE_CANDIDATE.pattern), F.lit(0))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    good = lambda x: (digits(x) <= 15) & ((digits(x) >= 10) | ((digits(x) >= 7) & x.rlike(r"^\+|[()]")))
    return texts(spark, d).select("doc_id", F.size(F.filter(found, good)).alias("n")).filter("n > 0")


def privacy_redaction_full(spark, d):
    out = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", privacy.redacted(F.col("text")).alias("r"))
    return out.select("doc_id", "r.*")


def metadata_redaction(spark, d):
    out = table(spark, d, "text_rows").filter("meta IS NOT NULL").select("row_id", privacy.redacted_json(F.col("meta")).alias("r"))
    return out.select("row_id", "r.*")


def boilerplate_lines(spark, d):
    return texts(spark, d).select("doc_id", text.boilerplate(F.col("text")).alias("boilerplate_content"))


def word_counts(spark, d):
    return texts(spark, d).select("doc_id", F.size(text.words(F.col("text"))).alias("words"))


def top_trigram_fraction(spark, d):
    return texts(spark, d).select("doc_id", F.round(text.top_ngram_fraction(F.col("text"), 3), 6).alias("fraction")).filter("fraction IS NOT NULL")


def repetition_8gram(spark, d):
    return texts(spark, d).select("doc_id", text.repetitive(F.col("text")).alias("repetitive_content"))


# ---- sizes, samples and order -----------------------------------------------------------------------


def byte_targets(spark, d):
    return training.byte_targets(documents(spark, d))


def epoch_targets(spark, d):
    one = training.byte_targets(documents(spark, d))
    return one.select(training.byte_targets_for(F.col("targets"), 3).alias("targets"))


def partition_targets(spark, d):
    docs = documents(spark, d)
    return training.partition_targets(sampling.training_part(docs, heldout_lowest_sha256(spark, d), "doc_id"))


def byte_stats_by_source(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.octet_length("text")).alias("largest"))


def heldout_lowest_sha256(spark, d):
    return sampling.held_out(documents(spark, d), "doc_id", EVALUATION_SEED, most_bytes=1 << 40)


def heldout_stratified(spark, d):
    return sampling.held_out_stratified(documents(spark, d), "doc_id", "source", EVALUATION_SEED, most_bytes=1 << 40)


def heldout_byte_budget(spark, d):
    return sampling.held_out(documents(spark, d), "doc_id", EVALUATION_SEED, most_bytes=20_000)


def training_minus_heldout(spark, d):
    docs = documents(spark, d)
    left = sampling.training_part(docs, heldout_lowest_sha256(spark, d), "doc_id")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


def evaluation_records(spark, d):
    return sampling.evaluation_part(documents(spark, d), heldout_lowest_sha256(spark, d), "doc_id").select("doc_id", "source")


def evaluation_digest(spark, d):
    return sampling.evaluation_digest(heldout_lowest_sha256(spark, d))


def calibration_order(spark, d):
    return sampling.calibration_order(table(spark, d, "shards"))


def calibration_budget_sample(spark, d):
    rows = documents(spark, d).withColumn("score", hashing.evaluation_score(sampling.CALIBRATION_SEED, F.col("doc_id").cast("string")))
    return sampling.calibration_sample(rows.select("doc_id", "text", "score"), ["score", "doc_id"]).select("doc_id", F.octet_length("sample").alias("bytes"))


def weighted_interleave_order(spark, d):
    """All rows that have a source, in the merge of all corpora; where the token count is missing or negative, the byte codec's counts."""
    every = table(spark, d, "text_rows").select("row_id", F.struct("ingested_at", "source", "token_count", F.octet_length("text").alias("bytes")).alias("f"))
    tokens = F.when(F.col("f.token_count") >= 0, F.col("f.token_count")).otherwise(F.coalesce("f.bytes", F.lit(0))).cast("bigint")
    rows = every.groupBy("row_id").agg(F.min("f").alias("f")).select("row_id", F.col("f.source").alias("corpus"), tokens.alias("tokens"))
    names = table(spark, d, "corpora").select("corpus").union(rows.select("corpus")).filter("corpus IS NOT NULL").distinct()
    weights = names.select("corpus", F.greatest(F.length("corpus"), F.lit(1)).cast("bigint").alias("weight"))
    merged = training.interleaved(rows, weights, ["row_id"])
    return training.weighted_rank(merged, ["row_id"]).select("row_id", "corpus", F.col("position").cast("bigint").alias("position"))


def sequence_packing_counts(spark, d):
    sums = documents(spark, d).groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("tokens"))
    return sums.select("source", "tokens", training.packed_sequences(F.col("tokens"), SEQUENCE).alias("sequences"))


def step_capacity(spark, d):
    one = documents(spark, d).agg(F.sum(F.octet_length("text") + 1).alias("tokens"))
    sequences = training.packed_sequences(F.col("tokens"), SEQUENCE)
    return one.select(sequences.alias("sequences"), training.step_capacity(sequences, BATCH).alias("steps"))


def record_offsets(spark, d):
    rows = documents(spark, d).select("doc_id", "source", F.octet_length("text").cast("bigint").alias("tokens"))
    return training.token_offsets(rows, ["doc_id"], group="source").select("doc_id", F.col("offset").cast("bigint").alias("offset"))


def seeded_shuffle(spark, d):
    return training.shuffled(documents(spark, d).select("doc_id"), EVALUATION_SEED, 0, "doc_id")


def bounded_shuffle(spark, d):
    rows = documents(spark, d).select("doc_id", "source", F.octet_length("text").cast("bigint").alias("bytes"))
    return training.bounded_shuffled(rows, "source", ["doc_id"], EVALUATION_SEED)


def byte_encoding(spark, d):
    tokens = training.byte_tokens(F.col("text"))
    total = F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return texts(spark, d).select("doc_id", F.size(tokens).alias("tokens"), total.alias("sum"), F.slice(tokens, 1, 8).alias("first_tokens"))


def epoch_repetition(spark, d):
    rows = training.epochs(documents(spark, d).select("doc_id", "source"), 3)
    return rows.groupBy("epoch", "source").agg(F.count(F.lit(1)).alias("docs"))


# ---- conversations ------------------------------------------------------------------------------------


def _turns(spark, d):
    """Order lines as turns: odd lines ask, even lines answer."""
    lines = table(spark, d, "lineitem")
    who = F.when(F.col("l_linenumber") % 2 == 1, "user").otherwise("assistant")
    return lines.select(F.col("l_orderkey").alias("conv_id"), F.col("l_linenumber").alias("turn"), who.alias("role"), F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" <"), F.col("l_returnflag"), F.lit(">")).alias("content"))


def conversation_assemble(spark, d):
    conv = mapping.turns_to_conversations(_turns(spark, d), "conv_id", "turn")
    return conv.filter(mapping.valid_conversation(F.col("messages"))).select("conv_id", F.sha2(mapping.encode_conversation(F.col("messages")), 256).alias("payload_sha256"))


def conversation_validate(spark, d):
    conv = mapping.turns_to_conversations(_turns(spark, d), "conv_id", "turn")
    return conv.groupBy(mapping.valid_conversation(F.col("messages")).alias("valid")).agg(F.count(F.lit(1)).alias("conversations"))


def chat_template_render(spark, d):
    conv = mapping.turns_to_conversations(_turns(spark, d), "conv_id", "turn")
    return conv.select("conv_id", *[F.sha2(training.rendered(F.col("messages"), t), 256).alias(c) for t, c in (("user-assistant-v1", "plain_sha256"), ("chatml-v1", "markup_sha256"))])


def loss_mask_targets(spark, d):
    conv = mapping.turns_to_conversations(_turns(spark, d), "conv_id", "turn")
    total, trained = training.supervised_bytes(F.col("messages"), "chatml-v1", ["assistant"])
    return conv.agg(F.sum(total).alias("tokens"), F.sum(trained).alias("targets"))


# ---- catalogue --------------------------------------------------------------------------------------


def shard_summary(spark, d):
    rows = table(spark, d, "text_rows")
    return catalog.shard_summary(rows, ["shard_id"])


def catalog_grouping_sets(spark, d):
    shards = shards_once(spark, d).withColumn("corpus", F.get("sources", 0))
    return catalog.grouped_totals(shards.fillna({"license": "", "corpus": "", "format": ""}), "format", "license")


def corpora_list(spark, d):
    shards = shards_once(spark, d).select(F.explode("sources").alias("corpus"), "docs", "tokens", "bytes")
    return catalog.corpora_list(table(spark, d, "corpora"), shards)


def unknown_references(spark, d):
    known = table(spark, d, "corpora").filter("corpus NOT LIKE 'archive/%'")
    return catalog.unknown_references(shards_once(spark, d), known)


def reference_full_outer(spark, d):
    return catalog.reference_state(table(spark, d, "shards").select("shard_id"), table(spark, d, "text_rows").select("shard_id").filter("shard_id IS NOT NULL"), "shard_id")


def longest_prefix_match(spark, d):
    chosen = spark.createDataFrame([(s,) for s in ("web", "web/openpages", "mail", "books/man", "civic/minutes")], "selection string")
    return catalog.longest_prefix(table(spark, d, "text_rows").select(F.col("source").alias("path")).distinct(), chosen)


def modality_map_sums(spark, d):
    sums = catalog.map_sums(table(spark, d, "data_plans"), ["max_repeats"], "corpus_weights")
    return sums.select("max_repeats", F.explode("corpus_weights").alias("corpus", "weight"))


def reconcile_totals(spark, d):
    declared = shards_once(spark, d).select("shard_id", "docs", "tokens")
    counted = first_rows(spark, d, "shard_id", "token_count").groupBy("shard_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"))
    return catalog.reconcile(declared, counted, "shard_id", ["docs", "tokens"])


def distinct_objects(spark, d):
    return catalog.distinct_objects(table(spark, d, "shards").select("sha256", "bytes"))


def pin_bijection(spark, d):
    pins = table(spark, d, "corpora").select("corpus")
    return catalog.bijection(pins, shards_once(spark, d).select(F.explode("sources").alias("corpus")), "corpus")


def inventory_paths(spark, d):
    sha = F.col("sha256")
    path = F.when(F.col("shard_id") % 2 == 0, F.concat_ws("/", F.lit("objects"), F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)).otherwise(F.concat(F.lit("objects/"), sha))
    return table(spark, d, "shards").filter("sha256 IS NOT NULL").select("shard_id", audit.object_path(path)["canonical"].alias("canonical")).distinct()


# ---- audit, telemetry, forecasts ------------------------------------------------------------------------


def audit_violations(spark, d):
    found = audit.violations(table(spark, d, "text_rows"), "row_id")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_ids_audit(spark, d):
    return audit.violations(table(spark, d, "text_rows"), "row_id").filter("rule = 'content-repeated'").select("row_id")


def telemetry_latest(spark, d):
    return telemetry.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_type"])


def heldout_relative_change(spark, d):
    ends = telemetry.latest(table(spark, d, "events").filter("value IS NOT NULL"), ["user_id"], ["ts", "event_id"], ["value"])
    change = F.round(telemetry.relative_change(F.col("first_value"), F.col("last_value")), 6)
    return ends.select("user_id", change.alias("change"), telemetry.advice(telemetry.relative_change(F.col("first_value"), F.col("last_value"))).alias("advice"))


def step_regressions(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("step"), F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("at"))
    return audit.not_increasing(lines, ["l_orderkey"], "at", "step").select("l_orderkey", "l_linenumber", "step", "before")


def heldout_loss(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("loss"), F.col("l_quantity").alias("mask"))
    return telemetry.held_out_loss(rows, ["l_returnflag"]).select("l_returnflag", F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"))


def resource_forecast(spark, d):
    runs = table(spark, d, "part").select(F.col("p_partkey").alias("run"), (F.col("p_size") * 1e8).alias("parameters"), (F.col("p_retailprice") * 1e8).alias("tokens"))
    profiles = spark.createDataFrame([("small", 18.0, 1, 8e9, 0.0), ("medium", 120.0, 2, 2.4e10, 0.0), ("large", 400.0, 8, 8e10, 2.0e15)], "accelerator string, tflops double, gpus int, memory_bytes double, calibrated_flops_per_second double")
    out = forecast.forecasts(runs.withColumn("bytes_per_parameter", F.lit(16.0)), profiles)
    return out.groupBy("accelerator", "fits").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("seconds") / 1e6, 3).alias("megaseconds"))


def forecast_calibration(spark, d):
    evidence = table(spark, d, "orders").select(F.col("o_orderpriority").alias("accelerator"), (F.col("o_custkey") % 4).alias("gpus"), F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("double").alias("flops"), (F.col("o_orderkey") % 100 + 1).cast("double").alias("seconds"))
    return forecast.calibrations(evidence).select("accelerator", "gpus", "runs", "flops", "seconds", F.round("flops_per_second", 6).alias("flops_per_second"))


# ---- streams --------------------------------------------------------------------------------------------


def stream_event_windows(spark, d):
    out = streams.drained(streams.windowed(streams.event_stream(spark, f"{d}/events.parquet"), "6 hours"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("value", 4).alias("value"))


def stream_sliding_windows(spark, d):
    out = streams.drained(streams.windowed(streams.event_stream(spark, f"{d}/events.parquet"), "12 hours", "6 hours"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


def event_sessions(spark, d):
    out = streams.sessions(table(spark, d, "events"), "30 minutes")
    return out.select("user_id", F.col("w.start").alias("session_start"), "events")


# ---- export and drift ------------------------------------------------------------------------------------


def jsonl_export_lines(spark, d):
    from loomwright.sources import sinks

    rows = first_rows(spark, d, "text", "source", "source_name", "license", "license_raw", "language", "language_score", "date", "token_count", "meta")
    return sinks.jsonl_lines(rows.filter("text IS NOT NULL")).select("row_id", F.sha2("line", 256).alias("line_sha256"))


def mapped_payloads(spark, d):
    rows = table(spark, d, "raw_rows").select("file_id", "line_no", F.expr("try_parse_json(payload)").alias("doc")).filter("doc IS NOT NULL")
    body = mapping.mapped_text(F.col("doc"), ["text", "text[]", "body", "content"], ["title"])
    return rows.select("file_id", "line_no", F.octet_length(body).alias("bytes"), mapping.mapped_meta(F.col("doc"), {"source": "source", "kept": "origin"}).alias("meta"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "raw_files"), drift.statistics_once(table(spark, d, "raw_rows")))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_rows")
    stats = drift.statistics_once(rows)
    return drift.Projection(stats, drift.changes(table(spark, d, "raw_files"), stats)).table(rows, keep_unreadable=True)


_HELPERS = {"documents", "first_rows", "shards_once", "texts", "table", "queries", "oracle_sql"}


def queries() -> dict[str, Query]:
    from loomwright import scenarios

    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _HELPERS}
    return own | scenarios.queries()


def oracle_sql() -> dict[str, str]:
    from loomwright.oracle import SQL
    from loomwright.scenarios_sql import SQL as FILES

    return {**SQL, **FILES}
