"""DuckDB SQL of the core queries."""

from __future__ import annotations

from loomwright.functions import license as licenses
from loomwright.functions import privacy, text

_EMAIL = text.EMAIL.replace("'", "''")
_PHONE = privacy.PHONE_CANDIDATE.pattern


def _license(column: str) -> str:
    """Normalization of a licence column, in SQL."""
    value = f"regexp_replace({column}, '{licenses.SPACE_AROUND}', '', 'g')"
    low = f"lower({value})"
    url, name = licenses.CC_URL.removeprefix("(?i)"), licenses.CC_NAME.removeprefix("(?i)")
    part = lambda pattern, i: f"regexp_extract({value}, '{pattern}', {i}, 'i')"
    named = f"upper(translate({part(name, 1)}, ' _', '--'))"
    aliases = " ".join(f"WHEN {low} = '{k.lower()}' THEN '{v}'" for k, v in licenses.ALIASES.items())
    return (
        f"(CASE WHEN {low} = '' THEN '' {aliases} WHEN {part(url, 3)} <> '' THEN 'CC0-' || {part(url, 3)} WHEN {part(url, 1)} <> '' THEN 'CC-' || upper({part(url, 1)}) || '-' || {part(url, 2)}"
        f" WHEN {low} = 'public domain' THEN 'LicenseRef-Public-Domain' WHEN {named} IN ('ZERO', '0') THEN 'CC0-' || {part(name, 2)} WHEN {named} <> '' THEN 'CC-' || {named} || '-' || {part(name, 2)} ELSE {value} END)"
    )


DOCS = f"docs AS (SELECT doc_id, text, source, coalesce(nullif({_license('license')}, ''), 'LicenseRef-Default') AS license, sha256(text) AS content_sha256, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL AND text <> '')"
SURVIVORS = "kept AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY content_sha256, license ORDER BY doc_id) = 1)"
ROWS = "first AS (SELECT * FROM text_rows QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"
SHARDS = "sh AS (SELECT * REPLACE (coalesce(sources, []::VARCHAR[]) AS sources) FROM shards QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY indexed_at) = 1)"
SCORE = "sha256('\\x00\\x00\\x00\\x00\\x00\\x00\\x00\\x2A'::BLOB || encode({key}))"
HELD = (
    "scored AS (SELECT doc_id::VARCHAR AS selection_id, " + SCORE.format(key="doc_id::VARCHAR") + " AS score, source FROM docs),"
    " held AS (SELECT selection_id FROM scored ORDER BY score, selection_id LIMIT (SELECT greatest(1, least(ceil(count(*) * 0.01), 256, count(*) - 1))::BIGINT FROM docs))"
)
INTERVAL = """dated AS (SELECT *, CASE
    WHEN regexp_full_match(date, '\\d{4}') THEN try_strptime(date || '-01-01', '%Y-%m-%d')
    WHEN regexp_full_match(date, '\\d{4}-\\d{2}') THEN try_strptime(date || '-01', '%Y-%m-%d')
    WHEN regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(date, '%Y-%m-%d')
    WHEN regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z') THEN try_strptime(date, '%Y-%m-%dT%H:%M:%SZ') END AS a FROM text_rows),
  ranged AS (SELECT *, length(date) > 10 AS instant, CASE length(date) WHEN 4 THEN a + INTERVAL 1 YEAR WHEN 7 THEN a + INTERVAL 1 MONTH WHEN 10 THEN a + INTERVAL 1 DAY ELSE a END AS b FROM dated)"""
TURNS = "turns AS (SELECT l_orderkey AS conv_id, l_linenumber AS turn, CASE WHEN l_linenumber % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, 'part ' || l_partkey || ' <' || l_returnflag || '>' AS content FROM lineitem)"
VALID = "bool_or(role = 'user') AND bool_or(role = 'assistant')"
PAYLOAD = "'{\"messages\":[' || string_agg('{\"role\":\"' || role || '\",\"content\":\"' || replace(replace(content, '<', '\\u003c'), '>', '\\u003e') || '\"}', ',' ORDER BY turn, role, content) || ']}'"
MARKUP = "string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn, role, content)"
_SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _elements(pieces: str) -> str:
    return f"list_filter(list_transform({pieces}, lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' ')), lambda x: x <> '')"


def _repeats(items: str) -> str:
    size = lambda a: f"coalesce(list_sum(list_transform({a}, lambda x: octet_length(encode(x)))), 0)"
    return f"(len({items}) >= 4 AND ((len({items}) - len(list_distinct({items}))) / len({items}) > 0.30 OR ({size(items)} - {size(f'list_distinct({items})')}) / octet_length(encode(text)) > 0.20))"


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_MATCH = "regexp_full_match(coalesce({c}, ''), '{p}')"
_FLAG = {k: f"coalesce({k}, false)" for k in ("repetitive_content", "boilerplate_content")}



def _optional(column: str, key: str) -> str:
    """A member of a JSON line that is left out where it is null or empty."""
    return f"""CASE WHEN coalesce({column}, '') <> '' THEN ',"{key}":' || to_json({column})::VARCHAR ELSE '' END"""


SQL = {
    "exact_dedup_by_license": f"WITH {DOCS}, {SURVIVORS} SELECT license, count(*) AS docs, sum(bytes)::BIGINT AS bytes FROM kept GROUP BY 1",
    "duplicate_groups": f"WITH {DOCS} SELECT content_sha256, count(*) AS copies, min(doc_id) AS first_id FROM docs GROUP BY 1 HAVING count(*) > 1",
    "dedup_survivors": f"WITH {DOCS}, {SURVIVORS} SELECT doc_id, content_sha256, license FROM kept",
    "dedup_copy_numbers": f"WITH {DOCS} SELECT doc_id, row_number() OVER (PARTITION BY content_sha256, license ORDER BY doc_id)::INT AS copy_no FROM docs",
    "dedup_totals": f"WITH {DOCS} SELECT count(*) AS seen, count(DISTINCT (content_sha256, license)) AS kept, count(*) - count(DISTINCT (content_sha256, license)) AS duplicate FROM docs",
    "dedup_seed_anti_join": f"WITH {DOCS} SELECT doc_id, license FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs s WHERE s.source LIKE 'web/%' AND s.content_sha256 = d.content_sha256 AND s.license = d.license)",
    "seed_semi_join": f"WITH {DOCS} SELECT doc_id FROM docs d WHERE EXISTS (SELECT 1 FROM docs s WHERE s.source LIKE 'web/%' AND s.content_sha256 = d.content_sha256 AND s.license = d.license)",
    "union_of_selections": "SELECT DISTINCT path FROM raw_files WHERE stream LIKE 'a%' OR stream LIKE 'abstracts%' OR stream LIKE 'm%'",
    "license_normalize": f"SELECT license_raw, {_license('license_raw')} AS license FROM (SELECT license_raw FROM text_rows UNION SELECT license FROM text_rows)",
    "license_set_join": f"SELECT corpus, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(licenses, lambda x: {_license('x')}), lambda x: x IS NOT NULL AND x <> ''))), ' AND '), '') AS license FROM corpora",
    "license_policy_filter": "SELECT corpus FROM corpora WHERE licenses IS NOT NULL AND len(list_filter(licenses, lambda x: NOT (regexp_full_match(x, 'CC[^/]*') OR x = 'MIT'))) = 0",
    "license_usage_totals": f"WITH {ROWS} SELECT shard_id, license, count(*) AS docs, coalesce(sum(token_count), 0)::BIGINT AS tokens FROM first GROUP BY 1, 2",
    "totals_by_license": f"WITH {SHARDS} SELECT coalesce(nullif(license, ''), '(none declared)') AS license, count(*) AS shards, coalesce(sum(docs), 0)::BIGINT AS docs, coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM sh GROUP BY 1",
    "glob_include_exclude": "SELECT source, count(*) AS rows FROM text_rows WHERE regexp_full_match(source, 'web/[^/]*|mail/[^/]*|civic/m[^/]nutes') AND NOT regexp_full_match(source, 'web/harbor[^/]*') GROUP BY 1",
    "date_interval_filter": f"WITH {INTERVAL} SELECT length(date)::INT AS precision, count(*) AS rows FROM ranged WHERE (b > TIMESTAMP '2010-03-01' OR (instant AND b = TIMESTAMP '2010-03-01')) AND a < TIMESTAMP '2019-06-16' GROUP BY 1",
    "exclusion_tristate": f"SELECT repetitive_content, boilerplate_content, license, {_FLAG['repetitive_content']} OR {_FLAG['boilerplate_content']} OR {_MATCH.format(c='license', p='LicenseRef-[^/]*|Public[^/]*')} AS excluded, count(*) AS rows FROM text_rows GROUP BY 1, 2, 3, 4",
    "record_filter_policy": f"""WITH {INTERVAL} SELECT source, count(*) AS rows FROM ranged WHERE {_MATCH.format(c='license', p='CC[^/]*|MIT|Apache-[^/]*')} AND NOT {_FLAG['repetitive_content']}
        AND (source <> 'web/openpages' OR ({_MATCH.format(c='language', p='en[^/]*')} AND coalesce((b > TIMESTAMP '2000-01-01' OR (instant AND b = TIMESTAMP '2000-01-01')) AND a < TIMESTAMP '2025-07-01', false)))
        AND (source <> 'books/manuals' OR coalesce(main_content, true)) GROUP BY 1""",
    "language_corpora": "SELECT corpus FROM corpora WHERE len(list_filter(languages, lambda x: lower(x) IN ('de', 'th'))) > 0",
    "rejection_summary": f"SELECT CASE WHEN text IS NULL THEN 'mapping' WHEN regexp_full_match(text, '[\\s\\x0B]*') THEN 'empty' WHEN contains(text, chr(0)) THEN 'malformed' WHEN NOT {_MATCH.format(c='license', p='CC[^/]*|MIT|Apache[^/]*')} THEN 'license-policy' ELSE 'accepted' END AS reason, count(*) AS rows FROM documents GROUP BY 1",
    "unassessed_corpora": "SELECT corpus, record_schema FROM corpora WHERE record_schema < 2",
    "skip_completed": "SELECT corpus FROM corpora WHERE corpus NOT IN (SELECT source FROM text_rows WHERE source IS NOT NULL)",
    "email_flag": f"SELECT doc_id, coalesce(regexp_matches(text, '{_EMAIL}'), false) AS email_addresses FROM documents",
    "email_redaction_counts": f"SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '{_EMAIL}'))::INT AS n FROM documents) WHERE n > 0",
    "phone_candidates": f"""SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_PHONE}'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) <= 15
        AND (length(regexp_replace(x, '[^0-9]', '', 'g')) >= 10 OR (length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7 AND regexp_matches(x, '^\\+|[()]')))))::INT AS n FROM documents) WHERE n > 0""",
    "boilerplate_lines": f"WITH e AS (SELECT doc_id, text, {_elements('string_split(text, chr(10))')} AS l, {_elements(chr(114) + 'egexp_split_to_array(trim(text, chr(32)), ' + chr(39) + text.PARAGRAPH + chr(39) + ')')} AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_repeats('l')} OR {_repeats('p')} AS boilerplate_content FROM e",
    "word_counts": f"SELECT doc_id, len({WORDS})::INT AS words FROM documents WHERE text IS NOT NULL",
    "top_trigram_fraction": f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, len(w) AS n, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
        c AS (SELECT doc_id, n, g, count(*) AS c FROM g GROUP BY 1, 2, 3) SELECT doc_id, round(max(c) * 3 / n, 6) AS fraction FROM c GROUP BY doc_id, n""",
    "byte_targets": f"WITH {DOCS} SELECT (sum(bytes + 1) - 1)::BIGINT AS targets FROM docs",
    "epoch_targets": f"WITH {DOCS} SELECT (sum(bytes + 1) * 3 - 1)::BIGINT AS targets FROM docs",
    "partition_targets": f"WITH {DOCS}, {HELD} SELECT sum(bytes)::BIGINT AS targets FROM docs WHERE doc_id::VARCHAR NOT IN (SELECT selection_id FROM held)",
    "byte_stats_by_source": f"WITH {DOCS} SELECT source, count(*) AS docs, sum(bytes)::BIGINT AS bytes, max(bytes)::INT AS largest FROM docs GROUP BY 1",
    "heldout_lowest_sha256": f"WITH {DOCS}, {HELD} SELECT selection_id FROM held",
    "heldout_stratified": f"WITH {DOCS}, {HELD}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, selection_id) AS r FROM scored) SELECT selection_id FROM ranked ORDER BY r, source LIMIT (SELECT greatest(1, least(ceil(count(*) * 0.01), 256, count(*) - 1))::BIGINT FROM docs)",
    "training_minus_heldout": f"WITH {DOCS}, {HELD} SELECT source, count(*) AS docs FROM docs WHERE doc_id::VARCHAR NOT IN (SELECT selection_id FROM held) GROUP BY 1",
    "evaluation_records": f"WITH {DOCS}, {HELD} SELECT doc_id, source FROM docs WHERE doc_id::VARCHAR IN (SELECT selection_id FROM held)",
    "evaluation_digest": f"WITH {DOCS}, {HELD} SELECT sha256(string_agg(selection_id || chr(10), '' ORDER BY selection_id)) AS evaluation_sha256, count(*) AS records FROM held",
    "calibration_order": "SELECT DISTINCT sha256, sha256('\\x2A\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB || encode(sha256)) AS score FROM shards WHERE sha256 IS NOT NULL",
    "sequence_packing_counts": f"WITH {DOCS} SELECT source, sum(bytes + 1)::BIGINT AS tokens, ceil((sum(bytes + 1) - 1) / 1024)::BIGINT AS sequences FROM docs GROUP BY 1",
    "step_capacity": f"WITH {DOCS}, s AS (SELECT ceil((sum(bytes + 1) - 1) / 1024)::BIGINT AS sequences FROM docs) SELECT sequences, ceil(sequences / 8)::BIGINT AS steps FROM s",
    "record_offsets": f"WITH {DOCS} SELECT doc_id, coalesce(sum(bytes + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM docs",
    "seeded_shuffle": f"WITH {DOCS} SELECT doc_id, {SCORE.format(key='doc_id::VARCHAR')} AS shuffle_key FROM docs",
    "weighted_interleave_order": f"""WITH {ROWS}, w AS (SELECT DISTINCT corpus, greatest(length(corpus), 1) AS weight FROM (SELECT corpus FROM corpora UNION SELECT source FROM text_rows) WHERE corpus IS NOT NULL),
        r AS (SELECT row_id, source AS corpus, CASE WHEN token_count >= 0 THEN token_count ELSE coalesce(octet_length(encode(text)), 0) END AS tokens FROM first),
        e AS (SELECT row_id, corpus, weight, coalesce(sum(tokens + 1) OVER (PARTITION BY corpus ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS emitted FROM r JOIN w USING (corpus)),
        m AS (SELECT *, emitted // weight AS whole, ((emitted % weight) * 1000000000000000000) // weight AS part FROM e)
        SELECT row_id, corpus, row_number() OVER (ORDER BY whole, part, corpus, row_id) AS position FROM m""",
    "epoch_repetition": f"WITH {DOCS} SELECT epoch::INT AS epoch, source, count(*) AS docs FROM docs, range(3) t(epoch) GROUP BY 1, 2",
    "conversation_assemble": f"WITH {TURNS} SELECT conv_id, sha256({PAYLOAD}) AS payload_sha256 FROM turns GROUP BY 1 HAVING {VALID}",
    "conversation_validate": f"WITH {TURNS}, c AS (SELECT conv_id, {VALID} AS valid FROM turns GROUP BY 1) SELECT valid, count(*) AS conversations FROM c GROUP BY 1",
    "chat_template_render": f"WITH {TURNS} SELECT conv_id, sha256(string_agg(upper(role[1]) || role[2:] || ':' || CASE WHEN role = 'assistant' THEN '' ELSE ' ' END || content, chr(10) || chr(10) ORDER BY turn, role, content)) AS plain_sha256, sha256({MARKUP}) AS markup_sha256 FROM turns GROUP BY 1",
    "loss_mask_targets": f"WITH {TURNS}, c AS (SELECT octet_length(encode({MARKUP})) + 1 AS tokens, sum(CASE WHEN role = 'assistant' THEN octet_length(encode(content)) + 11 ELSE 0 END) + CASE WHEN arg_max(role, turn) = 'assistant' THEN 1 ELSE 0 END AS targets FROM turns GROUP BY conv_id) SELECT sum(tokens)::BIGINT AS tokens, sum(targets)::BIGINT AS targets FROM c",
    "shard_summary": """SELECT shard_id, count(*) AS records, coalesce(sum(token_count), 0)::BIGINT AS tokens, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes, count(*) FILTER (email_addresses) AS email_addresses_records, count(*) FILTER (repetitive_content) AS repetitive_content_records,
        count(*) FILTER (boilerplate_content) AS boilerplate_content_records, coalesce(sum(redacted_email_addresses), 0)::BIGINT AS redacted_email_addresses, coalesce(sum(redacted_ip_addresses), 0)::BIGINT AS redacted_ip_addresses, coalesce(sum(redacted_phone_numbers), 0)::BIGINT AS redacted_phone_numbers,
        coalesce(sum(removed_mail_routing_headers), 0)::BIGINT AS removed_mail_routing_headers, coalesce(sum(redacted_credentials), 0)::BIGINT AS redacted_credentials, coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (license IS NOT NULL)), ','), '') AS licenses FROM text_rows GROUP BY 1""",
    "catalog_grouping_sets": f"WITH {SHARDS}, s AS (SELECT coalesce(format, '') AS format, coalesce(license, '') AS license, docs, tokens, bytes FROM sh) SELECT grouping_id(format, license)::BIGINT AS level, format, license, count(*) AS shards, coalesce(sum(docs), 0)::BIGINT AS docs, coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM s GROUP BY ROLLUP (format, license)",
    "corpora_list": f"""WITH {SHARDS}, e AS (SELECT unnest(sources) AS corpus, docs, tokens, bytes FROM sh), s AS (SELECT corpus, count(*) AS shards, sum(docs)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes FROM e GROUP BY 1)
        SELECT c.corpus, domain, coalesce(array_to_string(list_sort(list_distinct(licenses)), ','), '') AS licenses, coalesce(array_to_string(list_sort(list_distinct(languages)), ','), '') AS languages, coalesce(shards, 0) AS shards, coalesce(docs, 0) AS docs, coalesce(tokens, 0) AS tokens, coalesce(bytes, 0) AS bytes FROM corpora c LEFT JOIN s USING (corpus)""",
    "unknown_references": f"WITH {SHARDS} SELECT DISTINCT corpus, shard_id FROM (SELECT shard_id, unnest(sources) AS corpus FROM sh) WHERE corpus NOT IN (SELECT corpus FROM corpora WHERE corpus NOT LIKE 'archive/%')",
    "reference_full_outer": "WITH a AS (SELECT DISTINCT shard_id FROM shards), b AS (SELECT shard_id, count(*) AS uses FROM text_rows WHERE shard_id IS NOT NULL GROUP BY 1) SELECT shard_id, CASE WHEN a.shard_id IS NULL THEN 'missing' WHEN b.uses IS NULL THEN 'unreferenced' ELSE 'referenced' END AS state, coalesce(uses, 0) AS uses FROM a FULL JOIN b USING (shard_id)",
    "longest_prefix_match": "WITH s(selection) AS (VALUES ('web'), ('web/openpages'), ('mail'), ('books/man'), ('civic/minutes')), p AS (SELECT DISTINCT source AS path FROM text_rows) SELECT path, arg_max(selection, length(selection)) AS selection FROM p JOIN s ON path = selection OR starts_with(path, selection || '/') GROUP BY 1",
    "modality_map_sums": "WITH e AS (SELECT max_repeats, unnest(map_entries(corpus_weights)) AS e FROM data_plans) SELECT max_repeats, e.key AS corpus, sum(e.value)::BIGINT AS weight FROM e GROUP BY 1, 2",
    "reconcile_totals": f"WITH {ROWS}, {SHARDS}, c AS (SELECT shard_id, count(*) AS n, sum(token_count)::BIGINT AS t FROM first GROUP BY 1) SELECT shard_id, docs AS declared_docs, n AS computed_docs, tokens AS declared_tokens, t AS computed_tokens FROM (SELECT shard_id, docs, tokens FROM sh) FULL JOIN c USING (shard_id) WHERE docs IS DISTINCT FROM n OR tokens IS DISTINCT FROM t",
    "distinct_objects": "SELECT sha256, count(*) AS uses, min(bytes) AS bytes, count(DISTINCT bytes) > 1 AS conflict FROM shards GROUP BY 1",
    "pin_bijection": f"WITH {SHARDS}, a AS (SELECT corpus, count(*) AS e FROM corpora GROUP BY 1), b AS (SELECT corpus, count(*) AS g FROM (SELECT unnest(sources) AS corpus FROM sh) GROUP BY 1) SELECT corpus, coalesce(e, 0) AS expected, coalesce(g, 0) AS given FROM a FULL JOIN b USING (corpus) WHERE coalesce(e, 0) <> 1 OR coalesce(g, 0) <> 1",
    "inventory_paths": "SELECT DISTINCT shard_id, shard_id % 2 = 0 AND regexp_full_match(sha256, '[0-9a-f]{64}') AS canonical FROM shards WHERE sha256 IS NOT NULL",
    "telemetry_latest": "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS last_value, arg_max(event_type, (ts, event_id)) FILTER (event_type IS NOT NULL) AS last_event_type, arg_min(value, (ts, event_id)) FILTER (value IS NOT NULL) AS first_value, arg_min(event_type, (ts, event_id)) FILTER (event_type IS NOT NULL) AS first_event_type FROM events GROUP BY 1",
    "heldout_relative_change": "WITH e AS (SELECT user_id, arg_max(value, (ts, event_id)) AS l, arg_min(value, (ts, event_id)) AS f FROM events WHERE value IS NOT NULL GROUP BY 1), c AS (SELECT user_id, CASE WHEN f <> 0 THEN (l - f) / f END AS c FROM e) SELECT user_id, round(c, 6) AS change, CASE WHEN c > 0.25 THEN 'stop' WHEN c > 0.05 THEN 'inspect' WHEN c < -0.05 THEN 'note' ELSE 'none' END AS advice FROM c",
    "step_regressions": "SELECT l_orderkey, l_linenumber, step, before FROM (SELECT l_orderkey, l_linenumber, l_partkey AS step, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS before FROM lineitem) WHERE step <= before",
    "heldout_loss": "WITH l AS (SELECT l_returnflag, sum(l_discount * 10 * l_quantity) / sum(l_quantity) AS loss FROM lineitem GROUP BY 1) SELECT l_returnflag, round(loss, 6) AS loss, round(exp(least(loss, 80)), 4) AS perplexity FROM l",
    "resource_forecast": """WITH a(accelerator, tflops, gpus, mem, cal) AS (VALUES ('small', 18.0::DOUBLE, 1, 8e9, 0.0::DOUBLE), ('medium', 120.0, 2, 2.4e10, 0.0), ('large', 400.0, 8, 8e10, 2.0e15)),
        r AS (SELECT accelerator, p_size * 1e8 * 16.0 <= mem * gpus * 0.9 AS fits, CASE WHEN cal > 0 THEN 6.0::DOUBLE * (p_size * 1e8) * (p_retailprice * 1e8) / cal ELSE 6.0::DOUBLE * (p_size * 1e8) * (p_retailprice * 1e8) / (tflops * 1e12 * gpus) * 1.08::DOUBLE END AS s FROM part, a)
        SELECT accelerator, fits, count(*) AS runs, round(sum(s) / 1e6, 3) AS megaseconds FROM r GROUP BY 1, 2""",
    "forecast_calibration": "SELECT o_orderpriority AS accelerator, o_custkey % 4 AS gpus, count(*) AS runs, sum(o_custkey)::DOUBLE AS flops, sum(o_orderkey % 100 + 1)::DOUBLE AS seconds, round(sum(o_custkey)::DOUBLE / sum(o_orderkey % 100 + 1)::DOUBLE, 6) AS flops_per_second FROM orders GROUP BY 1, 2",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_sliding_windows": "SELECT window_start, event_type, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) AS window_start, event_type FROM events) GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, s",
    "byte_encoding": """WITH b AS (SELECT doc_id, encode(text) AS e, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, n, list_transform(range(n), lambda i: ('0x' || substr(hex(e), 2 * i + 1, 2))::INT + 3) AS t FROM b)
        SELECT doc_id, n::INT AS tokens, coalesce(list_sum(t), 0)::BIGINT AS sum, t[1:8] AS first_tokens FROM t""",
    "jsonl_export_lines": f"""WITH {ROWS} SELECT row_id, sha256('{{"sha256":"' || sha256(text) || '","text":' || to_json(text)::VARCHAR || {_optional('source', 'source')} || {_optional('source_name', 'source_name')} || {_optional('license', 'license')} || {_optional('license_raw', 'license_raw')} || {_optional('language', 'lang')} || {_optional('date', 'date')}
        || CASE WHEN coalesce(language_score, 0) <> 0 THEN ',"lang_score":' || language_score ELSE '' END || CASE WHEN coalesce(token_count, 0) <> 0 THEN ',"tokens":' || token_count ELSE '' END || CASE WHEN coalesce(meta, '') <> '' THEN ',"meta":' || meta ELSE '' END || '}}') AS line_sha256 FROM first WHERE text IS NOT NULL""",
    "audit_violations": """WITH v AS (SELECT row_id, text, lower(hex(content_sha256)) AS h, token_count, language_score, meta FROM text_rows), s AS (
        SELECT row_id, 'text-missing' AS rule FROM v WHERE text IS NULL OR text = '' UNION SELECT row_id, 'digest-differs' FROM v WHERE text IS NOT NULL AND h IS DISTINCT FROM sha256(text) UNION SELECT row_id, 'tokens-missing' FROM v WHERE token_count IS NULL OR token_count < 0
        UNION SELECT row_id, 'score-out-of-range' FROM v WHERE language_score < 0 OR language_score > 1000 UNION SELECT row_id, 'meta-not-an-object' FROM v WHERE meta IS NOT NULL AND NOT (json_valid(meta) AND left(ltrim(meta), 1) = '{')
        UNION SELECT row_id, 'content-repeated' FROM v WHERE sha256(text) IN (SELECT sha256(text) FROM v WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT row_id) > 1)) SELECT rule, count(*) AS rows FROM s GROUP BY 1""",
    "duplicate_ids_audit": "SELECT DISTINCT row_id FROM text_rows WHERE sha256(text) IN (SELECT sha256(text) FROM text_rows WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT row_id) > 1)",
    "heldout_byte_budget": f"""WITH RECURSIVE {DOCS}, scored AS (SELECT doc_id::VARCHAR AS selection_id, {SCORE.format(key='doc_id::VARCHAR')} AS score, bytes FROM docs), top AS (SELECT *, row_number() OVER (ORDER BY score, selection_id) AS n FROM (SELECT * FROM scored ORDER BY score, selection_id LIMIT 256)),
        want AS (SELECT greatest(1, least(ceil(count(*) * 0.01), 256, count(*) - 1))::BIGINT AS w FROM docs),
        f(n, used, taken, id) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR UNION ALL SELECT t.n, CASE WHEN f.used + t.bytes <= 20000 AND f.taken < w THEN f.used + t.bytes ELSE f.used END, CASE WHEN f.used + t.bytes <= 20000 AND f.taken < w THEN f.taken + 1 ELSE f.taken END, CASE WHEN f.used + t.bytes <= 20000 AND f.taken < w THEN t.selection_id END
        FROM f JOIN top t ON t.n = f.n + 1, want) SELECT id AS selection_id FROM f WHERE id IS NOT NULL""",
    "repetition_8gram": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL), long AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) >= 50),
        g AS (SELECT doc_id, n, unnest(list_transform(range(1, n - 1), lambda i: array_to_string(w[i:i + 2], chr(31)))) AS g FROM long), t AS (SELECT doc_id, max(c) * 3 / any_value(n) AS f FROM (SELECT doc_id, n, g, count(*) AS c FROM g GROUP BY 1, 2, 3) GROUP BY 1),
        e AS (SELECT doc_id, n, list_transform(range(1, n - 6), lambda i: array_to_string(w[i:i + 7], chr(31))) AS e FROM long),
        s(doc_id, pos, total, seen) AS (SELECT doc_id, 1, 0, []::VARCHAR[] FROM e WHERE len(e) > len(list_distinct(e)) UNION ALL SELECT s.doc_id, CASE WHEN list_contains(s.seen, e.e[s.pos]) THEN s.pos + 8 ELSE s.pos + 1 END, CASE WHEN list_contains(s.seen, e.e[s.pos]) THEN s.total + 8 ELSE s.total END, list_append(s.seen, e.e[s.pos]) FROM s JOIN e USING (doc_id) WHERE s.pos <= len(e.e)),
        m AS (SELECT doc_id, max(total) AS total FROM s GROUP BY 1) SELECT w.doc_id, coalesce(t.f > 0.18 OR m.total / long.n > 0.12, t.f > 0.18, false) AS repetitive_content FROM w LEFT JOIN long USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "calibration_budget_sample": f"""WITH {DOCS}, o AS (SELECT doc_id, text, bytes, coalesce(sum(bytes) OVER (ORDER BY {SCORE.format(key='doc_id::VARCHAR')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs), near AS (SELECT *, least(bytes, 100000 - start) AS room FROM o WHERE start < 100000),
        k AS (SELECT doc_id, text, room, unnest(range(0, length(text) + 1)) AS k FROM near), c AS (SELECT doc_id, max(octet_length(encode(left(text, k)))) FILTER (octet_length(encode(left(text, k))) <= room) AS bytes FROM k GROUP BY 1) SELECT doc_id, bytes::INT AS bytes FROM c WHERE bytes > 0""",
}
