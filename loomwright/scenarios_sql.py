"""DuckDB SQL of the queries over files and documents."""

from __future__ import annotations

from loomwright.oracle import _SPACE, DOCS, HELD, ROWS, SCORE, SHARDS, TURNS, VALID, _elements, _license, _repeats
from loomwright.scenarios import text

_EMAIL = text.EMAIL.replace("'", "''")
_OBJECT = "(json_valid(payload) AND json_type(payload) = 'OBJECT')"
_ESCAPED = lambda x: f"replace(replace(replace({x}, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"
_CONTENT = _ESCAPED("to_json(content)::VARCHAR")
_MESSAGE = "'{\"role\":\"' || role || '\",\"content\":' || " + _CONTENT + " || '}'"
CANONICAL = f"{ROWS}, rows AS (SELECT row_id, text, source, coalesce(license, '') AS license, coalesce(token_count, 0) AS token_count, meta FROM first WHERE text IS NOT NULL)"
_CLEAN = "regexp_replace(text, '[<>&\"\\\\\\n\\r\\t]', ' ', 'g')"


def _payload(messages: str) -> str:
    return f"'{{\"messages\":[' || {messages} || ']}}'"


_TREE = "SELECT l_orderkey, 'order ' || l_orderkey AS question, 'part ' || arg_min(l_partkey, (l_suppkey % 3, l_linenumber, l_suppkey, l_partkey)) AS answer FROM lineitem GROUP BY 1"
_LINE = f"'{{\"text\":\"' || {_CLEAN} || '\"}}'"

SQL = {
    "scan_text_files": "SELECT sample_id, sha256(text) AS text_sha256, 'sha256:' || sha256(text) AS source, 0::BIGINT AS position FROM lang_samples WHERE text <> ''",
    "probe_formats": f"""SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'jsonl' WHEN 2 THEN 'json' WHEN 3 THEN 'xml' WHEN 4 THEN 'html' ELSE 'jsonl' END AS format, CASE WHEN item_id % 6 = 5 THEN 'gzip' END AS compression,
        CASE item_id % 6 WHEN 0 THEN sha256({_CLEAN}) WHEN 1 THEN sha256({_LINE} || chr(10) || {_LINE} || chr(10)) WHEN 2 THEN sha256({_LINE}) WHEN 3 THEN sha256('<?xml version="1.0"?><d><p>' || {_CLEAN} || '</p></d>') WHEN 4 THEN sha256('<!doctype html><html><p>' || {_CLEAN} || '</p></html>') END AS sha256 FROM eval_items WHERE text <> ''""",
    "scan_jsonl": "SELECT file_id, position, sha256(payload) AS line_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no, payload) AS position FROM raw_rows WHERE payload IS NOT NULL) WHERE trim(payload) <> ''",
    "scan_jsonl_rejections": """WITH p AS (SELECT file_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM raw_rows WHERE trim(payload) <> '')
        SELECT file_id, CASE WHEN p IS NULL OR json_type(p) <> 'OBJECT' THEN 'malformed' WHEN coalesce(json_type(p, '$.text'), 'NULL') IN ('NULL', 'OBJECT', 'ARRAY') THEN 'mapping' WHEN trim(p ->> '$.text', ' ') = '' THEN 'empty' ELSE 'accepted' END AS reason, count(*) AS rows FROM p GROUP BY 1, 2""",
    "scan_json_documents": f"SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no, payload) AS position, sha256(trim(payload)) AS record_sha256 FROM raw_rows WHERE {_OBJECT}",
    "scan_parquet_text": "SELECT sha256(text) AS text_sha256, count(*) AS rows, min(octet_length(encode(text)))::INT AS bytes, count(*) AS positions FROM documents GROUP BY 1",
    "parquet_row_counts": "SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'text_rows', count(*) FROM text_rows UNION ALL SELECT 'shards', count(*) FROM shards UNION ALL SELECT 'raw_rows', count(*) FROM raw_rows",
    "rows_by_position": f"WITH {DOCS}, {HELD} SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id::VARCHAR IN (SELECT selection_id FROM held)",
    "text_sizes_by_position": f"WITH {DOCS}, {HELD} SELECT count(*) AS rows, sum(octet_length(encode(text)))::BIGINT AS bytes, max(octet_length(encode(text)))::INT AS largest FROM documents WHERE doc_id::VARCHAR IN (SELECT selection_id FROM held)",
    "scan_mailboxes": "SELECT benchmark, row_number() OVER (PARTITION BY benchmark ORDER BY item_id) AS position, sha256('Subject: ' || item_id || chr(10) || chr(10) || text || chr(10)) AS message_sha256 FROM eval_items WHERE text IS NOT NULL",
    "scan_xml_records": f"""WITH x AS (SELECT item_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') || chr(10) || chr(10) || 'End.' || chr(10) AS body FROM eval_items WHERE text IS NOT NULL)
        SELECT 'item:' || item_id AS source, sha256(body) AS text_sha256, octet_length(encode(body))::INT AS bytes FROM x""",
    "scan_bounded_text": "SELECT item_id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10)) AS body_sha256 FROM eval_items WHERE text IS NOT NULL",
    "scan_chunked_text": "SELECT item_id, sha256(text) AS text_sha256, true AS bounded, octet_length(encode(text)) > 300 AS several FROM eval_items WHERE text IS NOT NULL",
    "scan_opaque_chunks": "SELECT item_id, sha256(text) AS content_sha256, ceil(octet_length(encode(text)) / 150)::INT AS chunks FROM eval_items WHERE text IS NOT NULL",
    "canonical_layouts": "SELECT language, true AS main_content, NULL::BOOLEAN AS email_addresses, count(*) AS rows, sum(token_count)::BIGINT AS tokens, sum(coalesce(language_score, 0))::BIGINT AS scores, 0::BIGINT AS redacted, min(lower(hex(content_sha256))) AS least_sha256 FROM text_rows GROUP BY 1",
    "mapped_license_sets": f"""WITH l AS (SELECT corpus, list_filter(licenses, lambda x: x IS NOT NULL AND x <> '') AS l FROM corpora)
        SELECT corpus, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(l, []::VARCHAR[]), lambda x: {_license('x')}), lambda x: x <> ''))), ' AND '), ''), 'LicenseRef-Default') AS license, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) > 1 THEN to_json(l)::VARCHAR END AS license_raw FROM l""",
    "dialogue_pairs": f"""WITH m AS (SELECT o_orderkey, 'say "' || o_orderpriority || '"' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || o_orderstatus ELSE '' END AS q, '<é\\' || o_custkey || '>' || chr(10) || '&' AS a FROM orders)
        SELECT o_orderkey, sha256({_payload("'{\"role\":\"user\",\"content\":' || " + _ESCAPED("to_json(q)::VARCHAR") + " || '},{\"role\":\"assistant\",\"content\":' || " + _ESCAPED("to_json(a)::VARCHAR") + " || '}'")}) AS payload_sha256, true AS valid FROM m""",
    "chat_messages_mapped": f"""WITH {TURNS}, c AS (SELECT conv_id, {VALID} AS valid, string_agg({_MESSAGE}, ',' ORDER BY turn, role DESC, content) AS m FROM turns GROUP BY 1)
        SELECT conv_id, CASE WHEN valid THEN sha256({_payload("CASE WHEN conv_id % 3 = 0 THEN '{\"role\":\"system\",\"content\":\"Be kind.\"},' ELSE '' END || m")}) END AS payload_sha256 FROM c""",
    "ranked_tree_paths": _TREE,
    "conversation_assessment": f"""WITH {TURNS}, s AS (SELECT conv_id, string_agg(content, chr(10) ORDER BY turn, role, content) AS text FROM turns GROUP BY 1), e AS (SELECT conv_id, text, {_elements('string_split(text, chr(10))')} AS l, {_elements("regexp_split_to_array(trim(text, ' '), '" + text.PARAGRAPH + "')")} AS p FROM s)
        SELECT conv_id, sha256(text) AS said_sha256, {_repeats('l')} OR {_repeats('p')} AS boilerplate_content, regexp_matches(text, '{_EMAIL}') AS email_addresses FROM e""",
    "conversation_redaction": f"""WITH {TURNS}, r AS (SELECT conv_id, turn, role, 'He said:' || chr(10) || '"mail <EMAIL_ADDRESS>" & left.' AS content FROM turns)
        SELECT conv_id, sha256({_payload("string_agg(" + _MESSAGE + ", ',' ORDER BY turn, role, content)")}) AS payload_sha256, count(*) AS email_addresses, 0::BIGINT AS phone_numbers FROM r GROUP BY 1""",
    "training_view": "WITH s AS (SELECT shard_id, min(sha256) AS sha FROM shards WHERE sha256 IS NOT NULL GROUP BY 1) SELECT DISTINCT sha || ':' || row_id AS selection_id, sha256(text) AS id, source, license, coalesce(language, '') AS language, source AS corpus, false AS unreadable FROM text_rows JOIN s USING (shard_id)",
    "shard_order": "SELECT sha256, path, (row_number() OVER (ORDER BY sha256, path NULLS FIRST) - 1)::BIGINT AS position FROM (SELECT DISTINCT sha256, url AS path FROM shards WHERE sha256 IS NOT NULL)",
    "objects_written": f"WITH {CANONICAL} SELECT count(*) AS records, sum(token_count)::BIGINT AS tokens, sum(octet_length(encode(text)))::BIGINT AS content_bytes, 0::BIGINT AS wrong FROM rows",
    "footers_or_scan": f"WITH {CANONICAL} SELECT count(*) AS records, sum(token_count)::BIGINT AS tokens, sum(octet_length(encode(text)))::BIGINT AS content_bytes FROM rows",
    "attestation_states": f"WITH {CANONICAL} SELECT 'embedded' AS state, count(*) AS records, 0::BIGINT AS broken FROM rows",
    "native_export": f"WITH {CANONICAL} SELECT count(*) AS records, sum(token_count)::BIGINT AS tokens, 0::BIGINT AS broken, 0::BIGINT AS faults FROM rows",
    "jsonl_written": f"WITH {CANONICAL} SELECT sha256(text) AS sha256, true AS intact, nullif(source, '') AS source, nullif(license, '') AS license, token_count AS tokens FROM rows",
    "telemetry_file": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY 1",
    "contribution_applied": "SELECT min(corpus) || '.json' AS path, 'differs' AS state, 0::BIGINT AS before FROM corpora",
    "artifact_sources": "SELECT DISTINCT source || '/part.parquet' AS path, CASE WHEN source = 'web/openpages' OR starts_with(source, 'web/openpages/') THEN 'web/openpages' ELSE split_part(source, '/', 1) END AS root FROM text_rows WHERE split_part(source, '/', 1) IN ('web', 'mail', 'books', 'civic', 'science', 'archive')",
    "resolved_selection": """WITH s AS (SELECT corpus || '.yaml' AS path FROM corpora UNION ALL SELECT corpus || '.json' FROM corpora WHERE record_schema = 1), d AS (SELECT DISTINCT source AS declared FROM text_rows WHERE source IS NOT NULL UNION SELECT corpus || '.yaml' FROM corpora),
        n AS (SELECT d.declared, count(DISTINCT path) AS n, min(path) AS p FROM d LEFT JOIN s ON s.path = d.declared OR regexp_replace(s.path, '\\.(ya?ml|json)$', '') = d.declared GROUP BY 1) SELECT declared, CASE WHEN n = 1 THEN p END AS path, CASE WHEN n = 0 THEN 'not selected' WHEN n > 1 THEN 'ambiguous' END AS fault FROM n""",
    "source_contexts": "WITH c AS (SELECT * FROM corpora WHERE title IS NOT NULL AND domain IS NOT NULL) SELECT DISTINCT f.title AS name, f.domain AS url, (SELECT min(corpus) FROM c p WHERE p.title = f.title OR p.domain = f.domain) AS context FROM c f",
    "calibrated_profiles": """WITH e AS (SELECT o_orderpriority AS accelerator, o_custkey % 4 AS gpus, sum(o_custkey)::DOUBLE / sum(o_orderkey % 100 + 1)::DOUBLE AS s FROM orders GROUP BY 1, 2), p AS (SELECT DISTINCT o_orderpriority AS accelerator, o_custkey % 6 AS gpus FROM orders)
        SELECT accelerator, gpus, coalesce(round(s, 6), 0) AS speed FROM p LEFT JOIN e USING (accelerator, gpus)""",
    "license_totals_with_usage": f"""WITH {ROWS}, {SHARDS}, n AS (SELECT shard_id, coalesce(c.licenses, [sh.license]) AS l, docs, tokens, bytes FROM sh LEFT JOIN corpora c ON c.corpus = sh.sources[1]), u AS (SELECT shard_id, license, count(*) AS docs, coalesce(sum(token_count), 0) AS tokens FROM first WHERE license IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT l[1] AS license, docs, tokens, bytes FROM n WHERE coalesce(len(l), 0) <= 1 UNION ALL SELECT license, docs, tokens, 0 FROM u WHERE shard_id IN (SELECT shard_id FROM n WHERE len(l) > 1))
        SELECT coalesce(nullif(license, ''), '(none declared)') AS license, count(*) AS shards, coalesce(sum(docs), 0)::BIGINT AS docs, coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM a GROUP BY 1""",
    "pruned_objects": f"""WITH {SHARDS}, o AS (SELECT sha256, min(bytes) AS bytes, max(created_at) AS used_at, bool_or(coalesce(format = 'jsonl', false)) AS in_use FROM sh WHERE sha256 IS NOT NULL AND bytes IS NOT NULL AND created_at IS NOT NULL GROUP BY 1),
        r AS (SELECT *, sum(bytes) OVER (ORDER BY in_use DESC, used_at DESC, sha256 ROWS UNBOUNDED PRECEDING) AS kept FROM o) SELECT sha256 FROM r WHERE kept > (SELECT sum(bytes) // 3 FROM o) AND NOT in_use""",
    "attempts_seconds": """WITH s AS (SELECT user_id, ts::DATE AS day, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(epoch(b) - epoch(a)) AS s, epoch(max(b)) - epoch(min(a)) AS whole FROM s GROUP BY 1) SELECT user_id, round(CASE WHEN s > 0 THEN s ELSE whole END, 3) AS seconds FROM t""",
    "run_advice_table": """WITH e AS (SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS l, arg_min(value, (ts, event_id)) FILTER (value IS NOT NULL) AS f FROM events GROUP BY 1),
        r AS (SELECT user_id AS run, ['running', 'failed', 'complete', 'planned'][user_id % 4 + 1] AS state, user_id % 11 = 0 AS broken, CASE WHEN f > 0 THEN l / f - 1 END AS c, user_id % 5 = 0 AND user_id % 4 = 0 AS silent, user_id % 100 AS step, user_id % 7 = 0 AS err FROM e),
        b AS (SELECT *, CASE state WHEN 'running' THEN 'let-run' WHEN 'failed' THEN 'fix' WHEN 'complete' THEN 'complete' ELSE 'wait' END AS base, coalesce(c > 0.25, false) AS worse, coalesce(c > 0.05 AND c <= 0.25, false) AS watch, coalesce(c < -0.05, false) AS better FROM r)
        SELECT run, CASE WHEN broken OR worse THEN 'stop' WHEN base = 'let-run' AND (watch OR silent) THEN 'inspect' ELSE base END AS action,
        concat_ws(',', CASE WHEN broken THEN 'loss-not-finite' END, CASE WHEN worse THEN 'heldout-worse' END, CASE WHEN watch AND base = 'let-run' AND NOT broken THEN 'heldout-slightly-worse' END, CASE WHEN better THEN 'heldout-better' END,
        CASE WHEN silent AND NOT broken AND NOT worse AND NOT watch THEN 'no-telemetry' END, CASE WHEN step > 0 THEN 'progress' END, CASE WHEN err THEN 'error' END) AS findings, step::DOUBLE AS progress_percent FROM b""",
    "observation_bounds": """WITH o AS (SELECT l_quantity::BIGINT AS steps, l_partkey AS tokens, l_suppkey AS planned, CASE WHEN l_linenumber = 7 THEN 'inf'::DOUBLE ELSE l_tax - 0.01 END AS loss, l_shipdate FROM lineitem)
        SELECT rule, count(*) AS runs FROM (SELECT 'steps' AS rule FROM o WHERE steps < 0 OR steps > 45 UNION ALL SELECT 'tokens' FROM o WHERE tokens < 0 OR tokens > planned UNION ALL SELECT 'loss' FROM o WHERE loss = 'inf'::DOUBLE OR loss < 0 UNION ALL SELECT 'times' FROM o WHERE TIMESTAMP '1996-01-01' < l_shipdate) GROUP BY 1""",
    "evaluation_windows": """WITH b AS (SELECT item_id, encode(text) AS e, octet_length(encode(text)) AS n FROM eval_items WHERE text <> ''), t AS (SELECT item_id, n, list_transform(range(n), lambda i: ('0x' || substr(hex(e), 2 * i + 1, 2))::INT + 3) AS t FROM b), w AS (SELECT item_id, t, unnest(range(0, greatest(n - 2, 0) + 1, 64)) AS s FROM t)
        SELECT item_id, (s // 64)::INT AS n, len(t[s + 1 : s + 65])::INT AS tokens, list_sum(t[s + 1 : s + 65])::INT AS sum FROM w""",
    "packed_windows": """WITH b AS (SELECT item_id, encode(text) AS e, octet_length(encode(text)) AS n FROM eval_items WHERE text IS NOT NULL), t AS (SELECT coalesce(sum(n + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, list_append(list_transform(range(n), lambda i: ('0x' || substr(hex(e), 2 * i + 1, 2))::INT + 3), 2) AS t FROM b),
        p AS (SELECT o + i AS p, t[i + 1] AS v FROM (SELECT o, t, unnest(range(len(t))) AS i FROM t)), w AS (SELECT (p // 256)::BIGINT AS win, p, v FROM p UNION ALL SELECT (p // 256)::BIGINT - 1, p, v FROM p WHERE p % 256 = 0 AND p > 0)
        SELECT win AS "window", sum(v)::BIGINT AS sum, (count(*) - 1)::INT AS targets FROM w GROUP BY 1 HAVING count(*) > 1""",
    "corpus_consumption": "WITH n AS (SELECT benchmark, octet_length(encode(text)) AS n FROM eval_items WHERE text IS NOT NULL) SELECT benchmark AS corpus, sum(n - n // 3)::BIGINT AS targets FROM n GROUP BY 1",
    "recommended_presets": "WITH p AS (SELECT p_name AS name, p_size::BIGINT * 1000 + p_partkey % 1000 AS parameters FROM part) SELECT name, parameters FROM p WHERE parameters <= (SELECT coalesce(sum(octet_length(encode(text))), 0) // 20 FROM documents) ORDER BY parameters DESC, name LIMIT 1",
    "model_names": "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '[^/]*green[^/]*|a[^/]*[a-m]|[^/]lue[^/]*')",
    "referential_inner_join": "WITH s AS (SELECT shard_id, min(format) AS format FROM shards GROUP BY 1) SELECT format, count(*) AS rows, count(*) FILTER (t.shard_id IS NULL) AS without_shard FROM text_rows t LEFT JOIN s ON s.shard_id = t.shard_id GROUP BY 1",
    "filter_faults": "SELECT * FROM (VALUES ('CC*', false), ('[a-', true), ('MIT\\', true), ('', true), ('a?', false), ('[]', true), ('Apache-[0-9]*', false)) t(pattern, fault)",
    "ingest_records": """WITH r AS (SELECT item_id, text || ' Write to <EMAIL_ADDRESS>.' AS t, CASE WHEN item_id % 2 = 0 THEN 'CC-BY-4.0 AND MIT' ELSE 'MIT' END AS license, CASE WHEN item_id % 2 = 0 THEN '["MIT License","CC BY 4.0"]' ELSE 'MIT License' END AS license_raw, benchmark FROM eval_items WHERE text IS NOT NULL)
        SELECT sha256(t) AS sha256, item_id::VARCHAR AS source, license, license_raw, '{"ids":"' || item_id || '","origin":' || to_json(benchmark)::VARCHAR || '}' AS meta, item_id % 3 <> 0 AS main_content, false AS email_addresses, 2 - 1::BIGINT AS redacted_email_addresses, octet_length(encode(t)) AS token_count
        FROM r QUALIFY row_number() OVER (PARTITION BY t, license ORDER BY item_id) = 1""",
    "ingest_report": """WITH k AS (SELECT count(*) AS n, count(DISTINCT (text, item_id % 2)) AS kept FROM eval_items WHERE text IS NOT NULL) SELECT 2 * n + 4 AS input, 2 * n AS seen, kept AS retained, 2 * n - kept AS duplicate, 2::BIGINT AS malformed, 2::BIGINT AS empty FROM k""",
    "planned_formats": "SELECT CASE WHEN item_id % 2 = 0 THEN 'text' ELSE 'jsonl' END AS format, item_id || '.bin' AS name FROM eval_items WHERE text <> ''",
    "index_bom": f"""WITH {SHARDS}, s AS (SELECT replace(sources[1], '/', '-') || '.json' AS manifest, sha256, max(coalesce(docs, 0)) AS docs, max(coalesce(tokens, 0)) AS tokens, max(coalesce(bytes, 0)) AS bytes, coalesce(max(license), '') AS license FROM sh WHERE sha256 IS NOT NULL AND sources[1] IS NOT NULL GROUP BY sources[1], sha256)
        SELECT grouping_id(manifest, license)::BIGINT AS level, manifest, license, count(*) AS shards, sum(docs)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes FROM s GROUP BY ROLLUP (manifest, license)""",
    "index_faults": f"""WITH {SHARDS}, c AS (SELECT DISTINCT sources[1] AS corpus FROM sh WHERE sha256 IS NOT NULL AND sources[1] IS NOT NULL), f AS (SELECT corpus, 'docs differ from the shards'' sum' AS fault FROM c UNION ALL SELECT corpus, 'web-crawl needs acquisition details' FROM c WHERE length(corpus) % 2 = 1)
        SELECT replace(corpus, '/', '-') || '.json' AS manifest, fault, 0::BIGINT AS sound FROM f""",
    "disclosure_gaps": """SELECT section, field, name FROM (SELECT corpus AS name, unnest([{'section': 'data', 'field': 'license', 'v': license}, {'section': 'collection', 'field': 'collected_from', 'v': collected_from}, {'section': 'collection', 'field': 'collected_to', 'v': collected_to}, {'section': 'content', 'field': 'languages', 'v': array_to_string(languages, ',')}], recursive := true) FROM corpora) WHERE coalesce(v, '') = ''""",
    "store_round_trip": "SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text)) AS bytes, octet_length(encode(text)) AS fetched, true AS available FROM eval_items WHERE text <> ''",
    "objects_against_index": """WITH s AS (SELECT * FROM shards WHERE sha256 IS NOT NULL AND docs IS NOT NULL AND tokens IS NOT NULL AND bytes IS NOT NULL), o AS (SELECT sha256, min(docs) AS docs, count(DISTINCT (docs, tokens, bytes)) > 1 AS conflict FROM s GROUP BY 1)
        SELECT sha256, fault FROM (SELECT sha256, 'missing' AS fault FROM o WHERE sha256[1] = 'f' UNION ALL SELECT sha256, 'broken' FROM o WHERE sha256[1] <= '3' UNION ALL SELECT sha256, 'conflict' FROM o WHERE conflict UNION ALL SELECT sha256, 'tokens' FROM o WHERE docs % 2 <> 0)""",
    "handoff_inventory": """WITH n AS (SELECT item_id || '.txt' AS path, row_number() OVER (ORDER BY item_id || '.txt') AS r FROM eval_items) SELECT path, CASE r WHEN 1 THEN 'missing' ELSE 'differs' END AS state FROM n WHERE r <= 2 UNION ALL SELECT 'new.txt', 'unexpected'""",
    "worker_frames": """WITH i AS (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM eval_items WHERE text IS NOT NULL), l AS (SELECT 0::BIGINT AS n, '{"kind":"begin","schema":1,"begin":{"run":1}}' AS line UNION ALL SELECT n, '{"kind":"record","schema":1,"record":{"item_id":' || item_id || ',"benchmark":' || to_json(benchmark)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}}' FROM i
        UNION ALL SELECT count(*) + 1, '{"kind":"end","schema":1}' FROM i) SELECT n, sha256(line) AS line_sha256 FROM l""",
    "calibration_text_digest": f"""WITH {DOCS}, o AS (SELECT doc_id, text, bytes, {SCORE.format(key='doc_id::VARCHAR')} AS score, coalesce(sum(bytes) OVER (ORDER BY {SCORE.format(key='doc_id::VARCHAR')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs), near AS (SELECT *, least(bytes, 100000 - start) AS room FROM o WHERE start < 100000),
        k AS (SELECT doc_id, score, text, room, unnest(range(0, length(text) + 1)) AS k FROM near), c AS (SELECT doc_id, any_value(score) AS score, any_value(text) AS text, max(k) FILTER (octet_length(encode(left(text, k))) <= room) AS k FROM k GROUP BY 1), j AS (SELECT string_agg(left(text, k), chr(10) || chr(10) ORDER BY score, doc_id) AS body FROM c WHERE k > 0)
        SELECT sha256(body) AS sha256, octet_length(encode(body))::INT AS bytes FROM j""",
    "manifest_document": f"WITH {CANONICAL} SELECT 'all' AS name, 64 AS plan_digits, count(*) AS records, count(*) AS shard_records FROM rows",
    "disclosure_corpora": "WITH u AS (SELECT unnest(map_keys(corpus_weights)) AS corpus, coalesce(order_policy, '') AS stage FROM data_plans) SELECT sha256(corpus) AS bom_sha256, corpus, count(*) AS uses, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM u GROUP BY corpus",
    "publication_states": """WITH s AS (SELECT shard_id, min(sha256) AS sha256, min(url) AS url, min(created_at) AS created_at FROM shards WHERE sha256 IS NOT NULL GROUP BY 1), o AS (SELECT * FROM s WHERE created_at < (SELECT quantile_disc(created_at, 0.5) FROM s))
        SELECT CASE WHEN sha256 IN (SELECT sha256 FROM o) THEN 'published' ELSE 'assembled' END AS state, count(DISTINCT sha256) AS objects FROM s WHERE shard_id IN (SELECT shard_id FROM text_rows) GROUP BY 1""",
    "assessment_sums": """WITH c AS (SELECT source, count(*) AS r, count(*) FILTER (email_addresses) AS e, count(*) FILTER (repetitive_content) AS p, coalesce(sum(redacted_email_addresses), 0)::BIGINT AS re, coalesce(sum(redacted_credentials), 0)::BIGINT AS rc FROM text_rows WHERE source = 'web/openpages' GROUP BY 1)
        SELECT source, r AS declared_records, e + 1 AS declared_email_addresses_records, p AS declared_repetitive_content_records, re AS declared_redacted_email_addresses, rc AS declared_redacted_credentials, r AS computed_records, e AS computed_email_addresses_records, p AS computed_repetitive_content_records, re AS computed_redacted_email_addresses, rc AS computed_redacted_credentials FROM c""",
    "resolved_parameters": """WITH p AS (SELECT plan_id, ceil(requested_tokens / 1024)::BIGINT AS s, coalesce(shuffle_buffer_records, 1024)::BIGINT AS b FROM data_plans WHERE requested_tokens > 0)
        SELECT plan_id, s AS steps, 1::BIGINT AS epochs, s * 1024 AS token_capacity, greatest(least(100, s // 10), CASE WHEN s > 1 THEN 1 ELSE 0 END) AS warmup_steps, least(500, s) AS checkpoint_every, b AS shuffle_records, 'corpus-balanced-shuffle-v1' AS policy, round(0.001 / greatest(least(100, s // 10), 1), 12) AS first_rate, 0.0::DOUBLE AS last_rate FROM p""",
}
SQL["loss_masks"] = f"""WITH {TURNS}, m AS (SELECT conv_id, string_agg(repeat('0', length(role) + 13) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, octet_length(encode(content)) + 11), '' ORDER BY turn, role, content) || CASE WHEN arg_max(role, (turn, role, content)) = 'assistant' THEN '1' ELSE '0' END AS c,
        string_agg(repeat('0', length(role) + CASE WHEN role = 'assistant' THEN 1 ELSE 2 END) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, octet_length(encode(content))), '00' ORDER BY turn, role, content) || CASE WHEN arg_max(role, (turn, role, content)) = 'assistant' THEN '1' ELSE '0' END AS p FROM turns GROUP BY 1)
        SELECT conv_id, sha256(c) AS markup_sha256, sha256(p) AS plain_sha256 FROM m"""
SQL["decoded_conversations"] = f"""WITH {TURNS}, c AS (SELECT conv_id, {VALID} AND conv_id % 5 <> 0 AS good, count(*) AS n, string_agg(content, chr(10) ORDER BY turn, role, content) AS t FROM turns GROUP BY 1)
        SELECT conv_id, CASE WHEN good THEN n ELSE 0 END::INT AS messages, CASE WHEN good THEN sha256(t) END AS contents_sha256 FROM c"""
SQL["parquet_nested_records"] = f"""SELECT doc_id::VARCHAR AS id, sha256(CASE WHEN regexp_full_match(text, '[\\s\\x0B]*') THEN '' ELSE text END) AS text_sha256, coalesce(nullif({_license('license')}, ''), 'LicenseRef-D') AS license, CASE WHEN lang IS NOT NULL THEN '{{"lang":' || to_json(lang)::VARCHAR || '}}' END AS meta,
        CASE WHEN regexp_full_match(text, '[\\s\\x0B]*') THEN 'empty' END AS reject_reason FROM documents WHERE text IS NOT NULL"""
SQL["disclosure_gap_counts"] = f"SELECT section, field, count(*) AS gaps, min(name) AS first_name FROM ({SQL['disclosure_gaps']}) GROUP BY 1, 2"
