"""Redaction and assessment of conversations by message."""

import json

from loomwright.functions import privacy
from loomwright.plans import ingest
from loomwright.plans.profile import Input, Plan, Profile


def test_conversations_are_redacted_and_assessed_by_message(spark, tmp_path):
    menu = "\n".join(["Home"] * 40)
    rows = [
        {"a": "Write to\nalice@x.org", "b": 'Said "yes" & <no>'},
        {"a": "Received: from a by b\nSubject: Hello\nTo: me\n\nBody", "b": "Fine"},
        {"a": menu, "b": menu},
    ]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    plan = Plan((Input(str(tmp_path / "a.jsonl"), "jsonl", "MIT", Profile("dialogue-pair", {"text": "a", "response": "b"})),))
    kept = ingest.ingested(ingest.scan_plan(spark, plan)).collect()
    assert len(kept) == 3
    by = {json.loads(r.text)["messages"][0]["content"]: r for r in kept}
    mail = by["Write to\n<EMAIL_ADDRESS>"]
    assert mail.redacted_email_addresses == 1 and "<" not in mail.text and json.loads(mail.text)["messages"][1]["content"] == 'Said "yes" & <no>'
    routed = by["Subject: Hello\nTo: me\n\nBody"] if "Subject: Hello\nTo: me\n\nBody" in by else by["Subject: Hello\n\nBody"]
    assert routed.removed_mail_routing_headers >= 1
    assert by[menu].boilerplate_content and by[menu].repetitive_content and not mail.boilerplate_content


def test_tools_keep_keys_numbers_and_roles():
    payload = '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"ho"}],"tools":[{"a@x.org":"b@x.org","n":1e5}]}'
    new, n = privacy.redact_conversation(payload)
    assert new == payload.replace('"b@x.org"', '"\\u003cEMAIL_ADDRESS\\u003e"') and n["email_addresses"] == 1
