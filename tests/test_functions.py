import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import dates, glob, hashing, license, privacy, text

LICENSES = {
    "Apache 2 License - https://www.apache.org/licenses/LICENSE-2.0": "Apache-2.0",
    "apache 2 license - HTTPS://www.apache.org/licenses/license-2.0": "Apache-2.0",
    "http://creativecommons.org/licenses/by-nc-nd/3.0/de/": "CC-BY-NC-ND-3.0",
    "See https://CreativeCommons.org/licenses/by/2.5 for terms": "CC-BY-2.5",
    "https://creativecommons.org/publicdomain/zero/1.0/legalcode": "CC0-1.0",
    "https://creativecommons.org/publicdomain/mark/1.0/": "https://creativecommons.org/publicdomain/mark/1.0/",
    "PUBLIC domain": "LicenseRef-Public-Domain",
    "cc by-nc 2.0": "CC-BY-NC-2.0",
    "CC-BY_ND SA 3": "CC-BY-ND-SA-3",
    "cc0 1.0": "CC0-1.0",
    "CC XY 4.0": "CC XY 4.0",
    "GPL-3.0-or-later": "GPL-3.0-or-later",
    "\tMIT License\r\n": "MIT",
    "\u00a0bsd 2-clause\u3000": "BSD-2-Clause",
    "iSc LiCeNsE": "ISC",
    " \n ": "",
}


def test_licenses(spark):
    df = spark.createDataFrame([(k,) for k in LICENSES] + [(None,)], "raw string")
    got = {r.raw: r.out for r in df.select("raw", license.normalize(F.col("raw")).alias("out")).collect()}
    assert got == LICENSES | {None: None}
    one = spark.createDataFrame([(["ISC License\n", "cc by-sa 3.0", "isc license", " "],), ([],)], "raw array<string>")
    assert [r[0] for r in one.select(license.normalize_set(F.col("raw"))).collect()] == ["CC-BY-SA-3.0 AND ISC", ""]


@pytest.mark.parametrize(
    ("pattern", "value", "wanted"),
    [("CC-*", "CC-BY-4.0", True), ("a*", "a/b", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("\\*", "*", True), ("\\*", "x", False), ("*.parquet", ".parquet", True), ("a", "A", False)],
)
def test_globs(pattern, value, wanted):
    assert bool(re.match(glob.to_regex(pattern).replace("\\z", "\\Z"), value)) is wanted


@pytest.mark.parametrize("bad", ["[", "[]", "[a", "a\\", "[-]", "[a-]"])
def test_bad_globs(bad):
    with pytest.raises(ValueError):
        glob.to_regex(bad)


def test_dates(spark):
    rows = [("2000",), ("2000-02",), ("2000-02-29",), ("2000-02-29T10:00:00Z",), ("2001-02-29",), ("soon",), ("",), (None,), ("2000-02-29T23:30:00-02:00",)]
    df = spark.createDataFrame(rows, "d string")
    got = {r.d: r.ok for r in df.select("d", dates.overlaps(F.col("d"), "2000-02", "2000-02").alias("ok")).collect()}
    assert got == {"2000": True, "2000-02": True, "2000-02-29": True, "2000-02-29T10:00:00Z": True, "2001-02-29": False, "soon": False, "": False, None: False, "2000-02-29T23:30:00-02:00": False}


def test_scores(spark):
    df = spark.createDataFrame([("k",)], "k string")
    for seed in (0, 42, 2**64 - 1):
        got = df.select(hashing.evaluation_score(seed, F.col("k")), hashing.calibration_score(seed, F.col("k"))).first()
        assert got[0] == hashlib.sha256(seed.to_bytes(8, "big") + b"k").hexdigest()
        assert got[1] == hashlib.sha256(seed.to_bytes(8, "little") + b"k").hexdigest()
    digest = spark.createDataFrame([("b",), ("a",)], "k string").agg(hashing.ordered_digest(F.col("k"))).first()[0]
    assert digest == hashlib.sha256(b"a\nb\n").hexdigest()
    assert spark.createDataFrame([], "k string").agg(hashing.ordered_digest(F.col("k"))).first()[0] == hashlib.sha256(b"").hexdigest()
    numbers = hashing.split_mix(0)
    assert next(numbers) == 0xE220A8397B1DCDAF  # first output of the generator from state 0


def test_assessment(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    lines = "\n".join(["same line here", "same line here", "same line here", "one other line", "last of all"])
    phrase = " ".join(["one two three four five six seven eight"] * 10)
    df = spark.createDataFrame([(1, clean), (2, lines), (3, phrase), (4, ""), (5, None)], "i int, t string")
    got = {r.i: (r.b, r.r) for r in df.select("i", text.boilerplate(F.col("t")).alias("b"), text.repetitive(F.col("t")).alias("r")).collect()}
    assert got[1] == (False, False) and got[2] == (True, False) and got[3][1] is True and got[4] == (False, False) and got[5][1] is False


def test_email_flag(spark):
    df = spark.createDataFrame([("write to a.b@example.org",), ("user@localhost",), ("no address",), ("A@B.CO",)], "t string")
    assert [r[0] for r in df.select(text.has_email(F.col("t"))).collect()] == [True, False, False, True]


def test_truncation(spark):
    df = spark.createDataFrame([("aé€😀", n) for n in range(12)], "t string, n int")
    got = [r[0] for r in df.select(text.truncate_utf8(F.col("t"), F.col("n"))).collect()]
    assert got == [("aé€😀".encode()[:n]).decode("utf-8", "ignore") for n in range(12)]


def test_redaction_facts():
    given_text = "From: Jane Doe <jane@example.org>\nReceived: from relay.example (192.0.2.4)\nMessage-ID: <x@example.org>\nSubject: Call me\n\nJane Doe is at +1 (415) 555-0123 from 2001:db8::1. password=hunter2-secret-value"
    out, n = privacy.redact(given_text)
    assert n == {"email_addresses": 1, "ip_addresses": 1, "phone_numbers": 1, "mail_routing_headers": 2, "credentials": 1}
    assert "Jane Doe" in out and "jane@example.org" not in out and "Received" not in out and "2001:db8" not in out
    plain = "Received: this is a prose label, not a header\nLinux 6.12 has commit 123456789 and version 1.2.3."
    assert privacy.redact(plain) == (plain, dict.fromkeys(privacy.COUNTS, 0))
    overlap = "examples 192.0.2.10 and 198.51.100.20; overlap 2001:db8::7.415-555-0123"
    assert {k: v for k, v in privacy.redact(overlap)[1].items() if v} == {"ip_addresses": 3, "phone_numbers": 1}
    key = "before\n-----BEGIN PRIVATE KEY-----\nsecret\n-----END PRIVATE KEY-----\nafter"
    assert privacy.redact(key)[0] == "before\n<CREDENTIAL>\nafter"
    assert privacy.redact(None)[0] is None and privacy.redact("")[0] == ""


def test_redacted_json_keeps_numbers():
    document = '{"n":1.10,"big":12345678901234567890123,"e":1e5,"m":"a@b.example"}'
    assert privacy.redact_json(document)[0] == '{"big":12345678901234567890123,"e":1e5,"m":"<EMAIL_ADDRESS>","n":1.10}'


def test_redacted_json_keeps_keys():
    out, n = privacy.redact_json('{"a@b.example": "c@d.example", "n": 1}')
    assert out == '{"a@b.example":"<EMAIL_ADDRESS>","n":1}' and n["email_addresses"] == 1


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab@.:1205+()- \n", max_size=60))
def test_redaction_settles(t):
    once, _ = privacy.redact(t)
    assert privacy.redact(once)[0] == once


def test_placeholders_match_no_detector():
    for p in privacy.PLACEHOLDERS.values():
        assert privacy.redact(p)[0] == p
