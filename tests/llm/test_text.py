"""Operators on single texts, against facts, brute force and held-out labels."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import encode, language, mainbody, pii, sentences, tokens

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables aren't here")
needs_tokenizer = pytest.mark.skipif(not os.path.exists(encode.MODEL_PATH), reason="tokenizer files aren't here")


# ---- personal data -----------------------------------------------------------------------------


def found(text):
    return {(k, text[a:b]) for k, a, b in pii.find_items(text)}


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Write to mailto:a.b+c@lists.example.org.", {("email", "a.b+c@lists.example.org")}),
        ("Write to <a@b.example> now", {("email", "a@b.example")}),
        ("mail a_b (at) host [dot] example today", {("email", "a_b (at) host [dot] example")}),
        ("mail a-b AT host DOT example today", {("email", "a-b AT host DOT example")}),
        ("mail a.b @ host.example today", {("email", "a.b @ host.example")}),
        ("an a.b＠host.example", {("email", "a.b＠host.example")}),
        ("an ju​nia@host.example", {("email", "ju​nia@host.example")}),
        ("an pаul@host.example", {("email", "pаul@host.example")}),  # a Cyrillic letter
        ("mails user@localhost. Meet at the @ sign of page 9", set()),
        ("call (485) 555-0152 or 310‑555‑0166", {("phone", "(485) 555-0152"), ("phone", "310‑555‑0166")}),
        ("call +49 (0)30 23125407, 030/23125-865, 01 99 00 03 54", {("phone", "+49 (0)30 23125407"), ("phone", "030/23125-865"), ("phone", "01 99 00 03 54")}),
        ("o llame al +34 600 00 0444 hoy", {("phone", "+34 600 00 0444")}),
        ("Ticket 310.204.118-99 and ISBN 978-1-99-555-0 and Invoice 8841-2207-855", set()),
        ("My SSN 958-46-5013, CPF 851.401.358-09, DNI 70024574Q", {("identity_number", "958-46-5013"), ("identity_number", "851.401.358-09"), ("identity_number", "70024574Q")}),
        ("Row 12345678A is a cell", set()),
        ("My passport no. Y05038297 is", {("identity_number", "Y05038297")}),
        ("typed 993381195210186675 here", {("identity_number", "993381195210186675")}),
        ("to 133 Elirmere St., Apt 14, Falalnell.", {("street_address", "133 Elirmere St., Apt 14, Falalnell")}),
        ("to 9 rue de Baladan, 75453 Norirkeld.", {("street_address", "9 rue de Baladan, 75453 Norirkeld")}),
        ("en Calle Ostotavo 229, 6.º B, 40677 Falevlund.", {("street_address", "Calle Ostotavo 229, 6.º B, 40677 Falevlund")}),
        ("der Rasaiholtstraße 19, 58481 Yaronmere.", {("street_address", "Rasaiholtstraße 19, 58481 Yaronmere")}),
        ("Die Straße der Daten 40 ist nur ein Titel. Block 2 of Street Level Notes.", set()),
        ("Dr. Balano M. Halvorsted signed", {("name", "Balano M. Halvorsted")}),
        ("La Dra. DOVRIN PIQUERO dijo", {("name", "DOVRIN PIQUERO")}),
        ("According to the Hirunsund handbook. The index of Selumwick.", set()),
        ("Signed, Tarrowby, Pellin.", {("name", "Tarrowby, Pellin")}),
        ("Garvin Z. Zorbach and Orrin Jorongast counted the discs", {("name", "Garvin Z. Zorbach"), ("name", "Orrin Jorongast")}),
        ("Best wishes,\nCaldra Lindrose", {("name", "Caldra Lindrose")}),
    ],
)
def test_items(text, wanted):
    assert found(text) == wanted


def test_spelled_digits_map_back():
    text = "ring zero one nine nine zero zero zero three five four now"
    n = pii.Normalised(text)
    assert "0199000354" in n.text
    at = n.text.index("0199000354")
    assert text[slice(*n.span(at, at + 10))] == "zero one nine nine zero zero zero three five four"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab@. (at)[dot]​１２-+０３Zz,", max_size=50))
def test_spans_are_in_order_and_inside(text):
    last = 0
    for _, a, b in pii.find_items(text):
        assert last <= a < b <= len(text)
        last = b
    out = pii.redact(text)
    assert out is not None and (bool(pii.find_items(text)) or out == text)


def test_items_of_tables(spark):
    rows = spark.createDataFrame([(1, "to a@b.example"), (1, "to a@b.example"), (2, None), (3, ""), (None, "x@y.example")], "row_id bigint, text string").withColumn("kind", F.lit(1))
    got = {tuple(r) for r in pii.items(rows).collect()}
    assert got == {(1, "email", 3, 14), (None, "email", 0, 11)}
    assert pii.items(rows.limit(0)).count() == 0
    assert {r.row_id: r.text for r in pii.redacted(rows).collect()}[1] == "to <EMAIL_ADDRESS>"


# ---- main body -----------------------------------------------------------------------------------


def test_main_body():
    para = "The packing step, which orders the inputs by their full path, waits for the checksum of the mirror until the next release."
    page = "\n".join(["We use cookies to keep X working. Accept all | Reject", "* Home", "* Sign in", "Home > Catalogue > X", "Related pages", "An older page", "The title of it", para, "It says so:", "- before the window closes", "- with a margin", "Popular tags", "An older page", "A last short sentence stands here.", "© 2016 X Press. All rights reserved.", "", "Back to top"])
    assert mainbody.boilerplate_lines(page) == [1, 2, 3, 4, 5, 6, 12, 13, 15, 17]
    assert mainbody.main_body(page).split("\n")[:2] == ["The title of it", para]
    assert mainbody.boilerplate_lines("The Dovelund bakery sells cookies by weight and accepts no cards.") == []
    assert mainbody.boilerplate_lines(None) == [] and mainbody.boilerplate_lines("") == [] and mainbody.boilerplate_lines("Bump.") == []


def test_main_body_tables(spark):
    rows = spark.createDataFrame([(1, "web/a", "Home > X\n" + "A sentence of the body, long enough. " * 5), (2, "mail/a", "Home > X"), (3, "web/a", None), (4, None, "Home > X")], "row_id bigint, source string, text string").withColumn("line_no", F.lit("x"))
    assert [tuple(r) for r in mainbody.boilerplate(rows).collect()] == [(1, 1)]
    assert mainbody.bodies(rows).count() == 2 and mainbody.boilerplate(rows.limit(0)).count() == 0


# ---- sentences -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "parts",
    [
        ["The U.S. mirror of X answers slower than the one in St. Orlan.", "Wait... the digest changed again?!", "Next."],
        ['"Is the index stale?" asked the steward, and nobody answered.', 'He said "Stop!" and closed Istarrost.', '"It works." was the message.'],
        ["Version 7.12.5 reads approx. 6.87 GB per hour, i.e. about a third.", "See fig. 80 and sec. 8.41 of it.", "It grew by No. 86.", "The end."],
        ["Die Quelle liefert z. B. Briefe usw. in drei Formaten.", "Am 3. Mai prüft Dr. N. R. Trevanne den Stand.", "Sie stammt aus dem 19. Jahrhundert.", "Auf Stufe 813.", "Das Ende."],
        ["El Sr. J. Ekstrund revisa la pág. 68 del expediente.", "La Dra. X dijo: «Está listo.» y cerró la sesión.", "¿Por qué falta?"],
        ["« L'index est-il périmé ? » demande la responsable.", "Attendez !", "On garde les lettres, etc. dans deux formats."],
        ["«Индекс устарел?» — спрашивает хранитель.", "В 9038 г. архив открыл третий зал.", "См. рис. 9 и табл. 2 в заметках."],
        ["डॉ. मेहरांत ने पृ. 139 पर टिप्पणी लिखी।", '"क्या सूची पुरानी है?" प्रबंधक ने पूछा।', "रुकिए!"],
        ["(The whole sentence stands in brackets.)", "“And this one in marks.”", "Done."],
    ],
)
def test_spaced_sentences(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text)] == parts


@pytest.mark.parametrize("parts", [["管理员问道：“索引过期了吗？”没有人回答。", "“已经完成。”这就是X的全部说明。", "停！", "版本4.18.2每小时读取约16.51GB数据。"], ["「索引は古いのですか？」と管理者が尋ねました。", "担当者は「準備ができました。」とだけ書きました。", "止めてください！"]])
def test_spaceless_sentences(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences.sentences(text)] == parts


def test_blocks_and_thai():
    text = "A heading\r\n \r\n  One line\nbreaks here. Two.\n\n\n"
    assert [text[a:b] for a, b in sentences.sentences(text)] == ["A heading", "One line\nbreaks here.", "Two."]
    thai = "ดัชนีล้าสมัยแล้วหรือยัง สำเนาที่สองของ Wynilmora ที่เก็บไว้ 44 แถว(X, Y)รอ"
    assert [thai[a:b] for a, b in sentences.sentences(thai)] == ["ดัชนีล้าสมัยแล้วหรือยัง", "สำเนาที่สองของ Wynilmora ที่เก็บไว้ 44 แถว(X, Y)รอ"]
    assert sentences.sentences(None) == [] and sentences.sentences(" \n ") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB. !?\n\"”“。「」ก 9।", max_size=60))
def test_sentences_cover_everything_but_space(text):
    spans = sentences.sentences(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left = set(range(len(text))) - {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in left)


def test_word_lattice():
    assert "".join(sentences.word_lattice("这就是全部")) == "这就是全部" and sentences.word_lattice("这就是全部")[0] == "这就是"


# ---- language --------------------------------------------------------------------------------------


def test_labels():
    assert [language.normal_label(x) for x in ("en_GB", "PT-br", "zho", "Thai", "", None, "und", "it")] == ["en", "pt", "zh", "th", None, None, None, "it"]


@needs_tables
def test_held_out_accuracy(spark):
    import pandas as pd

    rows = pd.read_parquet(f"{TABLES}/lang_samples.parquet").sort_values("sample_id")
    train, test = rows.iloc[::2], rows.iloc[1::2]
    profiles = language.Profiles(list(zip(train.language, train.text)))
    judged = language.Judged(profiles, list(test.text))
    right = [judged.codes[m] == w for m, w in zip(judged.main, test.language)]
    assert sum(right) / len(right) >= 0.98
    assert judged.counts.sum(axis=1).max() == 1  # no sample seems mixed
    mixed = [a + " " + b for a, b, la, lb in zip(test.text, test.text[::-1], test.language, test.language[::-1]) if la != lb]
    wanted = [{la, lb} for la, lb in zip(test.language, test.language[::-1]) if la != lb]
    both = language.Judged(profiles, mixed)
    got = [{both.codes[k] for k in c.nonzero()[0]} for c in both.counts]
    assert sum(g == w for g, w in zip(got, wanted)) / len(got) >= 0.9


@needs_tables
def test_language_tables(spark):
    samples = spark.read.parquet(f"{TABLES}/lang_samples.parquet")
    en, de = (samples.filter(f"language = '{c}'").first().text for c in ("en", "de"))
    rows = spark.createDataFrame([(1, en, "English"), (1, en, "English"), (2, en, None), (3, en, "de"), (4, en + "\n" + de, "en"), (5, "", None), (6, None, "en"), (7, "1234 5678 !!", None), (8, "Short", None)], "row_id bigint, text string, language string").withColumn("score", F.lit("x"))
    assert {tuple(r) for r in language.wrong_labels(rows, samples).collect()} == {(2, "en"), (3, "en"), (4, "en"), (4, "de")}
    spans = [r for r in language.segments(rows, language.fit(samples)).collect() if r.row_id == 4]
    assert {r.language for r in spans} == {"en", "de"} and max(r.end_char for r in spans) == len(en) + 1 + len(de)
    assert language.wrong_labels(rows.limit(0), samples).count() == 0
    assert language.wrong_labels(rows, samples.limit(0)).count() == 0 and language.segments(rows, language.fit(samples.limit(0))).count() == 0


# ---- tokens and encoding -----------------------------------------------------------------------------


@needs_tokenizer
def test_recursive_encoding_is_the_tokenizer(spark):
    plain = tokens._encoding(tokens.RANKS_PATH)
    texts = ["", None, " a  b\n\nc", "<|endoftext|> isn't special", "日本語の文章。", "नमस्ते दुनिया", "x" * 700, "ab" * 300 + "é😀", " ﻿\x00", "ข้อความ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in encode.encode_ids(rows).collect()}
    assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert encode.encode_ids(rows.limit(0)).count() == 0


@needs_tokenizer
@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    if encode.MODEL_PATH not in encode._models:
        encode._models[encode.MODEL_PATH] = encode.RecursiveBpe()
    ids = encode._models[encode.MODEL_PATH].encode([text])[0]
    assert tokens._encoding(tokens.RANKS_PATH).decode(ids) == text


@needs_tokenizer
def test_wrong_counts(spark):
    n = len(tokens._encoding(tokens.RANKS_PATH).encode_ordinary("some words of text"))
    rows = spark.createDataFrame([(1, "some words of text", n), (2, "some words of text", None), (3, "some words of text", 2 * n + 1), (4, "some words of text", 2 * n), (5, "some words of text", n // 2 - 1 if n > 3 else 0), (6, "", 0), (7, "", 5), (8, None, 0)], "row_id bigint, text string, token_count bigint")
    rows = rows.withColumn("ingested_at", F.current_timestamp()).withColumn("n_tokens", F.lit("clash"))
    late = rows.filter("row_id = 1").withColumn("token_count", F.lit(None).cast("bigint")).withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 1 DAY"))
    assert sorted(r.row_id for r in tokens.wrong_counts(rows.unionByName(late)).collect()) == [2, 3, 5, 7]


@needs_tokenizer
def test_budget_deltas(spark):
    corpora = spark.createDataFrame([("a", "d1"), ("b", "d1")], "corpus string, domain string")
    schema = "row_id bigint, source string, language string, text string"
    at = lambda df: df.withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp"))
    old = at(spark.createDataFrame([(1, "a", "en", "one two"), (2, "a", None, "three"), (3, "b", "en", "four")], schema))
    new = at(spark.createDataFrame([(1, "a", "en", "one two changed now"), (3, "b", "en", "four"), (4, "c", "de", "five")], schema))
    before, after = tokens.members(old, corpora), tokens.members(new, corpora)
    cube = tokens.apply_delta(None, tokens.cube_delta(None, before))
    moved = tokens.apply_delta(cube, tokens.cube_delta(before, after))
    fresh = tokens.apply_delta(None, tokens.cube_delta(None, after))
    assert sorted(map(str, moved.collect())) == sorted(map(str, fresh.collect())) and fresh.count() == 3
    table = tokens.update_counts(None, old)
    assert tokens.update_counts(table, new).count() == 5
    counted = tokens.members(new, corpora, counts=tokens.update_counts(table, new))
    assert sorted(map(str, counted.collect())) == sorted(map(str, after.collect()))
    total = tokens.roll_up(fresh).filter("level = ''").first()
    assert total.rows == 3 and total.tokens == sum(r.tokens for r in fresh.collect())
