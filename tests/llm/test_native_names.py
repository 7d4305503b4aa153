"""Names in scripts other than Latin."""

import pytest

from loomwright.llm import pii


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("वह रखता है। डॉ. मेहरांत ने पृ. 681 पर टिप्पणी की।", "मेहरांत"),
        ("कल श्री राम शर्मा ने पूछा।", "राम शर्मा"),
        ("По словам Анны Петровой, всё готово.", "Анны Петровой"),
        ("Контакт: И. П. Смирнов", "И. П. Смирнов"),
        ("Его видел профессор Иванов вчера.", "Иванов"),
        ("联系人：王小明，电话见下。", "王小明"),
        ("担当：山田 太郎様まで。", "山田 太郎"),
        ("ดร. สมชาย ใจดี", "สมชาย ใจดี"),
        ("До встречи.\n\nС уважением,\nИван Орлов\n", "Иван Орлов"),
        ("谢谢。\n此致\n李雷\n", "李雷"),
        ("धन्यवाद।\nसादर,\nमीरा जोशी\n", "मीरा जोशी"),
    ],
)
def test_names_of_other_scripts(text, name):
    assert [(k, text[a:b]) for k, a, b in pii.find_items(text)] == [("name", name)]


@pytest.mark.parametrize("text", ["श्रीलंका में वर्षा हुई।", "Этот доктор ушёл домой.", "担当者は「準備ができました。」とだけ書きました。", "联系人很多。", "По словам очевидцев, всё тихо."])
def test_no_names_of_other_scripts(text):
    assert pii.find_items(text) == []
