"""Sentences around quotations of several sentences."""

import pytest

from loomwright.llm import sentences


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ('He said "Stop. Go home." and left. We stayed.', ['He said "Stop. Go home." and left.', "We stayed."]),
        ('"Stop. Go home," he said. We stayed.', ['"Stop. Go home," he said.', "We stayed."]),
        ("“你走吧。我不去。”他说。我们留下。", ["“你走吧。我不去。”他说。", "我们留下。"]),
        ("Er rief „Halt. Geh heim.“ und ging. Wir blieben.", ["Er rief „Halt. Geh heim.“ und ging.", "Wir blieben."]),
        ("Il dit « Stop. Rentre. » et partit. Nous restons.", ["Il dit « Stop. Rentre. » et partit.", "Nous restons."]),
        ("彼は「やめて。帰って。」と言った。私は残った。", ["彼は「やめて。帰って。」と言った。", "私は残った。"]),
        ('It is 5" wide. That one is 6" wide. Good.', ['It is 5" wide.', 'That one is 6" wide.', "Good."]),
        ('An "open one. Then another. "Yes," he said. Good.', ['An "open one.', "Then another.", '"Yes," he said.', "Good."]),
        ('He stopped. "Go home." She left.', ["He stopped.", '"Go home."', "She left."]),
    ],
)
def test_quotations_of_several_sentences(text, wanted):
    assert [text[a:b] for a, b in sentences.sentences(text)] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("你走了吗 但是我不走。", ["你走了吗", "但是我不走。"]),  # a final particle and an opening word
        ("你走了吗 石头不走。", ["你走了吗 石头不走。"]),  # the particle alone
        ("石头 但是我不走。", ["石头 但是我不走。"]),  # the opening word alone
        ("帰りました しかし雨です。", ["帰りました", "しかし雨です。"]),
        ("他说：“走吧。”但是我不走。", ["他说：“走吧。”", "但是我不走。"]),
        ("他写：“走吧。”的人不走。", ["他写：“走吧。”的人不走。"]),  # goes on
    ],
)
def test_particles_and_opening_words(text, wanted):
    assert [text[a:b] for a, b in sentences.sentences(text)] == wanted


def test_best_path():
    inside = [(5, 1.0), (9, 1.0)]
    assert sentences._best_path(inside, [(0, 8, 9)]) == [5, 9]
    assert sentences._best_path([(5, 1.0), (9, -1.0), (20, 1.0)], [(0, 8, 9)]) == [20]  # its sentence goes on
    assert sentences._best_path(inside[:1], [(0, 8, -1)]) == [] and sentences._best_path(inside[:1], [(0, 8, 0)]) == [5]
    assert sentences._best_path([(3, 1.0), (9, -1.0), (12, 1.0), (16, 1.0)], [(0, 8, 9), (10, 15, 16)]) == [12, 16]
    assert sentences._best_path([], []) == []
