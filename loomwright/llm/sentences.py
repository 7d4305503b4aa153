"""Sentence boundaries across languages and scripts.

A blank line ends a sentence. Within a block, gaps become the nodes of a lattice, scored by script,
and the best path over the nodes gives the boundaries.

Spaced scripts have a terminator lattice: every run of end marks with its closing marks is a node,
scored by the word before it (abbreviation, initial, ordinal), the token after it (case, script,
reporting clause) and what the mark is. Spaceless scripts are cut into words on both sides of a gap
by a dictionary word lattice (dynamic programming over dictionary words, unknown letters costing
more); their gaps - end marks and spaces in Chinese and Japanese, spaces in Thai - are classified
by the final particle that ends the words before and the opening or reporting word that begins the
words after.

A path takes a node as a boundary, for its score, or passes it. Quotations are states of the path:
once it took a boundary inside one, it has to take one where the quotation closes too, since an end
mark inside a quotation that its sentence goes on after is no boundary. Nodes with a score below
zero are never taken.

Defined results: null, empty and blank texts have no sentences; positions count code points of the
text as it stands, without white space around the sentence; a heading or fragment set off by blank
lines is one sentence; repeated rows give repeated results once; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import map_arrow, spread, strings

_BLANK = re.compile(r"(?:\r\n|\r|\n| )(?:[^\S\r\n ]*(?:\r\n|\r|\n| ))+")
_CLOSERS = "\"'”’»›)）]】」』〉》"
_NODE = re.compile(rf"[.!?…。！？।॥｡‼⁇⁈⁉]+(?:[    ]?[»›]|[{re.escape(_CLOSERS)}])*")
_OPENERS = "\"'“‘„«‹(（[【「『〈《¿¡*_-–—"
#: Closing mark by opening mark; straight marks and » open by what stands around them.
_QUOTES = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}
_QUOTE = re.compile(r'["“”„«»「」『』]')
_THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๎])[^\S]+(?=[ก-ฺเ-๎])")
_WIDE_END = re.compile(r"[。！？｡‼⁇⁈⁉]")

#: Abbreviations that go on, lower-cased and without their last full stop.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st sr sra srta dra jr mme mlle mgr rev hon gen col capt lt sgt hr fr herr frau "
    "approx ca env aprox etwa vs cf viz al fig figs sec secs ch chap vol vols no nos nr nro num art arts abs abb kap bd bde hrsg s p pp pag pág págs pgs op ed eds par núm nº n.º "
    "e.g i.e z.b d.h u.a z.t bzw vgl ggf inkl evtl sog zzgl p.ej p.ex "
    "jan feb febr mar mär apr jun jul aug sep sept oct okt nov dec dez ene abr ago dic janv févr avr juil déc fev set out "
    "ave blvd rd ln apt dept univ inc ltd corp co bros "
    "tel tél fax ext hon arch bibl cap caps sta sto nº n.° г гг стр рис табл прибл тел гл илл напр сокр см им ул д кв пр обл тыс млн млрд руб др проф акад т.е т.к т.д т.п "
    "डॉ श्री पृ सं क्र प्रो कु".split()
)
#: Of these, those that may also end a sentence: before a capital they do.
MAY_END = frozenset("etc usw p.m a.m inc ltd corp co bros u.s.a т.д т.п др ff al u.a v.chr n.chr".split())
#: Words after a German ordinal.
AFTER_ORDINAL = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrhunderts Jahrtausend Kapitel Stock Auflage Band Tag Woche Monat Platz Klasse Mal Geburtstag Teil Schritt Sitzung".split())
#: Dictionary of the word lattice. Words that go on with the sentence of a quotation before them: reports, copulas, case marks.
GOES_ON = frozenset("这 这就 这就是 这是 那 那就是 几个 几个字 几句 没有 没有人 没人 无人 的 他 她 我 便 就 是 一句 一行 四个字 之类 等 字样 等字样 说 问 答 写道 喊道 道 と とだけ とは という といった って など の と言 とのこと が を に は も".split())
#: Particles and endings after which a sentence of a spaceless script is complete.
FINAL_PARTICLES = frozenset(
    "了 吗 呢 吧 啊 呀 嘛 啦 哦 么 而已 罢了 です ます ました でしょう でした ません だ だった ない か ね よ な わ ぞ さ ください である ครับ ครับผม ค่ะ คะ จ้ะ จ้า นะ แล้ว หรือยัง ไหม มั้ย หรือ เถอะ สิ เลย ด้วย เท่านั้น".split()
)
#: Words that open a sentence: conjunctions, adverbs, pronouns, questions.
OPENERS = frozenset(
    "但是 但 然而 不过 所以 因此 于是 而且 另外 此外 同时 后来 最后 首先 其次 然后 因为 如果 虽然 为什么 我们 你们 他们 她们 它们 大家 今天 昨天 明天 请 "
    "しかし でも だから そして また それで そこで ところが さらに なお つまり なぜ もし 次に 最後に 私 私たち 彼 彼女 これ それ あれ この その "
    "แต่ และ ดังนั้น เพราะ ถ้า เมื่อ นอกจากนี้ อย่างไรก็ตาม ต่อมา สุดท้าย ทำไม เรา เขา ฉัน ผม วันนี้ เมื่อวาน".split()
)
#: Common words that keep the lattice from reading a particle out of the middle of another word.
COMMON_WORDS = frozenset(
    "一个 一些 什么 怎么 哪里 这里 那里 自己 可以 需要 已经 还是 就是 不是 关于 根据 时候 现在 以后 以前 了解 为了 除了 目的 的确 有的 吧台 问题 "
    "ここ そこ どこ こと もの ため よう とき する した して いる ある なる から まで より など たち もう まだ かも だけ ではない なかった "
    "การ ความ ที่ ของ ใน เป็น มี ไม่ ได้ ให้ จะ กับ จาก โดย".split()
)
_DICTIONARY = GOES_ON | FINAL_PARTICLES | OPENERS | COMMON_WORDS
_LONGEST = max(map(len, _DICTIONARY))
#: Letters of a spaceless script on each side of a gap that the lattice reads.
_REACH = 12
#: Gaps without an end mark: white space between two letters of Chinese or Japanese, within a line.
_WIDE_GAP = re.compile(r"(?<=[\u3040-\u30ff\u3400-\u9fff])[ \t\u3000]+(?=[\u3040-\u30ff\u3400-\u9fff])")
_SOLID = re.compile(r"\S")
#: Letters behind a gap that its score looks at, from the first that isn't white space.
_AHEAD = 200
_SPEECH = re.compile(r"^[^।.!?]{0,80}(?:पूछा|कहा|बोला|बोली|लिखा|उत्तर|जवाब)")


def word_lattice(text: str) -> list[str]:
    """Cheapest path through the dictionary words of a text; letters outside of it cost more."""
    n = len(text)
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + _LONGEST) + 1):
            known = text[i:j] in _DICTIONARY
            if not known and j > i + 1:
                continue
            c = cost[i] + (1.0 - 0.01 * (j - i) if known else 2.0)
            if c < cost[j]:
                cost[j], back[j] = c, i
    out = []
    while n:
        out.append(text[back[n] : n])
        n = back[n]
    return out[::-1]


def _spaceless(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _word_before(text: str, end: int, start: int) -> str:
    k = end
    while k > start and not text[k - 1].isspace() and text[k - 1] not in "(（[\"“«„'‘":
        k -= 1
    return text[k:end]


def _quotations(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(opening, closing) positions of the outermost quotations that close before ``end``."""
    stack: list[tuple[str, int]] = []
    for m in _QUOTE.finditer(text, start, end):
        c, at = m.group(), m.start()
        before, after = text[at - 1] if at > start else " ", text[at + 1] if at + 1 < end else " "
        if stack and c == stack[-1][0]:
            # a straight mark after a space and before a letter opens another one
            if c != '"' or not before.isspace() or after.isspace():
                opened = stack.pop()[1]
                if not stack:
                    yield opened, at
                continue
        if c in _QUOTES:
            stack.append((_QUOTES[c], at))
        elif c in '"»' and not after.isspace() and (before.isspace() or not before.isalnum() and before not in _CLOSERS or c == '"' and _spaceless(before)):
            if c == '"' and stack and stack[-1][0] == '"':
                stack.pop()  # the one before never closed
            stack.append(('"' if c == '"' else "«", at))


def _around(text: str, start: int, at: int, to: int, end: int) -> tuple[str, str]:
    """The last word before ``at`` and the first word from ``to`` on, by the word lattice."""
    before = re.search(r"[^\W\d_]*\Z", text[max(start, at - _REACH) : at]).group()
    after = re.match(r"[^\W\d_]*", text[to : min(end, to + _REACH)]).group()
    left, right = word_lattice(before), word_lattice(after)
    return (left[-1] if left else ""), (right[0] if right else "")


def _gap_score(text: str, start: int, at: int, to: int, end: int, base: float) -> float:
    """Gap of a spaceless script: a final particle before and an opening word after speak for it, a word that goes on against it."""
    last, opening = _around(text, start, at, to, end)
    return base + 0.5 * (last in FINAL_PARTICLES) + 0.5 * (opening in OPENERS) - 2.0 * (opening in GOES_ON and opening not in OPENERS)


def _wide_score(text: str, start: int, node: re.Match, end: int) -> float:
    """Gap after an end mark of a spaceless script."""
    solid = _SOLID.search(text, node.end(), end)
    if not any(c in _CLOSERS for c in node.group()) or not solid:
        return 1.0
    ahead = text[solid.start() : min(end, solid.start() + _AHEAD)]
    if ahead[0] in "，、；：,;:":
        return -1.0
    if node.group()[-1] in ")）]】" and not any(c in "\"”’»」』" for c in node.group()):
        return 1.0
    return _gap_score(text, start, node.start(), solid.start(), end, 0.8)


def _score(text: str, start: int, node: re.Match, end: int) -> float:
    """Positive for a boundary after the node, negative for none."""
    marks = node.group()
    solid = _SOLID.search(text, node.end(), end)
    if not solid:
        return 1.0
    if _WIDE_END.search(marks):
        return _wide_score(text, start, node, end)
    if solid.start() == node.end():
        return 1.0 if marks[0] in "!?।॥" and _spaceless(solid.group()) else -9.0
    ahead = text[solid.start() : min(end, solid.start() + _AHEAD)]
    first = next((c for c in ahead if c not in _OPENERS), "")
    closed = any(c in _CLOSERS for c in marks)
    if ahead[0] in "—–-" and len(ahead) > 1 and (ahead[1:].lstrip()[:1].islower() or closed):
        return -2.0
    if first.islower():
        # a small letter goes on, but for an opening of its own such as an address
        return -2.0
    if ahead[0] in ",;:，、；：":
        return -2.0
    if "ऀ" <= first <= "ॿ" and closed and any(c in "\"”’»" for c in marks):
        return -2.0 if _SPEECH.match(ahead) else 1.0
    if marks[0] in "।॥!?":
        return 2.0
    if marks.startswith(("...", "…")):
        return 0.5
    if closed:
        return 1.5
    word = _word_before(text, node.start(), start)
    low = word.lower().strip("(*_")
    if word and "ऀ" <= word[-1] <= "ॿ":
        return -1.0
    joined = low if low else ""
    # abbreviations of several pieces may hold spaces: p. ej., z. B., т. д.
    head = text[max(start, node.start() - len(word) - 4) : node.start() - len(word)]
    pieces = re.search(r"(\w)\.\s$", head)
    if pieces:
        joined = f"{pieces.group(1).lower()}.{low}"
    may_end = low in MAY_END or joined in MAY_END
    if may_end:
        return 1.0 if first.isupper() or not first.isalpha() and not first.isdigit() else -1.0
    if low in ABBREVIATIONS or (pieces and joined in ABBREVIATIONS):
        # a page or a number at the very end of a sentence has its figure behind it
        return -1.5
    if len(word) == 1 and word.isalpha():
        if re.match(r"\w\.", ahead):
            return -1.0
        return -1.0 if word.isupper() else (-1.0 if pieces or first.isdigit() else 0.5)
    if re.fullmatch(r"(?:\w\.)+\w", word):
        return 0.4 if first.isupper() else -1.0
    if word.isdigit() and first.isupper():
        token = re.match(r"[\wäöüÄÖÜß]+", ahead)
        return -1.0 if token and token.group() in AFTER_ORDINAL and len(word) <= 4 else 1.0
    return 1.0


def _best_path(nodes: list[tuple[int, float]], quotations: list[tuple[int, int, int]]) -> list[int]:
    """Positions of the boundaries on the best path over (position, score) nodes.

    Quotations are (opening mark, closing mark, position of the node that closes it; 0 where the
    text ends with it, -1 where the sentence goes on without a node). The state is whether the
    path took a boundary inside the quotation that it is in; every state keeps its best score and
    the way there.
    """
    paths: dict[bool, tuple[float, tuple | None]] = {False: (0.0, None)}
    left = list(reversed(quotations))

    def keep(into: dict, state: bool, path: tuple[float, tuple | None]) -> None:
        if state not in into or path[0] > into[state][0]:
            into[state] = path

    def close(closing: int) -> None:
        """Leave a quotation that no node closes; where its sentence goes on, boundaries inside are no path."""
        nonlocal paths
        after: dict = {}
        for cut, path in paths.items():
            if not cut or closing == 0:
                keep(after, False, path)
        paths = after

    for position, score in nodes:
        while left and position > left[-1][1] and position != left[-1][2]:
            close(left.pop()[2])
        inside = bool(left) and left[-1][0] < position <= left[-1][1]
        closes = bool(left) and position == left[-1][2]
        after: dict = {}
        for cut, (gain, way) in paths.items():
            if score > 0:
                keep(after, inside, (gain + score, (position, way)))
            if not (closes and cut):
                keep(after, cut and not closes, (gain, way))
        if closes:
            left.pop()
        paths = after
    while left:
        close(left.pop()[2])
    way, out = max(paths.values(), key=lambda p: p[0])[1], []
    while way is not None:
        out.append(way[0])
        way = way[1]
    return out[::-1]


def _closings(text: str, nodes: list[tuple[int, float]], start: int, end: int) -> list[tuple[int, int, int]]:
    """Quotations of a block with the node that takes in each one's closing mark, with the marks behind it."""
    out, positions = [], [p for p, _ in nodes]
    for opened, closed in _quotations(text, start, end):
        k = bisect_right(positions, closed)
        last = positions[k] if k < len(positions) else end + 1
        closing = closed + 1 <= last <= closed + 4 and all(c in _CLOSERS for c in text[closed:last])
        out.append((opened, closed, last if closing else (-1 if _SOLID.search(text, closed + 1, end) else 0)))
    return out


def _block(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Sentences of a block without blank lines."""
    nodes = [(m.end(), _score(text, start, m, end)) for m in _NODE.finditer(text, start, end)]
    # spaces between Thai letters: the rule of the script makes each a boundary, whatever the words around it
    nodes += [(m.start(), max(0.1, _gap_score(text, start, m.start(), m.end(), end, 1.0))) for m in _THAI_GAP.finditer(text, start, end)]
    # spaces between Chinese or Japanese letters: both a final particle and an opening word are needed
    nodes += [(m.start(), _gap_score(text, start, m.start(), m.end(), end, -0.9)) for m in _WIDE_GAP.finditer(text, start, end)]
    nodes.sort()
    at = start
    for position in _best_path(nodes, _closings(text, nodes, start, end) if len(nodes) > 1 else []):
        if position > at:
            yield at, position
            at = position
    yield at, end


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without white space around it."""
    if not text or text.isspace():
        return []
    out, at = [], 0
    breaks = [m.span() for m in _BLANK.finditer(text)]
    for a, b in [*breaks, (len(text), len(text))]:
        for x, y in _block(text, at, a):
            while x < y and text[x].isspace():
                x += 1
            while y > x and text[y - 1].isspace():
                y -= 1
            if x < y:
                out.append((x, y))
        at = b
    return out


def sentence_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char), a row a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends = [], [], []
            for i, s in enumerate(strings(batch.column(1))):
                for a, b in sentences(s):
                    at.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "start_char", "end_char"])

    zero = F.lit(0).cast("bigint")
    schema = documents.select(key, zero.alias("start_char"), zero.alias("end_char")).schema
    return map_arrow(spread(documents.select(key, text)), run, schema).distinct()
