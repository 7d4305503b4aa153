"""Personal data in free text: found in normalised text, replaced in the text as it stands.

A transducer normalises a text while keeping, for every normalised position, the source
position: full-width and other digits, dashes, spaces and letters that only look Latin are
mapped one to one; zero-width characters vanish; ``(at)``, ``[dot]``, spaced ``@`` and spelled
digits contract. Detectors run on the normalised text and their spans are mapped back, so that
placeholders replace whole disguised items and everything else stays as it was.

Kinds: email, phone, identity_number, street_address, name. Start positions count code points
and leave out labels, titles, ``mailto:`` and ``<``.

Defined results: null and empty texts have no items; items never overlap (the earlier kind in
the order street_address, email, identity_number, phone, name wins); a row id that arrives
several times is reported once; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import map_arrow, spread, strings

KINDS = ("street_address", "email", "identity_number", "phone", "name")
PLACEHOLDERS = {"email": "<EMAIL_ADDRESS>", "phone": "<PHONE_NUMBER>", "identity_number": "<IDENTITY_NUMBER>", "street_address": "<STREET_ADDRESS>", "name": "<PERSON_NAME>"}

# ---- the transducer ---------------------------------------------------------------------

#: Letters of other scripts that look like the Latin letter after them.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοαρνικΟΑΡΝΙΚΕΒΗΜΤΧΖ", "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHoapvikOAPNIKEBHMTXZ"))
_MIXED = re.compile("[A-Za-z0-9][" + "".join(_LOOKALIKE) + "]|[" + "".join(_LOOKALIKE) + "][A-Za-z0-9]")
_MIXED_WORD = re.compile(r"\S+")


def _one_to_one() -> dict[int, int]:
    out = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
    for zero in (0x0660, 0x06F0, 0x0966, 0x0E50):
        out |= {zero + i: 0x30 + i for i in range(10)}
    out |= dict.fromkeys([*range(0x2010, 0x2016), 0x2212, 0xFE63], 0x2D)
    out |= dict.fromkeys([0xA0, 0x3000, 0x202F, *range(0x2000, 0x200B)], 0x20)
    return out


_PLAIN = _one_to_one()
#: Quick test for characters that the one-to-one map changes, in texts that aren't ASCII.
_CHANGES = re.compile("[" + "".join(map(re.escape, map(chr, _PLAIN))) + "]")

_SPELLED = {w: str(i) for ws in ("zero one two three four five six seven eight nine", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf", "null eins zwei drei vier fünf sechs sieben acht neun", "zero um dois três quatro cinco seis sete oito nove", "ноль один два три четыре пять шесть семь восемь девять") for i, w in enumerate(ws.split())}
_SPELLED["oh"] = "0"
_WORDS = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:(?:{_WORDS})(?!\w)[ .,/-]*){{6,}}")
_SPELLED_WORD = re.compile(rf"(?i)({_WORDS})[ ]*")
#: Disguises that change the length; the named group tells what they become.
_CONTRACT = re.compile(
    r"(?P<gone>[​‌‍⁠﻿­])"
    r"|(?P<at> ?[(\[{<] ?(?:at|AT|At|arroba|@) ?[)\]}>] ?|(?<=\w) @ (?=[\w-]+ ?[.(\[])| (?:at|AT) (?=[\w-]+ (?:dot|DOT) \w))"
    r"|(?P<dot> ?[(\[{] ?(?:dot|DOT|Dot|punto|ponto|point|punkt|\.) ?[)\]}] ?)"
    r"|(?P<word>(?<=\w) (?:dot|DOT) (?=\w))"
)
_GONE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_BRACKETED = re.compile(r"[(\[{<] ?(?:at|AT|At|arroba|@|dot|DOT|Dot|punto|ponto|point|punkt|\.) ?[)\]}>]")
_LOOKS = re.compile("[" + "".join(_LOOKALIKE) + "]")


def _disguised(t: str) -> bool:
    """Quick test for anything that the transducer contracts."""
    return " @ " in t or " dot " in t or " DOT " in t or bool(_BRACKETED.search(t)) or (not t.isascii() and bool(_GONE.search(t)))


class Normalised:
    """A normalised text and the way back to source positions."""

    __slots__ = ("text", "_at", "_from", "_made")

    def __init__(self, text: str):
        plain = text if text.isascii() or not _CHANGES.search(text) else text.translate(_PLAIN)
        if not text.isascii() and _LOOKS.search(plain) and _MIXED.search(plain):
            plain = _MIXED_WORD.sub(lambda m: m.group().translate(str.maketrans(_LOOKALIKE)) if _MIXED.search(m.group()) else m.group(), plain)
        self._at: list[int] | None = None
        self.text = plain
        found = [(m.start(), m.end(), {"gone": "", "at": "@"}.get(m.lastgroup, ".")) for m in _CONTRACT.finditer(plain)] if _disguised(plain) else []
        if sum(map(_SPELLED.__contains__, plain.lower().replace("-", " ").split())) >= 5 and (run := _SPELLED_RUN.search(plain)):
            found += self._digits(plain, run)
        if found:
            self._contract(plain, sorted(found))

    @staticmethod
    def _digits(plain: str, run) -> list[tuple[int, int, str]]:
        out = []
        while run:
            end = run.start() + len(run.group().rstrip(" .,/-"))
            out += [(m.start(), min(m.end(), end), _SPELLED[m.group(1).lower()]) for m in _SPELLED_WORD.finditer(plain, run.start(), end)]
            run = _SPELLED_RUN.search(plain, run.end())
        return out

    def _contract(self, plain: str, found: list[tuple[int, int, str]]) -> None:
        parts, at, src, made, done, size = [], [0], [0], [False], 0, 0
        for start, end, new in found:
            if start < done:
                continue
            parts += [plain[done:start], new]
            size += start - done
            if new:
                at.append(size)
                src.append(start)
                made.append(True)
            size += len(new)
            at.append(size)
            src.append(end)
            made.append(False)
            done = end
        parts.append(plain[done:])
        self.text, self._at, self._from, self._made = "".join(parts), at, src, made

    def source(self, position: int) -> int:
        if self._at is None:
            return position
        k = bisect_right(self._at, position) - 1
        return self._from[k] + position - self._at[k]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a normalised one; a disguise at its end belongs to it whole."""
        if self._at is None:
            return start, end
        k = bisect_right(self._at, end - 1) - 1
        last = self._from[k + 1] if self._made[k] else self._from[k] + end - self._at[k]
        return self.source(start), last


# ---- detectors --------------------------------------------------------------------------

_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+")
#: Characters of the part before the at sign, of which a dot may not be the last.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGITS = re.compile(r"[+(\d][\d().\-/ ]{5,}[\dXx]")
_PHONE = re.compile(
    r"(?<![\w.\-/+])(?:"
    r"\+\d{1,3}(?:[ .\-]?\(0\))?(?:[ .\-]?\(?\d{1,8}\)?){1,6}"
    r"|00[1-9]\d{0,2}(?:[ .\-]\d{2,8}){1,5}"
    r"|\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}"
    r"|\d{3}([ .\-])\d{3}\1\d{4}"
    r"|0\d{1,4}/\d{3,8}(?:[ \-]\d{1,6})?"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{3,4} \d{3} ?\d{3,4}"
    r")(?![\w]|[\-/.]\d)"
)
_IDENTITY = re.compile(r"(?<![\w.\-/])(?:\d{3}([ \-])\d{2}\1\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{6}-\d{4}|\d{17}[\dXx])(?![\w]|[\-/.]\d)")
_LETTERED = re.compile(r"(?<![\w.\-/])(?:(\d{8}|[XYZ]\d{7})([A-Z])|[A-Z]\d{8}|[A-Z]{2}\d{6}[A-D])(?!\w)")
_SIX = re.compile(r"\d{6}")
#: Fixed value: the control letters of Spanish identity numbers, by remainder.
_CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE"
_THING = re.compile(r"(?i)(?:ticket|invoice|facture|factura|fatura|rechnung|isbn|issn|checksum|build|shard|row|version|order|serial|part|object|record|entry|page|block|№|发票|请求书)[ #:.]*(?:no\.?|nr\.?|n[.]?º)?[ #:]*$")
_DIALLED = re.compile(r"\+\d{1,3}[ -]$")
_ID_LABEL = re.compile(r"(?i)(?:passport|passeport|pasaporte|passaporte|reisepass|national id|identity|insurance|nino|dni|nie|cpf|ssn|护照|身份证|旅券|паспорт)[^\n]{0,12}$")

_CITY = r"[A-ZÀ-Þ][\w'’\-]+(?: [A-ZÀ-Þ][\w'’\-]+)?"
_STREET = [
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}[A-Za-z]? (?:[A-ZÀ-Þ][\w'’\-]+ ){{1,3}}(?:Street|Road|Lane|Avenue|Terrace|Drive|Court|Place|Square|Close|Boulevard|St\.|Rd\.|Ln\.|Ave\.|Blvd\.)(?!\w)(?:, (?:Apt|Apartment|Flat|Unit|Suite)\.? ?\w+)?(?:, {_CITY}(?: \d{{4,6}})?)?"),
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}[A-Za-z]? (?:[NSEW]\.? )?(?:[A-ZÀ-Þ][\w'’\-]+ ){{1,3}}(?:St|Rd|Ave|Blvd|Ln|Dr|Ct|Pl|Sq|Hwy|Pkwy|Way|Row)(?!\w)(?: (?:NE|NW|SE|SW|N|S|E|W)(?!\w))?(?:, (?:Apt|Apartment|Flat|Unit|Suite)\.? ?\w+)?(?:, {_CITY}(?: \d{{4,6}})?)?"),
    re.compile(rf"(?<![\w.\-/])(?:\d{{1,5}} )?(?:[NSEW]\.? )?\d{{1,3}}(?:st|nd|rd|th) (?:Avenue|Ave|Street|St)(?!\w)(?: (?:NE|NW|SE|SW|N|S|E|W)(?!\w))?,? {_CITY}(?: \d{{4,6}})?"),
    re.compile(rf"(?<![\w.\-/])\d{{1,5}}(?: ?(?:bis|ter|[a-z]))?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|route) (?:de la |de l['’]|des |du |de |d['’])?[A-ZÀ-Þ][\w'’\-]+(?: [A-ZÀ-Þ][\w'’\-]+)*(?:,? \d{{5}} {_CITY})?"),
    re.compile(rf"(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Rua|Travessa) (?:de (?:la |los |las )?|do |da )?[A-ZÀ-Þ][\w'’\-]+(?: [A-ZÀ-Þ][\w'’\-]+)?,? \d{{1,5}}(?:, \d{{1,2}}\.? ?[ºª°] ?\w?)?(?:, \d{{5}}(?:-\d{{3}})? {_CITY})?"),
    re.compile(rf"(?<!\w)[A-ZÄÖÜ][\w\-]+(?:straße|strasse|weg|gasse|platz|allee|damm) \d{{1,4}} ?[a-z]?(?!\w)(?:, \d{{5}} {_CITY})?"),
    re.compile(r"(?<!\w)(?:ул\.|улица|пр\.|проспект|переулок) ?[А-ЯЁ][\w\-]+(?: [А-ЯЁ][\w\-]+)?,? ?(?:д\.|дом)? ?\d{1,4}(?:, ?(?:кв\.|квартира) ?\d+)?"),
]
_STREET_HINT = [re.compile(h) for h in (r"Street|Road|Lane|Avenue|Terrace|Drive|Court|Place|Square|Close|Boulevard|St\.|Rd\.|Ln\.|Ave\.|Blvd\.", r" (?:St|Rd|Ave|Blvd|Ln|Dr|Ct|Pl|Sq|Hwy|Pkwy|Way|Row)(?!\w)", r"\d(?:st|nd|rd|th) (?:Ave|St)", r" (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|route) ", r"Calle|Avenida|Plaza|Paseo|Rua|Travessa", r"(?:straße|strasse|weg|gasse|platz|allee|damm) \d", r"ул|пр")]

_CAP = r"(?!\S*@)[A-ZÀ-ÞŁŚŠŽ][\w'’]*\w"
_TOKEN = rf"(?:al-)?{_CAP}(?:-{_CAP})*"
_INITIAL = r"[A-ZÀ-Þ]\."
_PARTICLE = r"(?:van der|van den|van|von|de la|del|de|da|dos|di|bin|ben)"
_STRAIGHT = rf"(?:{_INITIAL}|{_TOKEN})(?: (?:{_PARTICLE} {_TOKEN}|{_INITIAL}|{_TOKEN})){{0,4}}"
_TWO = rf"(?:{_INITIAL}|{_TOKEN})(?: (?:{_PARTICLE} {_TOKEN}|{_INITIAL}|{_TOKEN})){{1,4}}"
#: Surname first, after a comma the given name; telephone labels are no given names.
_TURNED = rf"(?:{_PARTICLE} )?{_TOKEN}, (?!T[eé]l|Fax|Mail)(?:{_INITIAL}|{_TOKEN})(?: {_INITIAL})*(?!\w)"
_ANY = rf"(?:{_TURNED}|{_TWO})"

_TITLES = r"Mrs?\.|Ms\.|Miss|Dr\.|Prof\.|Sra?\.|Srta\.|Dra\.|Mmes?|Mlle|Frau|Herrn?|Señora?|Senhora?|Madame|Monsieur|Mister"
_TITLED = re.compile(rf"(?:{_TITLES}) ((?:(?:{_TITLES}) )*)({_TURNED}|{_STRAIGHT})")
#: In sentences of capitals every word looks like a name: initials and one word, or two words.
_LOUD = re.compile(rf"(?:MRS?|MS|MISS|DR|PROF|SRA?|DRA|MME|M|FRAU|HERRN?)\.? ({_TURNED}|(?:{_INITIAL} )+{_TOKEN}|{_TOKEN} (?:{_INITIAL} )*(?:(?:VAN|DE|VON|AL) )?{_TOKEN})(?= [A-ZÀ-Þ]{{2,}} |,? [A-ZÀ-Þ] )")
_MONSIEUR = re.compile(rf"(?:^|(?<=[.!?»\n] )|(?<=\n))M\. ({_TURNED}|{_STRAIGHT})(?= (?:[a-zàâéè]+|a) )")
#: Phrases after which a person is named, by what they do there. Each stands with a small and a capital first letter.
_LABELS = (
    "Signed,|From:|Cc:|To:|Name:|Author:|Attn:|Attention:|Contact:|Contact :|Contacto:|Contato:|Ansprechpartner:|Ansprechpartnerin:|Contatto:|Nombre:|Nom:|Nome:|Autor:|Auteur:|Auteur :|Firmado,|Gezeichnet,|Signé,|Assinado,|"
    "По словам|Контакт:|Подпись:|联系人：|联系人:|担当：|担当:"
).split("|")
_INTRODUCED = (
    "my name is|I am|I'm|I’m|this is|on behalf of|mein Name ist|ich heiße|ich bin|im Namen von|me llamo|mi nombre es|soy|en nombre de|je m'appelle|je m’appelle|mon nom est|je suis|au nom de|"
    "meu nome é|chamo-me|me chamo|sou|sou o|sou a|em nome de|according to|laut|según|selon|segundo|d'après|d’après|de acordo com|de acuerdo con"
).split("|")
_MADE_BY = [
    f"{verb} {by}"
    for verbs, by in (
        ("transcribed written translated edited signed reviewed prepared sent drawn painted approved reported illustrated founded", "by"),
        ("escrito escrita traducido traducida firmado firmada revisado revisada enviado enviada traduzido traduzida assinado assinada revisto revista", "por"),
        ("écrit écrite traduit traduite signé signée relu relue envoyé envoyée", "par"), ("geschrieben übersetzt unterschrieben geprüft verfasst", "von"),
    )
    for verb in verbs.split()
]
_DONE_TO = (
    "told|asked|ask for|thanked|met|meet|reach|reached|phone|phoned|called|emailed|contacted|visited|interviewed|married|invited|hired|informed|greeted|lists|knows|helped|"
    "preguntar por|pregunte por|conocí a|llamó a|llame a|avisó a|invitó a|contactar a|demandez|rencontré|appelé|prévenu|invité|contacter|"
    "fragen Sie nach|traf|treffe|rief|besuchte|kenne|fragte|grüßte|procure|conheci|chamou|convidou|contacte|avisou"
).split("|")
_BESIDE = [
    f"{verb} {by}"
    for verbs, preps in (
        ("stay stays live lives work works worked spoke speak talked met talk", "with to"), ("queda quedan vive viven trabaja trabajan hablo habló hablé hablar reunió", "con"),
        ("fica ficam mora moram trabalha trabalham falei falou falar reuniu", "com"), ("reste restent habite habitent travaille travaillent", "chez avec"), ("parlé parler parlez", "avec à"),
        ("bleibt bleiben wohnt wohnen arbeitet arbeiten", "bei mit"), ("sprach sprechen rede redete", "mit"),
    )
    for verb in verbs.split() for by in preps.split()
]
_MEANT_FOR = [
    f"{thing} {by}"
    for things, by in (
        ("parcel letter package message note invitation ticket room gift call", "for"), ("paquete carta mensaje nota regalo llamada encomenda mensagem recado presente", "para"),
        ("colis lettre message mot paquet cadeau", "pour"), ("Paket Brief Nachricht Geschenk Anruf", "für"),
    )
    for thing in things.split()
]
#: Verbs whose subject is a person, spoken or signed.
_SAID = (
    "said|says|asked|replied|explained|answered|smiled|laughed|wrote|lives|retired|counted|signed|agreed|met|sagte|fragte|antwortete|erklärte|schrieb|wohnt|lachte|zählten|"
    "dijo|preguntó|respondió|explicó|escribió|vive|contaron|a dit|a demandé|a répondu|a écrit|a expliqué|habite|ont compté|ont signé|disse|perguntou|respondeu|explicou|escreveu|mora|contaram"
).split("|")
#: Words of organisations, places and things; a name holds none of them. Words that begin sentences.
_THINGS = re.compile(
    r"(?:^|[ -])(?:Street|Road|Avenue|Lane|Project|Operation|Team|Group|Press|Archives?|Archiv|Library|University|Universität|College|School|Institute|Committee|Council|Company|Corporation|Bank|Museum|Hospital|Church|Station|Bridge|River|"
    r"Lake|Mountain|Island|City|Town|Village|County|State|Republic|Ministry|Department|Office|Court|House|Hall|Park|Garden|Tower|Version|Release|Protocol|System|Server|Service|Software|License|Licence|Report|Record|Index|Catalogue|Registry|"
    r"Society|Association|Foundation|Club|Union|Party|Army|Times|Journal|Review|Award|Prize|Festival|Conference|January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|"
    r"Straße|Platz|Stadt|Verein|Gesellschaft|Bibliothek|Calle|Ciudad|Universidad|Biblioteca|Archivo|Rue|Ville|Université|Bibliothèque|Cidade|Universidade|Arquivo|New|North|South|East|West|Saint|San|Los|Las|Great)(?![\w])"
)
_OPENS = re.compile(
    r"(?:The|This|That|These|Those|A|An|In|On|At|By|For|From|With|And|But|Or|If|When|While|After|Before|Since|It|He|She|We|They|You|I|My|Our|Your|His|Her|Their|There|Here|No|Not|All|Each|Every|Some|Many|One|Two|What|Who|How|Why|Where|"
    r"Der|Die|Das|Den|Dem|Ein|Eine|Und|Aber|Wenn|Nach|Vor|Im|In|Am|Es|Er|Sie|Wir|Ich|El|La|Los|Las|Un|Una|Y|Pero|Cuando|En|De|Con|Le|Les|Une|Et|Mais|Quand|Dans|Avec|O|Os|As|Um|Uma|E|Mas|Quando|Em|Com) "
)
#: Titles start no name; they have their own form.
_TITLE_FIRST = re.compile(rf"(?:{_TITLES}) ")
_AFTER = re.compile(rf" ({_ANY})")
_AFTER_LABEL = re.compile(rf" ?({_ANY})")
_SUBJECT = re.compile(rf"(?<![\w.@-])(?:({_ANY}) (?:and|und|y|et|e) )?({_ANY})\Z")
#: Letters before a verb that may hold its subjects.
_SUBJECT_REACH = 110


@lru_cache(maxsize=1)
def _cues():
    """Automaton over all phrases: (what it is, length) where one ends."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, phrases in (("after", [*_INTRODUCED, *_MADE_BY, *_DONE_TO, *_BESIDE, *_MEANT_FOR]), ("label", _LABELS)):
        for phrase in phrases:
            for first in {phrase[0], phrase[0].upper()}:
                out.add_word(first + phrase[1:], (kind, len(phrase)))
    for verb in _SAID:
        # a verb may be a phrase of its own too; the space before it keeps them apart
        out.add_word(" " + verb, ("before", len(verb) + 1))
    out.make_automaton()
    return out


_LOUD_HINTS = ("MR. ", "MRS. ", "MS. ", "DR. ", "PROF. ", "SR. ", "SRA. ", "DRA. ", "MME ", "M. ", "FRAU ", "HERR")
_CLOSING = re.compile(
    r"(?m)^[ \t]*(?:Best wishes|Best regards|Best|All the best|Love|Thank you|Respectfully|Herzliche Grüße|Liebe Grüße|Beste Grüße|Grüße|Hochachtungsvoll|Un abrazo|Cordiales saludos|Bien cordialement|Amicalement|Abraços|Cumprimentos|Kind regards|Warm regards|Regards|Sincerely|Yours sincerely|Yours|Cheers|Thanks|Un saludo|Saludos|Atentamente|Bien à vous|Cordialement"
    r"|Viele Grüße|Mit freundlichen Grüßen|Atenciosamente|Um abraço|Com os melhores cumprimentos|С уважением|此致|敬具|सादर|ด้วยความเคารพ)[,;:]?[ \t]*\n+"
    rf"[ \t]*({_TURNED}|{_STRAIGHT})[ \t]*$"
)

#: Names in scripts without Latin letters, by a title before them or by a phrase in their script. Matras are no word characters to ``re``.
_HINDI = r"[\u0900-\u0963\u0966-\u097f]+"
_HINDI_CASE = r"(?:ने|को|से|का|की|के|में|पर|और|द्वारा)(?![\u0900-\u0963\u0966-\u097f])"
_HINDI_NAME = rf"{_HINDI}(?:(?: (?!{_HINDI_CASE}){_HINDI}){{1,2}}(?=,| {_HINDI_CASE}))?"
_CYRILLIC_INITIAL, _CYRILLIC_TOKEN = r"[А-ЯЁ]\.", r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_CYRILLIC_NAME = rf"(?:{_CYRILLIC_INITIAL} ?)*{_CYRILLIC_TOKEN}(?: (?:{_CYRILLIC_INITIAL} ?)*{_CYRILLIC_TOKEN}){{0,2}}(?: ?{_CYRILLIC_INITIAL})*"
_HAN = r"[\u3041-\u3096\u30a1-\u30fa\u30fc\u3005\u4e00-\u9fff]"
_HAN_NAME = rf"{_HAN}{{2,5}}?(?:[ \u3000・·]{_HAN}{{1,6}}?)?(?=様|さん|氏|先生|女士|[\s。、,;)」]|$)"
_THAI_NAME = r"[\u0e01-\u0e4e]+(?: [\u0e01-\u0e4e]+)?(?=[\s,;.]|$)"
_NATIVE = [
    (("डॉ", "प्रो", "श्री", "कुमारी"), re.compile(rf"(?<![\u0900-\u097f])(?:डॉ\.|डॉक्टर|प्रो\.|श्री|श्रीमती|सुश्री|कुमारी) ({_HINDI_NAME})")),
    (("г-", "д-р", "Д-р", "осп", "окт", "роф", "По сл", "Контакт", "Подпись"), re.compile(rf"(?<!\w)(?:[Гг]-(?:н|на|ну|жа|жи|же|жу)|[Гг]осподин[ау]?|[Гг]оспож[аиеу]|[Дд]-р|[Дд]октор[ау]?|[Пп]рофессор[ау]?|[Пп]роф\.|По словам|Контакт ?:|Подпись ?:) ?(?<=[ .:])({_CYRILLIC_NAME})(?!\w)")),
    (("联系人", "担当"), re.compile(rf"(?:联系人|担当者?) ?[:：] ?({_HAN_NAME})")),
    (("ดร.", "นาย ", "นาง ", "นางสาว ", "คุณ "), re.compile(rf"(?<![\u0e01-\u0e4e])(?:ดร\. ?|(?:นาย|นางสาว|นาง|คุณ) )({_THAI_NAME})")),
    (("С уважением", "此致", "敬具", "सादर", "ด้วยความเคารพ"), re.compile(
        rf"(?m)^[ \t]*(?:С уважением[,;:]?[ \t]*\n+[ \t]*(?P<ru>{_CYRILLIC_NAME})|(?:此致|敬具)[,;:]?[ \t]*\n+[ \t]*(?P<han>{_HAN}{{2,5}}(?:[ \u3000・·]{_HAN}{{1,6}})?)"
        rf"|सादर[,;:]?[ \t]*\n+[ \t]*(?P<hi>{_HINDI}(?: {_HINDI}){{0,3}})|ด้วยความเคารพ[,;:]?[ \t]*\n+[ \t]*(?P<th>[\u0e01-\u0e4e]+(?: [\u0e01-\u0e4e]+){{0,2}}))[ \t]*$"
    )),
]


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Addresses from their at signs on, so that long runs of letters cost nothing."""
    done = 0
    at = t.find("@")
    while at >= 0:
        if at > done and t[at - 1] in _LOCAL and t[at - 1] != "." and (host := _HOST.match(t, at + 1)):
            start = at
            while start > done and t[start - 1] in _LOCAL:
                start -= 1
            while t[start] in ".%+-":
                start += 1
            yield start, host.end()
            done = host.end()
        at = t.find("@", max(at + 1, done))


def _streets(t: str) -> Iterator[tuple[int, int]]:
    for hint, form in zip(_STREET_HINT, _STREET):
        if hint.search(t):
            for m in form.finditer(t):
                yield m.start(), m.end()


def _numbers(t: str) -> Iterator[tuple[str, int, int]]:
    """Phones and identity numbers among the runs of digits."""
    for c in _DIGITS.finditer(t):
        if sum(map(str.isdigit, c.group())) < 7:
            continue
        # a number may end in a bracket behind the run, and what follows is looked at by two characters
        until = c.end() + 4
        for m in _IDENTITY.finditer(t, c.start(), until):
            if not _THING.search(t, max(0, m.start() - 24), m.start()) and not _DIALLED.search(t, max(0, m.start() - 5), m.start()):
                yield "identity_number", m.start(), m.end()
        for m in _PHONE.finditer(t, c.start(), until):
            if 7 <= sum(map(str.isdigit, m.group())) <= 15 and not _THING.search(t, max(0, m.start() - 24), m.start()):
                yield "phone", m.start(), m.end()
    if not _SIX.search(t):
        return
    for m in _LETTERED.finditer(t):
        before = max(0, m.start() - 30)
        if m.group(1):
            number = int(m.group(1).translate(str.maketrans("XYZ", "012")))
            good = _CONTROL[number % 23] == m.group(2) and not _THING.search(t, before, m.start())
        else:
            good = bool(_ID_LABEL.search(t, before, m.start()))
        if good:
            yield "identity_number", m.start(), m.end()


def _person(t: str, start: int, end: int) -> bool:
    """Whether a capitalised sequence can be a person: no word of a thing or place, and no word that begins sentences."""
    return not _THINGS.search(t, start, end) and not _OPENS.match(t, start, end) and not _TITLE_FIRST.match(t, start, end)


def _names(t: str) -> Iterator[tuple[int, int]]:
    for last, (kind, size) in _cues().iter(t):
        end, start = last + 1, last + 1 - size
        if t[end : end + 1].isalnum() and kind != "label" or kind == "after" and start and t[start - 1].isalnum():
            continue
        if kind == "before":
            m = _SUBJECT.search(t[max(0, start - _SUBJECT_REACH) : start])
            if m:
                base = max(0, start - _SUBJECT_REACH)
                spans = [(base + m.start(k), base + m.end(k)) for k in (1, 2) if m.group(k)]
                # before a French verb M. is a title, elsewhere an initial
                french = t.startswith((" a ", " ont ", " habite"), start)
                if all(_person(t, *x) and not (french and t.startswith("M. ", x[0])) for x in spans):
                    yield from spans
            continue
        m = (_AFTER if kind == "after" else _AFTER_LABEL).match(t, end)
        if m and _person(t, *m.span(1)):
            yield m.span(1)
    for m in _TITLED.finditer(t):
        if not m.start() or not t[m.start() - 1].isalnum():
            yield m.span(2)
    if any(h in t for h in _LOUD_HINTS):
        for m in _LOUD.finditer(t):
            if not m.start() or not t[m.start() - 1].isalnum():
                yield m.span(1)
    if "M. " in t:
        for m in _MONSIEUR.finditer(t):
            yield m.span(1)
    if "\n" in t:
        for m in _CLOSING.finditer(t):
            yield m.span(1)
    if not t.isascii():
        for hints, form in _NATIVE:
            if any(h in t for h in hints):
                for m in form.finditer(t):
                    yield m.span(m.lastindex)


def find_items(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in source positions, in order of start, without overlaps."""
    if not text:
        return []
    n = Normalised(text)
    t = n.text
    found = [(0, a, b) for a, b in _streets(t)] + [(1, a, b) for a, b in _emails(t)]
    found += [(KINDS.index(k), a, b) for k, a, b in _numbers(t)] + [(4, a, b) for a, b in _names(t)]
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for kind, a, b in sorted(set(found), key=lambda x: (x[0], x[1], -x[2])):
        k = bisect_left(starts, a)
        if (k == len(starts) or starts[k] >= b) and (not k or ends[k - 1] <= a):
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((KINDS[kind], *n.span(a, b)))
    return sorted(out, key=lambda x: x[1])


def redact(text: str | None) -> str | None:
    """The text with typed placeholders."""
    if not text:
        return text
    parts, done = [], 0
    for kind, a, b in find_items(text):
        parts += [text[done:a], PLACEHOLDERS[kind]]
        done = b
    return "".join(parts) + text[done:]


def items(rows: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, kind, start_char, end_char), a row an item; map-side up to the narrow removal of repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, s in enumerate(strings(batch.column(1))):
                for kind, a, b in find_items(s):
                    at.append(i)
                    kinds.append(kind)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "kind", "start_char", "end_char"])

    schema = rows.select(key, F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("start_char"), F.lit(0).cast("bigint").alias("end_char")).schema
    return map_arrow(spread(rows.select(key, text)), run, schema).distinct()


def redacted(rows: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, text, has_email) with placeholders in the text; a row an input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [redact(s) for s in strings(batch.column(1))]
            mail = [None if s is None else PLACEHOLDERS["email"] in s for s in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(mail, pa.bool_())], names=[key, text, "has_email"])

    schema = rows.select(key, text, F.lit(True).alias("has_email")).schema
    return map_arrow(spread(rows.select(key, text)), run, schema)
