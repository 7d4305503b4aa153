"""Main body of web pages by tree scoring over the lines of their text.

A page's text is read as a tree: the page holds regions, a region holds containers that stand
close together, and a container holds neighbouring lines of one nature (paragraphs with their
lists). Paragraphs get points for length and commas and pass them to their ancestors: whole to
their container, half to their region, a quarter to the page. Points are discounted by link
density, the share of a line's characters that sit in link-like pieces; what makes a piece
link-like is its shape (short pieces between separators, menus of capitalised words, a call to do
something on the site, a notice), of which the fixed words are one feature. The container with the
most points, its own and what its region adds, is the main body; containers beside it, in its
region or another, are kept if they have a small share of its points at least. With the body go the
lists within it, the title line right above it, and a lone line between two of its parts.

Lines are those between line feeds, numbered from 1; blank lines are neither body nor
boilerplate. A page without any paragraph keeps its lines that don't look like links.

Defined results: null and empty texts have no lines; a row id that arrives several times is
reported once; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.runtime import map_arrow, spread, strings

#: A container beside the best one is kept from this share of its score on; notices, whose links
#: take all their points, stay below it, and the last short paragraph after a sidebar doesn't.
SIBLING = 0.03
#: Characters from which a line is a paragraph whatever its end.
LONG = 110

#: Words of menus, by language; a menu entry is one of them.
MENU_WORDS = frozenset(
    w.strip()
    for w in (
        "home|about|about us|contact|contact us|help|search|sign in|log in|login|sign up|register|archive|archives|catalogue|catalog|topics|downloads|licences|licenses|news|blog|faq|sitemap|categories|tags|menu|next|previous|settings|"
        "startseite|über uns|kontakt|hilfe|suche|anmelden|registrieren|archiv|katalog|themen|lizenzen|aktuelles|einstellungen|weiter|zurück|"
        "accueil|à propos|aide|recherche|connexion|inscription|dossiers|téléchargements|catalogue|paramètres|suivant|précédent|"
        "inicio|quiénes somos|contacto|ayuda|buscar|entrar|registro|archivo|catálogo|temas|descargas|licencias|ajustes|siguiente|anterior|"
        "início|quem somos|contato|contacto|ajuda|pesquisar|arquivo|licenças|definições|"
        "главная|о нас|контакты|помощь|поиск|войти|архив|каталог|темы|загрузки|首页|关于我们|联系我们|帮助|搜索|登录|归档|目录|主题|下载|ホーム|お問い合わせ|ヘルプ|検索|ログイン"
    ).split("|")
)
#: Headings of sidebars.
SIDE_HEADINGS = re.compile(
    r"(?i)^(?:related (?:pages|posts|articles|links)|most read(?: this week)?|most popular|popular (?:tags|posts)|you may also like|recent (?:posts|comments)|see also|tags|trending|"
    r"verwandte (?:seiten|artikel)|meistgelesen|beliebte (?:stichwörter|beiträge)|das könnte (?:sie|dich) auch interessieren|auch interessant|schlagwörter|"
    r"pages voisines|les plus lus|mots-clés|articles liés|à lire aussi|vous aimerez aussi|"
    r"páginas (?:afines|relacionadas)|lo más leído|etiquetas|también le puede (?:gustar|interesar)|te puede interesar|entradas recientes|"
    r"mais lidos|leia também|artigos relacionados|похожие страницы|популярное|相关页面|热门|関連ページ)[:\s]*$"
)
#: Phrases of notices and footers.
NOTICE = re.compile(
    r"(?i)©|\(c\) \d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|todos os direitos reservados|все права защищены|版权所有|"
    r"\b(?:use|uses|using|accept|agree|usamos|utilizamos|utilisons|verwenden|setzen|aceptar|accepter|akzeptieren|nutzung|usage|uso|utilisation|использу\w+)\b[^.\n]{0,60}\bcookies?\b|\bcookies?\b[^.\n]{0,60}\b(?:accept|akzeptier\w*|accepter|acceptez|aceptar|acepta|reject|ablehnen|refuser|rechazar|zu|einverstanden)\b|"
    r"stores? small files|speichert kleine dateien|dépose de petits fichiers|guarda pequeños archivos|guarda pequenos ficheiros|"
    r"privacy matters|your privacy|ihre privatsphäre|votre vie privée|respectons votre|su privacidad|sua privacidade|without tracking|ohne tracking|sans suivi|sin rastreo|"
    r"^back to top|^nach oben|^zum seitenanfang|^haut de page|^retour en haut|^volver arriba|^voltar ao topo|"
    r"^subscribe\b|newsletter\b|s'abonner|^suscr[ií]base|^assine|boletín|^share (?:this|on)|^seite teilen|^diese seite teilen|^partager|^compartir|^compartilhar|^powered by|^betrieben mit|^propulsé par|^fait avec|^funciona con|^desarrollado con|"
    r"^(?:terms|privacy|imprint|impressum|datenschutz|mentions légales|aviso legal|nutzungsbedingungen|condiciones|conditions)\b[^.]*$"
)
#: Verbs that call to do something on a site, first in a short line; and things one does it with.
CALL = re.compile(
    r"(?i)^(?:please )?(?:follow|join|like|share|subscribe|sign up|sign in|log in|register|download|click|tap|read more|see more|show more|load more|view all|learn more|get in touch|contact us|create an? account|get the|try our|"
    r"folgen|folge|teilen|abonnieren|melden|registrieren|herunterladen|klicken|weiterlesen|mehr (?:lesen|anzeigen)|síganos|sigue|síguenos|únete|comparte|suscríbete|regístrate|descarga|haz clic|leer más|ver más|"
    r"suivez|rejoignez|partagez|abonnez|inscrivez|téléchargez|cliquez|lire la suite|voir plus|siga|junte-se|partilhe|compartilhe|subscreva|inscreva|registe|baixe|descarregue|clique|leia mais|ver mais)\b"
)
SITE = re.compile(
    r"(?i)\b(?:us|our|newsletters?|mailing list|e-?mails?|updates?|offers?|account|app|apps|social|media|facebook|twitter|instagram|youtube|linkedin|rss|feed|here|page|site|website|cookies?|friends|comments?|more|now|today|free|"
    r"uns|unser\w*|konto|hier|seite|kostenlos|jetzt|nosotros|nuestr\w+|cuenta|aquí|página|gratis|ahora|nous|notre|nos|compte|ici|gratuit\w*|maintenant|nossos?|nossas?|conta|aqui|grátis|agora|redes|sociais|sociales|sociaux|réseaux|sozialen|medien)\b"
)
#: Words of a line that may still be a call.
CALL_WORDS = 14
_SEPARATED = re.compile(r" ?[|·»•›→] ?| > | / ")
_BULLET = re.compile(r"^[ \t]*(?:[*•\-–+]|\d{1,2}[.)])[ \t]+")
_ENDS = re.compile(r"[.!?…。！？।:;][\"'”’»）)\]]*$|[.!?…。！？][\"'”’»）)\]]*$")
_SPACELESS = re.compile(r"[぀-ヿ一-鿿฀-๿]")


def _words(line: str) -> int:
    return len(line.split()) + len(_SPACELESS.findall(line)) // 2


def is_call(line: str) -> bool:
    """A short sentence or phrase that calls to do something on the site."""
    return _words(line) <= CALL_WORDS and bool(CALL.match(line)) and bool(SITE.search(line))


def link_density(line: str) -> float:
    """Share of the line in link-like pieces; 1 for menus, breadcrumbs, calls and notices."""
    if NOTICE.search(line) or SIDE_HEADINGS.match(line) or is_call(line):
        return 1.0
    bare = _BULLET.sub("", line).strip()
    if bare.lower() in MENU_WORDS:
        return 1.0
    pieces = [p for p in _SEPARATED.split(bare) if p]
    if len(pieces) > 1:
        linked = sum(len(p) for p in pieces if _words(p) <= 4)
        return linked / max(1, sum(map(len, pieces)))
    return 0.0


class Line:
    """A line with its nature and its points."""

    __slots__ = ("text", "density", "kind", "points")

    def __init__(self, text: str):
        self.text = text
        self.density = link_density(text) if text else 0.0
        bullet = bool(_BULLET.match(text))
        bare = _BULLET.sub("", text) if bullet else text
        if not text:
            self.kind = "blank"
        elif self.density > 0.5:
            self.kind = "link"
        elif bullet:
            # entries that go on like prose belong to a body; lone capitalised words to a menu
            self.kind = "item" if bare[:1].islower() or _words(bare) >= 3 or _ENDS.search(bare) else "link"
        elif len(text) >= LONG or (_ENDS.search(text) and (_words(text) >= 3 or text[-1] in "!?！？。")):
            self.kind = "paragraph"
        else:
            self.kind = "short"
        commas = sum(text.count(c) for c in ",，、،;；")
        self.points = (1 + commas + min(len(text) / 100, 3)) * (1 - self.density) if self.kind == "paragraph" else 0.0


def regions_of(containers: list[list[int]], gap: int = 2) -> list[list[int]]:
    """Numbers of the containers of every region: those with less than ``gap`` other lines between them."""
    out: list[list[int]] = []
    for k, c in enumerate(containers):
        if k and c[0] - containers[k - 1][-1] <= gap:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def boilerplate_lines(text: str | None) -> list[int]:
    """Numbers of the lines that aren't main body."""
    if not text:
        return []
    lines = [Line(s.strip()) for s in text.split("\n")]
    # containers: runs of paragraphs and items, blank lines don't part them
    containers: list[list[int]] = []
    last = None
    for i, line in enumerate(lines):
        if line.kind == "blank":
            continue
        inside = line.kind == "paragraph" or (line.kind == "item" and last == "in")
        if inside:
            if last == "in":
                containers[-1].append(i)
            else:
                containers.append([i])
        last = "in" if inside else "out"
    full = [i for i, x in enumerate(lines) if x.kind != "blank"]
    if not containers:
        return [i + 1 for i in full if lines[i].kind == "link"]
    own = [sum(lines[i].points for i in c) for c in containers]
    regions = regions_of(containers)
    passed = [sum(own[k] for k in r) / 2 for r in regions]
    page = sum(own) / 4
    score = {k: own[k] + passed[n] - own[k] / 2 + page for n, r in enumerate(regions) for k in r}
    best = max(score, key=lambda k: (score[k], -k))
    kept = {i for k, c in enumerate(containers) if k == best or own[k] >= SIBLING * own[best] for i in c}
    keep = set(kept)
    # the title stands right above the body, a heading alone between two parts of it
    before = None
    for c in containers:
        if c[0] not in kept:
            continue
        gap = [i for i in full if (before is None or i > before) and i < c[0]]
        if gap and lines[gap[-1]].kind == "short" and (before is None or len(gap) == 1):
            keep.add(gap[-1])
        before = c[-1]
    return [i + 1 for i in full if i not in keep]


def main_body(text: str | None) -> str | None:
    """The text without its boilerplate lines."""
    if not text:
        return text
    gone = set(boilerplate_lines(text))
    return "\n".join(s for i, s in enumerate(text.split("\n"), 1) if i not in gone)


def _pages(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("source").startswith("web/")).select("row_id", "text")


def boilerplate(rows: DataFrame) -> DataFrame:
    """(row_id, line_no) of the lines of web pages that aren't main body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers = [], []
            for i, s in enumerate(strings(batch.column(1))):
                found = boilerplate_lines(s)
                at += [i] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64())], names=["row_id", "line_no"])

    schema = rows.select("row_id", F.lit(0).cast("bigint").alias("line_no")).schema
    return map_arrow(spread(_pages(rows)), run, schema).distinct()


def bodies(rows: DataFrame) -> DataFrame:
    """(row_id, text, boilerplate_content, main_content): the main body, and what the page held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            out = [main_body(s) for s in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([a != b for a, b in zip(texts, out)]), pa.array([bool(s and s.strip()) for s in out])], names=["row_id", "text", "boilerplate_content", "main_content"])

    schema = rows.select("row_id", "text", F.lit(True).alias("boilerplate_content"), F.lit(True).alias("main_content")).schema
    return map_arrow(spread(_pages(rows)), run, schema)
