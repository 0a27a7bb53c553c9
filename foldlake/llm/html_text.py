"""Main text of web pages by two passes of block rules.

A page is read as a sequence of text blocks. Blocks of elements that never hold the article (menus, footers, forms, and
what classes, ids or roles name so) are left out. Where the page marks its article, blocks outside it are left out too.
The first pass classifies each remaining block by its length, link density and stop-word density. The second settles
ambiguous blocks, most of them short, by their nearest decided neighbours, those of the same element first. Where the page's language or a block's script
has no list of stop words, length and link density alone classify.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# ---------------------------------------------------------------- fixed values

#: Frequent words, by language.
STOP_WORDS = {
    "en": "a about all also an and are as at be been but by can could do for from had has have he her his if in into is it its more no not of on one "
          "or other our she so some than that the their them then there these they this to was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr im in ist kann mit "
          "nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur",
    "fr": "à au aussi aux avec ce ces cette comme dans de des du elle en est et être eux il ils je la le les leur lui mais ne nous on ont ou où par pas "
          "plus pour qu que qui sa sans se ses si son sont sur tout un une vous y",
    "es": "a al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta la las le lo los más me muy no nos o para pero por "
          "porque que se ser si sin sobre son su sus también un una y ya",
    "it": "a al alla anche che chi come con da dal dei del della di e gli ha i il in io la le lo ma nel non o per più quando se si sono su un una",
    "pt": "a ao aos as com como da das de do dos e ela em entre era essa esta eu foi já mais mas na não nas no nos o os ou para pela pelo por quando que se sem ser seu sua um uma",
    "nl": "aan als bij dat de den der deze die dit door een en er het hij ik in is maar met naar niet nog of om onder ook op over te tot uit van voor was wat we werd wie zij zijn",
}

#: Elements whose text is no page text at all.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video select textarea datalist head title map applet embed".split())
#: Their content is not markup; it ends at the first end tag of the same name.
RAW = frozenset("script style template noscript iframe textarea title svg math select object canvas audio video".split())
#: Elements that never hold the article.
OUTSIDE = frozenset("nav footer aside form menu dialog button address".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "wbr img br input".split())
#: Elements whose text has few stop words in any language: code, tables, lists.
FORMS = frozenset("pre li td th dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of classes, ids and roles that name what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr "
    "notice notices notification notifications alert alerts disclaimer newsletter subscribe subscription signup sidebar sidebars aside menu menus nav navbar "
    "navigation navigational breadcrumb breadcrumbs footer footers foot masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion related "
    "recommended recommendations share sharing social socials popup modal overlay lightbox widget widgets pagination pager paging tags tagcloud login "
    "search searchbox skip copyright legal outbrain taboola complementary contentinfo dialog form hidden".split())
#: Names of the page's header; they are also used of the article's own.
HEADER_NAMES = frozenset("header headers".split())
#: Names that, beside another word, only say where an element stands or what it lacks.
QUALIFIED = re.compile(r"(?:^|[\s_-])(?:has|no|with|without|is|not)[-_][\w-]*", re.ASCII)
#: Beginnings of names that mean the same when words are run together.
BEGINNINGS = ("cookie", "newsletter", "advert", "sponsor", "sidebar", "breadcrumb", "disqus", "paywall", "popup", "navbar")

LONG, SHORT = 200, 70  # characters
STOP_HIGH, STOP_LOW, LINKS = 0.30, 0.15, 0.5

# ---------------------------------------------------------------- blocks

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:--!?>|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    heading: bool
    region: int  # number of the article it lies in, 0 outside
    form: bool = False  # code, or a part of a table or list
    parent: int = 0  # number of the element that holds the block's paragraph


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


def _names(attributes: dict[str, str]) -> set[str]:
    named = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
    if not named.strip():
        return set()
    return {w.lower() for w in _NAME.findall(_CAMEL.sub(" ", QUALIFIED.sub(" ", named)))}


class _Reader:
    """Turns tags and text into blocks."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, int, bool, int]] = []  # element, is outside, article, is the article's header, number
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.articles = self.elements = 0

    def state(self) -> tuple[bool, int, bool]:
        return self.open[-1][1:4] if self.open else (False, 0, False)

    def text(self, source: str) -> None:
        if not self.state()[0]:
            self.parts.append(source)
            if self.links:
                self.linked += len("".join(source.split()))

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            outside, region, header = self.state()
            heading = any(e[0] in HEADINGS for e in self.open)
            if text and not outside and (heading or not header):
                holder = next((e[4] for e in reversed(self.open) if e[0] not in INLINE and e[0] != "p" and e[0] not in HEADINGS), 0)
                self.blocks.append(Block(text, self.linked, heading, region, any(e[0] in FORMS for e in self.open), holder))
        self.parts, self.linked = [], 0

    def start(self, tag: str, source: str) -> None:
        if tag not in INLINE:
            self.end_block()
            if tag in ("p", *HEADINGS, "div", "ul", "ol", "table", "section", "article", "blockquote", "pre", "form", "hr", "nav", "aside", "footer", "header", "main", "dl"):
                self._close_paragraph()
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close_item(tag)
        if tag in ("br", "img"):
            self.parts.append(" ")
        if tag in VOID:
            return
        attributes = _attributes(source)
        names = _names(attributes)
        outside, region, header = self.state()
        if tag not in ("html", "body"):
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""))
            is_article = tag == "article" or tag == "main" or "main" == attributes.get("role") or "articleBody" in attributes.get("itemprop", "")
            bad = tag in OUTSIDE or bool(names & NAMES) or any(n.startswith(BEGINNINGS) for n in names)
            if is_article and tag != "article":  # what is marked as the main part is it, whatever stands around
                outside, bad = False, bool(names & {"comment", "comments"})
            outside = outside or bool(hidden) or bad
            if not outside and (tag == "header" or names & HEADER_NAMES and tag not in HEADINGS and not is_article):
                outside, header = (False, True) if region else (True, header)
            if is_article and not outside and not region:
                self.articles += 1
                region = self.articles
        if tag == "a":
            self.links += 1
        self.elements += 1
        self.open.append((tag, outside, region, header, self.elements))

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_block()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return  # an inline end tag closes nothing around its block

    def _pop(self, k: int) -> None:
        self.links -= sum(e[0] == "a" for e in self.open[k:])
        del self.open[k:]

    def _close_paragraph(self) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "p":
                self._pop(k)
                return
            if self.open[k][0] not in INLINE:
                return

    def _close_item(self, tag: str) -> None:
        rivals = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in rivals:
                self._pop(k)
                return
            if self.open[k][0] not in INLINE and self.open[k][0] != "p" and not (tag == "tr" and self.open[k][0] in ("td", "th")):
                return


def blocks(html: str) -> list[Block]:
    """Text blocks of a whole page in page order, without those of elements that never hold the article."""
    reader, at = _Reader(), 0
    lowered = None
    while True:
        match = _TOKEN.search(html, at)
        if match is None:
            break
        if match.start() > at:
            reader.text(html[at:match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        closing, source = match[1] or match[4], match[3] or match[6] or ""
        if closing:
            if tag not in VOID and tag not in SILENT:
                reader.end(tag)
        elif tag in RAW:
            if not source.endswith("/"):
                lowered = html.lower() if lowered is None else lowered
                if len(lowered) != len(html):  # lower-casing moved places
                    found = re.compile(rf"</{tag}", re.IGNORECASE).search(html, at)
                    end = found.start() if found else -1
                else:
                    end = lowered.find(f"</{tag}", at)
                if end < 0 and tag in ("script", "style", "textarea", "title"):
                    end = len(html)
                if end >= 0:
                    close = html.find(">", end)
                    at = close + 1 if close >= 0 else len(html)
        elif tag not in SILENT:
            reader.start(tag, source)
    if at < len(html):
        reader.text(html[at:])
    reader.end_block()
    return reader.blocks


# ---------------------------------------------------------------- rules

_WORD = re.compile(r"\w+")
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_LETTER = re.compile(r"[^\W\d_]")
_LATIN = re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
#: Ideographs and kana; one holds about as much as three Latin letters.
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
GOOD, NEAR, OPEN, SPARSE, BAD = "good", "near", "open", "sparse", "bad"


def _unlisted_script(text: str) -> bool:
    return not text.isascii() and 2 * len(_LATIN.findall(text)) < len(_LETTER.findall(text))


def classify(found: list[Block]) -> list[bool]:
    """Which of the blocks belong to the main text."""
    words = [_WORD.findall(b.text.lower()) for b in found]
    every = [w for ws in words for w in ws]
    stops = max(_STOPS.values(), key=lambda s: sum(w in s for w in every))
    sizes = [len(b.text) if b.text.isascii() else len(b.text) + 2 * len(_WIDE.findall(b.text)) for b in found]
    densities = [sum(w in stops for w in ws) / max(1, len(ws)) for ws in words]
    linked = [b.linked > LINKS * len(b.text.replace(" ", "")) for b in found]
    scripts = [_unlisted_script(b.text) for b in found]
    prose = [k for k, b in enumerate(found) if sizes[k] >= SHORT and not linked[k] and not b.form]
    # of the prose in scripts that have lists: whether its language has one too
    known = [k for k in prose if not scripts[k]]
    listed = any(densities[k] >= STOP_HIGH for k in known) or (
        sum(densities[k] * len(words[k]) for k in known) >= STOP_LOW * max(1, sum(len(words[k]) for k in known)))
    main_script = 2 * sum(sizes[k] for k in prose if scripts[k]) > sum(sizes[k] for k in prose)
    kinds = []
    for block, size, density, by_links, script in zip(found, sizes, densities, linked, scripts):
        if by_links:
            kinds.append(BAD)
        elif size < SHORT:
            kinds.append(BAD if block.linked and not block.region else OPEN)
        elif "©" in block.text and size < LONG and not block.region:
            kinds.append(BAD)
        elif density >= STOP_HIGH:
            kinds.append(GOOD if size > LONG else NEAR)
        elif density >= STOP_LOW:
            kinds.append(NEAR)
        elif block.region:  # the page says that it is part of the article
            kinds.append(OPEN)
        elif script:
            kinds.append(GOOD if main_script and size > LONG else NEAR)
        elif not listed:
            kinds.append(NEAR)
        else:  # prose of a listed language would have stop words
            kinds.append(OPEN if block.form else SPARSE)
    if GOOD not in kinds:  # a page of short paragraphs: the next best ones decide
        best = NEAR if NEAR in kinds else OPEN if BAD not in kinds and SPARSE not in kinds else GOOD
        kinds = [GOOD if kind == best else kind for kind in kinds]
    return [_settled(found, kinds, k) for k in range(len(found))]


def _settled(found: list[Block], kinds: list[str], k: int) -> bool:
    """The second pass for block ``k``. The border of a marked article counts as good, that of a page as bad."""
    kind, marked = kinds[k], found[k].region > 0
    if kind in (GOOD, BAD):
        return kind == GOOD
    sides, siblings = [], []
    for step in (-1, 1):
        j = k + step
        while 0 <= j < len(kinds) and kinds[j] not in (GOOD, BAD):
            j += step
        inside = 0 <= j < len(kinds)
        sides.append(kinds[j] == GOOD if inside else marked)
        if inside and found[j].parent == found[k].parent:
            siblings.append(kinds[j] == GOOD)
    if marked or kind == NEAR:
        return any(sides)
    if siblings and all(siblings) and not found[k].linked and not found[k].form:
        return True  # a paragraph of the element whose other paragraphs are good
    if kind == SPARSE:
        return all(sides)
    if found[k].heading:
        return sides[1]
    return all(sides) or any(sides) and not found[k].linked and _beside(kinds, k)


def _beside(kinds: list[str], k: int) -> bool:
    """Between a good and a bad neighbour: the good one is next to it, or only near-good ones are between."""
    for step in (-1, 1):
        j = k + step
        while 0 <= j < len(kinds) and kinds[j] == NEAR:
            j += step
        if 0 <= j < len(kinds) and kinds[j] == GOOD:
            return True
    return False


def main_text(html: str) -> str:
    """The main text of one page: its kept blocks joined by a space."""
    if not html:
        return ""
    found = blocks(html)
    if any(b.region for b in found):
        found = [b for b in found if b.region]
    return " ".join(b.text for b, keep in zip(found, classify(found)) if keep) if found else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages`` (page_id, url, html).

    A null or empty page, or one without main text, has the empty text. Null and repeated ids are rows like any other;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
