"""Facts of a web page, one row a page, from a tolerant streaming parser.

Pages are read within ``Limits``, each of which can be lifted (None); ``cut`` names those that a
page ran into. The parser takes time in proportion to the page, and no clock decides on a row unless
``seconds`` is given. A page that fails gives a row with status 'error', never a failed task.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Limits:
    """What of a page is looked at, at most."""

    chars: int | None = 1_500_000
    elements: int | None = 120_000
    depth: int | None = 256
    links: int | None = 5_000
    text: int | None = 400_000
    seconds: float | None = None


#: What carries no text, what starts a line, what frames a page.
SILENT = {"script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "textarea", "option", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul", "option", "title"}
FRAME = {"nav", "header", "footer", "aside"}
SOCIAL = {"facebook.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com", "t.me", "viber.com", "whatsapp.com", "google.com"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?![.\d])|opacity\s*:\s*0(?![.\d])", re.I)
_WORD = re.compile(r"[^\W_]+")
class _Either:
    """A pattern, and what of it can stand in a text of ASCII characters (None: nothing)."""

    def __init__(self, whole: str, ascii_only: str | None):
        self.whole, self.ascii_only = re.compile(whole, re.I), re.compile(ascii_only or r"(?!)", re.I)

    def search(self, text: str) -> re.Match | None:
        return (self.ascii_only if text.isascii() else self.whole).search(text)

    def finditer(self, text: str) -> Iterator[re.Match]:
        return (self.ascii_only if text.isascii() else self.whole).finditer(text)


#: Patterns by which texts are told to be a call, a price, a number to call and so on.
_FAQ = re.compile(r"\bfaq\b|frequently asked|често\s+задавани|въпроси и отговори|f\.a\.q", re.I)
_CTA = _Either(
    r"поръч|заяви|заявка|свържи|свържете|запитване|оферт|консултаци|безплатн|започн|разбер|виж\s+цен|изпрат|обади|звънни|купи|регистр|пробв|демо|contact|get\s+(?:a\s+)?(?:quote|started)|request|order|buy|book|free\s+(?:quote|consult)|call\s+us|start\s+now",
    r"contact|get\s+(?:a\s+)?(?:quote|started)|request|order|buy|book|free\s+(?:quote|consult)|call\s+us|start\s+now",
)
_PROOF = _Either(r"доволн[иа]|клиент|отзив|препоръ|проект|портфолио|референци|рейтинг|оценк|testimonial|case\s+study|★|⭐", r"testimonial|case\s+study")
_WORK = re.compile(r"портфолио|проекти|референци|клиент|отзив|case|работи|примери|portfolio|testimonial", re.I)
_PRICE = _Either(r"(?:от\s+)?\d[\d\s.,]{0,8}\s?(?:лв\.?|лева|bgn|eur|евро|€|usd|\$)(?:\s?(?:/|на)\s?(?:месец|мес\.?|година|час))?", r"\d[\d\s.,]{0,8}\s?(?:bgn|eur|usd|\$)")
_PRICE_WORD = _Either(r"\b(?:ценова\s+листа|ценообразуване|цени|цената|цена|pricing|price)\b", r"\b(?:pricing|price)\b")
_PHONE = re.compile(r"(?<![\w.])(?:\+|00|0)\d[\d\s().-]{6,16}\d")
_EMAIL = re.compile(r"[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,8}\.[a-z]{2,24}", re.I)
_ABOUT = _Either(r"за\s+нас|кои\s+сме|екип|about|team|компания", "about|team")
_ADDRESS = _Either(r"\b(?:ул|бул|гр|пл|ж\.к|жк)\.\s?\w", None)
_REGISTRATION = _Either(r"\b(?:ЕИК|булстат|ддс\s*(?:номер|№)|vat\s*(?:number|no)?)\b|(?-i:\b(?:ЕООД|ООД|АД|ЕТ)\b)", r"\bvat\s*(?:number|no)?\b")
_BANNER, _CONSENT, BANNER_CHARS = re.compile("cookie", re.I), re.compile("consent|gdpr", re.I), 800
_YEAR = re.compile(r"(?<!\d)20[0-3]\d(?!\d)")
_BYLINE, _BY = re.compile(r"\bauthor\b|\bbyline\b|\bpost-author\b", re.I), _Either(r"\bавтор\s*:", None)
_FILE, _PAID, _WWW = re.compile(r"\.(?:png|jpe?g|gif|webp|svg)$", re.I), re.compile("sponsored|ugc"), re.compile(r"^www\d?\.")
_NO_DIGIT, _SLASHES, _SCHEME_WWW = re.compile(r"\D"), re.compile(r"/+(?=$|\?)"), re.compile(r"^(https?://)www\.")
#: A start tag that reads the same wherever it stands: quotes are closed in it, and nothing in it ends or begins another tag.
_PLAIN_TAG = re.compile(r"""<[a-zA-Z][a-zA-Z0-9]*(?:[ \t\r\n]+[a-zA-Z][a-zA-Z0-9_:.-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`/]+))?)*[ \t\r\n]*>""")
_PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
#: Links whose host needs no resolving: whole web addresses of plain hosts, and plain paths.
_WHOLE_LINK, _PATH_LINK = re.compile(r"https?://([a-zA-Z0-9.-]+)(?=[/?#]|$)[!-~]*"), re.compile(r"/(?:[a-zA-Z0-9._~%+-][a-zA-Z0-9._~%+/?&=#-]*)?")
_DATE = re.compile(r"^(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.\d{1,9})?)?\s*(Z|[+-]\d\d:?\d\d)?)?$")
_QUESTION = re.compile(r"\?\s*$|^(?:how|what|why|when|where|which|who|can|should|is|are|do|does|как|какво|кой|кога|къде|колко|защо)\b", re.I)

HEADING = pa.struct([("level", pa.int32()), ("text", pa.string())])
FACTS = pa.struct(
    [(n, pa.string()) for n in ("status", "title", "description", "canonical", "lang", "intro", "middle", "modified_at", "published_at")]
    + [(n, pa.bool_()) for n in ("canonical_self", "noindex", "viewport", "https", "faq_schema", "faq_section", "author", "form", "about_link", "registration", "address")]
    + [(n, pa.int64()) for n in ("words", "h1", "h2", "h3", "links_in", "links_out", "images", "images_alt", "tables", "lists", "phones", "emails", "external_domains", "latest_year")]
    + [(n, pa.list_(pa.string())) for n in ("schema_types", "faq_questions", "cta", "nav", "prices", "proof", "hosts", "work", "cut")]
    + [("headings", pa.list_(HEADING))]
)


def parse_date(text: str | None, now: datetime) -> datetime | None:
    """A strict ISO date from 1995 to a day from now; without a zone it is UTC."""
    m = _DATE.match((text or "").strip())
    if not m:
        return None
    try:
        at = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), tzinfo=timezone.utc)
    except ValueError:
        return None
    if m[7] and m[7] != "Z":
        sign = 1 if m[7][0] == "+" else -1
        at -= sign * timedelta(hours=int(m[7][1:3]), minutes=int(m[7][-2:]))
    return at if datetime(1995, 1, 1, tzinfo=timezone.utc) <= at <= now + timedelta(days=1) else None


class _Tag:
    """What a start tag says by itself, whatever page it stands in."""

    __slots__ = ("name", "a", "hidden", "frame", "block", "void", "byline", "cdata", "banner", "kind", "simple")

    def __init__(self, name: str, attrs: list[tuple[str, str | None]]):
        a = {k: v or "" for k, v in attrs}
        self.name, self.a = name, a
        self.hidden = name in SILENT or "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))
        self.frame = name in FRAME or a.get("role") in ("navigation", "banner", "contentinfo", "complementary")
        self.block, self.void, self.cdata = name in BLOCK, name in VOID, name in HTMLParser.CDATA_CONTENT_ELEMENTS
        self.byline = a.get("rel") == "author" or a.get("itemprop") == "author" or bool(_BYLINE.search(a.get("class", "")))
        named = f"{a.get('id', '')} {a.get('class', '')}"
        self.banner = bool(name in ("div", "section", "aside") and _BANNER.search(named) or name == "div" and _CONSENT.search(named))
        self.kind = "main" if name == "main" or a.get("role") == "main" else "article" if name == "article" else None
        self.simple = name not in _TOLD and "itemtype" not in a


#: Names of tags that more is told by than where lines, frames and hidden parts begin.
_TOLD = {"html", "meta", "link", "base", "img", "time", "h1", "h2", "h3", "h4", "a", "script", "form", "textarea", "input", "table", "tr", "td", "th", "ul", "ol", "li"}
#: Start tags by their source, met before in this process: at most so many, none longer than that.
_TAGS: dict[str, _Tag] = {}
TAGS_KEPT, TAG_CHARS = 8192, 200


class _Page(HTMLParser):
    """Collects what the facts are made of, in one pass.

    Plain tags and texts are told apart here; whatever else a page has is left to the parser of the standard library."""

    def __init__(self, limits: Limits):
        super().__init__(convert_charrefs=True)
        self.limits, self.seen, self.cut = limits, 0, set()
        self.deadline = None if limits.seconds is None else time.monotonic() + limits.seconds
        self.stack: list[tuple[str, bool, bool]] = []  # name, hidden, in a frame
        self.lines: dict[str, list[str]] = {"body": [""], "all": [""]}
        self.meta: dict[str, str] = {}
        self.root_lang = self.canonical = self.base = None
        self.title, self.heads, self.head = [], [], None
        self.links, self.ld, self.catch = [], [], None
        self.images = self.alts = self.tables = self.lists = 0
        self.form = self.byline = False
        self.ctas, self.times, self.types = [], [], []
        self.open_tables: list[list[int]] = []  # rows, cells of the first
        self.open_lists: list[int] = []  # items
        self.open_form: list | None = None  # a search form, text fields, text areas
        self.roots: dict[str, list[tuple[int, int]]] = {"main": [], "article": []}
        self.open_roots: list[tuple[str, int, int]] = []  # kind, depth in the stack, first line
        self.banner: tuple | None = None
        self.learn: str | None = None  # the source of a plain start tag that is being read

    def _state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def _mark(self) -> tuple:
        return {k: (len(x), x[-1]) for k, x in self.lines.items()}, len(self.heads), len(self.links), len(self.ctas)

    def _undo(self, mark: tuple) -> None:
        """Forget what came since ``mark``."""
        at, heads, links, ctas = mark
        for k, (n, last) in at.items():
            self.lines[k][n - 1 :] = [last]
        del self.heads[heads:], self.links[links:], self.ctas[ctas:]

    def updatepos(self, i, j):
        return j  # nothing asks for lines and columns

    def goahead(self, end):
        raw = self.rawdata
        i, n, find, startswith = 0, len(raw), raw.find, raw.startswith
        while i < n:
            if self.cdata_elem is not None:
                if self.cdata_elem not in ("script", "style") or not (m := self.interesting.search(raw, i)):
                    break
                if i < (j := m.start()):
                    self.handle_data(raw[i:j])
                k = self.parse_endtag(j)
            else:
                j = find("<", i)
                if j < 0:
                    break
                if i < j:
                    data = raw[i:j]
                    self.handle_data(unescape(data) if "&" in data else data)
                after = raw[j + 1 : j + 2]
                if after == "/":
                    if m := _PLAIN_END.match(raw, j):
                        self.handle_endtag(m[1].lower())
                        k = m.end()
                    else:
                        k = self.parse_endtag(j)
                elif after.isascii() and after.isalpha():
                    k = self._starttag(j, find(">", j) + 1)
                elif startswith("<!--", j):
                    k = self.parse_comment(j)
                elif after == "?":
                    k = self.parse_pi(j)
                elif after == "!":
                    k = self.parse_html_declaration(j)
                else:
                    k = -1
            if k < 0:
                i = j
                break
            i = k
        # what is open at the end, and what no step above takes
        self.rawdata = raw[i:]
        super().goahead(end)

    def _starttag(self, i: int, end: int) -> int:
        source = self.rawdata[i:end] if 0 < end <= i + TAG_CHARS else ""
        tag = _TAGS.get(source)
        if tag is None:
            self.learn = source if source and _PLAIN_TAG.fullmatch(source) else None
            return self.parse_starttag(i)
        self.lasttag = tag.name
        self._open(tag)
        if tag.cdata:
            self.set_cdata_mode(tag.name)
        return end

    def handle_starttag(self, tag, attrs):
        made = _Tag(tag, attrs)
        if self.learn is not None:
            if len(_TAGS) >= TAGS_KEPT:
                _TAGS.clear()
            _TAGS[self.learn] = made
            self.learn = None
        self._open(made)

    def _open(self, t: _Tag) -> None:
        self.seen += 1
        if self.limits.elements is not None and self.seen > self.limits.elements:
            raise _Enough("elements")
        if self.deadline is not None and self.seen % 512 == 0 and time.monotonic() > self.deadline:
            raise _Enough("seconds")
        hidden, frame = self.stack[-1][1:] if self.stack else (False, False)
        hidden, frame = hidden or t.hidden, frame or t.frame
        if t.block:
            self._line()
        self.byline |= t.byline
        if not t.simple:
            self._told(t.name, t.a, hidden, frame)
        if t.void:
            return
        if self.limits.depth is not None and len(self.stack) >= self.limits.depth:
            self.cut.add("depth")
            return
        if self.banner is None and t.banner:
            self.banner = (len(self.stack), self._mark())
        elif self.banner is not None and t.name in ("main", "article", "h1"):
            self.banner = None  # a page wrapped in such a class
        if t.kind:
            self.open_roots.append((t.kind, len(self.stack), len(self.lines["all"]) - 1))
        self.stack.append((t.name, hidden, frame))

    def _told(self, tag: str, a: dict[str, str], hidden: bool, frame: bool) -> None:
        """What the page's facts take from a tag and its attributes."""
        if tag == "html":
            self.root_lang = a.get("lang", "")[:35] or None
        elif tag == "meta":
            key = (a.get("name") or a.get("property") or a.get("itemprop") or "").lower()
            if key:
                self.meta.setdefault(key, a.get("content", ""))
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = self.canonical or a.get("href")
        elif tag == "base":
            self.base = self.base or a.get("href")
        elif tag == "img":
            self.images += 1
            self.alts += bool(a.get("alt", "").strip())
        elif tag == "time" and a.get("datetime") and not frame:
            self.times.append(a["datetime"])
        self._structure(tag, a, frame)
        if "itemtype" in a:
            self.types.append(a["itemtype"].rstrip("/").rpartition("/")[2])
        if tag in ("h1", "h2", "h3", "h4") and not frame and not hidden:
            self.head = (int(tag[1]), [])
        if tag == "a" and a.get("href") is not None:
            if self.limits.links is None or len(self.links) < self.limits.links:
                self.links.append([a["href"], [], frame, a.get("rel", "")])
            else:
                self.cut.add("links")
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.catch = []

    def _structure(self, tag: str, a: dict[str, str], frame: bool) -> None:
        """Tables of two rows and columns, lists of three items, forms to write to someone."""
        if tag == "form":
            self.open_form = [a.get("role") == "search", 0, 0]
        elif self.open_form and tag == "textarea":
            self.open_form[2] += 1
        elif self.open_form and tag == "input":
            kind = a.get("type", "text").lower() or "text"
            self.open_form[0] |= kind == "search"
            self.open_form[1] += kind not in ("hidden", "submit", "button", "checkbox", "radio", "search")
        if frame:
            return
        if tag == "table":
            self.open_tables.append([0, 0])
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1][0] += 1
        elif tag in ("td", "th") and self.open_tables and self.open_tables[-1][0] == 1:
            self.open_tables[-1][1] += 1
        elif tag in ("ul", "ol"):
            self.open_lists.append(0)
        elif tag == "li" and self.open_lists:
            self.open_lists[-1] += 1

    def _line(self):
        for x in self.lines.values():
            if x[-1]:
                x.append("")

    def _close_structure(self, tag: str) -> None:
        if tag == "table" and self.open_tables:
            rows, cells = self.open_tables.pop()
            self.tables += rows >= 2 and cells >= 2
        elif tag in ("ul", "ol") and self.open_lists:
            self.lists += self.open_lists.pop() >= 3
        elif tag == "form" and self.open_form:
            search, fields, areas = self.open_form
            self.form |= not search and (areas > 0 or fields >= 3)
            self.open_form = None

    def handle_endtag(self, tag):
        if tag == "script" and self.catch is not None:
            self.ld.append("".join(self.catch))
            self.catch = None
        if self.head and tag == f"h{self.head[0]}":
            self._heading()
        if tag in BLOCK:
            self._line()
        self._close_structure(tag)
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 40), -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        self._leave()

    def _leave(self) -> None:
        """Roots and banners whose element has been closed."""
        while self.open_roots and self.open_roots[-1][1] >= len(self.stack):
            kind, _, first = self.open_roots.pop()
            # the line that has just been begun is of what comes after
            self.roots[kind].append((first, len(self.lines["all"]) - (self.lines["all"][-1] == "")))
        if self.banner is not None and self.banner[0] >= len(self.stack):
            mark, self.banner = self.banner[1], None
            n, last = mark[0]["all"]
            if len("".join(self.lines["all"][n - 1 :])) - len(last) <= BANNER_CHARS:
                self._undo(mark)

    def _heading(self) -> None:
        text = " ".join("".join(self.head[1]).split())
        if 0 < len(text) <= 200 and (not self.heads or self.heads[-1] != (self.head[0], text)) and len(self.heads) < 60:
            self.heads.append((self.head[0], text))
        self.head = None

    def finish(self) -> None:
        """What a page leaves open ends with it."""
        if self.head:
            self._heading()
        for tag, some in (("table", self.open_tables), ("ul", self.open_lists)):
            while some:
                self._close_structure(tag)
        self._close_structure("form")
        self.stack.clear()
        self._leave()

    def root(self) -> list[str]:
        """Lines of the main part, of the longest article, or of the body without its frame."""
        tidy = lambda some: [" ".join(x.split()) for x in some if x.strip()]
        size = lambda some: sum(map(len, some))
        for a, b in sorted(self.roots["main"])[:1]:
            if size(tidy(self.lines["all"][a:b])) >= 300:
                return tidy(self.lines["all"][a:b])
        best = max((tidy(self.lines["all"][a:b]) for a, b in sorted(self.roots["article"])), key=size, default=[])
        return best if size(best) >= 600 else tidy(self.lines["body"])

    def handle_data(self, data):
        if self.catch is not None:
            self.catch.append(data)
            return
        hidden, frame = self._state()
        names = [s[0] for s in self.stack[-6:]]
        if "title" in names[-3:]:
            self.title.append(data)
            return
        if hidden:
            return
        if self.head:
            self.head[1].append(data)
        if self.links and "a" in names:
            self.links[-1][1].append(data)
        if "button" in names[-3:] and _CTA.search(data):
            self.ctas.append(data)
        self.lines["all"][-1] += data
        if not frame:
            self.lines["body"][-1] += data


class _Enough(Exception):
    """A limit that ends the reading of a page."""


def _around(text: str, pattern: _Either, radius: int, most: int) -> list[str]:
    """Short pieces around what matches, apart from one another, cut at blanks, each once."""
    out: dict[str, str] = {}
    done = -1
    for m in pattern.finditer(text):
        if len(out) >= most:
            break
        if m.start() < done:
            continue
        lo, hi = max(0, m.start() - radius), min(len(text), m.end() + radius)
        if lo and not text[lo - 1].isspace() and (blank := text.find(" ", lo, m.start())) >= 0:
            lo = blank + 1
        if hi < len(text) and not text[hi - 1].isspace() and (blank := text.rfind(" ", m.end(), hi)) > m.end():
            hi = blank
        done = hi
        piece = " ".join(text[lo:hi].split())
        out.setdefault(piece.lower(), piece)
    return list(out.values())


def _distinct(items, width: int, most: int) -> list[str]:
    out: dict[str, str] = {}
    for x in items:
        text = " ".join(x.split())
        if text and len(text) <= width:
            out.setdefault(text.lower(), text)
    return list(out.values())[:most]


def _walk_ld(scripts: list[str]) -> tuple[list[str], list[str], list[str], list[str], bool]:
    """Types, questions, modified and published dates, author, of the top level and @graph."""
    types, asked, modified, published, author = [], [], [], [], False
    for s in scripts:
        try:
            found = json.loads(s)
        except (ValueError, RecursionError):
            continue
        tops = found if isinstance(found, list) else [found]
        tops += [g for t in tops if isinstance(t, dict) for g in (t.get("@graph") if isinstance(t.get("@graph"), list) else [])]
        for t in tops:
            if not isinstance(t, dict):
                continue
            kind = t.get("@type")
            types += [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]
            modified += [x for x in [t.get("dateModified")] if isinstance(x, str)]
            published += [x for x in [t.get("datePublished")] if isinstance(x, str)]
            author |= bool(t.get("author"))
            if "FAQPage" in (kind if isinstance(kind, list) else [kind]):
                parts = t.get("mainEntity")
                asked += [q["name"] for q in (parts if isinstance(parts, list) else [parts]) if isinstance(q, dict) and isinstance(q.get("name"), str)]
    return types, asked, modified, published, author


def _site(host: str) -> str:
    return _WWW.sub("", host.lower())


class _Hosts:
    """Hosts that a page's links lead to; what is resolved by the library is told by a pattern where both agree."""

    def __init__(self, url: str, base: str | None):
        self.url, self.base, self.own, self.plain = url, base, None, False
        try:
            to = urlsplit(urljoin(url, base or ""))
            self.plain, self.own = to.scheme in ("http", "https") and bool(to.hostname), _site(to.hostname or "")
        except ValueError:
            pass

    def of(self, href: str) -> str:
        if self.plain:
            if m := _WHOLE_LINK.fullmatch(href):
                return _site(m[1])
            if _PATH_LINK.fullmatch(href):
                return self.own
        return _site(urlsplit(urljoin(urljoin(self.url, self.base or ""), href)).hostname or "")


def extract(html: str, url: str, now: datetime, limits: Limits = Limits()) -> dict:
    """The facts of FACTS for one page."""
    page = _Page(limits)
    if limits.chars is not None and len(html) > limits.chars:
        page.cut.add("chars")
    try:
        page.feed(html[: limits.chars])
        page.close()
    except _Enough as limit:
        page.cut.add(str(limit))
    page.finish()
    lines = [" ".join(x.split()) for x in page.lines["all"] if x.strip()]
    full, everything = "\n".join(page.root()), "\n".join(lines)
    if limits.text is not None and max(len(full), len(everything)) > limits.text:
        page.cut.add("text")
        full, everything = full[: limits.text], everything[: limits.text]
    own = _site(urlsplit(url).hostname or "")
    inside, outside, hosts, about, tels, mails, to_host = 0, 0, {}, False, set(), set(), _Hosts(url, page.base)
    for href, text, frame, rel in page.links:
        href = href.strip()
        if not href or href.startswith("#"):
            continue
        scheme = href.partition(":")[0].lower() if ":" in href[:12] else ""
        if scheme == "tel":
            tels.add(_NO_DIGIT.sub("", href))
        if scheme == "mailto":
            mails.add(href[7:].partition("?")[0].lower())
        if scheme in ("javascript", "mailto", "tel", "sms"):
            continue
        try:
            to = to_host.of(href)
        except ValueError:
            continue
        label = "".join(text)
        about |= bool(_ABOUT.search(f"{href} {label}"))
        if to == own:
            inside += 1
        elif to:
            outside += 1
            if not _PAID.search(rel) and ".".join(to.split(".")[-2:]) not in SOCIAL:
                hosts.setdefault(to)
    types, asked, modified, published, ld_author = _walk_ld(page.ld)
    types = list(dict.fromkeys(t for t in [*types, *page.types] if t))[:20]
    texts = [t for _, t in page.heads]
    questions = [t for t in texts if _QUESTION.search(t)]
    section = any(_FAQ.search(t) for t in texts) or len(questions) >= 3
    dates = lambda xs: [d for d in (parse_date(x, now) for x in xs) if d]
    changed = max(dates(modified), default=None) or next(iter(dates([page.meta.get("article:modified_time"), page.meta.get("og:updated_time"), page.meta.get("datemodified")])), None)
    first = min(dates(published), default=None) or next(iter(dates([page.meta.get("article:published_time"), page.meta.get("datepublished"), *page.times])), None)
    tels = {t for t in tels if len(t) >= 7} | {d for d in (_NO_DIGIT.sub("", m) for m in _PHONE.findall(everything)) if 9 <= len(d) <= 13}
    mails |= {m.lower() for m in _EMAIL.findall(everything) if not _FILE.search(m)} if "@" in everything else set()
    canonical = urljoin(url, page.canonical) if page.canonical else None
    same = lambda u: _SLASHES.sub("", _SCHEME_WWW.sub(r"\1", u.partition("#")[0].lower()))
    robots, years = page.meta.get("robots", "").lower(), [int(y) for y in _YEAR.findall(full) if int(y) <= now.year + 1]
    prices = _around(everything, _PRICE, 30, 8)
    prices += _around(everything, _PRICE_WORD, 40, 3 - len(prices)) if len(prices) < 3 else []
    iso = lambda d: d.strftime("%Y-%m-%dT%H:%M:%SZ") if d else None
    return {
        "status": "ok", "title": " ".join((" ".join(page.title) or page.meta.get("og:title", "")).split())[:300] or None, "description": " ".join(page.meta.get("description", "").split())[:500] or None,
        "canonical": canonical, "canonical_self": None if canonical is None else same(canonical) == same(url), "noindex": "noindex" in robots, "lang": page.root_lang, "viewport": "viewport" in page.meta,
        "https": url.lower().startswith("https:"), "schema_types": types, "faq_schema": any("faqpage" in t.lower() for t in types), "faq_section": section, "faq_questions": (asked or (questions if section else []))[:50],
        "headings": [{"level": h, "text": t} for h, t in page.heads], **{f"h{k}": sum(h == k for h, _ in page.heads) for k in (1, 2, 3)}, "words": len(_WORD.findall(full)), "intro": full[:1500],
        "middle": full[len(full) // 2 - 500 : len(full) // 2 + 500] if len(full) > 3000 else None, "links_in": inside, "links_out": outside, "hosts": list(hosts)[:200], "external_domains": len(hosts), "images": page.images,
        "images_alt": page.alts, "tables": page.tables, "lists": page.lists, "form": page.form, "phones": len(tels), "emails": len(mails),
        "cta": _distinct([*page.ctas, *("".join(t) for _, t, _, _ in page.links if _CTA.search("".join(t)))], 60, 10), "nav": _distinct(["".join(t) for _, t, frame, _ in page.links if frame], 40, 12),
        "prices": prices, "proof": _distinct((x for x in lines if _PROOF.search(x)), 200, 8), "work": [t for t in texts if _WORK.search(t)][:8],
        "latest_year": max(years, default=None), "modified_at": iso(changed), "published_at": iso(first), "author": ld_author or page.byline or bool(page.meta.get("author")) or bool(_BY.search(everything)), "about_link": about,
        "registration": bool(_REGISTRATION.search(everything)), "address": bool(_ADDRESS.search(everything)), "cut": sorted(page.cut),
    }


#: Pages whose facts are held as Python objects at a time; Spark's batch, up to 10,000 pages or 64 MB of them, comes in whole.
AT_ONCE = 128


def page_facts(pages: DataFrame, now: datetime, url_col: str = "url", html_col: str = "html", limits: Limits = Limits()) -> DataFrame:
    """``pages`` without the source text, with the struct ``facts``."""
    from pyspark.sql.pandas.types import from_arrow_type

    @F.arrow_udf(from_arrow_type(FACTS))
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, sources in parts:
            for at in range(0, max(1, len(urls)), AT_ONCE):
                out = []
                for u, h in zip(urls.slice(at, AT_ONCE).to_pylist(), sources.slice(at, AT_ONCE), strict=True):
                    try:
                        out.append(extract(h.as_py() or "", u or "", now, limits))
                    except Exception:  # one page's failure is a row of its own
                        out.append({"status": "error"})
                yield pa.array(out, FACTS)

    return pages.withColumn("facts", run(F.col(url_col), F.col(html_col))).drop(html_col)


def decode_html(body: bytes, header: str | None) -> str:
    """Bytes of a page by the header's character set, else the one named in its first 4 KB, else UTF-8."""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", header or "", re.I) or re.search(rb"<meta[^>]{0,300}charset\s*=\s*[\"']?([\w.:-]+)", body[:4096], re.I)
    name = named[1] if named else "utf-8"
    try:
        return body.decode(name if isinstance(name, str) else name.decode(), "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def decode_pages(pages: DataFrame, body_col: str = "body", type_col: str = "content_type") -> DataFrame:
    """``pages`` with ``html`` from a binary column: Spark's own decode lacks some character sets."""
    from pyspark.sql.types import StringType

    @F.arrow_udf(StringType())
    def run(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([None if b is None else decode_html(b, k) for b, k in zip(bodies.to_pylist(), kinds.to_pylist(), strict=True)], pa.string())

    return pages.withColumn("html", run(F.col(body_col), F.col(type_col))).drop(body_col)


class _Links(HTMLParser):
    def __init__(self, most: int | None):
        super().__init__(convert_charrefs=True)
        self.found, self.base, self.inside, self.most = [], None, 0, most

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.inside += tag == "template"
        if tag == "base" and self.base is None:
            self.base = a.get("href")
        if tag == "a" and a.get("href") and not self.inside and (self.most is None or len(self.found) < self.most):
            self.found.append(a["href"])

    def handle_endtag(self, tag):
        self.inside = max(0, self.inside - (tag == "template"))


def link_table(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int | None = 20_000, chars: int | None = 1_500_000) -> DataFrame:
    """(from_url, ordinal, to_url) of every link, resolved against the page or its base; an address that can not be resolved
    is left out by itself and keeps its place. Of a page the first ``most`` in its first ``chars`` characters (None: all)."""

    def resolved(base: str, x: str) -> str | None:
        try:
            return urljoin(base, x)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for u, h in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                parser = _Links(most)
                try:
                    parser.feed((h.as_py() or "")[:chars])
                except (ValueError, AssertionError):
                    pass  # what stands before the place that can not be read counts
                base = resolved(u or "", parser.base or "") or u or ""
                for i, x in enumerate(parser.found):
                    to_url = resolved(base, x.strip())
                    if to_url is not None:
                        for to, v in zip(out, (u, i, to_url), strict=True):
                            to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["from_url", "ordinal", "to_url"])

    return pages.select(url_col, html_col).mapInArrow(run, "from_url string, ordinal int, to_url string")
