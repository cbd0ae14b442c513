"""Web pages as element trees and text blocks, for one page at a time. Plain Python, no Spark."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

_NAME = r"[a-zA-Z][^\s/>]*"
# A quoted value ends at the next "<" at the latest, so that a missing quote costs one tag, not the page.
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)({_NAME})((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    rf"|<(/?)({_NAME})([^<>]*+)(?:>|(?=<)|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("table caption td th html template object".split())
_ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
#: Elements that never hold an article's text.
ASIDE_TAGS = frozenset(
    "head nav footer header aside form menu script style textarea title noscript iframe noembed noframes xmp template object svg math "
    "canvas audio video button select dialog datalist map search".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark a branch as no part of the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertisements banner sponsor sponsored sponsors promo promos promotion promotions "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription "
    "signup login sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment "
    "comments commentlist respond reply replies disqus discussion social share sharing related recommended recommendations pagination pager "
    "toolbar copyright disclaimer form forms".split()
)
# End of the fixed values.


@dataclass
class Page:
    """What the site style tree needs of a page: `blocks`, its texts in page order, each with the
    ids of the branches it hangs on from the top down, its own id as content last, and whether the
    markup itself sets it aside; `shapes`, one entry per element branch: id, parent's id, depth,
    id of the set of child sequences, and whether it lies within a declared article."""

    blocks: list[tuple[list[int], str, bool]] = field(default_factory=list)
    shapes: dict[int, tuple[int, int, int, bool]] = field(default_factory=dict)


class _Element:
    __slots__ = ("tag", "sign", "parent", "aside", "named", "children", "article")

    def __init__(self, tag, sign="", parent=None, aside=False, named=False, article=False):
        self.tag, self.sign, self.parent, self.aside, self.named, self.article = tag, sign, parent, aside, named, article
        self.children: list = []


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _element(tag: str, attributes: str, parent: _Element, within: bool) -> _Element:
    """`aside`: its tag, role or visibility sets it aside; `named`: only its class or id does."""
    if not attributes.strip(" \t\r\n\f/"):
        return _Element(tag, tag, parent, tag in ASIDE_TAGS and not (within and tag == "header"), False, tag in ("article", "main"))
    found = _attributes(attributes)
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "").lower()
    words = [[w.lower() for w in _PART.findall(name)] for name in names.split()]
    article = tag in ("article", "main") or role in ("article", "main") or "articlebody" in found.get("itemprop", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    aside = bool(hidden) or role in ASIDE_ROLES or (tag in ASIDE_TAGS and not (within and tag == "header"))
    named = tag not in ("html", "body", "main") and any(
        w in ASIDE_WORDS and not (k and name[k - 1] in ("has", "no", "with", "without")) for name in words for k, w in enumerate(name)
    )
    sign = f"{tag}.{re.sub('[0-9]+', '#', ' '.join(sorted(names.split())))}" if names.strip() else tag
    return _Element(tag, sign, parent, aside, named, article)


def _tree(source: str) -> _Element:
    """The page's elements; children are elements and strings. End tags that are left out are
    added where the next tag implies them; one that nothing opened is ignored."""
    root = at = _Element("#page")
    within = 0  # open declared articles
    pos, end = 0, len(source)
    open_count: dict[str, int] = {}

    def close(to: _Element):
        nonlocal at, within
        while at is not to:
            within -= at.article
            open_count[at.tag] -= 1
            at = at.parent

    while pos < end:
        mark = source.find("<", pos)
        if mark < 0:
            at.children.append(source[pos:])
            break
        if mark > pos:
            at.children.append(source[pos:mark])
        token = _TOKEN.match(source, mark)
        if token is None:
            at.children.append("<")
            pos = mark + 1
            continue
        pos = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            continue
        if token[1] or token[4]:  # an end tag
            if open_count.get(tag):
                found, inline = at, tag not in BLOCKS
                while found.tag != tag and found is not root:
                    if (inline and found.tag in BLOCKS) or (found.tag in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body")):
                        found = root
                        break
                    found = found.parent
                if found is not root:
                    close(found.parent)
            continue
        if tag in BLOCKS:
            if open_count.get("p"):
                found = at
                while found.tag != "p" and found.tag not in _SCOPE and found is not root:
                    found = found.parent
                if found.tag == "p":
                    close(found.parent)
            if tag in HEADINGS and at.tag in HEADINGS:
                close(at.parent)
            if tag in _ENDED_BY:
                ends, stops = _ENDED_BY[tag]
                found, last = at, None
                while found is not root and found.tag not in stops:
                    if found.tag in ends:
                        last = found
                    found = found.parent
                if last is not None:
                    close(last.parent)
        text = token[3] if token[2] else token[6]
        made = _element(tag, text, at, within > 0)
        at.children.append(made)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, pos)
            pos = stop.end() if stop else end
            continue
        if text.rstrip().endswith("/") and tag in ("svg", "math", "path"):
            continue
        at = made
        within += made.article
        open_count[tag] = open_count.get(tag, 0) + 1
    return root


def _declared(root: _Element) -> tuple[set, set]:
    """Outermost declared articles that hold text and that nothing sets aside, and the elements
    above them. Should a class or id above set all of them aside, these names do not count."""
    return _outermost(root, strict=True) or _outermost(root, strict=False) or (set(), set())


def _outermost(root: _Element, strict: bool) -> tuple[set, set] | None:
    articles, above = set(), set()
    work = [(root, False)]
    while work:
        element, aside = work.pop()
        aside = aside or element.aside or (element.named and (strict or element.article))
        if element.article and not aside and _has_text(element):
            inner = _inner(element)
            articles.add(inner)
            up = inner.parent
            while up is not None and up not in above:
                above.add(up)
                up = up.parent
            continue
        work.extend((child, aside) for child in element.children if type(child) is not str)
    return (articles, above) if articles else None


def _has_text(element: _Element) -> bool:
    work = [element]
    while work:
        for child in work.pop().children:
            if type(child) is str:
                if not child.isspace():
                    return True
            elif not child.aside:
                work.append(child)
    return False


def _inner(main: _Element) -> _Element:
    """The only article within a `main`, else the element itself."""
    if main.tag == "article":
        return main
    found, work = [], [main]
    while work:
        for child in work.pop().children:
            if type(child) is not str and not child.aside and not (child.named and child.article):
                (found if child.article and _has_text(child) else work).append(child)
    return found[0] if len(found) == 1 else main


def parse(source: str) -> Page:
    """Blocks and branches of a page. Text between two block elements' tags is one block, with
    white space turned into single spaces and character references decoded. A page that declares
    articles has its other text set aside."""
    root = _tree(source)
    articles, above = _declared(root)
    page = Page()
    shapes: dict[int, list] = {}
    chain: list[int] = []
    words: list[str] = []
    place = {"aside": False}

    def flush():
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                page.blocks.append(([*chain, _digest(str(chain[-1] if chain else 0), text)], text, place["aside"]))

    # Each entry: an element to enter or, as a tuple, to leave.
    work: list = [(root, False, not articles, False)]
    while work:
        entry = work.pop()
        if type(entry) is str:
            words.append(html.unescape(entry))
            continue
        if len(entry) == 2:  # the end of a block element, or of an inline one set aside
            flush()
            if entry[0]:
                chain.pop()
            place["aside"] = entry[1]
            continue
        element, aside, inside, in_article = entry
        if element.tag in ("br", "hr", "img", "wbr") and not element.children:
            words.append("" if element.tag == "wbr" else " ")
            if element.tag == "hr":
                flush()
            continue
        declared = element in articles
        inside = inside or declared
        in_article = in_article or declared
        own = element.aside or (element.named and element not in above and not declared)
        aside = aside or own
        block = element.tag in BLOCKS or element is root
        before = place["aside"]
        if block or (aside or not inside) != before:
            flush()
            place["aside"] = aside or not inside
            work.append((block, before))
            if block:
                parent = chain[-1] if chain else 0
                branch = _digest(str(parent), element.sign)
                chain.append(branch)
                kinds = []
                for child in element.children:
                    kind = "#text" if type(child) is str else child.sign
                    if type(child) is str and child.isspace() or type(child) is not str and child.tag not in BLOCKS and kinds[-1:] == ["#text"]:
                        continue
                    kind = kind if type(child) is str or child.tag in BLOCKS else "#text"
                    if kinds[-1:] != [kind]:
                        kinds.append(kind)
                shapes.setdefault(branch, [parent, len(chain), set(), in_article])[2].add("|".join(kinds))
        for child in reversed(element.children):
            work.append(child if type(child) is str else (child, aside, inside, in_article))
    flush()
    page.shapes = {branch: (parent, depth, _digest(*sorted(kinds)), within) for branch, (parent, depth, kinds, within) in shapes.items()}
    return page
