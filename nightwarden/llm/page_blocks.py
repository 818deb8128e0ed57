"""Text blocks of one HTML page, with what its markup says about them; plain Python, used inside tasks."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text without markup; the page's parser looks for their end tag alone.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr label img".split())
#: Elements that are never part of an article's text.
DROPPED = set("script style textarea title xmp iframe noembed noframes head nav footer aside form noscript template svg math canvas "
              "select option button object audio video map dialog menu datalist fieldset".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
PROSE = HEADINGS | set("p li blockquote pre td th dd dt figcaption caption".split())
#: End tags that browsers supply: a start tag of the key ends an open element of the values.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
          "option": {"option"}, "body": {"head"}} | {h: {"p"} for h in HEADINGS | set("ul ol div section article table blockquote pre aside footer header nav main form".split())}
SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}}

#: Words in class, id or role that mark what is not the article.
MARKS = set("ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted banner sidebar "
            "sidebars widget widgets menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs pager pagination masthead footer "
            "footnav colophon cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
            "login paywall share sharing sharebar social related recommended recommendations recirc trending teaser teasers outbrain taboola "
            "comment comments commentlist replies respond disqus discussion toolbar skip copyright disclaimer feedback search searchbox complementary "
            "contentinfo hidden".split())
TITLED = {"header", "banner"}  # their headings belong to an article that holds them
NOT_MARKS = {"has", "with", "no", "without", "layout"}  # "has-sidebar" is a page, not a sidebar
BODY_OF = {"article", "post", "entry", "story"}
BODY_WORDS = BODY_OF | set("body content text main full single container wrapper inner blog news".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    main: bool  # inside an explicit <article>, <main> or article body
    prose: bool  # in a paragraph, heading, list item or the like


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _words(value: str) -> set[str]:
    return {w for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w}


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or \
        re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I) is not None


def _kind(name: str, attrs: dict[str, str], inside_main: bool, marks: bool) -> str:
    """What an element does to its content: drop, titled (drop all but headings), article, main, or nothing."""
    words = _words(" ".join(attrs.get(k, "") for k in ("class", "id", "role"))) if attrs and marks else set()
    if words & NOT_MARKS:
        words -= MARKS
    if name in DROPPED or _hidden(attrs):
        return "drop"
    if name == "article" or "articlebody" in _words(attrs.get("itemprop", "").replace("articleBody", "articlebody")):
        return "drop" if words & {"comment", "comments", "teaser", "ad", "ads", "advert", "related", "promo", "sponsored"} else "article"
    if name == "main" or attrs.get("role", "").lower() == "main":
        return "main"
    if name in ("html", "body"):
        return ""
    if name == "header" or words & TITLED and not words & (MARKS - TITLED):
        return "titled" if inside_main else "drop"
    if name not in HEADINGS and words & MARKS:
        return "drop"
    if name in ("div", "section"):
        return "article" if words & BODY_OF and words <= BODY_WORDS else "main" if words and words <= {"main", "content"} else ""
    return ""


def blocks(page: str, marks: bool = True) -> list[Block]:
    """All blocks the markup does not rule out, in page order, white space made single.

    Where class names rule out everything, only element names count.
    """
    out: list[tuple[str, str, bool]] = []  # text, container, prose
    open_: list[tuple[str, str]] = []
    counts = {"drop": 0, "titled": 0, "article": 0, "main": 0, "heading": 0, "prose": 0}
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, "article" if counts["article"] else "main" if counts["main"] else "", counts["prose"] > 0))

    def tally(name: str, kind: str, by: int) -> None:
        if kind:
            counts[kind] += by
        counts["heading"] += by * (name in HEADINGS)
        counts["prose"] += by * (name in PROSE)

    def close_down_to(size: int) -> None:
        while len(open_) > size:
            tally(*open_.pop(), -1)

    def take(piece: str) -> None:
        if piece and not counts["drop"] and (not counts["titled"] or counts["heading"]):
            parts.append(html.unescape(piece))

    at, length = 0, len(page)
    while at < length:
        m = TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at:m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in ("p", "br") or name not in INLINE:
                flush()
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close_down_to(k)
                    break
                if name in INLINE and open_[k][0] not in INLINE:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if name not in INLINE:
            flush()
        ends = CLOSES.get(name)
        if ends:
            scope = SCOPES.get(name, ())
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in ends:
                    close_down_to(k)
                    if name not in ("tr", "body"):
                        break
                elif open_[k][0] in scope or open_[k][0] not in INLINE | ends:
                    break
        attrs = _attributes(m["attrs"]) if m["attrs"] and m["attrs"].strip("/ \t\r\n") else {}
        kind = _kind(name, attrs, counts["article"] + counts["main"] > 0, marks)
        if kind in ("article", "main") and counts["drop"]:
            # An article inside an unclosed menu or a form around the page is still the article.
            if any(n in ("nav", "header", "footer", "form", "head", "fieldset") for n, k in open_ if k == "drop") and not any(
                    k == "drop" and n not in ("nav", "header", "footer", "form", "head", "fieldset") for n, k in open_):
                for i, (n, k) in enumerate(open_):
                    if k == "drop":
                        counts["drop"] -= 1
                        open_[i] = (n, "")
        if name in VOID or m["attrs"].endswith("/") and name not in INLINE and name not in RAW and name in ("svg", "path", "br", "hr"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else length
            continue
        open_.append((name, kind))
        tally(name, kind, 1)
    flush()
    if not out and marks:
        return blocks(page, False)
    best = "article" if any(c == "article" for _, c, _ in out) else "main" if any(c == "main" for _, c, _ in out) else ""
    return [Block(text, best == "article", prose) for text, container, prose in out if container == best or best == "main" and container]
