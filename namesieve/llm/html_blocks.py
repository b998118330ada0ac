"""Leaf blocks of an HTML page: the runs of text between block-level tags, with what surrounds them as bits.

The reader takes any string: unclosed and stray tags, comments and raw-text elements without an end, and attributes
with ``>`` in quotes are read as browsers broadly do. Work and memory grow linearly with the page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: Elements whose content is no text of the page. Unclosed, the first run to the end of the page, the others are tags;
#: svg and math may close themselves.
_TO_END, _TO_CLOSE, _FOREIGN = "script|style|textarea", "noscript|template|title|select|iframe|object|canvas|audio|video", "svg|math"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?--!?>|.*\Z)|<({_TO_END})(?![\w:-]){_QUOTED}>(?:.*?</\1\s*>|.*\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_QUOTED})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*>",
    re.S | re.I,
)
_RAW = frozenset(f"{_TO_CLOSE}|{_FOREIGN}".split("|"))
_CLOSING = re.compile(rf"</({_TO_CLOSE}|{_FOREIGN})\s*>", re.I)
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("br hr img input meta link wbr area base col embed source track param".split())
#: A start tag that ends an open element of the same kind.
_CLOSES = {
    "li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}

ANCESTORS = (
    "article", "main", "section", "nav", "header", "footer", "aside", "form", "list", "table", "figure", "dialog",
    "button", "details", "blockquote", "pre", "label",
)
_ANCESTOR_OF = {"ul": "list", "ol": "list", "menu": "list", "dl": "list", "fieldset": "form", "center": "section"}
#: What class, id and role say about an element.
HINTS = {
    "content": r"article|content|story|entry|post(?!er)|body|text|main|prose",
    "menu": r"\bnav|navi|menu|breadcrumb|toolbar|pagination|pager|\btabs?\b|skip",
    "top": r"header|masthead|logo|top-?bar|branding|site-?title|tagline",
    "bottom": r"foot|copyright|legal|colophon|imprint|disclaimer",
    "side": r"side|aside|widget|related|recommend|popular|trending|archive|more-|see-also|tag-?(?:s|list|cloud)|rail",
    "advert": r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|outbrain|taboola|affiliate|commercial",
    "notice": r"cookie|consent|gdpr|notice|alert|newsletter|subscri|sign-?up|popup|modal|overlay|paywall|warning|message|toast",
    "comment": r"comment|disqus|\brepl(?:y|ies)|discussion|respond|response|review|feedback|thread|guestbook",
    "social": r"share|sharing|social|follow|tweet|facebook",
    "form": r"form|search|login|log-in|sign-?in|contact|input",
    "meta": r"byline|author|\bmeta\b|\bdate|time-?stamp|published",
}
_HINT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in HINTS.items()), re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label|itemprop|data-[\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
OWN = ("p", "li", "div", "h1", "heading", "cell", "other")
TEXT = (
    "words<3", "words<8", "words<20", "words<60", "words>=60", "ends a sentence", "has a comma", "links<10%",
    "links<60%", "links>=60%", "copyright", "phrase", "shouting", "digits", "first", "last", "bias",
)
NESTED = ("inner header", "inner footer", "inner article")
FEATURES = (*ANCESTORS, *(f"named {k}" for k in HINTS), *NESTED, *(f"own {k}" for k in OWN), *TEXT)
_BIT = {name: 1 << i for i, name in enumerate(FEATURES)}
_PHRASE = re.compile(
    r"cookie|subscribe|newsletter|sign (?:in|up)|log ?in|read more|all rights reserved|privacy|terms of|advertis"
    r"|sponsored|share this|leave a (?:comment|reply)|click here|related (?:articles|posts|stories)",
    re.I,
)
_COPYRIGHT = re.compile(r"^\s*(?:©|\(c\)|copyright)", re.I)
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)\]]*$")


@dataclass
class Block:
    text: str
    bits: int
    parent: int


def _hints(attributes: str) -> int:
    bits = 0
    for found in _NAMED.finditer(attributes):
        for hint in _HINT.finditer(found[1] or found[2] or found[3] or ""):
            bits |= _BIT[f"named {hint.lastgroup}"]
    return bits


def _text_bits(text: str, linked: int, size: int) -> int:
    n = text.count(" ") + 1
    bits = _BIT["bias"]
    bits |= _BIT["words<3" if n < 3 else "words<8" if n < 8 else "words<20" if n < 20 else "words<60" if n < 60 else "words>=60"]
    share = linked / max(1, size)
    bits |= _BIT["links<10%" if share < 0.1 else "links<60%" if share < 0.6 else "links>=60%"]
    if _SENTENCE.search(text[-8:]):
        bits |= _BIT["ends a sentence"]
    if "," in text:
        bits |= _BIT["has a comma"]
    if _COPYRIGHT.match(text):
        bits |= _BIT["copyright"]
    if n < 40 and _PHRASE.search(text):
        bits |= _BIT["phrase"]
    if text.isupper():
        bits |= _BIT["shouting"]
    if text.replace(" ", "").isdigit():
        bits |= _BIT["digits"]
    return bits


def _own(tag: str) -> int:
    if tag in ("p", "li", "div", "h1"):
        return _BIT[f"own {tag}"]
    if tag in ("td", "th"):
        return _BIT["own cell"]
    return _BIT["own heading"] if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else _BIT["own other"]


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, decoded, with white space made single."""
    page = page or ""
    found: list[Block] = []
    # Open elements: tag, bits of it and all around it, number.
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    open_tags: dict[str, int] = {}
    number = links = linked = size = 0
    pieces: list[str] = []

    def flush() -> None:
        nonlocal pieces, linked, size
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                tag, bits, place = stack[-1]
                found.append(Block(text, bits | _own(tag) | _text_bits(text, linked, size), place))
            pieces, linked, size = [], 0, 0

    def add(text: str) -> None:
        nonlocal linked, size
        pieces.append(text)
        if not text.isspace():
            size += len(text)
            linked += len(text) if links else 0

    def close(tag: str) -> None:
        while True:
            name, _, _ = stack.pop()
            open_tags[name] -= 1
            if name == tag:
                return

    # Where the raw elements' end tags are, last first, so that reading stays linear.
    closing: dict[str, list[int]] = {}
    for end in _CLOSING.finditer(page):
        closing.setdefault(end[1].lower(), []).append(end.end())
    for ends in closing.values():
        ends.reverse()

    at = 0
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        ending, attributes = token[2] or token[5], token[4] or token[7] or ""
        if tag in _RAW:
            ends = closing.get(tag, [])
            while ends and ends[-1] <= at:
                ends.pop()
            if ends and not ending and not (tag in ("svg", "math") and attributes.endswith("/")):
                at = ends[-1]
            continue
        if tag == "a":
            links = 0 if ending else 1
            continue
        if tag not in _BLOCK_TAGS:
            if tag == "br":
                pieces.append(" ")
            continue
        flush()
        if ending:
            if open_tags.get(tag):
                close(tag)
            continue
        if tag in _VOID:
            continue
        if stack[-1][0] == "p":
            close("p")
        elif stack[-1][0] in _CLOSES.get(tag, ()):
            close(stack[-1][0])
        number += 1
        around = stack[-1][1]
        bits = around | _BIT.get(_ANCESTOR_OF.get(tag, tag), 0) * (tag not in ("p",) and _ANCESTOR_OF.get(tag, tag) in ANCESTORS)
        if attributes and "=" in attributes and tag not in ("html", "body"):
            bits |= _hints(attributes)
        if around & (_BIT["article"] | _BIT["main"]):
            if tag in ("header", "footer"):
                bits |= _BIT[f"inner {tag}"]
            elif tag == "article" and around & _BIT["article"]:
                bits |= _BIT["inner article"]
        stack.append((tag, bits, number if tag not in ("p", "li") else stack[-1][2]))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        add(page[at:])
    flush()
    if found:
        found[0].bits |= _BIT["first"]
        found[-1].bits |= _BIT["last"]
    return found
