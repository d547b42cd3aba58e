"""HTML text functions for Arrow UDFs: plain regular expressions, linear in the length of the page."""

from __future__ import annotations

import html as entities
import re

#: Content that is never shown, with its tags.
HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|$)|<![^>]*>", re.I | re.S)
NOSCRIPT = re.compile(r"<noscript\b[^>]*>.*?(?:</noscript\s*>|$)", re.I | re.S)
HEAD = re.compile(r"<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b))", re.I | re.S)
BODY = re.compile(r"<body\b[^>]*>", re.I)
#: Tags that do not part words.
INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|font|small|mark|sub|sup|wbr|code|abbr|bdi|bdo|big|tt|var|kbd|samp|q|cite|dfn|ins|del)(?:\s[^>]*|/)?>", re.I)
TAG = re.compile(r"</?[A-Za-z][^>]*>|<\?[^>]*>")
TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|$)", re.I | re.S)
INVISIBLE = re.compile("[­​-‏⁠﻿]")


def body_of(page: str) -> str:
    """The markup of the body: after `<body>`, or what is left without the head."""
    found = BODY.search(page)
    return page[found.end() :] if found else HEAD.sub(" ", page)


def strip_tags(markup: str, gap: str = " ") -> str:
    """Text of markup without hidden parts: other than inline tags leave `gap`; entities are decoded."""
    text = HIDDEN.sub(gap, markup)
    text = TAG.sub(gap, INLINE.sub("", text))
    if "&" in text:
        text = entities.unescape(text)
    return text


def visible_text(page: str | None) -> str:
    """Visible text of a page's body, white space collapsed; '' for null or blank pages."""
    if not page or page.isspace():
        return ""
    text = strip_tags(NOSCRIPT.sub(" ", body_of(page)))
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return " ".join(text.split())


def title_of(page: str | None) -> str | None:
    """Text of the first `<title>`, stripped and lower-cased; null if there is none."""
    found = TITLE.search(page or "")
    return " ".join(entities.unescape(found[1]).split()).lower() if found else None
