"""Words of a page, shared by the text operators."""

from __future__ import annotations

import html
import re

INVISIBLE = re.compile("[\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]")
TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case, entities decoded, tags blanked, invisible characters dropped."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return WORD.findall(text.lower())
