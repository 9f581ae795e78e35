"""Words of a text: runs of letters and digits, whatever the markup around them."""

from __future__ import annotations

import html
import re
import unicodedata

#: Invisible characters that may stand inside a word.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|<!--.*?-->", re.S)
#: Tags that set the look of letters and don't end a word.
_INLINE = frozenset("b big em font i ins mark s small span strong sub sup tt u wbr".split())
_LINK_TARGET = re.compile(r"\]\([^()\s]*\)")
WORD = re.compile(r"[^\W_]+")


def _untag(m: re.Match) -> str:
    return "" if m[2] and m[2].lower() in _INLINE else " "


def plain(text: str) -> str:
    """Text without entities, tags, link targets and invisible characters, compatible forms unified, case folded."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(_untag, text)
    if "](" in text:
        text = _LINK_TARGET.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
    return text.casefold()


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null."""
    return WORD.findall(plain(text)) if text else []
