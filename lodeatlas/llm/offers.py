"""Reading offers of models: what a title, an identifier or a vendor's name says."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from lodeatlas.llm.names import NameDictionary, Similar, fold, squeeze

# Modifiers of model names and the ways they are written.
MODIFIERS = {
    "thinking": "thinking", "think": "thinking", "turbo": "turbo", "tools": "tools", "tool": "tools", "vision": "vision", "vis": "vision",
    "instruct": "instruct", "instr": "instruct", "inst": "instruct", "experimental": "exp", "exp": "exp", "preview": "preview", "prev": "preview",
    "fast": "fast", "chat": "chat", "audio": "audio", "aud": "audio", "free": "free",
}

_DATE = re.compile(r"@?(?<!\d)(?:19|20)\d{2}-?(?:0[1-9]|1[0-2])-?(?:0[1-9]|[12]\d|3[01])(?!\d)")
_REVISION = re.compile(r"[-_ ]v\d+:\d+\s*$")
_SIZE = re.compile(r"(?<!\d)(\d+(?:[.p]\d)?)[\s_-]*(?:billion|bn|b)(?![a-z])")
_WORD = re.compile(r"[a-z]+|[^\W\d_a-z]+|\d+")


@dataclass(frozen=True)
class Offer:
    family: str = ""
    variant: str = ""
    version: str = ""
    size: str = ""
    modifiers: str = ""
    edits: int = 0

    @property
    def filled(self) -> int:
        return bool(self.family) * 4 + bool(self.version) * 2 + bool(self.size)


def plain_number(text: str) -> str:
    """8.0 and 8 are the same number; 10.1 and 10.10 are not the same version."""
    return re.sub(r"\.0$", "", text.replace("p", ".").lstrip("0") if not text.startswith("0") else text.replace("p", "."))


def read_offer(text: str | None, names: NameDictionary) -> Offer:
    """Family, variant, version, size in billions and modifiers of a title or identifier."""
    if not text:
        return Offer()
    t = _REVISION.sub(" ", _DATE.sub(" ", fold(text)))
    size = ""
    hit = list(_SIZE.finditer(t))
    if hit:
        size = plain_number(hit[-1][1])
        t = t[: hit[-1].start()] + " ; " + t[hit[-1].end() :]
    words, numbers, mods = [], [], []
    for w in _WORD.findall(t):
        if w.isdigit():
            numbers.append(w)
        elif w in MODIFIERS:
            mods.append(MODIFIERS[w])
        elif len(w) > 1:
            words.append(w)
    got = names.read_words(words)
    version = plain_number(".".join(numbers[:2])) if numbers else ""
    known = names.of_family.get(got.family, set())
    variants = [v for v in got.variants if v in known] or got.variants
    return Offer(got.family, variants[0] if variants else "", version, size, ",".join(sorted(set(mods))), got.edits)


def read_model(model_id: str | None, display_name: str | None, family: str | None, variant: str | None, version: str | None, names: NameDictionary) -> Offer:
    """The offer of a catalog row: its stored columns where they are filled, else its two names.

    Where the two names differ the fuller reading counts; of two versions the one with two numbers.
    """
    a, b = read_offer(display_name, names), read_offer(model_id, names)
    if (b.filled, -b.edits) > (a.filled, -a.edits):
        a, b = b, a
    v = a.version
    if b.family == a.family and "." in b.version and "." not in v and b.version.replace(".", "") == v:
        v = b.version
    if family and family.strip():
        return Offer(squeeze(family), squeeze(variant or ""), plain_number((version or "").strip()), a.size or b.size, a.modifiers or b.modifiers)
    return Offer(a.family, a.variant or (b.variant if b.family == a.family else ""), v or b.version, a.size or b.size, a.modifiers or b.modifiers, a.edits)


class Vendors:
    """Providers by the name a vendor was typed with.

    ``around`` are words that stand in a share of all vendors' names; of them those that no provider has
    say nothing. What follows the name in a host name (``name.tld``) says nothing either.
    """

    _HOST = re.compile(r"^\s*(?:https?://)?(?:www\.)?([^\s./]+)(?:\.[^\s./]+)+/?\s*$", re.I)

    def __init__(self, providers: list[str], around: Iterable[str] = ()):
        self.by: dict[str, set[str]] = {}
        own: set[str] = set()
        for p in providers:
            words = _WORD.findall(fold(p))
            own |= set(words)
            for n in {"".join(words), words[0] if words else ""} - {""}:
                self.by.setdefault(n, set()).add(p)
        self.around = set(around) - own
        self.similar = Similar(set(self.by), skeletons=False)

    def find(self, typed: str | None) -> list[str]:
        """The providers meant, closest spelling first; empty for null, blank and unknown vendors."""
        host = self._HOST.match(typed or "")
        words = [w for w in _WORD.findall(fold(host[1] if host else typed or "")) if w not in self.around and len(w) > 1]
        for word in ("".join(words), words[0] if words else ""):
            hit = self.similar.find(word) if len(word) >= 3 else None
            if hit:
                return sorted(self.by[hit[1]])
        return []


_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?(?:e-?\d+)?")
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def read_context(text: str | None) -> float | None:
    """Tokens of a context window: ``128K ctx``, ``65,536 tokens``, ``1M``; None if there is no number."""
    hit = _NUMBER.search((text or "").lower())
    if not hit:
        return None
    value = float(hit[0].replace(",", ""))
    unit = (text or "").lower()[hit.end() :].strip()[:1]
    return value * {"k": 1000, "m": 1_000_000}.get(unit, 1)


def read_price(text: str | None) -> float | None:
    """The first price of a text, for a million tokens."""
    t = (text or "").lower()
    hit = _NUMBER.search(t)
    if not hit:
        return 0.0 if "free" in t else None
    value = float(hit[0].replace(",", ""))
    return value * 1000 if re.search(r"per\s*1?k|/\s*1?k\b", t) else value


def read_month(text: str | None) -> str | None:
    """yyyy-mm of a date written in one of the usual ways."""
    t = (text or "").lower()
    if m := re.search(r"((?:19|20)\d\d)-(\d\d)", t):
        return f"{m[1]}-{m[2]}"
    if m := re.search(r"([a-z]{3})[a-z]*\.? ?,?\s*((?:19|20)\d\d)", t):
        return f"{m[2]}-{_MONTHS[m[1]]:02d}" if m[1] in _MONTHS else None
    if m := re.search(r"\d{1,2}[./](\d{1,2})[./]((?:19|20)\d\d)", t):
        return f"{m[2]}-{int(m[1]):02d}"
    return None
