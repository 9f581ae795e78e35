"""Closed and open sets of names, and their parsers."""

from __future__ import annotations

from enum import Enum

from lodeatlas.functions import vocabulary as V


class Scheme(str, Enum):
    CANONICAL = "canonical"
    HUGGINGFACE = "huggingface"
    PURL = "purl"
    RAW = "raw"

    @classmethod
    def parse(cls, text: str) -> Scheme:
        """The scheme of exactly this spelling."""
        return cls(text)


class InputFormat(str, Enum):
    PEASANT = "peasant"
    HUGGINGFACE = "huggingface"
    PURL = "purl"
    RAW = "raw"

    @classmethod
    def parse(cls, text: str) -> InputFormat:
        """Any letter case; ``canonical`` is another name of peasant and ``hf`` of huggingface."""
        low = text.lower()
        return cls({"canonical": "peasant", "hf": "huggingface"}.get(low, low))

    @property
    def scheme(self) -> Scheme:
        return Scheme.CANONICAL if self is InputFormat.PEASANT else Scheme(self.value)


class Rating(str, Enum):
    ADMITTED = "admitted"
    PREFERRED = "preferred"
    DEPRECATED = "deprecated"


def _closed(name: str, values: list[str]):
    def parse(text: str) -> str:
        if text not in values:
            raise ValueError(f"unknown {name} {text!r}; known: {', '.join(values)}")
        return text

    return parse


parse_modality = _closed("modality", V.MODALITIES)
parse_derivation = _closed("kind of derivation", V.DERIVATION_KINDS)
parse_output_format = _closed("output format", ["json", "yaml", "table"])


def parse_modifier_class(text: str) -> str:
    low = text.strip().lower()
    if low not in ("identity", "attribute"):
        raise ValueError(f"unknown modifier class {text!r}")
    return low


def is_known_family(family: str, curated: bool = True) -> bool:
    """With ``curated`` exact letter case counts and the curated families are known; without, neither."""
    return family in V.FAMILIES or family in V.CURATED_FAMILIES if curated else family.lower() in {f.lower() for f in V.FAMILIES}


def is_enforced_family(family: str) -> bool:
    return family.lower() in V.ENFORCED_FAMILIES


def is_known_provider(provider: str) -> bool:
    return provider in V.PROVIDERS


def is_known_host(name: str) -> bool:
    return name in V.HOSTS


def is_known_harness(name: str) -> bool:
    return name in V.HARNESSES


def validate_vocabulary() -> None:
    """Raise for a curated table that names a family nobody knows."""
    known = {f.lower() for f in V.FAMILIES}
    for what, names in (("families with members", V.MEMBERS), ("aliases", V.FAMILY_ALIASES.values()), ("series", V.SERIES_LETTER), ("glued generations", V.GLUED_GENERATION)):
        odd = sorted(n for n in names if n not in known or n != n.lower())
        if odd:
            raise ValueError(f"{what}: unknown families {', '.join(odd)}")
