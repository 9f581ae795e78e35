"""Typed errors of lookups and sources."""

from __future__ import annotations

from dataclasses import dataclass, field


class CatalogError(Exception):
    """Base of all errors of the catalog."""


@dataclass
class NotFound(CatalogError):
    what: str
    key: str

    def __str__(self) -> str:
        return f"{self.what} {self.key!r} not found"


@dataclass
class Unavailable(CatalogError):
    url: str
    attempts: int
    reason: str

    def __str__(self) -> str:
        return f"{self.url} unavailable after {self.attempts} attempts: {self.reason}"


@dataclass
class CacheMiss(CatalogError):
    path: str

    def __str__(self) -> str:
        return f"no cached catalog at {self.path}"


@dataclass
class Ambiguous(CatalogError):
    """An input that means several models; one candidate each, and who else offers them."""

    input: str
    scheme: str
    candidates: list[dict] = field(default_factory=list)
    rehosts: list[str] = field(default_factory=list)
    missed_namespace: str = ""

    def __str__(self) -> str:
        return f"input {self.input!r} means {len(self.candidates)} models"
