"""Column names: one rule-driven cleaner behind the reader's header repair (S3)
and the two renaming operators (P1, P2)."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class NameRule:
    """``blanks`` (a regex) become ``blank``; of the rest, characters outside
    ``allowed`` (a regex) become ``other``; ``final`` replaces left-over blanks."""
    allowed: str
    blanks: str = r"\s+"
    blank: str = "_"
    other: str = ""
    final: str | None = None
    lower: bool = False


# The name of a column of which nothing is left, the byte-order
# mark, and the characters that each kind of name may hold.
EMPTY_NAME, BYTE_ORDER_MARK = "col", "\ufeff"
NORMALIZED = NameRule(allowed="[a-z0-9_]", lower=True)
SANITIZED = NameRule(allowed="[a-zA-Z0-9_ -]", blank=" ", final="_")
HEADER = NameRule(allowed=r"[^\W_]|[_ -]", blanks=r"[\r\n]", blank=" ", other="_")


def clean_name(name: object, rule: NameRule) -> str:
    text = re.sub(rule.blanks, rule.blank, str(name).strip().lstrip(BYTE_ORDER_MARK).strip())
    text = text.strip() if rule.blank == " " else text
    text = text.lower() if rule.lower else text
    kept = "".join(ch if re.fullmatch(rule.allowed, ch) else rule.other for ch in text)
    return (kept if rule.final is None else kept.replace(" ", rule.final)) or EMPTY_NAME


def unique_names(names: list[str]) -> list[str]:
    """Repeats get ``__2``, ``__3``...: the first that no earlier column has."""
    taken: dict[str, None] = {}
    for name in names:
        choices = itertools.chain([name], (f"{name}__{k}" for k in itertools.count(2)))
        taken[next(c for c in choices if c not in taken)] = None
    return list(taken)


def clean_names(names: list, rule: NameRule) -> list[str]:
    return unique_names([clean_name(n, rule) for n in names])
