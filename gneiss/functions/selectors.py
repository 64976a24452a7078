"""Requests as text: atom groups, feature combinations and file-safe names."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def atom_groups(text: str) -> list[list[int]]:
    """'1,2 3,4' as [[1, 2], [3, 4]]; commas join, spaces part. Empty text has no groups."""
    return [[int(n) for n in group.split(",") if n] for group in text.split()]


def atom_groups_column(text: Column) -> Column:
    """atom_groups of a column, as array<array<int>>; null stays null."""
    groups = F.filter(F.split(F.trim(text), r"\s+"), lambda g: g != "")
    return F.transform(groups, lambda g: F.transform(F.filter(F.split(g, ","), lambda n: n != ""), lambda n: n.cast("int")))


def combination(text: str) -> list[str]:
    """The names in "('a', 'Dist(1, 2)')": commas within quotes or inner brackets don't part."""
    body, names, own, depth, quote = text.strip(), [], "", 0, None
    if body[:1] in "([" and body[-1:] in ")]":
        body = body[1:-1]
    for c in body + ",":
        if quote:
            own, quote = (own, None) if c == quote else (own + c, quote)
        elif c in "'\"":
            quote = c
        elif c == "," and depth == 0:
            names, own = names + [own.strip()], ""
        else:
            depth += (c in "([") - (c in ")]")
            own += c
    return [n for n in names if n]


def slug(name: str) -> str:
    """Letters, digits and dashes only, without accents."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9]+", "-", plain).strip("-").lower()
