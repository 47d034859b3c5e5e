"""Making attacker-influenced text safe to display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = "[\\x00-\\x1f\\x7f-\\x9f]"
_LINKABLE_DOT = "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z])"
_ZERO_WIDTH_SPACE = "​"


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def clean_text(text: Column, limit: int | None = 300) -> Column:
    """Control characters become blanks, then the text is cut to ``limit``, if there is one."""
    plain = F.regexp_replace(text, _CONTROL, " ")
    return plain if limit is None else F.substring(plain, 1, limit)


def defang(url: Column) -> Column:
    """A URL nobody can click."""
    return _swap(
        clean_text(url, 500), ("http://", "hxxp://"), ("https://", "hxxps://"), (".", "[.]")
    )


def chat_safe(text: Column, limit: int | None = 300) -> Column:
    """Text a chat client shows without linking, mentioning or interpreting it."""
    inert = _swap(clean_text(text, limit), ("http://", "hxxp://"), ("https://", "hxxps://"))
    inert = F.regexp_replace(inert, _LINKABLE_DOT, "[.]")
    return _swap(
        inert, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("@", "@" + _ZERO_WIDTH_SPACE)
    )


def normalised_title(title: Column) -> Column:
    """Titles compared without case or spacing; a missing title equals an empty one."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), "\\s+", " "))
    return F.lower(squeezed)
