"""File-name wildcard rule of the read/write probes, as a column predicate.

Rule (pattern cut to 16 bytes, name already cut to 15 bytes):

* empty pattern: filter off (handled by the caller);
* pattern starting with ``*``: the rest is a **literal suffix** of the name
  (``*`` alone matches every name; later ``*`` and ``?`` are literal);
* otherwise: same length, and at every position the pattern byte equals
  the name byte or is ``?``.  A ``*`` that is not first is a literal.

All of this counts bytes, not characters: name and pattern are matched as
strings with one character per byte (their UTF-8 bytes read as ISO-8859-1).

A literal pattern compiles to ``endswith`` or an anchored ``rlike`` with
escaped literals; a per-row pattern column compiles to the same regex
built with ``regexp_replace`` so that parameters read from a config table
(as-of semantics) use the identical rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN_BYTES = 16


def _java_escape(ch: str) -> str:
    if ch.isascii() and not ch.isalnum():
        return "\\" + ch
    return ch


def pattern_regex(pattern: str) -> str:
    """Anchored Java regex for a non-leading-star pattern."""
    body = "".join("." if ch == "?" else _java_escape(ch) for ch in pattern)
    return "(?s)^" + body + "\\z"


def _bytewise(col: Column) -> Column:
    """One character per byte of the column's UTF-8 form."""
    return F.decode(col.cast("binary"), "ISO-8859-1")


def wildcard_match(name, pattern) -> Column:
    """Column predicate: does ``name`` match ``pattern`` under the rule above.

    ``pattern`` is a Python string (compiled on the driver) or a Column.
    Null / empty patterns are *not* handled here (the caller turns them
    into "filter off").
    """
    name = F.col(name) if isinstance(name, str) else name
    if isinstance(pattern, str):
        raw = pattern.encode("utf-8")[:PATTERN_BYTES]
        plain = raw.isascii() and "?" not in pattern   # then characters and bytes give the same answer, and the filter can be pushed down
        p = raw.decode("latin-1")
        if p.startswith("*"):
            rest = p[1:]
            return F.lit(True) if rest == "" else (name if raw.isascii() else _bytewise(name)).endswith(rest)
        return (name if plain else _bytewise(name)).rlike(pattern_regex(p))
    p = F.substring(_bytewise(pattern), 1, PATTERN_BYTES)
    name = _bytewise(name)
    rest = F.substring(p, 2, PATTERN_BYTES)
    escaped = F.regexp_replace(p, r"([^A-Za-z0-9?\x{80}-\x{FF}])", r"\\$1")
    rx = F.concat(F.lit("(?s)^"), F.regexp_replace(escaped, r"\?", "."), F.lit("\\z"))
    return (F.when(F.substring(p, 1, 1) == "*",
                   F.when(rest == "", F.lit(True)).otherwise(F.endswith(name, rest)))
            .otherwise(F.regexp_like(name, rx)))
