"""Text expressions whose meaning must equal Python's ``str`` methods; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
PY_SPACE = (
    "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
EDGE_SPACE = f"^[{PY_SPACE}]+|[{PY_SPACE}]+\\z"
RUN_SPACE = f"[{PY_SPACE}]+"


def py_strip(text: Column | str) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def is_blank(text: Column | str) -> Column:
    """True for texts with no visible character; null for null."""
    return ~F.col(text).rlike(f"[^{PY_SPACE}]") if isinstance(text, str) else ~text.rlike(f"[^{PY_SPACE}]")


def ws_norm(text: Column | str) -> Column:
    """Lower case, runs of white space as one blank, no white space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), RUN_SPACE, " "))


# Fixed value: the split into word pieces (contractions, letters, digits, other marks, white space); every character is in exactly
# one piece. White space is what Python takes for it.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_JVM_PIECES = PIECE_PATTERN.replace(r"[^\s", f"[^{PY_SPACE}").replace(r"\S", f"[^{PY_SPACE}]").replace(r"\s", f"[{PY_SPACE}]")


def pieces_of(text: Column) -> Column:
    """The word pieces of a text in order; none for null and empty texts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_JVM_PIECES), F.lit(0))
