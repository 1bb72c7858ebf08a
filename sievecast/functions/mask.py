"""The mask: comments and string literals blanked, every other character in its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a line comment with its newline, a block comment, a literal in one of three quotes, or plain text.
TOKEN = r"""//[^\n]*\n?|/\*(?s:.*?)(?:\*/|\z)|'(?:[^'\\]++|\\(?s:.))*+(?:'|\\?\z)|"(?:[^"\\]++|\\(?s:.))*+(?:"|\\?\z)|`(?:[^`\\]++|\\(?s:.))*+(?:`|\\?\z)|[^/'"`]++|/"""
COMMENT, INSIDE = "\x01", "\x02"
_quoted = lambda t: F.substring(t, 1, 1).isin("'", '"', "`")
_CLOSED = r"(?s)\A(['\"`])(?:[^\\]|\\.)*?\1\z"


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def mask(c: Column) -> Column:
    """Every character of a comment or literal but newlines becomes \\x01, so places and lines stay; a line comment's newline is masked with it."""
    blank = lambda t: F.regexp_replace(t, r"[^\n]", COMMENT)
    return F.array_join(F.transform(_tokens(c), lambda t: F.when(t.startswith("//") | t.startswith("/*") | _quoted(t), blank(t)).otherwise(t)), "")


def mask_keeping_quotes(c: Column) -> Column:
    """As :func:`mask`, but literals keep their quotes, and their inside becomes \\x02."""
    inner = lambda t: F.regexp_replace(t, r"[^\n]", INSIDE)

    def literal(t: Column) -> Column:
        closed = t.rlike(_CLOSED) & (F.length(t) > 1)
        head = F.substr(t, F.lit(1), F.lit(1))
        return F.when(closed, F.concat(head, inner(F.substr(t, F.lit(2), F.length(t) - 2)), head)).otherwise(F.concat(head, inner(F.substr(t, F.lit(2)))))

    blank = lambda t: F.regexp_replace(t, r"[^\n]", COMMENT)
    return F.array_join(F.transform(_tokens(c), lambda t: F.when(t.startswith("//") | t.startswith("/*"), blank(t)).when(_quoted(t), literal(t)).otherwise(t)), "")
