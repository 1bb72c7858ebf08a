"""Catch blocks without code, from one pass over a masked text's tokens: parentheses and braces nest to any depth, which no regex follows."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: What matters: the word, brackets, and anything else that is code; white space and what is masked fall through.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_$])catch(?![A-Za-z0-9_$])|[(){}]|[^\s\x01(){}]")
_PLACE = StructType().add("at", IntegerType()).add("line", IntegerType()).add("col", IntegerType())


def scan(masked: str) -> list[int]:
    """Where a ``catch`` stands whose braces hold no code but braces. A catch inside another's body is part of that body; a body that nothing closes ends with the text."""
    out, place, state, depth, code, end = [], 0, "", 0, False, 0
    while True:
        if not state and (end := masked.find("catch", end)) < 0:  # nothing else counts outside of a catch
            break
        m = _TOKEN.search(masked, end)
        if m is None:
            break
        t, end = m[0], m.end()
        if state == "body":
            if t == "{":
                depth += 1
            elif t == "}":
                depth -= 1
                if not depth:
                    state = ""
                    if not code:
                        out.append(place)
            else:
                code = True
        elif state == "list":
            depth += (t == "(") - (t == ")")
            if not depth:
                state = "closed"
        elif state and t == "{":
            state, depth, code = "body", 1, False
        elif state == "catch" and t == "(":
            state, depth = "list", 1
        elif t == "catch":
            state, place = "catch", m.start()
        else:
            state = ""
    if state == "body" and not code:
        out.append(place)
    return out


@F.pandas_udf(ArrayType(_PLACE))
def empty_catches(masked: pd.Series) -> pd.Series:
    """:func:`scan` with offsets from 0, lines and byte columns from 1. Takes the mask of a byte view; null has none."""

    def one(text: str | None) -> list[dict]:
        found = scan(text) if text else []
        newlines = [m.start() for m in re.finditer("\n", text)] if found else []
        rows = []
        for at in found:
            k = bisect_left(newlines, at)
            rows.append({"at": at, "line": k + 1, "col": at - (newlines[k - 1] if k else -1)})
        return rows

    return masked.map(one)
