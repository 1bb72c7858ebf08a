"""Complexity, nesting, lines of code and entropy of a text. ``masked`` is a column of :mod:`mask`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

KEYWORDS = ("if", "while", "for", "case")
#: A run of question marks that is one long and not followed by a dot is a ternary. Other words would only be filtered out, one by one.
_TOKEN = r"(?=[ifwc{}&|?])(?:(?<![A-Za-z0-9_$])(?:" + "|".join(KEYWORDS) + r")(?![A-Za-z0-9_$])|[{}]|&&|\|\||\?+\.?)"


def code_tokens(masked: Column) -> Column:
    """Keywords, braces, logical operators and question marks, in order. Select it once, then take several metrics of it."""
    return F.regexp_extract_all(masked, F.lit(_TOKEN), F.lit(0))


def cyclomatic(tokens: Column) -> Column:
    return 1 + F.size(F.filter(tokens, lambda t: t.isin(*KEYWORDS, "&&", "||", "?")))


def _fold(tokens: Column, finish) -> Column:
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"), F.lit(0).alias("cost"))

    def step(s: Column, t: Column) -> Column:
        depth = F.when(t == "{", s["depth"] + 1).when(t == "}", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cost = s["cost"] + F.when(t.isin(*KEYWORDS), s["depth"] + 1).otherwise(0)
        return F.struct(depth.alias("depth"), F.greatest(s["most"], depth).alias("most"), cost.alias("cost"))

    return F.aggregate(F.filter(tokens, lambda t: t.isin(*KEYWORDS, "{", "}")), zero, step, finish)


def nesting_and_cognitive(tokens: Column) -> Column:
    """Struct (most, cost): the deepest brace level, and the sum over keywords of one plus their level. One fold makes both."""
    return _fold(tokens, lambda s: F.struct(s["most"].alias("most"), s["cost"].alias("cost")))


def lines_of_code(quoted: Column) -> Column:
    """Lines with a character that is neither white space nor masked; quotes count. ``quoted``: of mask_keeping_quotes."""
    return F.size(F.filter(F.split(quoted, "\n"), lambda x: x.rlike(r"[^\s\x01\x02]")))


@F.pandas_udf(DoubleType())
def byte_entropy(texts: pd.Series) -> pd.Series:
    """Shannon bits per byte over bytes that aren't ASCII white space; 0 for none. A histogram a text, in numpy: exploding bytes into rows would shuffle each of them."""

    def one(text: str | None) -> float | None:
        if text is None:
            return None
        n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        n[[9, 10, 11, 12, 13, 32]] = 0
        n = n[n > 0]
        total = n.sum()
        return float(np.log2(total) - (n * np.log2(n)).sum() / total) if total else 0.0

    return texts.map(one)
