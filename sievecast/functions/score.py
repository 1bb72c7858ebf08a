"""Priority scores of diagnostics, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "info", "hint")


def severity_weight(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "error", 100).when(s == "warning", 50).when(s == "info", 20).when(s == "hint", 10).otherwise(30)


def severity_rank(severity: Column) -> Column:
    """0 for error up to 3 for hint, 4 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int"), F.lit(0)) - 1 + F.when(severity.isin(*SEVERITIES), 0).otherwise(5)


def proximity(line: Column, start: Column, end: Column, touched: Column | None = None) -> Column:
    """100 on a touched line, less with the distance, 0 from 50 lines away; 50 if nothing is known (start below 0)."""
    box = F.when(start < 0, F.lit(None)).when(line < start, start - line).when(line > end, line - end).otherwise(0)
    away = box if touched is None else F.when(F.size(touched) > 0, F.array_min(F.transform(touched, lambda t: F.abs(t - line)))).otherwise(box)
    return F.when(away.isNull(), F.lit(50.0)).otherwise(F.greatest(F.lit(0.0), 100.0 * (1.0 - away / 50.0)))


def blast(radius: Column) -> Column:
    return F.when(radius <= 0, 0).when(radius == 1, 30).when(radius <= 3, 60).when(radius <= 10, 85).otherwise(100)


def fixability(has_fix: Column, fixes: Column) -> Column:
    return F.when(~has_fix, 0).when(fixes <= 0, 30).when(fixes == 1, 80).otherwise(100)


def age_penalty(age: Column) -> Column:
    return F.least(F.greatest(age, F.lit(0)) * 2, F.lit(20))


def total(severity: Column, near: Column, radius: Column, fix: Column, age: Column) -> Column:
    """0.40 severity + 0.25 proximity + 0.20 blast radius + 0.10 fixability - age, within 0 and 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(0.4) * severity + F.lit(0.25) * near + F.lit(0.2) * radius + F.lit(0.1) * fix - age))
