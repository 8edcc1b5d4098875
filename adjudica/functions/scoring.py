"""Scores of findings. All inputs of the composite are whole numbers, so it is computed from them exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def lookup(column: Column, table: dict[str, int] | dict[str, str], default=None) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def severity_level(severity: Column) -> Column:
    return lookup(severity, vocab.SEVERITY_LEVEL, 1)


def severity_score(severity: Column) -> Column:
    return lookup(severity, vocab.SEVERITY_SCORE, 10)


def confidence_score(confidence: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), half_up(confidence * 100))).cast("int")


def evidence_strength(n: Column, files: Column, tight: Column) -> Column:
    """By the number of items and of distinct files, and whether every span has 10 lines at most."""
    base = F.when(n == 0, 0).when(n == 1, 40).when(n == 2, 70).otherwise(90)
    bonus = F.when(files >= 2, 10).otherwise(0) + F.when(tight, 5).otherwise(0)
    return F.when(n == 0, 0).otherwise(F.least(F.lit(100), base + bonus)).cast("int")


def blast_radius(dependents: Column) -> Column:
    return F.least(F.lit(100), half_up(10 + 90 * F.least(F.lit(1.0), F.log2(dependents + 1) / 4))).cast("int")


def security_impact(category: Column, severity: Column, text: Column) -> Column:
    words = r"(?i)(?<![A-Za-z0-9_])(" + "|".join(vocab.SECURITY_WORDS) + r")(?![A-Za-z0-9_])"
    return F.when(category == "security", lookup(severity, vocab.SECURITY_IMPACT, 0)).when(text.rlike(words), 15).otherwise(0)


def regression_probability(category: Column, blast: Column) -> Column:
    return F.least(F.lit(100), lookup(category, vocab.REGRESSION_BASE, 30) + F.when(blast >= 50, 15).otherwise(0))


def composite(severity: Column, confidence: Column, evidence: Column, blast: Column, impact: Column, regression: Column) -> Column:
    return (30 * severity + 20 * confidence + 15 * evidence + 15 * blast + 10 * impact + 10 * regression) / F.lit(100)


def tool_severity(tool: Column, raw: Column) -> Column:
    low = F.lower(raw)
    out = lookup(low, vocab.TOOL_SEVERITY[""], "info")
    for name, table in vocab.TOOL_SEVERITY.items():
        if name:
            out = F.when(tool == name, lookup(low, {k: v for k, v in table.items() if k}, table[""])).otherwise(out)
    ruff = F.when((low == "error") | low.startswith("e"), "critical").when((low == "warning") | low.startswith("w"), "medium").when(low.startswith("f"), "high").otherwise("info")
    return F.when(tool == "ruff", ruff).otherwise(out)


def validated_strength(valid: Column, total: Column, direct: Column, supporting: Column, indirect: Column, anchor: Column) -> Column:
    invalid = total - valid
    ratio = half_up(F.lit(10) * valid / total)
    s = 20 + F.when(direct, 40).otherwise(0) + F.least(F.lit(20), supporting * 10) + F.least(F.lit(10), indirect * 5) + ratio - invalid * 25
    return F.when((valid == 0) | ~anchor, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), s))).cast("int")


def backoff(attempt: Column, base: float = 1000, most: float = 30000) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
