"""Keyword routing expressions (R1-R4) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.constants import (
    LEAD_CONTEXT, LEAD_PHRASE, LEAD_WORDS, MONTH_WORDS, QUESTION_YEARS, ROUTE_RULES,
)


def _any(lowered: Column, words) -> Column:
    out = None
    for w in words:
        hit = lowered.contains(w)
        out = hit if out is None else (out | hit)
    return out


def route(text: Column) -> Column:
    """The first matching rule's route name, null when none matches."""
    low = F.lower(text)
    expr = None
    for name, groups in ROUTE_RULES:
        cond = None
        for g in groups:
            hit = _any(low, g)
            cond = hit if cond is None else (cond & hit)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    lead = low.contains(LEAD_PHRASE) | (_any(low, LEAD_WORDS) & low.contains(LEAD_CONTEXT))
    return expr.when(lead, F.lit("lead"))


def extract_month(text: Column) -> Column:
    """R2: number of the first month (calendar order) named anywhere in the text."""
    low = F.lower(text)
    expr = None
    for i, m in enumerate(MONTH_WORDS):
        expr = (F.when(low.contains(m), F.lit(i + 1)) if expr is None
                else expr.when(low.contains(m), F.lit(i + 1)))
    return expr.cast("int")


def extract_year(text: Column) -> Column:
    """First year of the searched range that appears in the text."""
    expr = None
    for y in QUESTION_YEARS:
        expr = (F.when(text.contains(str(y)), F.lit(y)) if expr is None
                else expr.when(text.contains(str(y)), F.lit(y)))
    return expr.cast("int")


def extract_hotel(text: Column) -> Column:
    """R4: 'resort' -> Resort Hotel, else 'city' -> City Hotel, else null."""
    low = F.lower(text)
    return (F.when(low.contains("resort"), F.lit("Resort Hotel"))
            .when(low.contains("city"), F.lit("City Hotel")))
