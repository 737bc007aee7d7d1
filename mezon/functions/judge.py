"""Reading and scoring a judge's answers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Penalties by severity, the floor, and the shape of an answer.
WEIGHTS, FLOOR = {"critical": 10, "major": 5, "minor": 1}, -25.0
ANSWER = "struct<errors:array<struct<category:string,severity:string,span:string>>,adequacy:int,fluency:int>"


def mqm_score(errors: Column) -> Column:
    """Minus the summed penalties, not below the floor; unknown severities cost 1, no errors 0."""

    def weight(e: Column) -> Column:
        s = F.lower(F.coalesce(e["severity"], F.lit("")))
        return F.when(s == "critical", WEIGHTS["critical"]).when(s == "major", WEIGHTS["major"]).otherwise(1)

    total = F.aggregate(F.transform(F.coalesce(errors, F.array().cast("array<struct<category:string,severity:string,span:string>>")), weight), F.lit(0), lambda a, x: a + x)
    return F.greatest(F.lit(FLOOR), F.lit(0.0) - total.cast("double"))


def balanced_object(text: str) -> str | None:
    """The first ``{...}`` whose braces balance outside of strings, or None."""
    start = text.find("{")
    while start >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(text, start)
            return text[start:end]
        except ValueError:
            start = text.find("{", start + 1)
    return None


@F.pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: balanced_object(t) if t else None)


def unfence(c: Column) -> Column:
    """Without a surrounding code fence."""
    return F.regexp_replace(c, "(?is)^\\s*```(?:json)?\\s*|\\s*```\\s*$", "")


def parse_answer(c: Column) -> Column:
    """The answer as a struct: the whole text, else the first balanced object in it; null if neither parses.

    Only answers that do not parse as they are go through Python.
    """
    text = unfence(c)
    whole = F.from_json(text, ANSWER, {"mode": "PERMISSIVE"})
    fine = F.coalesce(whole["errors"].isNotNull() | whole["adequacy"].isNotNull() | whole["fluency"].isNotNull(), F.lit(False))
    return F.when(fine, whole).otherwise(F.from_json(_first_object(F.when(~fine, text)), ANSWER, {"mode": "PERMISSIVE"}))
