"""Structural gates of an answer against its source, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mezon.functions.text import let, strip, words

# English function words that hardly survive a translation.
STOP_WORDS = "the and you your for with that this have will please can are our not from would could should".split()
LEAK_HITS, LEN_LOW, LEN_HIGH, LOOP_WORDS, LOOP_TIMES = 3, 0.3, 3.0, 8, 4


def english_leak(c: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z']+"), F.lit(0))
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, STOP_WORDS)))) >= LEAK_HITS


def degenerate(c: Column) -> Column:
    """At least 8 words, and some run of three words occurs at least 4 times (sorted hashes of the runs, so n log n)."""

    def repeats(runs: Column) -> Column:
        ends = F.sequence(F.lit(0), F.greatest(F.size(runs) - LOOP_TIMES, F.lit(0)))
        return F.coalesce(F.exists(ends, lambda i: F.get(runs, i) == F.get(runs, i + LOOP_TIMES - 1)), F.lit(False))

    def loops(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) < LOOP_WORDS, False).otherwise(let(F.sort_array(runs), repeats))

    return let(words(c), loops)


def entity_keep(c: Column, preserve: Column) -> Column:
    """Share of the entities that the text contains; null if there are none."""
    kept = F.size(F.filter(preserve, lambda e: F.contains(c, e)))
    return F.when(F.size(preserve) > 0, kept / F.size(preserve))


def detector_of(language_of: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A leak gate from a language detector: an answer leaks if the detector names English. Runs in Arrow batches."""

    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and (language_of(t) or "").lower() in ("en", "english"))

    return leaks


def lingua_detector() -> Callable[[Column], Column] | None:
    """The leak gate by the lingua library; None where it is not installed."""
    try:
        from lingua import Language, LanguageDetectorBuilder
    except ImportError:
        return None
    built: list = []

    def language_of(text: str) -> str | None:
        if not built:  # once per worker
            built.append(LanguageDetectorBuilder.from_languages(Language.ENGLISH, Language.UZBEK).build())
        found = built[0].detect_language_of(text)
        return found.name if found else None

    return detector_of(language_of)


def gates(source: Column, answer: Column, preserve: Column, leak: Callable[[Column], Column] = english_leak) -> dict[str, Column]:
    """All gates by name; null texts count as empty. ``leak`` may be that of a language detector."""
    uz, en = strip(F.coalesce(answer, F.lit(""))), strip(F.coalesce(source, F.lit("")))
    ratio = F.coalesce(F.try_divide(F.length(uz), F.length(en)), F.lit(0.0))
    return {
        "empty": uz == "",
        "copy_through": (uz != "") & (F.lower(uz) == F.lower(en)),
        "cyrillic": F.rlike(uz, F.lit("[Ѐ-ӿ]")),
        "english_leak": leak(uz),
        "entity_keep": entity_keep(uz, preserve),
        "len_ratio": F.round(ratio, 3),
        "len_outlier": (uz != "") & ((ratio < LEN_LOW) | (ratio > LEN_HIGH)),
        "degenerate": degenerate(uz),
    }


def passes() -> Column:
    """Whether a row of gates passes; the length outlier is reported, not counted."""
    failed = F.col("empty") | F.col("copy_through") | F.col("cyrillic") | F.col("english_leak") | F.col("degenerate")
    return ~failed & (F.coalesce(F.col("entity_keep"), F.lit(1.0)) >= 1.0)
