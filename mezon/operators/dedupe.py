"""The deduplication policies. Each orders ties by what it is given, so results do not depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mezon.functions.text import strip, text_key


def latest_answer(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Last row with text per key; where none has text, the first row.

    As an aggregate: partial results are combined before the shuffle, so repeated keys stay cheap.
    """
    full = F.coalesce(strip(F.col(text)) != "", F.lit(False))
    rank = F.struct(full.alias("full"), F.when(full, F.col(order)).otherwise(-F.col(order)).alias("rank"))
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    best = df.groupBy(*keys).agg(F.max_by(row, rank).alias("__row"))
    return best.select(*keys, "__row.*")


def last_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key even if empty, with the number of rows it replaces."""
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("__row"), (F.count("*") - 1).alias("n_replaced")).select(*keys, "__row.*", "n_replaced")


def last_text(df: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Last non-empty text per key; white space alone counts as text."""
    return df.where(F.col(text) != "").groupBy(*keys).agg(F.max_by(text, order).alias(text))


def last_score(df: DataFrame, keys: list[str], score: str, order: Column) -> DataFrame:
    """Last score per key among rows that have one."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.max_by(score, order).alias(score))


def first_text(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """First row of every text, texts compared by ``text_key``."""
    row = F.struct(*df.columns)
    best = df.groupBy(text_key(F.col(text)).alias("__key")).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return best.select("__row.*")
