"""Joins and set operations over scores and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to do: resuming is an anti-join on what has been written."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def shared_ids(scores: DataFrame, n_systems: int | None = None) -> DataFrame:
    """Ids that every system has; the number of systems is counted from the data unless given."""
    per_id = scores.groupBy("id").agg(F.count_distinct("system").alias("n"))
    if n_systems is None:
        total = scores.agg(F.count_distinct("system").alias("total"))
        return per_id.join(F.broadcast(total), F.col("n") == F.col("total")).select("id")  # one row
    return per_id.where(F.col("n") == n_systems).select("id")


def paired(scores: DataFrame, baseline: str) -> DataFrame:
    """(system, id, score, base, diff) of every system's ids that the baseline has too."""
    base = scores.where(F.col("system") == baseline).select("id", F.col("score").alias("base"))
    both = scores.where(F.col("system") != baseline).join(base, "id")
    return both.withColumn("diff", F.col("score") - F.col("base"))


def pairs_of(scores: DataFrame, ranked: DataFrame) -> DataFrame:
    """(a, b, id, diff) of every pair of ranked systems, the better one first; ``ranked``: system, rank."""
    r = scores.join(ranked, "system")
    a = r.select(F.col("system").alias("a"), F.col("rank").alias("ra"), "id", F.col("score").alias("sa"))
    b = r.select(F.col("system").alias("b"), F.col("rank").alias("rb"), "id", F.col("score").alias("sb"))
    return a.join(b, "id").where("ra < rb").select("a", "b", "ra", "rb", "id", (F.col("sa") - F.col("sb")).alias("diff"))


def zip_by_position(left: DataFrame, right: DataFrame, position: str = "pos") -> DataFrame:
    """Rows with the same ordinal; the longer side is cut to the shorter."""
    return left.join(right, position)


def choose_systems(df: DataFrame, wanted: str | None, known: list[str]) -> DataFrame:
    """Rows of the named systems (comma list); all for None or 'all'. An unknown name raises ValueError."""
    if wanted in (None, "", "all"):
        return df.where(F.col("system").isin(known))
    names = [n.strip() for n in wanted.split(",") if n.strip()]
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown systems: {', '.join(unknown)}")
    return df.where(F.col("system").isin(names))
