"""Seeded samples: the order is a hash of seed and id, so a sample is the same on any plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 13


def order_of(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def reservoir(df: DataFrame, bucket: list[str], ids: list[str], cap: int = 3000, seed: int = SEED) -> DataFrame:
    """At most ``cap`` rows per bucket; a top-N window, so buckets are cut before the shuffle."""
    w = Window.partitionBy(*bucket).orderBy(order_of(seed, *ids), *ids)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap)


def stratified(df: DataFrame, n: int, categories: list[str], ids: list[str], seed: int = SEED, cap: int = 3000) -> DataFrame:
    """About ``n`` rows: the same quota per section, taken from the categories in turn.

    Exhausted categories are passed over, a section's shortfall is not made up elsewhere. An empty
    table gives no rows.
    """
    pool = reservoir(df, ["section", "category"], ids, cap, seed)
    place = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    turn = F.row_number().over(Window.partitionBy("section").orderBy("r", place, *ids))
    sections = df.agg(F.count_distinct("section").alias("__sections"))  # one row
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.col("__sections"), F.lit(1))))
    picked = pool.withColumn("__turn", turn).join(F.broadcast(sections)).where(F.col("__turn") <= quota)
    return picked.orderBy(order_of(seed, *ids), *ids).limit(n).drop("r", "__turn", "__sections")


def smoke_slice(df: DataFrame, n: int, ids: list[str], seed: int = SEED) -> DataFrame:
    """About ``n`` rows, the same number from every section."""
    w = Window.partitionBy("section").orderBy(order_of(seed, *ids), *ids)
    sections = df.agg(F.count_distinct("section").alias("__sections"))
    per = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.col("__sections"), F.lit(1))))
    picked = df.withColumn("__r", F.row_number().over(w)).join(F.broadcast(sections)).where(F.col("__r") <= per)
    return picked.orderBy(order_of(seed, *ids), *ids).limit(n).drop("__r", "__sections")


def sample_ids(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    return df.select("id").distinct().orderBy(order_of(seed, "id"), "id").limit(n)
