"""Queries of problem 3: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mezon.operators.exact_dedup import keep_once, repeated_deliveries, segment_id


def _keys():
    return [F.col("run_id"), F.col("system"), segment_id(F.col("id"))]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = spark.read.parquet(f"{sf_dir}/candidate.parquet").select("ord", "run_id", "system", "id", "uz_text")
    return repeated_deliveries(cand, _keys(), "ord", "uz_text")


def p3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = spark.read.parquet(f"{sf_dir}/candidate.parquet").select("ord", "run_id", "system", "id", "uz_text")
    once = keep_once(cand, _keys(), "ord", "uz_text")
    return once.select("ord", "run_id", "system", segment_id(F.col("id")).alias("segment"), "uz_text")


QUERIES = {"p3_found": p3_found, "p3_messages": p3_messages}

_KEPT = """
WITH c AS (
  SELECT ord, run_id, system, uz_text,
         lower(regexp_replace(regexp_replace(id, '[\\p{Pd}\\x{2212}\\x{00AD}]', '-', 'g'), '[\\s\\p{Z}\\p{Cf}\\p{Cc}]+', '', 'g')) AS segment,
         coalesce(regexp_replace(uz_text, '[\\s\\p{Z}\\x{0B}\\x{1C}-\\x{1F}\\x{85}]+', '', 'g') <> '', false) AS full_text
  FROM candidate),
r AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, system, segment
    ORDER BY full_text DESC, CASE WHEN full_text THEN -ord ELSE ord END) AS rn FROM c)
"""
ORACLE = {
    "p3_found": _KEPT + "SELECT ord FROM r WHERE rn > 1",
    "p3_messages": _KEPT + "SELECT ord, run_id, system, segment, uz_text FROM r WHERE rn = 1",
}
