"""Sinks: JSON lines, resumable appends, translation caches, reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mezon.operators.relational import pending


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite JSON lines; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys are not in ``path`` yet and return how many files' rows were new.

    Running it again after a failure writes only what is missing: a batch is committed as a whole.
    """
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).json(path)
        todo = pending(df, done, keys)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = df
    from mezon.session import cut

    todo = cut(todo)
    todo.write.mode("append").option("ignoreNullFields", "false").json(path)
    return todo.count()


def eta(seconds: float) -> str:
    """m:ss below an hour, h:mm:ss from there on; --:-- where nothing is known."""
    if not 0 <= seconds < float("inf"):
        return "--:--"
    minutes, s = divmod(int(seconds), 60)
    return f"{minutes // 60}:{minutes % 60:02d}:{s:02d}" if minutes >= 60 else f"{minutes}:{s:02d}"


def append_in_parts(todo: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, keys: list[str], parts: int = 20, report: Callable[[str], None] = print) -> int:
    """Run an expensive operator over the rows not in ``path`` yet, in parts by a hash of the keys, and report after each.

    A part is written before the next begins, so what has been done survives a failure; the number of
    rows written is returned. ``run`` must keep the key columns.
    """
    began, written = time.monotonic(), 0
    for n in range(parts):
        part = todo.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == n)
        try:
            part = pending(part, todo.sparkSession.read.json(path).select(*keys), keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNRESOLVED_COLUMN" not in str(e):
                raise
        written += append_new(run(part), path, keys)
        spent = time.monotonic() - began
        report(f"{n + 1}/{parts} parts, {written} rows, {eta(spent)} spent, {eta(spent / (n + 1) * (parts - n - 1))} to go")
    return written


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of a translation cache; empty if there is none."""
    from mezon.sources.readers import _exists

    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], "key string, text string")


def flush_cache(cache: DataFrame, path: str) -> None:
    from mezon.session import cut

    cut(cache.dropDuplicates(["key"])).write.mode("overwrite").parquet(path)


def write_text(text: str, path: str) -> None:
    Path(path).write_text(text, encoding="utf-8")
