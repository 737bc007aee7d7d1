"""Sources: JSON lines in three degrees of tolerance, directories of systems, parallel texts, Markdown tables."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mezon.functions.text import normalize_apostrophes, strip

# The shapes of the tables.
SCHEMAS = {
    "corpus": "source STRING, domain STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>",
    "benchmark": "id STRING, section STRING, domain STRING, category STRING, en_text STRING, context_prev STRING, preserve ARRAY<STRING>, char_len INT, word_len INT",
    "refset": "id STRING, `set` STRING, domain STRING, en_text STRING, uz_text STRING",
    "candidate": "id STRING, system STRING, uz_text STRING, latency_ms BIGINT, error STRING",
    "scores": "id STRING, system STRING, score DOUBLE, n_chunks INT",
    "judged": "id STRING, system STRING, mqm DOUBLE, mqm_std DOUBLE, mqm_runs ARRAY<DOUBLE>, adequacy DOUBLE, fluency DOUBLE, errors ARRAY<STRUCT<category: STRING, severity: STRING, span: STRING>>, runs INT, error STRING",
    "chrf": "system STRING, n INT, chrf_pp DOUBLE, spbleu DOUBLE, degenerate INT",
}
_BAD = "_corrupt_record"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are skipped, a missing path gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, lines numbered from 0 in each file.

    A scan reads each split of a file in order, so a line's place in its split is its row id less the
    split's first; splits are few and their line counts are summed up before them.
    """
    ids = F.monotonically_increasing_id().alias("__id")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), ids, "value")
    splits = rows.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(splits.select("file", "__at", "__first", before.alias("__before")), ["file", "__at"]).select("file", (F.col("__before") + F.col("__id") - F.col("__first")).alias("line_no"), "value")


def read_reported(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines as file, line_no from 1, line) of JSON lines; blank lines are neither."""
    full = T._parse_datatype_string(schema).add(_BAD, "string")
    parse = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("x")
    good = spark.read.text(path).where(F.trim("value") != "").select(parse).where(f"x.{_BAD} IS NULL").select("x.*").drop(_BAD)
    bad = numbered_lines(spark, path).where(F.trim("value") != "").select("file", "line_no", "value", parse).where(f"x.{_BAD} IS NOT NULL")
    return good, bad.select("file", (F.col("line_no") + 1).alias("line_no"), F.col("value").alias("line"))


def read_systems(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """Every ``*.jsonl`` of a directory; the file's stem is the system, whatever the rows say."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(directory)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    return rows.withColumn("system", F.url_decode(stem))


def read_ordinal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of one file with ``dialogue_idx``, the line's number from 0."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("dialogue_idx"), F.from_json("value", schema).alias("x")).select("dialogue_idx", "x.*")


def _clean_pairs(df: DataFrame, name: str, domain: str) -> DataFrame:
    """Stripped pairs with both sides, target apostrophes normal, ids of the original position."""
    pairs = df.select("pos", strip(F.col("en")).alias("en_text"), normalize_apostrophes(strip(F.col("uz"))).alias("uz_text"))
    return pairs.where("en_text != '' AND uz_text != ''").select(
        F.format_string(f"{name}-%05d", "pos").alias("id"), F.lit(name).alias("set_name"), F.lit(domain).alias("domain"), "en_text", "uz_text"
    )


def read_parallel(spark: SparkSession, en_path: str, uz_path: str, name: str, domain: str = "news", limit: int | None = None) -> DataFrame:
    """Two text files zipped by line; the longer one is cut, with a warning."""

    def lines(path: str, side: str) -> DataFrame:
        return numbered_lines(spark, path).select(F.col("line_no").alias("pos"), F.col("value").alias(side))

    en, uz = lines(en_path, "en"), lines(uz_path, "uz")
    n, m = en.count(), uz.count()
    if n != m:
        warnings.warn(f"{name}: {n} and {m} lines; the longer file is cut", stacklevel=2)
    out = _clean_pairs(en.join(uz, "pos"), name, domain)
    return out.orderBy("id").limit(limit) if limit else out


def read_pairs(rows: DataFrame, name: str, en: str = "translation.en", uz: str = "translation.uz", position: str = "pos", domain: str = "news") -> DataFrame:
    """Pairs from a table with (nested) columns and an ordinal."""
    return _clean_pairs(rows.select(F.col(position).alias("pos"), F.col(en).alias("en"), F.col(uz).alias("uz")), name, domain)


def first_that_works(*makes: Callable[[], DataFrame]) -> DataFrame:
    """The first table that can be made; the last failure if none can. Earlier failures give a warning."""
    for n, make in enumerate(makes, 1):
        try:
            return make()
        except Exception as e:  # noqa: BLE001 - the next source is the answer to any failure
            if n == len(makes):
                raise
            warnings.warn(f"source {n} failed, trying the next: {str(e)[:80]}", stacklevel=2)
    raise ValueError("no source given")


def read_flores(load: Callable[[str], DataFrame], limit: int | None = None) -> DataFrame:
    """The paired configuration, else two single languages zipped by position; ``load(config)`` gives rows with ``pos``."""

    def zipped() -> DataFrame:
        side = lambda config, to: load(config).select("pos", F.col("sentence").alias(to))
        return read_pairs(side("eng_Latn", "en").join(side("uzn_Latn", "uz"), "pos"), "flores", "en", "uz", domain="wiki")

    out = first_that_works(lambda: read_pairs(load("eng_Latn-uzn_Latn"), "flores", "sentence_eng_Latn", "sentence_uzn_Latn", domain="wiki"), zipped)
    return out.orderBy("id").limit(limit) if limit else out


def read_xwmt(load: Callable[[str], DataFrame], limit: int | None = None) -> DataFrame:
    """Nested pairs of one configuration, else of the reversed one."""
    out = first_that_works(*(lambda c=c: read_pairs(load(c), "xwmt", domain="talks_news") for c in ("en-uz", "uz-en")))
    return out.orderBy("id").limit(limit) if limit else out


def read_all(sources: dict[str, Callable[[], DataFrame]], only: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables, errors) by name; a source that fails does not stop the others."""
    done, failed = {}, {}
    for name, make in sources.items():
        if only and name not in only:
            continue
        try:
            done[name] = make()
        except Exception as e:  # noqa: BLE001 - the point is to go on
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return done, failed


def read_markdown_table(spark: SparkSession, path: str, header: str, known: list[str], cells: int = 9) -> DataFrame:
    """(system, cells) of the table rows below the section ``header`` that have at least ``cells`` cells and a known system."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\n")).alias("n", "line"))
    heads = lines.where(F.startswith("line", F.lit("## ")))
    start = heads.where(F.startswith("line", F.lit(header))).agg(F.min("n").alias("a"))
    end = heads.join(F.broadcast(start)).where("n > a").agg(F.min("n").alias("b"))
    inside = lines.join(F.broadcast(start)).join(F.broadcast(end)).where("n > a AND (b IS NULL OR n < b)").where(F.startswith(F.trim("line"), F.lit("|")))
    split = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = inside.select("n", split.alias("cells")).where(F.size("cells") >= cells)
    system = F.regexp_replace(F.get("cells", F.lit(0)), r"[`*]", "")
    return rows.withColumn("system", system).where(F.col("system").isin(known)).orderBy("n").select("system", "cells")


def setting(name: str, env_file: str = ".env", default: str | None = None) -> str | None:
    """A setting of the process, else of a KEY=value file with comments and quotes."""
    if name in os.environ:
        return os.environ[name]
    p = Path(env_file)
    for line in p.read_text().splitlines() if p.is_file() else ():
        key, sep, value = line.strip().partition("=")
        if sep and not key.startswith("#") and key.strip() == name:
            return value.strip().strip("'\"")
    return default
