"""Gates over arriving answers: a file stream, checked and appended exactly once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mezon.functions.gates import gates, passes
from mezon.operators.exact_dedup import segment_id


def answer_stream(spark: SparkSession, directory: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(directory)


def gate_stream(answers: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Streamed answers joined with the static benchmark by the segment their id names, with their gates."""
    rows = answers.withColumn("id", segment_id(F.col("id"))).join(benchmark.select("id", "en_text", "preserve"), "id")
    flags = gates(F.col("en_text"), F.col("uz_text"), F.col("preserve"))
    return rows.select("ord", "run_id", "system", "id", *(c.alias(n) for n, c in flags.items())).withColumn("passed", passes())


def first_copies(answers: DataFrame, time: str, keys: list[str], delay: str = "2 hours") -> DataFrame:
    """Each key once within the watermark; state of older keys is dropped."""
    return answers.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def pass_rates(gated: DataFrame, time: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Answers and passes per window and system."""
    return (
        gated.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
        .groupBy(F.window(time, window), "system").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to Parquet, one folder per micro-batch: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
