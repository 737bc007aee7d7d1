"""Calling models from Spark: translation, scoring and judging as Arrow operators.

A model lives once per Python worker. Rows that fail give a row with an error, never a failed task, so
a run can be resumed by an anti-join on what succeeded. Filters belong before these operators: they are
not pushed through them.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezon.functions import text as tx
from mezon.functions.entities import mask, unmask, unrestored
from mezon.functions.judge import mqm_score, parse_answer
from mezon.models.registry import Spec, factory_of

_WORKER: dict = {}


class Fatal(Exception):
    """An error that another try cannot mend."""


class Throttle:
    """At most ``per_minute`` calls of this worker; 0 for no limit."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.next, self.clock, self.sleep = 60.0 / per_minute if per_minute else 0.0, 0.0, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def retried(call: Callable[[], str], tries: int = 4, cap: float = 30.0, sleep=time.sleep) -> str:
    """The result of ``call``, tried again with doubling, jittered pauses; client errors but 429 are fatal."""
    for n in range(tries):
        try:
            return call()
        except Fatal:
            raise
        except Exception as e:
            code = getattr(e, "code", getattr(e, "status_code", None))
            if n == tries - 1 or isinstance(code, int) and 400 <= code < 500 and code != 429:
                raise
            sleep(min(cap, 2.0**n) * (0.5 + random.random() / 2))
    raise AssertionError("unreachable")


def prompt_text(text: str, context: str | None) -> str:
    head = tx._CONTEXT + context + "\n\n" if context else ""
    return head + tx._TRANSLATE + text


def translate(df: DataFrame, spec: Spec, per_minute: float = 0, tries: int = 4, factory=None) -> DataFrame:
    """(id, system, uz_text, latency_ms, error) of rows id, en_text, context_prev.

    An empty generation is an error of its own kind. With a rate limit the rows are brought into one
    task, as the limit is the service's and not the worker's.
    """
    make = factory or factory_of(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, throttle = None, Throttle(per_minute)
        for pdf in batches:
            out = []
            for id_, text, context in zip(pdf["id"], pdf["en_text"], pdf["context_prev"]):
                began, answer, error = time.time(), "", None
                try:
                    if model is None:
                        name = (spec, getattr(make, "__qualname__", str(make)))
                        model = _WORKER[name] if name in _WORKER else _WORKER.setdefault(name, make(spec))

                    def once(t=text, c=context, m=model) -> str:
                        throttle.wait()  # every try counts against the limit
                        return m.translate(t, c)

                    answer = (retried(once, tries) or "").strip()
                    if not answer:
                        error = "EmptyGeneration: model returned no text"
                except Exception as e:  # noqa: BLE001 - a failed row must not fail the task
                    error = f"{type(e).__name__}: {str(e)[:300]}"
                out.append((id_, spec.key, answer, int(1000 * (time.time() - began)), error))
            yield pd.DataFrame(out, columns=["id", "system", "uz_text", "latency_ms", "error"])

    rows = df.select("id", "en_text", "context_prev")
    # a shuffle, so that what comes before stays parallel
    rows = rows.repartition(1) if per_minute else rows
    return rows.mapInPandas(run, "id string, system string, uz_text string, latency_ms long, error string")


def translate_sentences(df: DataFrame, id_col: str, text: str, batch: Callable[[list[str]], list[str]], target: str = "uz", cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) of texts translated sentence by sentence.

    Answers are (id, uz_text, n_dropped, has_cyrillic): how many entities the finished text lost and
    whether Cyrillic letters are left in it.

    Entities are masked, sentences made distinct, those in the cache left out, the rest sorted by
    length inside each task and translated in batches; then every text is put together again, its
    apostrophes made canonical and its entities restored.
    """
    masked = df.select(F.col(id_col), mask(F.col(text)).alias("m"))
    sents = masked.select(id_col, "m.entries", F.posexplode_outer(tx.sentences(F.col("m.masked"), line_breaks=False)).alias("pos", "s"))
    keyed = sents.withColumn("key", tx.cache_key(target, F.col("s")))
    todo = keyed.where("s IS NOT NULL").select("key", "s").distinct()
    if cache is not None:
        todo = todo.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "text": batch(pdf["s"].tolist())})

    fresh = todo.sortWithinPartitions(F.length("s")).mapInPandas(run, "key string, text string")
    known = fresh if cache is None else cache.select("key", "text").unionByName(fresh)
    joined = keyed.join(known, "key", "left").groupBy(id_col).agg(
        F.first("entries").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("raw")
    )
    whole = tx.strip(unmask(tx.normalize_apostrophes(F.col("raw")), F.col("entries")))
    done = joined.select(id_col, whole.alias("uz_text"), "entries")
    lost = F.size(unrestored(F.col("uz_text"), F.col("entries"))).alias("n_dropped")
    return done.select(id_col, "uz_text", lost, F.rlike("uz_text", F.lit("[Ѐ-ӿ]")).alias("has_cyrillic")), fresh


def score(chunks: DataFrame, predict: Callable[[list[dict]], list[float]], keys: list[str]) -> DataFrame:
    """(keys, score, n_chunks): a model's chunk scores recombined, weighted by the source's words.

    ``chunks``: keys, src, mt, ref. ``predict`` takes a batch of rows and is called once per Arrow batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["score"] = predict(pdf[["src", "mt", "ref"]].to_dict("records"))
            yield pdf[[*keys, "w", "score"]]

    w = F.greatest(F.lit(1), tx.word_count(F.col("src"))).cast("double").alias("w")
    types = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    scored = chunks.select(*keys, "src", "mt", "ref", w).mapInPandas(run, f"{types}, w double, score double")
    return scored.groupBy(*keys).agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("score"), F.count("*").alias("n_chunks"))


def judge(df: DataFrame, ask: Callable[[str], str], runs: int = 3, tries: int = 4, rubric: str = tx.JUDGE_RUBRIC) -> DataFrame:
    """(id, system, mqm, mqm_std, mqm_runs, adequacy, fluency, errors, runs, error) of rows id, system, en_text, uz_text, context_prev.

    Every row is asked ``runs`` times; ``rubric`` goes before the task ("" if ``ask`` sends it itself). The errors kept are those of the harshest run. A row without
    any usable answer has null figures and an error.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for p in pdf["prompt"]:
                try:
                    answers.append(retried(lambda p=p: ask(p), tries))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {str(e)[:300]}")
            yield pdf[["id", "system", "run"]].assign(answer=answers, error=errors)

    task = tx.judge_prompt(F.col("en_text"), F.col("uz_text"), F.col("context_prev"))
    prompt = (F.concat(F.lit(rubric + "\n\n"), task) if rubric else task).alias("prompt")
    asked = df.select("id", "system", prompt, F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    got = asked.repartition("id", "system", "run").mapInPandas(call, "id string, system string, run int, answer string, error string")
    a = got.withColumn("a", parse_answer(F.col("answer"))).withColumn("ok", F.col("a.errors").isNotNull())
    a = a.withColumn("mqm", F.when(F.col("ok"), mqm_score(F.col("a.errors"))))
    return a.groupBy("id", "system").agg(
        F.round(F.avg("mqm"), 3).alias("mqm"), F.round(F.stddev_pop("mqm"), 3).alias("mqm_std"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("run", "mqm")))), lambda x: x["mqm"]).alias("mqm_runs"),
        F.round(F.avg("a.adequacy"), 3).alias("adequacy"), F.round(F.avg("a.fluency"), 3).alias("fluency"),
        F.min_by(F.col("a.errors"), F.when(F.col("ok"), F.struct("mqm", "run"))).alias("errors"), F.count_if("ok").alias("runs"),
        F.when(F.count_if("ok") == 0, F.coalesce(F.max("error"), F.lit("ValueError: no usable answer"))).alias("error"),
    )


def preflight(specs: list[Spec], text: str = "Hello, how can I help you?") -> list[dict]:
    """One probe per system on the driver: ok if it answers with text."""
    out = []
    for spec in specs:
        began, answer, error = time.time(), "", None
        try:
            answer = factory_of(spec)(spec).translate(text, None).strip()
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {str(e)[:300]}"
        out.append({"system": spec.key, "ok": bool(answer), "answer": answer, "error": error, "seconds": round(time.time() - began, 3)})
    return out
