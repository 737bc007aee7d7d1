"""Repetition inside single texts.

Two figures per text. The probability that at least half of a text repeats what stands earlier in it
comes from a logistic regression over hashed word and character n-grams, each n-gram counted under how
often it occurs in the text; it is trained on labelled quality rows and calibrated on rows held out from
training (Platt scaling). The repeated share is exact: the share of letters that lie in passages of at
least ``PASSAGE`` letters which occurred earlier in the same text; case, punctuation, spacing,
apostrophes, script and numbers make no difference.

Texts are scored in Arrow batches. Those whose probability reaches a fixed threshold are measured
exactly, and of these the ones at or above the wanted share are reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezon.functions.pytext import latin
from mezon.session import cut, shuffle_partitions

#: Letters of the shortest passage that counts as repeated.
PASSAGE = 10
BUCKETS = 512
WORD_GRAMS, CHAR_GRAMS = (1, 2, 4), (8, 16)
#: Groups of labelled rows, rows and their greatest length in characters that training looks at. This
#: bounds the fit only; every text is scored whole.
SAMPLE_GROUPS, SAMPLE_ROWS, SAMPLE_CHARS = 64, 2000, 20_000
#: Rows that the labelled ones are varied to.
TRAINING_ROWS = 4000
#: Texts from this probability on are measured exactly.
THRESHOLD = 0.1

_WORD = regex.compile(r"\p{L}+")


def letters(text: str) -> list[str]:
    """Words of letters in normal form; numbers and marks are left out."""
    return _WORD.findall(latin(text))


def repeated_share(words: list[str], passage: int = PASSAGE) -> float:
    """Share of the letters that lie in passages which began earlier in the text; overlapping ones count.

    A passage of at least ``passage`` letters repeats if and only if each of its windows of that
    length does, so windows are enough. Linear in the length of the text.
    """
    s = "".join(words)
    seen: set[str] = set()
    end = covered = 0
    for i in range(len(s) - passage + 1):
        gram = s[i : i + passage]
        if gram in seen:
            covered += i + passage - max(i, end)
            end = i + passage
        else:
            seen.add(gram)
    return covered / len(s) if s else 0.0


def features(words: list[str]) -> np.ndarray:
    """Hashed n-grams: bucket of (kind, n, how often the n-gram occurs, from 5 on by powers of two), as shares of all n-grams."""
    out = np.zeros(BUCKETS)
    s = "".join(words)
    for kind, sizes, seq in (("w", WORD_GRAMS, words), ("c", CHAR_GRAMS, s)):
        for n in sizes:
            total = len(seq) - n + 1
            if total < 1:
                continue
            grams = Counter(zip(*(seq[j:] for j in range(n)))) if kind == "w" else Counter(s[j : j + n] for j in range(total))
            by = Counter()
            for c in grams.values():
                by[c if c < 5 else 2 + c.bit_length()] += c
            for level, c in by.items():
                out[xxhash.xxh32_intdigest(f"{kind}{n}:{level}") % BUCKETS] += c / total
    return out


class Regression:
    """Logistic regression with calibration; without labelled rows of both kinds every text gets probability 1."""

    def __init__(self, weights: np.ndarray | None = None, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.slope, self.offset = weights, slope, offset

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
        columns, used = x.shape[1], np.flatnonzero(np.abs(x).sum(axis=0))
        x, w = x[:, used], np.zeros(len(used))
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        out = np.zeros(columns)
        out[used] = w
        return out

    @classmethod
    def train(cls, texts: list[str], labels: list[bool]) -> Regression:
        y = np.array(labels, float)
        held = np.arange(len(y)) % 3 == 0
        if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
            return cls()
        x = np.column_stack([np.array([features(letters(t)) for t in texts]), np.ones(len(texts))])
        w = cls._newton(x[~held], y[~held], 0.01)
        z = x[held] @ w
        # Platt's targets keep the calibrated probabilities off 0 and 1
        pos, neg = y[held].sum(), (1 - y[held]).sum()
        target = np.where(y[held] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        slope, offset = cls._newton(np.column_stack([z, np.ones(len(z))]), target, 1e-3)
        return cls(w, float(slope), float(offset))

    def probability(self, words: list[str]) -> float:
        if self.weights is None:
            return 1.0
        z = features(words) @ self.weights[:-1] + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))))


def labelled_rows(answers: DataFrame, references: DataFrame, counts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Texts of labelled quality rows, at most ``sample_rows``.

    ``answers``: run_id, system, segment, ord, text; ``references``: segment, reference;
    ``counts``: run_id, system, degenerate. Rows come from at most ``SAMPLE_GROUPS`` groups (run and
    system), drawn by a hash, whose number of kept answers longer than 200 characters and than three
    times their reference is the count given: there text and label belong together.
    """
    groups = (
        counts.where("degenerate IS NOT NULL").groupBy("run_id", "system").agg(F.min("degenerate").alias("lo"), F.max("degenerate").alias("hi"))
        .orderBy(F.xxhash64("run_id", "system"), "run_id", "system").limit(SAMPLE_GROUPS)
    )
    # the drawn groups are few by the limit above
    kept = (
        answers.join(F.broadcast(groups), ["run_id", "system"]).where(F.length(F.trim("text")) > 0).join(references, "segment")
        .groupBy("run_id", "system", "segment").agg(F.max_by("text", "ord").alias("text"), F.max(F.length("reference")).alias("ref"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .withColumn("bad", (F.length("text") > 200) & (F.length("text") > 3 * F.col("ref")))
    )
    kept = cut(kept)
    agreed = kept.groupBy("run_id", "system").agg(F.count_if("bad").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n = lo AND n = hi")
    sure = kept.join(agreed.select("run_id", "system"), ["run_id", "system"], "left_semi").where(F.length("text") <= SAMPLE_CHARS)
    return [r[0] for r in sure.select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(sample_rows).collect()]


def training_set(texts: list[str]) -> tuple[list[str], list[bool]]:
    """The texts, and each with some of its words said again, labelled by whether half of it repeats.

    The added rows give every table both kinds and rows near the boundary, whatever it holds; a short
    list of texts is varied more often.
    """
    rows = set(texts)
    for v in range(min(12, -(-TRAINING_ROWS // max(len(texts), 1)))):
        for t in texts:
            w = t.split()
            h = xxhash.xxh64_intdigest(t, v)
            a = h % max(len(w), 1)
            few, times, at = (h >> 12) % 2, 1 + (h >> 32) % 4, (h >> 40) % 3
            # some passages of many words a few times over, and one or two words run together many times
            n = 1 + (h >> 16) % (2 if few else max(len(w) - a, 1))
            again = ["".join(w[a : a + n]) * times**3] if few else w[a : a + n] * times
            rows.add(" ".join(again + w if at == 0 else w[: a + n] + again + w[a + n :] if at == 1 else w + again))
    ordered = sorted(rows, key=lambda t: (xxhash.xxh64_intdigest(t, 99), t))
    return ordered, [repeated_share(letters(t)) >= 0.5 for t in ordered]


def measure(df: DataFrame, key: str, text: str, model: Regression, threshold: float | None = None) -> DataFrame:
    """(``key``, probability, repeated_share) of every row with a text.

    With a ``threshold``, texts below it are scored but not measured (their share is null). A null
    text gives no row; a text without letters has share 0. Repeated rows give repeated results.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    # answers repeat across systems and runs: each text is scored once, copies are combined before the shuffle
    texts = rows.select("t").distinct().select(F.sha2("t", 256).alias("h"), "t")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                w = letters(t)
                p = m.probability(w)
                out.append((p, repeated_share(w) if threshold is None or p >= threshold else None))
            p, s = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(s, pa.float64())], names=["h", "probability", "repeated_share"])

    scored = texts.repartition(shuffle_partitions(df.sparkSession), "h").mapInArrow(run, "h string, probability double, repeated_share double")
    return rows.select("k", F.sha2("t", 256).alias("h")).join(scored, "h").select(F.col("k").alias(key), "probability", "repeated_share")
