"""Paired statistics. Resampling is seeded by hashes, so every engine and every plan draws the same samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mezon.session import spread

ITERATIONS, SEED = 1000, 13


#: Poisson(1): a draw of u from [0, 1) gives as many as there are bounds not above it.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


#: Groups whose sums one task holds before it passes them on.
HELD_GROUPS = 1000


def _samples(df: DataFrame, group: list[str], value: str, order: str, iterations: int, seed: int) -> DataFrame:
    """(group, it, n, m): mean of every resample.

    Resampling is by independent Poisson weights per row and iteration, the distributed form of
    drawing with replacement: no group is gathered anywhere. Each task adds up one weighted sum per
    group and iteration, so what is shuffled is groups times iterations, whatever the number of rows.
    Weights depend on seed, group, ``order`` (a unique id in the group) and iteration: one md5 serves four iterations.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.concat_ws("|", *group).alias("g"), F.col(order).cast("string").alias("o"), F.col(value).cast("double").alias("v"), *group)
    blocks = [str(b).encode() for b in range(-(-iterations // 4))]
    bounds = np.array(POISSON)

    def weights(g: str, o: str | None) -> np.ndarray:
        # as concat_ws: a null order is left out with its separator
        start = hashlib.md5(f"{seed}:{g}:{o}:".encode() if o is not None else f"{seed}:{g}:".encode())
        digests = []
        for b in blocks:
            h = start.copy()
            h.update(b)
            digests.append(h.digest())
        u = np.frombuffer(b"".join(digests), ">u4")[:iterations] / float(1 << 32)
        return np.searchsorted(bounds, u, side="right").astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []

        def passed_on() -> pa.RecordBatch:
            keys = list(zip(*held)) if held else [()] * len(group)
            cols = [pa.array(k, t) for k, t in zip(keys, kinds)]
            n, w, s = (list(x) for x in zip(*held.values())) if held else ([], [], [])
            sums = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(w, sums), pa.array(s, sums)], names=[*group, "n", "w", "s"])

        for batch in batches:
            kinds = [batch.column(i).type for i in range(3, batch.num_columns)]
            for g, o, v, *key in zip(*(c.to_pylist() for c in batch.columns)):
                w, at = weights(g, o), tuple(key)
                if at in held:
                    one = held[at]
                    one[0] += 1
                    one[1] += w
                    one[2] += w * v
                else:
                    held[at] = [1, w, w * v]
            if len(held) > HELD_GROUPS:
                yield passed_on()
                held.clear()
        if held:
            yield passed_on()

    schema = T.StructType([*(rows.schema[c] for c in group), *T._parse_datatype_string("n bigint, w array<double>, s array<double>")])
    parts = spread(rows).mapInArrow(run, schema)
    each = parts.select(*group, "n", F.posexplode(F.arrays_zip("w", "s")).alias("it", "x"))
    sums = each.groupBy(*group, "it").agg(F.sum("n").alias("n"), F.sum("x.w").alias("w"), F.sum("x.s").alias("s"))
    return sums.where("w > 0").select(*group, "it", "n", (F.col("s") / F.col("w")).alias("m"))


def bootstrap_ci(df: DataFrame, group: list[str], value: str, order: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """95 % interval of the mean from order statistics; null for fewer than two values."""
    means = _samples(df, group, value, order, iterations, seed)
    # at most ``iterations`` means are gathered per group
    at = lambda q: F.round(F.get(F.array_sort(F.collect_list("m")), F.lit(int(q * iterations))), 4)
    big = F.max("n") >= 2
    return means.groupBy(*group).agg(F.when(big, at(0.025)).alias("ci_low"), F.when(big, at(0.975)).alias("ci_high"))


def paired_p(diffs: DataFrame, group: list[str], order: str = "id", iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """One-sided p: share of resampled mean differences at or below 0; 1 if the sum is not positive, null for fewer than two pairs."""
    totals = diffs.groupBy(*group).agg(F.count("*").alias("n"), F.sum("diff").alias("total"))
    live = diffs.join(totals.where("n >= 2 AND total > 0").select(*group), group, "left_semi")
    p = _samples(live, group, "diff", order, iterations, seed).groupBy(*group).agg(F.round(F.avg((F.col("m") <= 0).cast("double")), 4).alias("p"))
    value = F.when(F.col("n") < 2, None).when(F.col("total") <= 0, 1.0).otherwise(F.col("p"))
    return totals.join(p, group, "left").select(*group, value.alias("p"))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: null for fewer than two points or no variance, rounded to 4 places."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count_if(x.isNotNull() & y.isNotNull()) >= 2, F.round(r, 4))


def average_rank(value: str, partition: list[str] | None = None) -> Column:
    """1-based rank in which equal values share the mean of their places. Null values rank among themselves first."""
    keys = [F.col(c) for c in partition or []]
    ties = F.count("*").over(Window.partitionBy(*keys, F.col(value)))
    return F.rank().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value)) + (ties - 1) / 2


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``spearman``: Pearson of average ranks. Meant for per-system figures, ranked in one task."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = both.select(average_rank(x).alias("rx"), average_rank(y).alias("ry"))
    return ranks.agg(pearson(F.col("rx"), F.col("ry")).alias("spearman"))


def label(p: Column, system: Column | None = None, baseline: str | None = None) -> Column:
    """'*' behind a p below 0.05, a dash for null, 'baseline' for the baseline itself."""
    text = F.when(p.isNull(), "—").when(p < 0.05, F.concat(p.cast("string"), F.lit("*"))).otherwise(p.cast("string"))
    return text if system is None else F.when(system == baseline, "baseline").otherwise(text)
