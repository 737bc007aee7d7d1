"""Filling sequences of fixed capacity with texts, by minimum bin slack.

Only the histogram of lengths matters for the plan, and it has at most ``capacity`` entries whatever
the corpus holds. For one sequence, the longest remaining length is fixed and a subset-sum dynamic
program over a bitset picks, from the remaining multiset, the lengths whose sum comes closest to the
rest; backtracking gives how many of each. The pattern found is used for as many sequences as the
counts allow before the next one is computed, so the number of patterns does not grow with the corpus.

Items are then numbered within their length in parallel (salted by a hash bucket, so one frequent
length is no hot spot) and looked up in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mezon.session import cut, shuffle_partitions, spread

#: Lengths are numbered in at least so many independent buckets.
LEAST_BUCKETS = 16


def closest_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as near to ``room`` as possible, not above.

    Bit s of the bitset is set if sum s can be reached; counts are split into powers of two, so one
    length costs a logarithmic number of shifts. Lengths enter from the longest on until the room can
    be filled exactly, and backtracking takes the last ones only where it must: of equally good
    subsets one of long items is taken, so that short ones are left to fill gaps later.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if total >= take * length and not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= take * length
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of one sequence with their counts, number of such sequences), in order.

    Lengths must lie between 1 and ``capacity``.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("every length must lie between 1 and the capacity")
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        pattern = closest_subset({n: c for n, c in left.items() if c and n <= capacity - first}, capacity - first) if first < capacity else {}
        left[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


class Places:
    """Sequence number of the r-th item of a length, from a plan."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 1
        for pattern, times in patterns:
            for n, c in pattern.items():
                by.setdefault(n, []).append((used.get(n, 0), base, c))
                used[n] = used.get(n, 0) + c * times
            base += times
        self.by = {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in by.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Ranks count from 0; an item without length goes to sequence 1, where it takes no room."""
        out = np.ones(len(lengths), np.int64)
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            start, base, count = self.by[int(n)]
            k = np.searchsorted(start, ranks[at], side="right") - 1
            out[at] = base[k] + (ranks[at] - start[k]) // count[k]
        return out


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_pieces(df: DataFrame, key: str, text: str, capacity: int, tokenizer: str) -> DataFrame:
    """(k, piece_no, first_token, n_tokens): one row per text, or per piece of a text of more than ``capacity`` tokens.

    A null text counts as empty and has one piece of no tokens.
    """
    rows = spread(df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _tokenizer(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            for lo in range(0, len(texts), 256):
                n[lo : lo + 256] = [len(e) for e in enc.encode_batch(texts[lo : lo + 256], add_special_tokens=False)]
            pieces = np.maximum(1, -(-n // capacity))
            at = np.repeat(np.arange(len(n)), pieces)
            no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, n[at] - no * capacity)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(no + 1), pa.array(no * capacity), pa.array(size)], names=["k", "piece_no", "first_token", "n_tokens"]
            )

    return rows.mapInArrow(run, f"k {kind}, piece_no long, first_token long, n_tokens long")


def pack(df: DataFrame, key: str, text: str, capacity: int = 2048, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json") -> DataFrame:
    """(``key``, piece_no, first_token, n_tokens, seq_no) of every text.

    No text is split unless it has more tokens than ``capacity``; then its pieces hold ``capacity``
    tokens each and the rest. Sequences are numbered from 1. Null and empty texts have no tokens and
    are put in sequence 1. Rows that repeat a key are packed each for itself; an empty table gives no
    rows. ``tokenizer`` is the path of a public tokenizer file, readable on every executor.
    """
    pieces = cut(token_pieces(df, key, text, capacity, tokenizer))
    buckets = max(LEAST_BUCKETS, shuffle_partitions(df.sparkSession))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("k", "piece_no"), F.lit(buckets)))
    sizes = cut(salted.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in sizes.where("n_tokens > 0").groupBy("n_tokens").agg(F.sum("n")).collect()}
    places = df.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("n_tokens", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("k", "piece_no")) - 1
    ranked = salted.withColumn("inner", inner).join(offsets, ["n_tokens", "bucket"])
    slim = ranked.select("k", "piece_no", "first_token", "n_tokens", (F.col("inner") + F.col("offset")).alias("rank"))
    kind = slim.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = places.value.find(b.column(3).to_numpy(), b.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(seq)], names=["k", "piece_no", "first_token", "n_tokens", "seq_no"])

    return slim.mapInArrow(run, f"k {kind}, piece_no long, first_token long, n_tokens long, seq_no long").withColumnRenamed("k", key)
