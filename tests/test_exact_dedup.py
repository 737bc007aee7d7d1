import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mezon.operators.exact_dedup import QuotientTable, fixed_width, keep_once, permute, repeated_deliveries, segment_id

SCHEMA = "ord long, run_id long, system string, id string, uz_text string, kept string, shard int"


def keys():
    return [F.col("run_id"), F.col("system"), segment_id(F.col("id"))]


def brute(rows):
    by = {}
    for r in rows:
        if r[0] is None:
            continue
        seg = None if r[3] is None else "".join(r[3].replace("‑", "-").split()).lower()
        by.setdefault((r[1], r[2], seg), []).append(r)
    kept = set()
    for rs in by.values():
        full = [r[0] for r in rs if r[4] is not None and r[4].strip()]
        kept.add(max(full) if full else min(r[0] for r in rs))
    return {r[0] for r in rows if r[0] is not None} - kept


def test_against_brute_force(spark):
    rng = random.Random(5)
    ids = ["a-1", " A-1", "a‑1", "b-2", "B-2 ", "", None, "x" * 100, "x" * 101, "длинный-3"]
    texts = [None, "", " ", " \n", "ok", "​", "z" * 5000]
    rows = [(n, rng.choice([1, 2, None]), rng.choice(["s", "t", None, ""]), rng.choice(ids), rng.choice(texts), "k", 1) for n in range(600)]
    rows += rows[:20] + [(None, 1, "s", "a-1", "ok", "k", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in repeated_deliveries(df, keys(), "ord", "uz_text").collect()} == brute(rows)
    once = keep_once(df, keys(), "ord", "uz_text")
    assert once.columns == df.columns
    assert sorted(r[0] for r in once.collect()) == sorted({r[0] for r in rows if r[0] is not None} - brute(rows))


def test_one_message_holding_most_rows(spark):
    rows = [(n, 1, "s", "a-1", "t" if n % 2 else None, "k", 1) for n in range(3000)] + [(5000 + n, n + 10, "s", "a-1", "t", "k", 1) for n in range(50)]
    assert repeated_deliveries(spark.createDataFrame(rows, SCHEMA), keys(), "ord", "uz_text").count() == 2999


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_deliveries(df, keys(), "ord", "uz_text").count() == 0 and keep_once(df, keys(), "ord", "uz_text").count() == 0


def test_no_false_matches():
    """Every identifier is found where it was inserted, and no other is."""
    ids = [f"{n}".encode() for n in range(2000)] + [b"", b"\0", b"\0\0"]
    for at, lanes in fixed_width(ids).values():
        p = permute(lanes)
        assert len(np.unique(p, axis=0)) == len(at)
        t = QuotientTable(lanes.shape[1])
        t.insert(p[::2], np.arange(len(p))[::2], np.ones(len(p), bool)[::2], np.arange(len(p))[::2])
        t.settle()
        assert all(t.find(x) >= 0 for x in p[::2]) and all(t.find(x) < 0 for x in p[1::2])


def test_order_must_be_a_whole_number(spark):
    df = spark.createDataFrame([("a", "x", 1.5), ("a", "y", 1.6)], "id string, t string, ord double")
    with pytest.raises(TypeError, match="whole number"):
        repeated_deliveries(df, [F.col("id")], "ord", "t")
