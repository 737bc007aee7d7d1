import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings corpus benchmark refset candidate xcomet_qe chrf_flores".split()
SMALL = "/root/testdata/sf0.001"
CORE = {k: v for k, v in entry.oracle_sql().items() if not re.match(r"p[124-9]_", k)}


def tidy(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    f = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(f(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    r = duck.execute(CORE[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert tidy([tuple(x) for x in df.collect()], df.columns) == tidy(r.fetchall(), cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_masking_round_trip(spark):
    df = entry.queries()["masked_segments"](spark, SMALL)
    assert df.where("NOT restored").count() == 0


def test_plans_stay_in_the_jvm(spark):
    for name in ("gate_summary", "paired_mean", "chunk_sentences", "build_benchmark", "latest_candidate"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan, name
    scan = entry.queries()["overall_mean"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(score)]" in scan and "n_chunks" not in scan


def test_short_edge_turns_stay(spark, tmp_path):
    texts = ["Damn!", "Fine, thanks", "ORDERID please", "one two three", "shit " * 401]
    schema = "dialogue_idx long, source string, domain string, messages array<struct<role:string,content:string>>"
    spark.createDataFrame([(0, "s", "d", [("user", t) for t in texts])], schema).write.parquet(str(tmp_path / "corpus.parquet"))
    for name in ("length_filter", "dedupe_first_text"):
        assert sorted(r["turn_idx"] for r in entry.queries()[name](spark, str(tmp_path)).collect()) == [0, 2, 3], name
