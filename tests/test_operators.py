import math
import random
from collections import Counter

from pyspark.sql import functions as F

from mezon.operators import dedupe, metrics, relational, sampling, stats


def test_latest_answer(spark):
    rows = [(1, "a", ""), (2, "a", "x"), (3, "a", " "), (4, "b", ""), (5, "b", None), (6, "c", "y"), (7, "c", "z")]
    df = spark.createDataFrame(rows, "ord long, id string, t string")
    assert {r["id"]: r["ord"] for r in dedupe.latest_answer(df, ["id"], "t", "ord").collect()} == {"a": 2, "b": 4, "c": 7}
    last = {r["id"]: (r["ord"], r["n_replaced"]) for r in dedupe.last_row(df, ["id"], "ord").collect()}
    assert last == {"a": (3, 2), "b": (5, 1), "c": (7, 1)}
    assert {r["id"]: r["t"] for r in dedupe.last_text(df, ["id"], "t", "ord").collect()} == {"a": " ", "c": "z"}
    assert dedupe.latest_answer(df.limit(0), ["id"], "t", "ord").count() == 0


def test_first_text(spark):
    df = spark.createDataFrame([(2, "A  b"), (1, "a B"), (3, "c")], "n int, t string")
    assert sorted(r["n"] for r in dedupe.first_text(df, "t", ["n"]).collect()) == [1, 3]


def test_relational(spark):
    s = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("b", "1", 0.5)], "system string, id string, score double")
    assert [r[0] for r in relational.shared_ids(s).collect()] == ["1"]
    assert relational.shared_ids(s.limit(0)).count() == 0
    assert [(r["system"], r["diff"]) for r in relational.paired(s, "b").collect()] == [("a", 0.5)]
    assert relational.pending(s, s.where("system = 'b'"), ["system", "id"]).count() == 2
    assert relational.choose_systems(s, "a", ["a", "b"]).count() == 2
    try:
        relational.choose_systems(s, "zz", ["a"])
        raise AssertionError
    except ValueError as e:
        assert "zz" in str(e)


def test_stratified_against_round_robin(spark):
    rng, cats = random.Random(3), ["x", "y", "z"]
    rows = [(f"i{n}", rng.choice(["s", "t"]), rng.choice(cats)) for n in range(80)]
    df = spark.createDataFrame(rows, "id string, section string, category string")
    import hashlib

    order = lambda i: (hashlib.md5(f"13:{i}".encode()).hexdigest(), i)
    want = set()
    for sec in ("s", "t"):
        pools = [sorted((r[0] for r in rows if r[1:] == (sec, c)), key=order) for c in cats]
        taken = 0
        while taken < 10 and any(pools):
            for p in pools:
                if p and taken < 10:
                    want.add(p.pop(0))
                    taken += 1
    assert {r["id"] for r in sampling.stratified(df, 20, cats, ["id"]).collect()} == want
    assert sampling.stratified(df.limit(0), 20, cats, ["id"]).count() == 0
    assert sampling.smoke_slice(df, 6, ["id"]).groupBy("section").count().collect()[0]["count"] == 3


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double")
    assert df.agg(stats.pearson(F.col("a"), F.col("b"))).first()[0] == 1.0
    assert df.withColumn("b", F.lit(1.0)).agg(stats.pearson(F.col("a"), F.col("b"))).first()[0] is None
    assert df.limit(1).agg(stats.pearson(F.col("a"), F.col("b"))).first()[0] is None
    ties = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double").select(stats.average_rank("v").alias("r"))
    assert sorted(r[0] for r in ties.collect()) == [1.0, 2.5, 2.5, 4.0]


def test_published_correlations(spark):
    """System means of QE and chrF++ of nine systems, and their published correlations."""
    qe = [0.8184, 0.8268, 0.8198, 0.8171, 0.8231, 0.7846, 0.8011, 0.7917, 0.2490]
    a = [48.9, 45.85, 46.14, 43.83, 42.92, 41.13, 43.7, 43.03, 17.21]
    b = [56.09, 44.21, 53.45, 49.05, 51.23, 45.44, 51.68, 51.23, 17.66]
    df = spark.createDataFrame([(q, (x + y) / 2) for q, x, y in zip(qe, a, b)], "q double, c double")
    assert abs(df.agg(stats.pearson(F.col("q"), F.col("c"))).first()[0] - 0.9715) < 2e-3
    assert abs(stats.spearman(df, "q", "c").first()[0] - 0.3833) < 2e-3


def test_bootstrap(spark):
    rng = random.Random(4)
    rows = [("a", str(n), rng.gauss(0.5, 0.1)) for n in range(300)] + [("b", "1", 1.0)]
    df = spark.createDataFrame(rows, "system string, id string, v double")
    got = {r["system"]: (r["ci_low"], r["ci_high"]) for r in stats.bootstrap_ci(df, ["system"], "v", "id").collect()}
    half = 1.96 * 0.1 / math.sqrt(300)
    mean = sum(r[2] for r in rows[:300]) / 300
    assert got["b"] == (None, None)
    assert abs(got["a"][0] - (mean - half)) < 0.004 and abs(got["a"][1] - (mean + half)) < 0.004
    d = df.where("system = 'a'").select("system", "id", (F.col("v") - 0.5).alias("diff"))
    worse = d.withColumn("diff", -F.abs("diff"))
    better = d.withColumn("diff", F.abs("diff"))
    one = lambda x: stats.paired_p(x, ["system"]).first()["p"]
    assert one(worse) == 1.0 and one(better) == 0.0 and one(d.limit(1)) is None


def brute_chrf(pairs):
    def grams(s, n):
        return Counter(s[i : i + n] for i in range(len(s) - n + 1))

    ps, rs = [], []
    for kind, n in [("c", n) for n in range(1, 7)] + [("w", n) for n in (1, 2)]:
        m = h = r = 0
        for a, b in pairs:
            x, y = ("".join(a.split()), "".join(b.split())) if kind == "c" else (tuple(a.split()), tuple(b.split()))
            gx, gy = grams(x, n), grams(y, n)
            m, h, r = m + sum((gx & gy).values()), h + sum(gx.values()), r + sum(gy.values())
        if h and r:
            ps.append(m / h)
            rs.append(m / r)
    p, r = sum(ps) / len(ps), sum(rs) / len(rs)
    return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0


def test_chrf_tokens():
    assert metrics.chrf_tokens('Salom, "dunyo" (x) . -5%') == ["Salom", ",", '"dunyo', '"', "(x", ")", ".", "-5", "%"]
    assert metrics.chrf_tokens("«a» 'b") == ["«a»", "'", "b"] and metrics.chrf_tokens(" ") == []


def test_metrics_of_odd_texts(spark):
    rows = [("a", "1", None, "uch tort"), ("a", "2", "bir", ""), ("b", "1", "", ""), ("c", "1", "bir ikki uch tort", "bir ikki uch tort"), ("c", "1", "bir ikki uch tort", "bir ikki uch tort")]
    df = spark.createDataFrame(rows, "system string, id string, hyp string, ref string")
    got = {r["system"]: r["chrf_pp"] for r in metrics.chrf_pp(df, ["system"], "hyp", "ref").collect()}
    assert got == {"c": 100.0}  # nothing to compare gives no row
    assert {r["system"]: r["bleu"] for r in metrics.bleu(df, ["system"], "hyp", "ref").collect()}["c"] == 100.0
    assert metrics.chrf_pp(df.limit(0), ["system"], "hyp", "ref").count() == 0


def test_bleu_over_pieces(spark):
    model = "/opt/tokenizers/piece_bpe_32k.model"
    df = spark.createDataFrame([("s", "bir ikki uchinchi narsa", "bir ikki uchinchi narsalar")], "system string, hyp string, ref string")
    by_words, by_pieces = (metrics.bleu(df, ["system"], "hyp", "ref", *t).first()["bleu"] for t in ((), (metrics.sentencepiece(model),)))
    assert 0 < by_words < by_pieces < 100


def test_chrf_and_bleu(spark):
    rng = random.Random(6)
    words = "bir ikki uch tort besh olti".split()
    pairs = [(" ".join(rng.choices(words, k=9)), " ".join(rng.choices(words, k=10))) for _ in range(20)]
    df = spark.createDataFrame([("s", str(n), a, b) for n, (a, b) in enumerate(pairs)], "system string, id string, hyp string, ref string")
    assert abs(metrics.chrf_pp(df, ["system"], "hyp", "ref").first()["chrf_pp"] - brute_chrf(pairs)) < 0.01
    same = df.withColumn("hyp", F.col("ref"))
    assert metrics.chrf_pp(same, ["system"], "hyp", "ref").first()["chrf_pp"] == 100.0
    assert metrics.bleu(same, ["system"], "hyp", "ref").first()["bleu"] == 100.0
    assert 0 < metrics.bleu(df, ["system"], "hyp", "ref").first()["bleu"] < 60
