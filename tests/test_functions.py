import random
import re

import pytest
from pyspark.sql import functions as F

from mezon.functions import entities as ent
from mezon.functions import text as tx
from mezon.functions.gates import gates, passes
from mezon.functions.judge import balanced_object, mqm_score, parse_answer
from mezon.operators.chunking import chunk_pairs, group_by_words, split_k

PATTERNS = [re.compile(p) for p in ent.PATTERNS]


def run(spark, values, f, schema="t string"):
    rows = [(v,) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(f(F.col("t"))).collect()]


def brute_entities(t):
    spans = sorted((m.start(), -len(m[0]), m[0]) for p in PATTERNS for m in p.finditer(t))
    end, out = 0, []
    for start, neg, s in spans:
        if start >= end:
            out.append(s)
            end = start - neg
    return out


TEXTS = [
    "I can reserve a seat on TR2704 departing at 9:35.", "https://a/123 456 7890 5", "é１２３ 47.50 a.b+c@d-e.co.uk", "", "plain words",
    "call +998 71 200 70 07 or 12345, see https://x.y/1 $10,000 {{v}} a@b.com", "{{a}}{{b}} 1,250,000 99 100", "x 123 " * 400,
]


def test_entities(spark):
    assert run(spark, TEXTS, ent.entities) == [brute_entities(t) for t in TEXTS]
    assert run(spark, TEXTS[:1], ent.entities) == [["2704"]]
    assert run(spark, [None], ent.entities) == [None]


def test_mask_round_trip(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", ent.mask(F.col("t")).alias("m")).select("t", "m.*", ent.unmask(F.col("m.masked"), F.col("m.entries")).alias("back")).collect()
    assert all(r["back"] == r["t"] for r in got)
    assert got[0]["masked"] == "I can reserve a seat on TRXqAqX departing at 9:35."
    loose = spark.createDataFrame([("see xqA Q X", "no")], "a string, b string")
    e = F.array(F.struct(F.lit("XqAqX").alias("token"), F.lit("a\\b$1").alias("value")))
    assert loose.select(ent.unmask(F.lit("see xq A qx"), e)).first()[0] == "see a\\b$1"
    assert loose.select(ent.unrestored(F.lit("see"), e)).first()[0] == ["a\\b$1"]


def test_sentinels(spark):
    got = run(spark, [0, 25, 26, 51, 52, 701, 702], ent.sentinel, "t int")
    assert got == ["XqAqX", "XqZqX", "XqAAqX", "XqAZqX", "XqBAqX", "XqZZqX", "XqAAAqX"]


def test_sentinels_never_repeat(spark):
    assert run(spark, [18277, 18278, 18279, 475253, 475254], ent.sentinel, "t int") == ["XqZZZqX", "XqAAAAqX", "XqAAABqX", "XqZZZZqX", "XqAAAAAqX"]
    got = spark.range(60_000).select(ent.sentinel(F.col("id")).alias("t"))
    assert got.distinct().count() == 60_000



def test_text_functions(spark):
    assert run(spark, ["o'zbek ma'no a'b'c dogs'", "gʼ Oʻ"], tx.normalize_apostrophes) == ["oʻzbek maʼno aʼbʼc dogs'", "gʻ Oʻ"]
    assert run(spark, ["a  b c", " a\tb ", "", None], tx.word_count)[:3] == [3, 2, 0]
    assert run(spark, [" A  b ", ""], tx.text_key) == ["a b", ""]
    assert run(spark, ["One. Two!\nThree… Four", "", "no end"], tx.sentences) == [["One.", "Two!", "Three…", "Four"], [""], ["no end"]]
    assert run(spark, ["WEBSITEURL and CLAIMS and WEBSITEURL"], tx.placeholders) == [["CLAIMS", "WEBSITEURL"]]
    assert run(spark, ["a<think>x\ny</think>b<THINK></THINK>"], tx.strip_reasoning) == ["ab"]
    assert run(spark, ["<a & 'b'>"], tx.html_escape) == ["&lt;a &amp; &#x27;b&#x27;&gt;"]
    assert run(spark, [0.5, None], tx.fmt, "t double") == ["0.5000", "—"]


def test_categories(spark):
    rows = [("user", "Damn, wait"), ("user", "code 12345"), ("assistant", "w " * 40), ("assistant", "short"), ("user", "short"), ("user", "use WEBSITEURL")]
    got = [r[0] for r in spark.createDataFrame(rows, "r string, t string").select(ent.category(F.col("r"), F.col("t"))).collect()]
    assert got == ["edge", "tool_spoken", "kb_passage", "agent_reply", "caller_turn", "edge"]


def test_gates(spark):
    loop = "bir ikki uch " * 5
    rows = [
        ("Hello there", "Salom", ["100"], False), ("Hello there", " ", [], False), ("Hello there", "hello there ", [], False), ("Hello there", "Салом", [], False),
        ("Hello there my dear old friend " * 2, loop, [], False), ("Pay 100", "100 tola", ["100"], True), ("x", "the and you have", [], False), (None, None, None, False), ("Hello", "Salom", [], True),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "en string, uz string, p array<string>")
    g = df.select(*(c.alias(n) for n, c in gates(F.col("en"), F.col("uz"), F.col("p")).items())).withColumn("passed", passes()).collect()
    assert [r["passed"] for r in g] == [r[3] for r in rows]
    assert g[4]["degenerate"] and g[1]["empty"] and g[2]["copy_through"] and g[3]["cyrillic"] and g[6]["english_leak"] and g[0]["entity_keep"] == 0.0


def test_degenerate_brute_force(spark):
    from collections import Counter

    from mezon.functions.gates import degenerate

    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab c".split()) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + ["w " * 5000]

    def slow(t):
        w = t.split()
        c = Counter(zip(w, w[1:], w[2:]))
        return len(w) >= 8 and max(c.values()) >= 4

    assert run(spark, texts, degenerate) == [slow(t) for t in texts]


def test_judge(spark):
    assert balanced_object('noise {"a": "}{", "b": {"c": 1}} tail') == '{"a": "}{", "b": {"c": 1}}'
    assert balanced_object("{broken") is None
    answers = ['```json\n{"errors":[{"category":"a","severity":"Critical","span":"x"},{"category":"b","severity":null,"span":"y"}],"adequacy":3,"fluency":4}\n```', "no json", None, '{"errors":[]}']
    got = run(spark, answers, lambda c: mqm_score(parse_answer(c)["errors"]))
    assert got == [-11.0, 0.0, 0.0, 0.0]
    many = '{"errors":[' + ",".join(['{"severity":"critical"}'] * 4) + "]}"
    assert run(spark, [many], lambda c: mqm_score(parse_answer(c)["errors"])) == [-25.0]


def brute_group(sents, most):
    out, n = [], 0
    for s in sents:
        k = len(s.split())
        if out and n + k <= most:
            out[-1] += " " + s
            n += k
        else:
            out.append(s)
            n = k
    return out


def test_chunks(spark):
    rng = random.Random(2)
    sets = [[" ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    assert run(spark, sets, lambda c: group_by_words(c, 10), "t array<string>") == [brute_group(s, 10) for s in sets]
    rows = [(s, rng.randrange(1, len(s) + 1)) for s in sets]
    for (s, k), (got,) in zip(rows, spark.createDataFrame(rows, "s array<string>, k int").select(split_k(F.col("s"), F.col("k"))).collect()):
        assert len(got) == k and " ".join(got) == " ".join(s)
    text = " ".join(f"Word number {i} stands here now." for i in range(40))
    one = spark.createDataFrame([(text, "Bir. Ikki. Uch.", "A. B."), ("short", "qisqa", None)], "a string, b string, c string")
    long, short = (r[0] for r in one.select(chunk_pairs(F.col("a"), F.col("b"), F.col("c"))).collect())
    assert len(long) == 2 and all(x["src"] and x["mt"] and x["ref"] for x in long) and len(short) == 1
    assert len(one.select(chunk_pairs(F.col("a"), F.col("b"))).first()[0]) == 3


@pytest.mark.parametrize("f", [tx.strip, tx.text_key, tx.normalize_apostrophes, tx.strip_reasoning, ent.preserve])
def test_null_in_null_out(spark, f):
    assert run(spark, [None], f) == [None]
