import json

import pytest
from pyspark.sql import functions as F

from mezon.models import calls, registry
from mezon.plans.leaderboard import Inputs, render, render_html
from mezon.sources import readers, sinks
from mezon.streaming import gates_stream as gs


def test_json_sources(spark, tmp_path):
    p = tmp_path / "nllb-1.3b.jsonl"
    p.write_text('{"id":"a","uz_text":"x"}\nbroken\n\n{"id":"b","uz_text":null}\n')
    schema = "id string, uz_text string"
    assert readers.read_tolerant(spark, str(p), schema).count() == 2
    assert readers.read_tolerant(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    good, bad = readers.read_reported(spark, str(p), schema)
    assert good.count() == 2 and [(r["line_no"], r["line"]) for r in bad.collect()] == [(2, "broken")]
    with pytest.raises(Exception):
        readers.read_strict(spark, str(p), schema).collect()
    assert {r["system"] for r in readers.read_systems(spark, str(tmp_path), "id string, system string, uz_text string").collect()} == {"nllb-1.3b"}


def test_parallel_and_ordinal(spark, tmp_path):
    (tmp_path / "en").write_text("One\n\nThree\nFour\n")
    (tmp_path / "uz").write_text("Bir\nIkki\nO'ch")
    with pytest.warns(UserWarning, match="4 and 3 lines"):
        got = readers.read_parallel(spark, str(tmp_path / "en"), str(tmp_path / "uz"), "ntrex").orderBy("id").collect()
    assert [(r["id"], r["uz_text"]) for r in got] == [("ntrex-00000", "Bir"), ("ntrex-00002", "Oʻch")]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"source": f"s{i}", "messages": []}) + "\n" for i in range(3)))
    rows = readers.read_ordinal(spark, str(tmp_path / "c.jsonl"), readers.SCHEMAS["corpus"]).collect()
    assert [(r["dialogue_idx"], r["source"]) for r in rows] == [(0, "s0"), (1, "s1"), (2, "s2")]
    done, failed = readers.read_all({"a": lambda: 1, "b": lambda: 1 / 0})
    assert done == {"a": 1} and "ZeroDivisionError" in failed["b"]


def test_line_numbers_over_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("".join(f"{name}{i:05d}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line_no"], r["value"]) for r in got) == sorted((i, f"{n}{i:05d}") for i in range(3000) for n in "ab")


def test_source_fallbacks(spark):
    single = {"eng_Latn": [(0, "One"), (1, "")], "uzn_Latn": [(0, "Bir"), (1, "Ikki")]}

    def load(config):
        if config not in single:
            raise ValueError("no such configuration")
        return spark.createDataFrame(single[config], "pos long, sentence string")

    with pytest.warns(UserWarning, match="no such configuration"):
        assert [r["id"] for r in readers.read_flores(load).collect()] == ["flores-00000"]
    nested = spark.createDataFrame([(3, ("One", "Bir"))], "pos long, translation struct<en:string,uz:string>")

    def reversed_only(config):
        if config != "uz-en":
            raise ValueError("no")
        return nested

    with pytest.warns(UserWarning):
        assert [(r["id"], r["domain"]) for r in readers.read_xwmt(reversed_only, limit=5).collect()] == [("xwmt-00003", "talks_news")]
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        readers.read_xwmt(lambda c: load("x"))


def test_markdown_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "b.md").write_text("# T\n## Board\n| system | n |\n|---|---|\n| tilmoch | 3 |\n| other | 4 |\n## Next\n| tilmoch | 9 |\n")
    got = readers.read_markdown_table(spark, str(tmp_path / "b.md"), "## Board", ["tilmoch"], cells=2).collect()
    assert [r["cells"] for r in got] == [["tilmoch", "3"]]
    env = tmp_path / ".env"
    env.write_text("# c\nMEZON_X='1'\n")
    assert readers.setting("MEZON_X", str(env)) == "1" and readers.setting("MEZON_Y", str(env), "d") == "d"
    monkeypatch.setenv("MEZON_X", "2")
    assert readers.setting("MEZON_X", str(env)) == "2"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "x")], "id string, t string")
    out = str(tmp_path / "o")
    sinks.write_jsonl(df, out)
    assert '"t":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    more = spark.createDataFrame([("b", "y"), ("c", "z")], "id string, t string")
    assert sinks.append_new(more, out, ["id"]) == 1 and sinks.append_new(more, out, ["id"]) == 0
    assert spark.read.json(out).count() == 3
    cache = str(tmp_path / "cache")
    sinks.flush_cache(spark.createDataFrame([("k", "t"), ("k", "t")], "key string, text string"), cache)
    assert sinks.load_cache(spark, cache).count() == 1 and sinks.load_cache(spark, str(tmp_path / "no")).count() == 0


def test_append_in_parts(spark, tmp_path):
    df, said, asked = spark.range(50).selectExpr("cast(id AS string) AS id"), [], spark.sparkContext.accumulator(0)

    def run(part):
        def call(batches):
            for b in batches:
                asked.add(b.num_rows)
                yield b

        return part.mapInArrow(call, "id string").withColumn("t", F.lit("x"))

    out = str(tmp_path / "o")
    assert sinks.append_in_parts(df.where("id < 20"), run, out, ["id"], parts=3, report=said.append) == 20
    assert sinks.append_in_parts(df, run, out, ["id"], parts=3, report=said.append) == 30
    assert spark.read.json(out).count() == 50 and asked.value == 50 and said[2].startswith("3/3 parts, 20 rows") and said[2].endswith("0:00 to go")
    assert [sinks.eta(x) for x in (59.9, 3600, -1, float("nan"), float("inf"))] == ["0:59", "1:00:00", "--:--", "--:--", "--:--"]


def fake():
    class Fake:  # local, so that it travels to the workers by value
        def translate(self, text, context=None):
            if text == "boom":
                raise ValueError("bad")
            return "" if text == "none" else f"<{text}|{context}>"

    return Fake()


def test_translate(spark):
    df = spark.createDataFrame([("1", "hi", "c"), ("2", "boom", None), ("3", "none", None)], "id string, en_text string, context_prev string")
    model = fake()
    got = {r["id"]: r for r in calls.translate(df, registry.SPECS[0], tries=1, factory=lambda spec: model).collect()}
    assert got["1"]["uz_text"] == "<hi|c>" and got["1"]["error"] is None
    assert got["2"]["error"].startswith("ValueError") and got["3"]["error"].startswith("EmptyGeneration")
    registry.register("tilmoch", lambda spec: fake())
    probe = calls.preflight([s for s in registry.SPECS if s.kind in ("tilmoch", "gemini")])
    assert [p["ok"] for p in probe] == [False, True]
    limited = calls.translate(df, registry.SPECS[0], per_minute=6e5, tries=1, factory=lambda spec: model)
    assert limited.count() == 3
    assert len(registry.resolve(None, heavy=False)) == 7
    with pytest.raises(ValueError):
        registry.resolve("nobody")


def test_retry_and_throttle():
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError
        return "ok"

    assert calls.retried(flaky, 4, sleep=waits.append) == "ok" and len(waits) == 2
    error = RuntimeError()
    error.code = 404
    with pytest.raises(RuntimeError):
        calls.retried(lambda: (_ for _ in ()).throw(error), 4, sleep=waits.append)
    assert len(waits) == 2
    t = calls.Throttle(60, clock=lambda: 0.0, sleep=waits.append)
    t.wait(), t.wait()
    assert waits[-1] == 1.0


def test_sentences_with_cache(spark):
    df = spark.createDataFrame([("1", "Hello there. Call 12345!"), ("2", "Hello there."), ("3", "")], "id string, t string")
    got, fresh = calls.translate_sentences(df, "id", "t", lambda b: ["«" + s + "»" for s in b])
    assert {r["id"]: r["uz_text"] for r in got.collect()} == {"1": "«Hello there.» «Call 12345!»", "2": "«Hello there.»", "3": ""}
    assert fresh.count() == 2 and {r["id"]: (r["n_dropped"], r["has_cyrillic"]) for r in got.collect()}["1"] == (0, False)
    lost, _ = calls.translate_sentences(df, "id", "t", lambda b: ["Салом." for s in b])
    assert {r["id"]: (r["n_dropped"], r["has_cyrillic"]) for r in lost.collect()} == {"1": (1, True), "2": (0, True), "3": (0, False)}
    _, again = calls.translate_sentences(df, "id", "t", lambda b: ["«" + s + "»" for s in b], cache=fresh)
    assert again.count() == 0


def test_score_and_judge(spark):
    chunks = spark.createDataFrame([("a", "one two three", "x", None), ("a", "one", "y", None)], "id string, src string, mt string, ref string")
    r = calls.score(chunks, lambda rows: [1.0 if x["mt"] == "x" else 0.0 for x in rows], ["id"]).first()
    assert r["score"] == 0.75 and r["n_chunks"] == 2
    rows = spark.createDataFrame([("1", "s", "en", "uz", None), ("2", "s", "fail", "uz", None)], "id string, system string, en_text string, uz_text string, context_prev string")

    def ask(prompt):
        if "wrong-script" not in prompt or "fail" in prompt:
            raise ValueError("down")
        return '{"errors":[{"category":"x","severity":"major","span":"uz"}],"adequacy":4,"fluency":5}'

    got = {r["id"]: r for r in calls.judge(rows, ask, tries=1).collect()}
    assert got["1"]["mqm"] == -5.0 and got["1"]["mqm_std"] == 0.0 and got["1"]["runs"] == 3 and got["1"]["mqm_runs"] == [-5.0] * 3
    assert got["2"]["mqm"] is None and "down" in got["2"]["error"]


def test_adapters_with_stand_ins(monkeypatch):
    import contextlib
    import sys
    import types

    from mezon.models import adapters

    assert adapters.finish("<think>x\ny</think> O'zbek ma'no ") == "Oʻzbek maʼno" and adapters.finish(None) == ""
    seen = []

    class Batch(dict):
        def to(self, device):
            return self

    class Ids(list):
        shape = (1, 2)

    class Tokens:
        eos_token_id = 0

        @classmethod
        def from_pretrained(cls, name, **kw):
            return cls()

        def convert_tokens_to_ids(self, name):
            return name

        def __call__(self, texts, **kw):
            return Batch(input_ids=Ids(), texts=texts)

        def batch_decode(self, out, **kw):
            return out

        def decode(self, out, **kw):
            return "<think>hm</think>Salom o'g'il"

        def apply_chat_template(self, message, tokenize, add_generation_prompt, **kw):
            if kw:
                raise TypeError
            return message[0]["content"]

    class Model:
        device = "cpu"

        @classmethod
        def from_pretrained(cls, name, **kw):
            return cls()

        def to(self, device):
            return self

        def eval(self):
            return self

        def generate(self, texts, **kw):
            seen.append((texts, kw.get("forced_bos_token_id")))
            return [f"«{t}»" for t in texts] if isinstance(texts, list) else [[1, 2, 3]]

    torch = types.SimpleNamespace(cuda=types.SimpleNamespace(is_available=lambda: False), inference_mode=contextlib.nullcontext, bfloat16=None)
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(AutoTokenizer=Tokens, AutoModelForSeq2SeqLM=Model, AutoModelForCausalLM=Model))
    Model.generate = lambda self, **kw: (seen.append(kw), [f"«{t}»" for t in kw["texts"]] if isinstance(kw["texts"], list) else [[1, 2, 3]])[1]
    assert adapters.nllb()(registry.SPECS[0]).translate("B two. A. B two.", "c") == "«B two.» «A.» «B two.»"
    assert seen[0]["forced_bos_token_id"] == "uzn_Latn" and seen[0]["texts"] == ["A.", "B two."]
    assert adapters.local_chat()(registry.SPECS[8]).translate("Hello", "before") == "Salom oʻgʻil" and "before" in seen[-1]["texts"]

    class Client:
        def __init__(self, api_key):
            self.models = types.SimpleNamespace(generate_content=lambda model, contents, config: types.SimpleNamespace(text=f" {model}|{api_key}|{config}"))

    kinds = types.SimpleNamespace(GenerateContentConfig=lambda **kw: kw["temperature"], ThinkingConfig=lambda **kw: kw)
    genai = types.SimpleNamespace(Client=Client, types=kinds)
    for name, module in (("google", types.SimpleNamespace(genai=genai)), ("google.genai", genai), ("google.genai.types", kinds)):
        monkeypatch.setitem(sys.modules, name, module)
    assert adapters.gemini("k")(registry.SPECS[7]).translate("Hello") == "gemini-3.5-flash|k|0"
    monkeypatch.setattr(registry, "_FACTORIES", {})
    adapters.register_all(cloud_url="http://x", paid_url="http://y")
    assert set(registry._FACTORIES) == {s.kind for s in registry.SPECS}


def test_judge_answers_in_any_wrapping(spark):
    from mezon.functions.judge import parse_answer

    good = '{"errors":[{"category":"x","severity":"minor","span":"y"}],"adequacy":3,"fluency":2}'
    texts = [good, "```json\n" + good + "\n```", "Sure: " + good + " done", "nothing", None, '{"adequacy": 5}', "{broken " + good]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_answer(F.col("t")).alias("a"))
    got = {r["i"]: (r["a"] and (r["a"]["errors"] and len(r["a"]["errors"]), r["a"]["adequacy"])) for r in df.collect()}
    assert [got[i] for i in (0, 1, 2, 6)] == [(1, 3)] * 4 and got[5] == (None, 5) and not any(got[3] or ()) and not any(got[4] or ())


def test_leak_detector(spark):
    from mezon.functions.gates import detector_of, gates, lingua_detector

    df = spark.createDataFrame([("EN text",), ("Uzbek",), ("",), (None,)], "t string")
    leak = detector_of(lambda t: "ENGLISH" if t.startswith("EN") else None)
    flags = gates(F.lit("x"), F.col("t"), F.array().cast("array<string>"), leak)
    assert [r[0] for r in df.select(flags["english_leak"]).collect()] == [True, False, False, False]
    assert lingua_detector() is None or callable(lingua_detector())


def test_leaderboard(spark):
    rows = [(s, str(i), b + i / 1000) for s, b in (("nllb-1.3b", 0.5), ("tilmoch", 0.6), ("gemma4-12b", 0.4)) for i in range(40)]
    s = spark.createDataFrame(rows, "system string, id string, score double")
    cats = s.select("id", F.lit("edge").alias("category")).distinct()
    chrf = s.select("system").distinct().select("system", F.lit(10).alias("n"), F.rand(1).alias("chrf_pp"), F.lit(1.0).alias("spbleu"), F.lit(1).alias("degenerate"))
    text = render(Inputs(s, 41, categories=cats, chrf={"flores": chrf}), iterations=200)
    lines = text.splitlines()
    board = [x for x in lines if x.startswith("| tilmoch") or x.startswith("| nllb") or x.startswith("| gemma")][:3]
    assert board[0].startswith("| tilmoch") and "0.0*" in board[0] and "40/0/0" in board[0] and "baseline" in board[1] and "0/40/0" in board[2]
    assert "## Not run" in text and "- judge" in text and "moves no system" in text
    assert "tilmoch" in render_html(Inputs(s, 41), iterations=50)
    assert "Leaderboard" in render(Inputs(s.limit(0), 0), iterations=8)


def test_stream_equals_batch(spark, tmp_path):
    bench = spark.createDataFrame([("a", "Hello", ["100"]), ("b", "Bye", [])], "id string, en_text string, preserve array<string>")
    rows = [(n, 1, "s", "a" if n % 2 else "b", "100 ta" if n % 3 else "") for n in range(30)]
    schema = "ord long, run_id long, system string, id string, uz_text string"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = gs.append_to(gs.gate_stream(gs.answer_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1), bench), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = gs.gate_stream(df, bench)
    assert got.count() == 30 and got.exceptAll(want).count() == 0


def test_stream_repairs_damaged_ids(spark):
    bench = spark.createDataFrame([("a-1", "Hello", [])], "id string, en_text string, preserve array<string>")
    ids = ["a-1", " A-1", "a\u20131", "a\u00a0-\u200b1\n", "a-2", None]
    df = spark.createDataFrame([(n, 1, "s", x, "Salom") for n, x in enumerate(ids)], "ord long, run_id long, system string, id string, uz_text string")
    got = gs.gate_stream(df, bench).collect()
    assert sorted((r["ord"], r["id"]) for r in got) == [(n, "a-1") for n in range(4)]
