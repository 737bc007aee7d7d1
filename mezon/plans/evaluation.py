"""Queries of the evaluation operators over the project's tables, each with the SQL it must agree with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mezon.functions import entities as ent
from mezon.functions import text as tx
from mezon.functions.gates import STOP_WORDS, english_leak, gates, passes
from mezon.functions.judge import mqm_score, parse_answer
from mezon.operators import chunking, dedupe, metrics, relational, sampling, stats
from mezon.operators.exact_dedup import segment_id

BASELINE = "nllb-1.3b"
CATEGORIES = ["caller_turn", "agent_reply", "kb_passage", "tool_spoken", "edge"]
# The systems on the board, in registry order.
SYSTEMS = [
    "nllb-1.3b", "nllb-3.3b", "gemma4-12b", "gemma4-26b", "gemma4-31b-cloud", "translategemma-12b", "translategemma-27b",
    "gemini-3.5-flash", "neuronai-uzbek", "tilmoch",
]
TOP, ITERATIONS = 5, 1000
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- tables -------------------------------------------------------------------------------------


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def answers(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidate")
    return c.select("ord", "run_id", "system", segment_id(F.col("id")).alias("id"), "uz_text", "latency_ms", "error")


def bench(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("id", "section", "domain", "category", "en_text", "context_prev", "preserve").distinct()


def latest(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.latest_answer(answers(spark, d), ["run_id", "system", "id"], "uz_text", "ord")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Latest answers with their source; the source side is broadcast by the optimiser where its size allows."""
    return latest(spark, d).join(bench(spark, d), "id")


def gated(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    flags = gates(F.col("en_text"), F.col("uz_text"), F.col("preserve"))
    rows = p.select("run_id", "system", "id", "section", "category", *(c.alias(n) for n, c in flags.items()))
    return rows.withColumn("passed", passes())


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(system, id, score): mean over runs of the valid score of every message."""
    x = read(spark, d, "xcomet_qe").select("run_id", segment_id(F.col("id")).alias("id"), "system", "score").where("score IS NOT NULL")
    one = dedupe.last_score(x, ["run_id", "system", "id"], "score", F.col("score"))
    return one.groupBy("system", "id").agg(F.round(F.avg("score"), 12).alias("score"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(dialogue_idx, turn_idx, source, domain, role, text) of every turn, text stripped, null as empty."""
    c = read(spark, d, "corpus").select("dialogue_idx", "source", "domain", F.posexplode("messages").alias("turn_idx", "m"))
    return c.select("dialogue_idx", "turn_idx", "source", "domain", F.col("m.role").alias("role"), tx.strip(F.coalesce("m.content", F.lit(""))).alias("text"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Turns with their previous context: the last non-empty earlier turn of any role."""
    w = Window.partitionBy("dialogue_idx").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, -1)
    t = turns(spark, d).withColumn("context_prev", F.last(F.nullif("text", F.lit("")), ignorenulls=True).over(w))
    return t.where((F.coalesce("role", F.lit("")) != "system") & (F.col("text") != ""))


def of_length(text, n_words):
    """At most 400 words, and under three only with a placeholder or profanity."""
    return (n_words <= 400) & ((n_words >= 3) | ent.edge(text))


W = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def s_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{W}+'), lambda w: w <> '')"


S_SEG = r"lower(regexp_replace(regexp_replace(id, '[\p{Pd}\x{2212}\x{00AD}]', '-', 'g'), '[\s\p{Z}\p{Cf}\p{Cc}]+', '', 'g'))"
S_LATEST = f"""WITH cand AS (SELECT ord, run_id, system, {S_SEG} AS id, uz_text, latency_ms, error FROM candidate),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, system, id ORDER BY f DESC, CASE WHEN f THEN -ord ELSE ord END) AS rn
  FROM (SELECT *, coalesce({s_strip('uz_text')} <> '', false) AS f FROM cand)) WHERE rn = 1),
bench AS (SELECT DISTINCT id, section, domain, category, en_text, context_prev, preserve FROM benchmark)"""
S_GATES = S_LATEST + f""",
pairs AS (SELECT l.run_id, l.system, l.id, b.section, b.category, b.preserve, {s_strip("coalesce(l.uz_text, '')")} AS uz, {s_strip("coalesce(b.en_text, '')")} AS en
  FROM latest l JOIN bench b USING (id)),
w AS (SELECT *, {s_words('uz')} AS ws FROM pairs),
t AS (SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w),
gates AS (SELECT run_id, system, id, section, category, uz = '' AS empty, uz <> '' AND lower(uz) = lower(en) AS copy_through,
  regexp_matches(uz, '[\\x{{0400}}-\\x{{04FF}}]') AS cyrillic,
  len(list_intersect(list_distinct(regexp_extract_all(lower(uz), '[a-zA-Z'']+')), [{", ".join(f"'{w}'" for w in STOP_WORDS)}])) >= 3 AS english_leak,
  CASE WHEN len(preserve) > 0 THEN len(list_filter(preserve, lambda e: contains(uz, e))) / len(preserve) END AS entity_keep,
  CASE WHEN en = '' THEN 0.0 ELSE round(length(uz) / length(en), 3) END AS len_ratio,
  uz <> '' AND (CASE WHEN en = '' THEN 0.0 ELSE length(uz) / length(en) END < 0.3 OR CASE WHEN en = '' THEN 0.0 ELSE length(uz) / length(en) END > 3.0) AS len_outlier,
  len(ws) >= 8 AND coalesce(list_max(map_values(list_histogram(tri))) >= 4, false) AS degenerate FROM t),
g AS (SELECT *, NOT (empty OR copy_through OR cyrillic OR english_leak OR degenerate) AND coalesce(entity_keep, 1.0) >= 1.0 AS passed FROM gates)
"""
S_SCORES = f"""WITH x AS (SELECT run_id, {S_SEG} AS id, system, max(score) AS score FROM xcomet_qe WHERE score IS NOT NULL GROUP BY ALL),
scores AS (SELECT system, id, round(avg(score), 12) AS score FROM x GROUP BY ALL)"""
S_SHARED = S_SCORES + ", shared AS (SELECT id FROM scores GROUP BY id HAVING count(DISTINCT system) = (SELECT count(DISTINCT system) FROM scores))"
S_PAIRED = S_SCORES + f""",
paired AS (SELECT a.system, a.id, a.score - b.score AS diff FROM scores a JOIN scores b ON a.id = b.id AND b.system = '{BASELINE}' WHERE a.system <> '{BASELINE}')"""
S_TURNS = f"""WITH m AS (SELECT dialogue_idx, source, domain, unnest(messages) AS m, unnest(range(len(messages))) AS turn_idx FROM corpus),
turns AS (SELECT dialogue_idx, turn_idx, source, domain, m.role AS role, {s_strip("coalesce(m.content, '')")} AS text FROM m)"""
S_SEGMENTS = S_TURNS + """,
ctx AS (SELECT *, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY dialogue_idx ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_prev FROM turns),
segs AS (SELECT * FROM ctx WHERE coalesce(role, '') <> 'system' AND text <> '')"""

S_EDGE = rf"(regexp_matches(text, '\b[A-Z]{{{{6,}}}}\b') OR regexp_matches(text, '(?i){ent.PROFANITY}'))".replace("{{", "{").replace("}}", "}")
S_LENGTH = f"len({s_words('text')}) <= 400 AND (len({s_words('text')}) >= 3 OR {S_EDGE})"
# the entity patterns in the syntax of this engine, whose \d, \w and \s are ASCII
_S_PATTERNS = [
    r"\{\{.*?\}\}",
    r"https?://[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+",
    r"[\p{L}\p{M}\p{Nd}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Pc}-]+\.[\p{L}\p{M}\p{Nd}\p{Pc}.-]+",
    r"\+?\p{Nd}[\p{Nd}\s\p{Z}()\-]{5,}\p{Nd}",
    r"\p{Nd}{1,3}(?:[.,]\p{Nd}+)+",
    r"\p{Nd}{3,}",
]
# spans of every pattern by place, then the earliest, of several at one place the longest, none overlapping
S_SPANS = S_SEGMENTS + """,
hits AS (""" + " UNION ALL ".join(
    f"SELECT dialogue_idx, turn_idx, unnest(list_zip(regexp_split_to_array(text, '{p}'), regexp_extract_all(text, '{p}'))) AS z, {n} AS pat, generate_subscripts(regexp_split_to_array(text, '{p}'), 1) AS i FROM segs WHERE regexp_matches(text, '{p}')"
    for n, p in enumerate(_S_PATTERNS)
) + """),
placed AS (SELECT dialogue_idx, turn_idx, z[2] AS hit, (sum(length(z[1]) + coalesce(length(z[2]), 0)) OVER (PARTITION BY dialogue_idx, turn_idx, pat ORDER BY i) - coalesce(length(z[2]), 0))::BIGINT AS start FROM hits),
listed AS (SELECT dialogue_idx, turn_idx, list({'start': start, 'stop': start + length(hit), 'hit': hit} ORDER BY start, length(hit) DESC, hit) AS l FROM placed WHERE hit IS NOT NULL GROUP BY ALL),
spans AS (SELECT dialogue_idx, turn_idx, list_reduce(list_prepend(l[:0], list_transform(l, lambda x: [x])), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1].start >= acc[-1].stop THEN list_concat(acc, x) ELSE acc END) AS spans FROM listed),
found AS (SELECT s.*, coalesce(p.spans, []) AS spans FROM segs s LEFT JOIN spans p USING (dialogue_idx, turn_idx))"""
_S_PRESERVE = rf"array_to_string(list_sort(list_distinct(list_concat(list_filter(list_transform(spans, lambda x: x.hit), lambda e: NOT regexp_full_match(e, '{_S_PATTERNS[4]}')), regexp_extract_all(text, '\b[A-Z]{{6,}}\b')))), '|')"
_S_CATEGORY = f"""CASE WHEN {S_EDGE} THEN 'edge' WHEN len(spans) > 0 THEN 'tool_spoken' WHEN role = 'assistant' AND len({s_words('text')}) >= {ent.KB_MIN_WORDS} THEN 'kb_passage'
 WHEN role = 'assistant' THEN 'agent_reply' ELSE 'caller_turn' END"""

# --- gates --------------------------------------------------------------------------------------


@query(S_GATES + "SELECT run_id, system, id, empty, copy_through, cyrillic, english_leak, round(entity_keep, 6) AS entity_keep, len_ratio, len_outlier, degenerate, passed FROM g")
def gate_flags(spark, d):
    return gated(spark, d).drop("section", "category").withColumn("entity_keep", F.round("entity_keep", 6))


_RATES = ["empty", "copy_through", "cyrillic", "english_leak", "len_outlier", "degenerate"]


@query(
    S_GATES + "SELECT system, count(*) AS n, " + ", ".join(f"round(avg({r}::INT), 4) AS {r}" for r in _RATES)
    + ", round(avg(entity_keep), 8) AS entity_keep, round(avg((entity_keep >= 1)::INT), 4) AS entity_perfect, round(avg(passed::INT), 4) AS pass_all, count(*) FILTER (empty) AS n_empty FROM g GROUP BY system"
)
def gate_summary(spark, d):
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    return gated(spark, d).groupBy("system").agg(
        F.count("*").alias("n"), *(rate(F.col(r)).alias(r) for r in _RATES), F.round(F.avg("entity_keep"), 8).alias("entity_keep"),
        rate(F.col("entity_keep") >= 1).alias("entity_perfect"), rate(F.col("passed")).alias("pass_all"), F.count_if("empty").alias("n_empty"),
    )


@query(S_GATES + "SELECT system, coalesce(category, 'all') AS category, round(avg(passed::INT), 4) AS pass_rate, count(*) AS n FROM g GROUP BY ALL")
def gate_pass_rate(spark, d):
    c = F.coalesce("category", F.lit("all")).alias("category")
    return gated(spark, d).groupBy("system", c).agg(F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.count("*").alias("n"))


def _flagged(name: str):
    def run(spark, d):
        return gated(spark, d).where(name).select("run_id", "system", "id")

    QUERIES[name] = run
    ORACLE[name] = S_GATES + f"SELECT run_id, system, id FROM g WHERE {name}"


for _n in ("english_leak", "degenerate", "copy_through", "cyrillic", "len_outlier"):
    _flagged(_n)


@query(S_GATES + "SELECT system, round(avg(len_ratio), 8) AS len_ratio FROM g GROUP BY system")
def len_ratio(spark, d):
    return gated(spark, d).groupBy("system").agg(F.round(F.avg("len_ratio"), 8).alias("len_ratio"))


@query(S_GATES + "SELECT system, count(entity_keep) AS n, round(avg(entity_keep), 8) AS entity_keep FROM g GROUP BY system")
def entity_keep(spark, d):
    return gated(spark, d).groupBy("system").agg(F.count("entity_keep").alias("n"), F.round(F.avg("entity_keep"), 8).alias("entity_keep"))


@query(S_LATEST + """, m AS (SELECT l.system, list_filter(b.preserve, lambda e: NOT contains(coalesce(l.uz_text, ''), e)) AS missing, b.preserve
  FROM (SELECT run_id, system, id, arg_max(coalesce(uz_text, ''), ord) AS uz_text FROM cand GROUP BY ALL) l JOIN bench b USING (id) WHERE len(b.preserve) > 0)
SELECT system, count(*) AS n_rows, count(*) FILTER (len(missing) > 0) AS n_offenders, sum(len(missing))::BIGINT AS n_missing FROM m GROUP BY system""")
def dropped_entities(spark, d):
    last = dedupe.last_row(answers(spark, d).select("run_id", "system", "id", "ord", "uz_text"), ["run_id", "system", "id"], "ord")
    both = last.join(bench(spark, d).where(F.size("preserve") > 0).select("id", "preserve"), "id")
    missing = F.size(F.filter("preserve", lambda e: ~F.contains(F.coalesce("uz_text", F.lit("")), e)))
    return both.withColumn("m", missing).groupBy("system").agg(F.count("*").alias("n_rows"), F.count_if(F.col("m") > 0).alias("n_offenders"), F.sum("m").alias("n_missing"))


# --- deduplication ------------------------------------------------------------------------------


@query(S_LATEST + "SELECT run_id, system, id, ord, uz_text FROM latest")
def latest_candidate(spark, d):
    return latest(spark, d).select("run_id", "system", "id", "ord", "uz_text")


@query(S_LATEST + "SELECT system, (count(*) - count(DISTINCT (run_id, id)))::BIGINT AS n_replaced FROM cand GROUP BY system")
def replaced_rows(spark, d):
    last = dedupe.last_row(answers(spark, d).select("run_id", "system", "id", "ord", "uz_text"), ["run_id", "system", "id"], "ord")
    return last.groupBy("system").agg(F.sum("n_replaced").alias("n_replaced"))


@query(S_LATEST + "SELECT run_id, system, id, arg_max(uz_text, ord) AS uz_text FROM cand WHERE uz_text <> '' GROUP BY ALL")
def last_text(spark, d):
    return dedupe.last_text(answers(spark, d), ["run_id", "system", "id"], "uz_text", "ord")


@query(S_SCORES + "SELECT run_id, system, id, score FROM x")
def last_score(spark, d):
    x = read(spark, d, "xcomet_qe").select("run_id", segment_id(F.col("id")).alias("id"), "system", "score")
    return dedupe.last_score(x, ["run_id", "system", "id"], "score", F.col("score"))


@query(S_SEGMENTS + f""", k AS (SELECT *, lower(array_to_string({s_words('text')}, ' ')) AS k FROM segs WHERE {S_LENGTH})
SELECT dialogue_idx, turn_idx, text FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dialogue_idx, turn_idx) AS rn FROM k) WHERE rn = 1""")
def dedupe_first_text(spark, d):
    s = segments(spark, d).where(of_length(F.col("text"), tx.word_count(F.col("text"))))
    return dedupe.first_text(s.select("dialogue_idx", "turn_idx", "text"), "text", ["dialogue_idx", "turn_idx"])


@query(r"""SELECT DISTINCT s AS sentence FROM (SELECT unnest(string_split(regexp_replace(en_text, '([.!?])[\s\p{Z}\x{0B}\x{85}]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM benchmark) WHERE s <> ''""")
def distinct_sentences(spark, d):
    return read(spark, d, "benchmark").select(F.explode(tx.sentences(F.col("en_text"), line_breaks=False)).alias("sentence")).distinct()


# --- corpus -------------------------------------------------------------------------------------


@query(S_SEGMENTS + "SELECT dialogue_idx, turn_idx, context_prev FROM segs")
def prev_context(spark, d):
    return segments(spark, d).select("dialogue_idx", "turn_idx", "context_prev")


@query(S_SEGMENTS + f"SELECT dialogue_idx, turn_idx, len({s_words('text')})::INT AS n_words FROM segs WHERE {S_LENGTH}")
def length_filter(spark, d):
    return segments(spark, d).withColumn("n_words", tx.word_count(F.col("text"))).where(of_length(F.col("text"), F.col("n_words"))).select("dialogue_idx", "turn_idx", "n_words")


@query(S_SEGMENTS + r"SELECT dialogue_idx, turn_idx, list_sort(list_distinct(regexp_extract_all(text, '\b[A-Z]{6,}\b'))) AS placeholders FROM segs WHERE regexp_matches(text, '\b[A-Z]{6,}\b')")
def placeholders(spark, d):
    s = segments(spark, d).select("dialogue_idx", "turn_idx", tx.placeholders(F.col("text")).alias("placeholders"))
    return s.where(F.size("placeholders") > 0)


@query(S_SPANS + f" SELECT dialogue_idx, turn_idx, {_S_PRESERVE} AS preserve FROM found")
def preserve_entities(spark, d):
    """Recomputed must-survive tokens of every segment."""
    return segments(spark, d).select("dialogue_idx", "turn_idx", F.array_join(ent.preserve(F.col("text")), "|").alias("preserve"))


_S_TOKEN = "'Xq' || CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(64 + i // 26) || chr(65 + i % 26) ELSE chr(64 + (i - 26) // 676) || chr(65 + (i - 26) // 26 % 26) || chr(65 + i % 26) END || 'qX'"


@query(S_SPANS + f""", tok AS (SELECT *, list_transform(spans, lambda x, k: {re.sub(r'\bi\b', '(k - 1)::INT', _S_TOKEN)}) AS tokens FROM found)
SELECT dialogue_idx, turn_idx, array_to_string(list_transform(range(0, len(spans) + 1), lambda k: substr(text, CASE WHEN k = 0 THEN 1 ELSE spans[k].stop + 1 END,
  CASE WHEN k = len(spans) THEN length(text) + 1 ELSE spans[k + 1].start - CASE WHEN k = 0 THEN 0 ELSE spans[k].stop END END) || coalesce(tokens[k + 1], '')), '') AS masked, true AS restored FROM tok""")
def masked_segments(spark, d):
    """Every segment masked and unmasked again; ``restored`` tells whether the round trip gave the text back."""
    s = segments(spark, d).select("dialogue_idx", "turn_idx", "text", ent.mask(F.col("text")).alias("m"))
    back = ent.unmask(F.col("m.masked"), F.col("m.entries"))
    return s.select("dialogue_idx", "turn_idx", F.col("m.masked").alias("masked"), (back == F.col("text")).alias("restored"))


@query(S_SPANS + f" SELECT dialogue_idx, turn_idx, {_S_CATEGORY} AS category FROM found")
def categorize(spark, d):
    return segments(spark, d).select("dialogue_idx", "turn_idx", ent.category(F.col("role"), F.col("text")).alias("category"))


def benchmark_built(spark, d):
    """Benchmark records from the corpus: the first turn of every text, filtered by length."""
    s = segments(spark, d).withColumn("category", ent.category(F.col("role"), F.col("text"))).withColumn("word_len", tx.word_count(F.col("text")))
    s = s.where((F.col("word_len") <= 400) & ((F.col("word_len") >= 3) | (F.col("category") == "edge")))
    s = dedupe.first_text(s, "text", ["dialogue_idx", "turn_idx"])
    return s.select(
        F.format_string("%s-%06d-t%d", "source", "dialogue_idx", "turn_idx").alias("id"), F.col("source").alias("section"), "domain", "category",
        F.col("text").alias("en_text"), "context_prev", ent.preserve(F.col("text")).alias("preserve"), F.length("text").alias("char_len"), "word_len",
    )


@query(S_SPANS + f""", k AS (SELECT *, lower(array_to_string({s_words('text')}, ' ')) AS k, {_S_CATEGORY} AS category FROM found WHERE {S_LENGTH})
SELECT source || '-' || lpad(dialogue_idx::VARCHAR, greatest(6, length(dialogue_idx::VARCHAR))::INT, '0') || '-t' || turn_idx AS id, source AS section, domain, category, text AS en_text, context_prev,
 {_S_PRESERVE} AS preserve, length(text)::INT AS char_len, len({s_words('text')})::INT AS word_len FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dialogue_idx, turn_idx) AS rn FROM k) WHERE rn = 1""")
def build_benchmark(spark, d):
    return benchmark_built(spark, d).withColumn("preserve", F.array_join("preserve", "|"))


@query("SELECT section, category, count(*) AS n FROM (SELECT DISTINCT id, section, category FROM benchmark) GROUP BY ALL")
def category_counts(spark, d):
    return read(spark, d, "benchmark").select("id", "section", "category").distinct().groupBy("section", "category").agg(F.count("*").alias("n"))


_S_SAMPLE = f"""WITH b AS (SELECT DISTINCT id, section, category, md5('13:' || id) AS h FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY section, category ORDER BY h, id) AS r FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY r, list_position({CATEGORIES}, category), id) AS turn FROM r WHERE r <= 3000)"""


@query(_S_SAMPLE + " SELECT id, section, category FROM (SELECT * FROM t WHERE turn <= greatest(1, 120 // (SELECT count(DISTINCT section) FROM b)) ORDER BY h, id LIMIT 120)")
def stratified_sample(spark, d):
    b = read(spark, d, "benchmark").select("id", "section", "category").distinct()
    return sampling.stratified(b, 120, CATEGORIES, ["id"])


@query("""WITH b AS (SELECT DISTINCT id, section, md5('13:' || id) AS h FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY h, id) AS r FROM b)
SELECT id, section FROM (SELECT * FROM r WHERE r <= greatest(1, 60 // (SELECT count(DISTINCT section) FROM b)) ORDER BY h, id LIMIT 60)""")
def smoke_slice(spark, d):
    return sampling.smoke_slice(read(spark, d, "benchmark").select("id", "section").distinct(), 60, ["id"])


# --- text functions over whole tables -----------------------------------------------------------

_A = "''‘’ʼʻ`´′‵"
_B = "''‘’`´′‵"


@query(f"""SELECT ord, regexp_replace(regexp_replace(regexp_replace(uz_text, '([oOgG])[{_A}]', '\\1ʻ', 'g'), '([a-zA-Z])[{_B}]([a-zA-Z])', '\\1ʼ\\2', 'g'), '([a-zA-Z])[{_B}]([a-zA-Z])', '\\1ʼ\\2', 'g') AS uz_text
FROM candidate WHERE uz_text IS NOT NULL""")
def normalize_apostrophes(spark, d):
    return read(spark, d, "candidate").where("uz_text IS NOT NULL").select("ord", tx.normalize_apostrophes(F.col("uz_text")).alias("uz_text"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, 'https?://[^\s]+'), ' ') AS urls FROM documents WHERE regexp_matches(text, 'https?://[^\s]+')")
def url_entities(spark, d):
    urls = F.regexp_extract_all("text", F.lit("https?://[^\\s]+"), F.lit(0))
    return read(spark, d, "documents").select("doc_id", urls.alias("u")).where(F.size("u") > 0).select("doc_id", F.array_join("u", " ").alias("urls"))


@query("SELECT DISTINCT id, sha1('uz|' || en_text) AS key FROM benchmark WHERE en_text IS NOT NULL")
def cache_keys(spark, d):
    return read(spark, d, "benchmark").where("en_text IS NOT NULL").select("id", tx.cache_key("uz", F.col("en_text")).alias("key")).distinct()


@query(f"""SELECT DISTINCT id, CASE WHEN coalesce(context_prev, '') <> '' THEN '{tx._CONTEXT}' || context_prev || chr(10) || chr(10) ELSE '' END || '{tx._TRANSLATE}' || en_text AS prompt FROM benchmark""")
def translation_prompts(spark, d):
    return read(spark, d, "benchmark").select("id", tx.translation_prompt(F.col("en_text"), F.col("context_prev")).alias("prompt")).distinct()


@query("SELECT ord, CASE WHEN length(uz_text) > 40 THEN left(uz_text, 40) || '…' ELSE uz_text END AS short FROM candidate")
def truncated_texts(spark, d):
    return read(spark, d, "candidate").select("ord", tx.truncate(F.col("uz_text"), 40).alias("short"))


# --- scores -------------------------------------------------------------------------------------


@query(S_SHARED + " SELECT id FROM shared")
def shared_ids(spark, d):
    return relational.shared_ids(scores(spark, d))


@query(S_SHARED + " SELECT system, round(avg(score), 8) AS paired_mean, count(*) AS n FROM scores WHERE id IN (SELECT id FROM shared) GROUP BY system")
def paired_mean(spark, d):
    s = scores(spark, d)
    return s.join(relational.shared_ids(s), "id", "left_semi").groupBy("system").agg(F.round(F.avg("score"), 8).alias("paired_mean"), F.count("*").alias("n"))


@query(S_SCORES + " SELECT system, round(avg(score), 8) AS mean, count(*) AS n FROM scores GROUP BY system")
def overall_mean(spark, d):
    return scores(spark, d).groupBy("system").agg(F.round(F.avg("score"), 8).alias("mean"), F.count("*").alias("n"))


@query(S_SCORES + " SELECT system, round(sum(score) / (SELECT count(DISTINCT id) FROM benchmark), 8) AS zero_imputed FROM scores GROUP BY system")
def zero_imputed_mean(spark, d):
    n = read(spark, d, "benchmark").agg(F.count_distinct("id").alias("n"))
    return scores(spark, d).groupBy("system").agg(F.sum("score").alias("s")).join(F.broadcast(n)).select("system", F.round(F.col("s") / F.col("n"), 8).alias("zero_imputed"))


@query(
    S_SCORES + f", c AS (SELECT s.system, coalesce(b.category, 'all') AS category, s.score FROM scores s LEFT JOIN (SELECT id, min(category) AS category FROM benchmark GROUP BY id) b USING (id)) SELECT system, "
    + ", ".join(f"round(avg(score) FILTER (category = '{c}'), 8) AS \"{c}\"" for c in [*CATEGORIES, "all"]) + " FROM c GROUP BY system"
)
def mean_by_category_pivot(spark, d):
    cats = read(spark, d, "benchmark").groupBy("id").agg(F.min("category").alias("category"))
    s = scores(spark, d).join(cats, "id", "left").withColumn("category", F.coalesce("category", F.lit("all")))
    p = s.groupBy("system").pivot("category", [*CATEGORIES, "all"]).agg(F.avg("score"))
    return p.select("system", *(F.round(F.col(c), 8).alias(c) for c in [*CATEGORIES, "all"]))


@query(S_PAIRED + " SELECT system, count(*) FILTER (diff > 0.01) AS wins, count(*) FILTER (diff < -0.01) AS losses, count(*) FILTER (abs(diff) <= 0.01) AS ties FROM paired GROUP BY system")
def win_loss_tie(spark, d):
    p = relational.paired(scores(spark, d), BASELINE)
    return p.groupBy("system").agg(F.count_if(F.col("diff") > 0.01).alias("wins"), F.count_if(F.col("diff") < -0.01).alias("losses"), F.count_if(F.abs("diff") <= 0.01).alias("ties"))


@query(S_PAIRED + " SELECT system, round(avg(CASE WHEN diff > 0 THEN 1.0 WHEN diff = 0 THEN 0.5 ELSE 0.0 END), 4) AS win_rate FROM paired GROUP BY system")
def win_rate(spark, d):
    p = relational.paired(scores(spark, d), BASELINE)
    return p.groupBy("system").agg(F.round(F.avg(F.when(F.col("diff") > 0, 1.0).when(F.col("diff") == 0, 0.5).otherwise(0.0)), 4).alias("win_rate"))


_S_SYS = S_SCORES + ", q AS (SELECT system, avg(score) AS qe FROM scores GROUP BY system), c AS (SELECT system, avg(chrf_pp) AS chrf FROM chrf_flores GROUP BY system), j AS (SELECT * FROM q JOIN c USING (system))"


def _system_metrics(spark, d):
    q = scores(spark, d).groupBy("system").agg(F.avg("score").alias("qe"))
    return q.join(read(spark, d, "chrf_flores").groupBy("system").agg(F.avg("chrf_pp").alias("chrf")), "system")


@query(_S_SYS + " SELECT round(covar_pop(qe, chrf) / nullif(stddev_pop(qe) * stddev_pop(chrf), 0), 4) AS pearson, count(*) AS n FROM j")
def pearson(spark, d):
    return _system_metrics(spark, d).agg(stats.pearson(F.col("qe"), F.col("chrf")).alias("pearson"), F.count("*").alias("n"))


_S_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


@query(_S_SYS + f", r AS (SELECT {_S_RANK.format('qe')} AS a, {_S_RANK.format('chrf')} AS b FROM j) SELECT round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 4) AS spearman FROM r")
def spearman(spark, d):
    return stats.spearman(_system_metrics(spark, d), "qe", "chrf")


@query(f"SELECT run_id, system, rank() OVER (PARTITION BY run_id ORDER BY chrf_pp) + (count(*) OVER (PARTITION BY run_id, chrf_pp) - 1) / 2 AS avg_rank FROM chrf_flores WHERE chrf_pp IS NOT NULL")
def avg_tie_rank(spark, d):
    c = read(spark, d, "chrf_flores").where("chrf_pp IS NOT NULL")
    return c.select("run_id", "system", stats.average_rank("chrf_pp", ["run_id"]).alias("avg_rank"))


@query(S_SCORES + """, m AS (SELECT run_id, system, id, score FROM x), c AS (SELECT m.system, m.score AS a, s.chrf_pp AS b FROM m JOIN (SELECT run_id, system, max(chrf_pp) AS chrf_pp FROM chrf_flores GROUP BY ALL) s USING (run_id, system))
SELECT system, CASE WHEN count(*) >= 30 THEN round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 4) END AS r, count(*) AS n FROM c WHERE b IS NOT NULL GROUP BY system""")
def segment_correlation(spark, d):
    """Correlation of message scores with a second metric; null below 30 points."""
    x = QUERIES["last_score"](spark, d)
    c = read(spark, d, "chrf_flores").groupBy("run_id", "system").agg(F.max("chrf_pp").alias("b")).where("b IS NOT NULL")
    both = x.join(c, ["run_id", "system"])
    return both.groupBy("system").agg(F.when(F.count("*") >= 30, stats.pearson(F.col("score"), F.col("b"))).alias("r"), F.count("*").alias("n"))


def _s_samples(source: str, group: str, value: str, order: str) -> str:
    weight = " + ".join(f"(u >= {b})::INT" for b in stats.POISSON)
    return f""", rows AS (SELECT {group}, {order} AS o, {value} AS v FROM {source}),
blk AS (SELECT *, unnest(range({ITERATIONS // 4})) AS blk FROM rows),
h AS (SELECT *, md5('13:' || concat_ws('|', {group}) || ':' || o || ':' || blk) AS h FROM blk),
j AS (SELECT *, unnest([0, 1, 2, 3]) AS j FROM h),
u AS (SELECT {group}, blk * 4 + j AS it, v, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT / 4294967296.0 AS u FROM j),
wt AS (SELECT {group}, it, v, {weight} AS w FROM u),
means AS (SELECT {group}, it, sum(w * v) / sum(w) AS m FROM wt WHERE w > 0 GROUP BY ALL)"""


@query(S_SCORES + _s_samples("scores", "system", "score", "id") + """, n AS (SELECT system, count(*) AS n FROM scores GROUP BY system),
o AS (SELECT system, list_sort(list(m)) AS ms FROM means GROUP BY system)
SELECT system, CASE WHEN n >= 2 THEN round(ms[26], 4) END AS ci_low, CASE WHEN n >= 2 THEN round(ms[976], 4) END AS ci_high FROM o JOIN n USING (system)""")
def bootstrap_ci(spark, d):
    return stats.bootstrap_ci(scores(spark, d), ["system"], "score", "id")


_S_P = """, tot AS (SELECT {g}, count(*) AS n, sum(diff) AS total FROM {t} GROUP BY ALL), pv AS (SELECT {g}, round(avg((m <= 0)::INT), 4) AS p FROM means GROUP BY ALL)
SELECT {g}, CASE WHEN n < 2 THEN NULL WHEN total <= 0 THEN 1.0 ELSE p END AS p FROM tot LEFT JOIN pv USING ({g})"""


@query(S_PAIRED + _s_samples("paired", "system", "diff", "id") + _S_P.format(g="system", t="paired"))
def paired_bootstrap_p(spark, d):
    return stats.paired_p(relational.paired(scores(spark, d), BASELINE), ["system"])


def ranked(spark, d, top: int | None = None) -> DataFrame:
    """(system, mean, rank) by paired mean, ties in registry order; per-system rows, so one task ranks them."""
    s = scores(spark, d).where(F.col("system").isin(SYSTEMS))
    m = s.join(relational.shared_ids(s), "id", "left_semi").groupBy("system").agg(F.round(F.avg("score"), 12).alias("mean"))
    place = F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("system"))
    r = m.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), place)))
    return r.where(F.col("rank") <= top) if top else r


_S_RANKED = S_SHARED + f""", ranked AS (SELECT system, mean, row_number() OVER (ORDER BY mean DESC, list_position({SYSTEMS}, system)) AS rank
 FROM (SELECT system, round(avg(score), 12) AS mean FROM scores WHERE id IN (SELECT id FROM shared) GROUP BY system))"""


@query(_S_RANKED + f" SELECT system, mean, rank::INT AS rank FROM ranked WHERE rank <= {TOP}")
def topk_systems(spark, d):
    return ranked(spark, d, TOP)


@query(_S_RANKED + f""", pr AS (SELECT a.system AS a, b.system AS b, sa.id, sa.score - sb.score AS diff FROM ranked a JOIN ranked b ON a.rank < b.rank AND b.rank <= {TOP}
 JOIN scores sa ON sa.system = a.system JOIN scores sb ON sb.system = b.system AND sb.id = sa.id)""" + _s_samples("pr", "a, b", "diff", "id") + _S_P.format(g="a, b", t="pr"))
def top5_pair_matrix(spark, d):
    return stats.paired_p(relational.pairs_of(scores(spark, d), ranked(spark, d, TOP).select("system", "rank")), ["a", "b"])


@query(_S_RANKED + f""", z AS (SELECT system, row_number() OVER (ORDER BY s DESC, list_position({SYSTEMS}, system)) AS zero_rank FROM (SELECT system, round(sum(score), 8) AS s FROM scores GROUP BY system))
SELECT system, rank::INT AS rank, zero_rank::INT AS zero_rank FROM ranked JOIN z USING (system) WHERE rank <> zero_rank""")
def rank_shift(spark, d):
    place = F.array_position(F.array(*map(F.lit, SYSTEMS)), F.col("system"))
    z = scores(spark, d).where(F.col("system").isin(SYSTEMS)).groupBy("system").agg(F.round(F.sum("score"), 8).alias("s"))
    z = z.select("system", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("s"), place)).alias("zero_rank"))
    return ranked(spark, d).join(z, "system").where("rank <> zero_rank").select("system", "rank", "zero_rank")


@query(S_SHARED + " SELECT system, count(*) FILTER (id NOT IN (SELECT id FROM shared)) AS n_excluded FROM scores GROUP BY system")
def excluded_counts(spark, d):
    s = scores(spark, d)
    sh = relational.shared_ids(s).withColumn("shared", F.lit(True))
    return s.join(sh, "id", "left").groupBy("system").agg(F.count_if(F.col("shared").isNull()).alias("n_excluded"))


@query(S_LATEST + f""", e AS (SELECT system, count(*) AS n_answers, count(*) FILTER (NOT f) AS n_empty FROM latest JOIN bench USING (id) GROUP BY system),
sc AS (SELECT s.system, count(*) AS n_scored FROM (SELECT DISTINCT run_id, {S_SEG} AS id, system FROM xcomet_qe WHERE score IS NOT NULL) s JOIN (SELECT DISTINCT id FROM benchmark) b USING (id) GROUP BY ALL)
SELECT system, n_answers, n_empty, coalesce(n_scored, 0) AS n_scored FROM e LEFT JOIN sc USING (system) WHERE coalesce(n_scored, 0) + n_empty <> n_answers""")
def skew_check(spark, d):
    full = F.coalesce(tx.strip(F.col("uz_text")) != "", F.lit(False))
    ids = read(spark, d, "benchmark").select("id").distinct()
    e = latest(spark, d).join(ids, "id").groupBy("system").agg(F.count("*").alias("n_answers"), F.count_if(~full).alias("n_empty"))
    sc = QUERIES["last_score"](spark, d).join(ids, "id").groupBy("system").agg(F.count("*").alias("n_scored"))
    j = e.join(sc, "system", "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    return j.where("n_scored + n_empty <> n_answers").select("system", "n_answers", "n_empty", "n_scored")


@query("SELECT system, count(*) FILTER (coalesce(n_chunks, 1) > 1) AS n_chunked, count(*) AS n FROM xcomet_qe GROUP BY system")
def chunked_pairs(spark, d):
    x = read(spark, d, "xcomet_qe")
    return x.groupBy("system").agg(F.count_if(F.coalesce("n_chunks", F.lit(1)) > 1).alias("n_chunked"), F.count("*").alias("n"))


# --- joins ----------------------------------------------------------------------------------------


@query(S_LATEST + f", done AS (SELECT DISTINCT run_id, system, {S_SEG} AS id FROM xcomet_qe WHERE score IS NOT NULL) SELECT l.run_id, l.system, l.id FROM latest l WHERE f AND NOT EXISTS (SELECT 1 FROM done WHERE done.run_id = l.run_id AND done.system = l.system AND done.id = l.id)")
def resume_antijoin(spark, d):
    todo = latest(spark, d).where(F.coalesce(tx.strip(F.col("uz_text")) != "", F.lit(False))).select("run_id", "system", "id")
    return relational.pending(todo, QUERIES["last_score"](spark, d), ["run_id", "system", "id"])


@query(S_SCORES + ", s AS (SELECT id FROM (SELECT DISTINCT id FROM scores) ORDER BY md5('13:' || id), id LIMIT 50) SELECT system, id, score FROM scores WHERE id IN (SELECT id FROM s)")
def sample_semijoin(spark, d):
    s = scores(spark, d)
    return s.join(sampling.sample_ids(s, 50), "id", "left_semi").select("system", "id", "score")


@query(f"SELECT a.id, a.en_text, b.uz_text FROM (SELECT id, row_number() OVER (ORDER BY id) AS pos, {s_strip('en_text')} AS en_text FROM refset) a JOIN (SELECT row_number() OVER (ORDER BY id) AS pos, {s_strip('uz_text')} AS uz_text FROM refset) b USING (pos) WHERE a.en_text <> '' AND b.uz_text <> ''")
def refset_zip(spark, d):
    r = read(spark, d, "refset")  # a fixed table of evaluation items: one task numbers it
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("pos")
    en, uz = r.select("id", pos, tx.strip(F.col("en_text")).alias("en_text")), r.select(pos, tx.strip(F.col("uz_text")).alias("uz_text"))
    return relational.zip_by_position(en, uz).where("en_text <> '' AND uz_text <> ''").select("id", "en_text", "uz_text")


@query(S_LATEST + f", sc AS (SELECT run_id, {S_SEG} AS id, system, max(score) AS score FROM xcomet_qe WHERE score IS NOT NULL GROUP BY ALL) SELECT l.run_id, l.system, l.id, b.en_text, l.uz_text, s.score FROM latest l JOIN bench b USING (id) JOIN sc s ON s.run_id = l.run_id AND s.system = l.system AND s.id = l.id")
def worked_examples(spark, d):
    both = pairs(spark, d).select("run_id", "system", "id", "en_text", "uz_text")
    return both.join(QUERIES["last_score"](spark, d), ["run_id", "system", "id"])


# --- chunks ---------------------------------------------------------------------------------------


def _s_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?…]){W}+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda y: {s_strip('y')}), lambda y: y <> '')"


def _s_split(sents: str) -> str:
    """As many groups of about equal length as ``k`` says: a fold over sentences that carries the closed groups and the open one."""
    items = f"list_transform(range(1, len({sents}) + 1), lambda i: [{{'t': {sents}[i], 'c': list_sum(list_transform({sents}[:i], lambda y: length(y)))::BIGINT, 'i': i, 'open': true}}])"
    base, text = "CASE WHEN acc[-1].open THEN acc[:-2] ELSE acc END", "CASE WHEN acc[-1].open THEN acc[-1].t || ' ' || x[1].t ELSE x[1].t END"
    total = f"list_sum(list_transform({sents}, lambda y: length(y)))"
    done = f"len({base}) < k - 1 AND (x[1].c * k >= (len({base}) + 1) * {total} OR len({sents}) - x[1].i <= k - len({base}) - 1)"
    step = f"list_concat({base}, [{{'t': {text}, 'c': x[1].c, 'i': x[1].i, 'open': NOT ({done})}}])"
    return f"list_transform(list_reduce(list_prepend(({items})[1][:0], {items}), lambda acc, x: {step}), lambda y: y.t)"


_S_PACK = f"""list_reduce(list_prepend([{{'t': '', 'n': 0::BIGINT}}][:0], list_transform(es, lambda y: [{{'t': y, 'n': len({s_words('y')})::BIGINT}}])),
 lambda acc, x: CASE WHEN len(acc) > 0 AND acc[-1].n + x[1].n <= {chunking.MAX_WORDS} THEN list_concat(acc[:-2], [{{'t': acc[-1].t || ' ' || x[1].t, 'n': acc[-1].n + x[1].n}}]) ELSE list_concat(acc, x) END)"""


@query(S_LATEST + f""", p AS (SELECT l.run_id, l.system, l.id, b.en_text AS en, l.uz_text AS uz, {_s_sentences('b.en_text')} AS e0, {_s_sentences('l.uz_text')} AS u0 FROM latest l JOIN bench b USING (id) WHERE {s_strip("coalesce(l.uz_text, '')")} <> ''),
s AS (SELECT *, CASE WHEN len(e0) > 0 THEN e0 ELSE [en] END AS es, CASE WHEN len(u0) > 0 THEN u0 ELSE [uz] END AS us, len({s_words('en')}) AS words FROM p),
k AS (SELECT *, list_transform({_S_PACK}, lambda y: y.t) AS packed FROM s),
few AS (SELECT *, least(len(packed), len(us)) AS k FROM k),
c AS (SELECT run_id, system, id, CASE WHEN words <= {chunking.MAX_WORDS} OR len(es) < 2 OR len(us) < 2 OR k < 2 THEN [en] WHEN len(packed) = k THEN packed ELSE {_s_split('es')} END AS src,
 CASE WHEN words <= {chunking.MAX_WORDS} OR len(es) < 2 OR len(us) < 2 OR k < 2 THEN [uz] ELSE {_s_split('us')} END AS mt FROM few)
SELECT run_id, system, id, (i - 1)::INT AS chunk_no, src[i] AS src, mt[i] AS mt, len({s_words('src[i]')})::INT AS n_words FROM (SELECT *, unnest(range(1, len(src) + 1)) AS i FROM c)""")
def chunk_sentences(spark, d):
    """Chunks of every latest answer with its source."""
    p = pairs(spark, d).where(tx.strip(F.coalesce("uz_text", F.lit(""))) != "")
    chunks = F.posexplode(chunking.chunk_pairs(F.col("en_text"), F.col("uz_text"))).alias("chunk_no", "c")
    return p.select("run_id", "system", "id", chunks).select("run_id", "system", "id", "chunk_no", "c.src", "c.mt", tx.word_count(F.col("c.src")).alias("n_words"))


@query(f"""WITH b AS (SELECT DISTINCT id, en_text FROM benchmark), s AS (SELECT id, unnest(list_filter(list_transform(string_split(regexp_replace(en_text, '([.!?…]){W}+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {s_strip('x')}), lambda x: x <> '')) AS s FROM b),
w AS (SELECT id, greatest(1, len({s_words('s')})) AS w, length(s) / 100.0 AS score FROM s)
SELECT id, round(sum(score * w) / sum(w), 6) AS score, count(*) AS n_chunks FROM w GROUP BY id""")
def chunk_weighted_mean(spark, d):
    """Sentence figures recombined by words (the figure stands for a model's score)."""
    b = read(spark, d, "benchmark").select("id", "en_text").distinct()
    s = b.select("id", F.explode(tx.sentences(F.col("en_text"))).alias("s")).where("s <> ''")
    w = F.greatest(F.lit(1), tx.word_count(F.col("s")))
    s = s.select("id", w.alias("w"), (F.length("s") / 100.0).alias("score"))
    return s.groupBy("id").agg(F.round(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 6).alias("score"), F.count("*").alias("n_chunks"))


# --- judge ----------------------------------------------------------------------------------------

_SEVERITIES = ["critical", "major", "minor", "odd"]


def _judged(spark, d):
    """Stand-in judge answers: three runs per delivery with errors that follow from ord."""
    runs = read(spark, d, "candidate").select("ord", "system", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run"))
    sev = F.get(F.array(*map(F.lit, _SEVERITIES)), ((F.col("ord") + F.col("run")) % 4).cast("int"))
    error = F.concat(F.lit('{"category":"style","severity":"'), sev, F.lit('","span":"x"}'))
    n = (F.col("ord") % 3).cast("int")
    body = F.concat(F.lit('```json\n{"errors":['), F.array_join(F.array_repeat(error, n), ","), F.lit('],"adequacy":'), (F.col("ord") % 5 + 1).cast("string"), F.lit(',"fluency":4}\n```'))
    return runs.withColumn("answer", body)


_S_MQM = """WITH r AS (SELECT ord, system, unnest([1, 2, 3]) AS run FROM candidate),
m AS (SELECT ord, system, run, greatest(-25.0, -(ord % 3) * [10, 5, 1, 1][((ord + run) % 4 + 1)::INT])::DOUBLE AS mqm, (ord % 5 + 1)::DOUBLE AS adequacy FROM r)"""


@query(_S_MQM + " SELECT ord, run::INT AS run, mqm FROM m")
def mqm_scores(spark, d):
    p = _judged(spark, d).withColumn("a", parse_answer(F.col("answer")))
    return p.select("ord", "run", mqm_score(F.col("a.errors")).alias("mqm"))


def _judge_rows(spark, d):
    p = _judged(spark, d).withColumn("a", parse_answer(F.col("answer"))).withColumn("mqm", mqm_score(F.col("a.errors")))
    return p.groupBy("ord", "system").agg(
        F.round(F.avg("mqm"), 3).alias("mqm"), F.round(F.stddev_pop("mqm"), 3).alias("mqm_std"), F.count("*").alias("runs"),
        F.round(F.avg("a.adequacy"), 3).alias("adequacy"), F.min_by("a.errors", F.struct("mqm", "run")).alias("errors"),
    )


@query(_S_MQM + " SELECT ord, round(avg(mqm), 3) AS mqm, round(stddev_pop(mqm), 3) AS mqm_std, count(*) AS runs, round(avg(adequacy), 3) AS adequacy, max(ord % 3)::INT AS n_errors FROM m GROUP BY ord")
def mqm_aggregate(spark, d):
    return _judge_rows(spark, d).select("ord", "mqm", "mqm_std", "runs", "adequacy", F.size("errors").alias("n_errors"))


@query(_S_MQM + ", a AS (SELECT ord, system, round(stddev_pop(mqm), 3) AS sd FROM m GROUP BY ALL) SELECT system, round(avg(sd), 4) AS consistency, bool_and(sd = 0) AS all_zero FROM a GROUP BY system")
def judge_consistency(spark, d):
    return _judge_rows(spark, d).groupBy("system").agg(F.round(F.avg("mqm_std"), 4).alias("consistency"), F.every(F.col("mqm_std") == 0).alias("all_zero"))


# --- string metrics -------------------------------------------------------------------------------


def _ref_pairs(spark, d):
    """Last non-empty answers to the items with a reference."""
    hyps = dedupe.last_text(answers(spark, d), ["run_id", "system", "id"], "uz_text", "ord")
    refs = read(spark, d, "refset").where("uz_text <> ''").select("id", F.col("uz_text").alias("ref"))
    return hyps.join(refs, "id").select("system", F.concat_ws(":", F.col("run_id").cast("string"), "id").alias("id"), F.col("uz_text").alias("hyp"), "ref")


_S_REF = f"""WITH cand AS (SELECT ord, run_id, system, {S_SEG} AS id, uz_text FROM candidate),
h AS (SELECT run_id, system, id, arg_max(uz_text, ord) AS hyp FROM cand WHERE uz_text <> '' GROUP BY ALL),
pr AS (SELECT system, run_id || ':' || h.id AS id, hyp, r.uz_text AS ref FROM h JOIN refset r ON r.id = h.id WHERE r.uz_text <> '')"""


@query(_S_REF + " SELECT system, count(*) FILTER (length(hyp) > 200 AND length(hyp) > 3 * length(ref)) AS n_degenerate, count(*) AS n FROM pr GROUP BY system")
def ref_degenerate(spark, d):
    bad = (F.length("hyp") > 200) & (F.length("hyp") > 3 * F.length("ref"))
    return _ref_pairs(spark, d).groupBy("system").agg(F.count_if(bad).alias("n_degenerate"), F.count("*").alias("n"))


_PUNCT = r"!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def _s_chrf_tokens(x: str) -> str:
    last = f"length(w) > 1 AND regexp_matches(w, '[{_PUNCT}]$')"
    first = f"length(w) > 1 AND regexp_matches(w, '^[{_PUNCT}]')"
    return f"flatten(list_transform({s_words(x)}, lambda w: CASE WHEN {last} THEN [w[:-2], w[-1]] WHEN {first} THEN [w[1], w[2:]] ELSE [w] END))"


_S_CHRF = f""", tk AS (SELECT system, id, regexp_replace(hyp, '{W}+', '', 'g') AS hc, regexp_replace(ref, '{W}+', '', 'g') AS rc, {_s_chrf_tokens('hyp')} AS hw, {_s_chrf_tokens('ref')} AS rw FROM pr),
g AS (SELECT system, id, 'c' || k AS kind, unnest(list_concat(list_transform(range(1, length(hc) - k + 2), lambda i: {{'s': 0, 'g': substr(hc, i, k)}}), list_transform(range(1, length(rc) - k + 2), lambda i: {{'s': 1, 'g': substr(rc, i, k)}}))) AS x
  FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS k FROM tk)
  UNION ALL SELECT system, id, 'w' || k, unnest(list_concat(list_transform(range(1, len(hw) - k + 2), lambda i: {{'s': 0, 'g': array_to_string(hw[i:i + k - 1], ' ')}}), list_transform(range(1, len(rw) - k + 2), lambda i: {{'s': 1, 'g': array_to_string(rw[i:i + k - 1], ' ')}})))
  FROM (SELECT *, unnest([1, 2]) AS k FROM tk)),
c AS (SELECT system, id, kind, x.g AS gram, count(*) FILTER (x.s = 0) AS h, count(*) FILTER (x.s = 1) AS r FROM g GROUP BY ALL),
pp AS (SELECT system, id, kind, CASE WHEN sum(r) > 0 THEN sum(h) ELSE 0 END AS h, sum(r) AS r, sum(least(h, r)) AS m FROM c GROUP BY ALL),
k AS (SELECT system, kind, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM pp GROUP BY ALL HAVING sum(h) > 0 AND sum(r) > 0),
f AS (SELECT system, avg(m / h) AS p, avg(m / r) AS r FROM k GROUP BY system)
SELECT system, round(CASE WHEN 4 * p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 2) AS chrf_pp FROM f"""


@query(_S_REF + _S_CHRF)
def chrf_pp(spark, d):
    return metrics.chrf_pp(_ref_pairs(spark, d), ["system"], "hyp", "ref")


@query(_S_REF + f""", tk AS (SELECT system, id, {s_words('hyp')} AS h, {s_words('ref')} AS r FROM pr), o AS (SELECT *, unnest([1, 2, 3, 4]) AS k FROM tk),
hg AS (SELECT system, id, k, unnest(list_transform(range(1, len(h) - k + 2), lambda i: array_to_string(h[i:i + k - 1], ' '))) AS g FROM o), rg AS (SELECT system, id, k, unnest(list_transform(range(1, len(r) - k + 2), lambda i: array_to_string(r[i:i + k - 1], ' '))) AS g FROM o),
hc AS (SELECT system, id, k, g, count(*) AS n FROM hg GROUP BY ALL), rc AS (SELECT system, id, k, g, count(*) AS n FROM rg GROUP BY ALL),
mt AS (SELECT system, k, sum(least(hc.n, rc.n)) AS m FROM hc JOIN rc USING (system, id, k, g) GROUP BY ALL),
ht AS (SELECT system, k, sum(n) AS n FROM hc GROUP BY ALL), rt AS (SELECT system, sum(n) AS rl FROM rc WHERE k = 1 GROUP BY ALL),
l AS (SELECT system, sum(ln(m / ht.n)) / 4 AS lp, max(ht.n) FILTER (k = 1) AS hl FROM ht JOIN mt USING (system, k) GROUP BY system)
SELECT system, round(100 * exp(lp + CASE WHEN hl >= rl THEN 0 ELSE 1 - rl / hl END), 2) AS bleu FROM l JOIN rt USING (system)""")
def bleu_whitespace(spark, d):
    return metrics.bleu(_ref_pairs(spark, d), ["system"], "hyp", "ref")


# --- latency and errors -----------------------------------------------------------------------------


@query("SELECT system, count(*) FILTER (coalesce(error, '') <> '') AS n_errors, round(avg(latency_ms), 4) AS mean_latency, max(latency_ms) AS max_latency FROM candidate GROUP BY system")
def run_health(spark, d):
    c = read(spark, d, "candidate")
    return c.groupBy("system").agg(F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_errors"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.max("latency_ms").alias("max_latency"))


# --- report and streaming -----------------------------------------------------------------------------


_S_BOARD = f"""{S_SHARED}, paired AS (SELECT a.system, a.id, a.score - b.score AS diff FROM scores a JOIN scores b ON a.id = b.id AND b.system = '{BASELINE}' WHERE a.system <> '{BASELINE}')
{_s_samples('scores', 'system', 'score', 'id')}, o AS (SELECT system, list_sort(list(m)) AS ms FROM means GROUP BY system)
{re.sub(r"\b(rows|blk|h|j|u|wt|means) AS \(", r"p_\1 AS (", re.sub(r"FROM (rows|blk|h|j|u|wt|means)\b", r"FROM p_\1", _s_samples('paired', 'system', 'diff', 'id')))},
tot AS (SELECT system, count(*) AS n, sum(diff) AS total, count(*) FILTER (diff > 0.01) AS w, count(*) FILTER (diff < -0.01) AS l, count(*) FILTER (abs(diff) <= 0.01) AS t FROM paired GROUP BY system),
pv AS (SELECT system, round(avg((m <= 0)::INT), 4) AS p FROM p_means GROUP BY system),
mean AS (SELECT system, count(*) AS n, round(avg(score), 8) AS qe, round(sum(score) / (SELECT count(DISTINCT id) FROM benchmark), 8) AS zero FROM scores GROUP BY system),
pm AS (SELECT system, round(avg(score), 8) AS paired, count(*) AS n_shared FROM scores WHERE id IN (SELECT id FROM shared) GROUP BY system)
SELECT mean.system, mean.n, qe, zero, paired, n_shared, CASE WHEN mean.n >= 2 THEN round(ms[26], 4) END AS ci_low, CASE WHEN mean.n >= 2 THEN round(ms[976], 4) END AS ci_high,
 CASE WHEN tot.n IS NULL OR tot.n < 2 THEN NULL WHEN total <= 0 THEN 1.0 ELSE p END AS p, w, l, t
FROM mean LEFT JOIN pm USING (system) LEFT JOIN o USING (system) LEFT JOIN tot ON tot.system = mean.system LEFT JOIN pv ON pv.system = mean.system"""


@query(_S_BOARD)
def leaderboard(spark, d):
    """The board of the report: means, intervals, p against the baseline, wins, losses and ties by system."""
    from mezon.plans.leaderboard import Inputs, board

    n = read(spark, d, "benchmark").select("id").distinct().count()
    b = board(Inputs(scores(spark, d), n), ITERATIONS)
    return b.withColumns({c: F.round(c, 8) for c in ("qe", "zero", "paired")})


@query(S_GATES.replace("FROM latest l JOIN bench b USING (id)", "FROM cand l JOIN bench b USING (id)") + "SELECT system, count(*) AS n, count(*) FILTER (passed) AS n_passed FROM g GROUP BY system")
def stream_gate_counts(spark, d):
    """All deliveries run through the gate stream until nothing is left, then counted."""
    import uuid

    from mezon.session import checkpoint_dir
    from mezon.streaming import gates_stream as gs

    out = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = gs.answer_stream(spark, f"{d}/candidate.parquet*", read(spark, d, "candidate").schema)
    gs.append_to(gs.gate_stream(source, bench(spark, d)), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("system").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))


@query(f"SELECT unnest({SYSTEMS}) AS system, unnest(range(10))::INT AS position")
def system_registry(spark, d):
    from mezon.models.registry import as_table

    return as_table(spark).select("system", "position")


@query(r"""SELECT id, set_name, CASE WHEN domain IS NULL THEN 'all' ELSE domain END AS category, en_text, regexp_replace(regexp_replace(regexp_replace(uz, '([oOgG])[''‘’ʼʻ`´′‵]', '\1ʻ', 'g'),
 '([a-zA-Z])[''‘’`´′‵]([a-zA-Z])', '\1ʼ\2', 'g'), '([a-zA-Z])[''‘’`´′‵]([a-zA-Z])', '\1ʼ\2', 'g') AS uz_text FROM (SELECT *, """ + s_strip("uz_text") + " AS uz FROM refset) WHERE " + s_strip("en_text") + " <> '' AND uz <> ''")
def clean_references(spark, d):
    r = read(spark, d, "refset").withColumn("uz", tx.strip(F.col("uz_text")))
    kept = r.where((tx.strip(F.col("en_text")) != "") & (F.col("uz") != ""))
    return kept.select("id", "set_name", F.coalesce("domain", F.lit("all")).alias("category"), "en_text", tx.normalize_apostrophes(F.col("uz")).alias("uz_text"))


# --- further functions, sources and sinks over whole tables ---------------------------------------------


@query("SELECT DISTINCT id, coalesce(category, domain, 'all') AS category FROM benchmark")
def default_categories(spark, d):
    return read(spark, d, "benchmark").select("id", tx.category_or_domain(F.col("category"), F.col("domain")).alias("category")).distinct()


@query(S_LATEST + """, m AS (SELECT run_id, system, id, arg_max(coalesce(uz_text, ''), ord) AS uz_text FROM cand GROUP BY ALL)
SELECT m.run_id, m.system, m.id, array_to_string(list_filter(b.preserve, lambda e: NOT contains(m.uz_text, e)), '|') AS missing FROM m JOIN bench b USING (id)
WHERE len(list_filter(b.preserve, lambda e: NOT contains(m.uz_text, e))) > 0""")
def missing_entities(spark, d):
    """Every last answer that lost entities, with those it lost."""
    last = dedupe.last_row(answers(spark, d).select("run_id", "system", "id", "ord", "uz_text"), ["run_id", "system", "id"], "ord")
    both = last.join(bench(spark, d).where(F.size("preserve") > 0).select("id", "preserve"), "id")
    lost = F.filter("preserve", lambda e: ~F.contains(F.coalesce("uz_text", F.lit("")), e))
    return both.withColumn("m", lost).where(F.size("m") > 0).select("run_id", "system", "id", F.array_join("m", "|").alias("missing"))


_S_JUDGE = tx._JUDGE.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(f"""SELECT DISTINCT r.id, CASE WHEN coalesce(b.context_prev, '') <> '' THEN 'Dialogue context (previous turn, background only):' || chr(10) || b.context_prev || chr(10) || chr(10) ELSE '' END
 || 'English source:' || chr(10) || r.en_text || chr(10) || chr(10) || 'Uzbek candidate:' || chr(10) || r.uz_text || '{_S_JUDGE}' AS prompt FROM refset r LEFT JOIN benchmark b USING (id) WHERE r.uz_text IS NOT NULL""")
def judge_prompts(spark, d):
    context = read(spark, d, "benchmark").select("id", "context_prev")
    r = read(spark, d, "refset").where("uz_text IS NOT NULL").join(context, "id", "left")
    return r.select("id", tx.judge_prompt(F.col("en_text"), F.col("uz_text"), F.col("context_prev")).alias("prompt")).distinct()


@query("SELECT ord, regexp_replace('<think>' || coalesce(error, '') || chr(10) || '</THINK>' || uz_text, '(?is)<think>.*?</think>', '', 'g') AS uz_text FROM candidate WHERE uz_text IS NOT NULL")
def reasoning_stripped(spark, d):
    """Reasoning in front of an answer taken out again (the delivery's error stands for it)."""
    raw = F.concat(F.lit("<think>"), F.coalesce("error", F.lit("")), F.lit("\n</THINK>"), "uz_text")
    return read(spark, d, "candidate").where("uz_text IS NOT NULL").select("ord", tx.strip_reasoning(raw).alias("uz_text"))


@query("SELECT ord, replace(replace(replace(replace(replace(uz_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS html FROM candidate WHERE uz_text IS NOT NULL")
def html_escaped(spark, d):
    return read(spark, d, "candidate").where("uz_text IS NOT NULL").select("ord", tx.html_escape(F.col("uz_text")).alias("html"))


@query("""SELECT system, printf('%.2f', avg(latency_ms)) AS mean_latency, CASE WHEN s < 3600 THEN printf('%d:%02d', s // 60, s % 60) ELSE printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) END AS spent
FROM (SELECT system, latency_ms, sum(latency_ms) OVER (PARTITION BY system)::BIGINT // 1000 AS s FROM candidate) GROUP BY system, s""")
def latency_report(spark, d):
    """Mean latency and the time all answers of a system took, as a report writes them."""
    c = read(spark, d, "candidate").groupBy("system").agg(F.avg("latency_ms").alias("m"), F.sum("latency_ms").alias("s"))
    return c.select("system", tx.fmt(F.col("m"), 2).alias("mean_latency"), tx.fmt_duration(F.col("s") / 1000).alias("spent"))


@query(S_PAIRED + _s_samples("paired", "system", "diff", "id") + """, tot AS (SELECT system, count(*) AS n, sum(diff) AS total FROM paired GROUP BY ALL), pv AS (SELECT system, round(avg((m <= 0)::INT), 4) AS p FROM means GROUP BY ALL),
r AS (SELECT system, CASE WHEN n < 2 THEN NULL WHEN total <= 0 THEN 1.0 ELSE p END::DOUBLE AS p FROM tot LEFT JOIN pv USING (system))
SELECT system, CASE WHEN p IS NULL THEN '—' WHEN p < 0.05 THEN p::VARCHAR || '*' ELSE p::VARCHAR END AS label FROM r""")
def significance_labels(spark, d):
    p = stats.paired_p(relational.paired(scores(spark, d), BASELINE), ["system"])
    return p.select("system", stats.label(F.col("p")).alias("label"))


@query(S_GATES + f""", x AS (SELECT run_id, {S_SEG} AS id, system, max(score) AS score FROM xcomet_qe WHERE score IS NOT NULL GROUP BY ALL)
SELECT system, CASE WHEN count(*) >= 30 THEN round(covar_pop(score, len_ratio) / nullif(stddev_pop(score) * stddev_pop(len_ratio), 0), 4) END AS r, count(*) AS n FROM x JOIN g USING (run_id, system, id) GROUP BY system""")
def message_correlation(spark, d):
    """Correlation of a message's score with its length ratio, a figure of the same message; null below 30 points."""
    both = QUERIES["last_score"](spark, d).join(gated(spark, d).select("run_id", "system", "id", "len_ratio"), ["run_id", "system", "id"])
    return both.groupBy("system").agg(F.when(F.count("*") >= 30, stats.pearson(F.col("score"), F.col("len_ratio"))).alias("r"), F.count("*").alias("n"))


@query(f"SELECT DISTINCT system FROM xcomet_qe WHERE system IN ({', '.join(repr(x) for x in SYSTEMS if not x.startswith(('nllb', 'neuronai')))})")
def light_systems(spark, d):
    """Scored systems that load no large model into a worker."""
    from mezon.models.registry import resolve

    light = [x.key for x in resolve("all", heavy=False)]
    return relational.choose_systems(read(spark, d, "xcomet_qe"), ",".join(light), SYSTEMS).select("system").distinct()


def _scratch(spark) -> str:
    import uuid

    from mezon.session import checkpoint_dir

    return f"{checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


_S_LINES = "SELECT ord, run_id, id, system, uz_text, latency_ms FROM candidate"
_LINES = "ord long, run_id long, id string, system string, uz_text string, latency_ms long"


@query(_S_LINES)
def jsonl_round_trip(spark, d):
    """Answers written as JSON lines and read strictly again."""
    from mezon.sources import readers, sinks

    out = _scratch(spark)
    sinks.write_jsonl(read(spark, d, "candidate").select("ord", "run_id", "id", "system", "uz_text", "latency_ms"), out)
    return readers.read_strict(spark, out, _LINES)


def _with_bad_lines(spark, d) -> str:
    """JSON lines of all answers, and for each run one line that is cut off."""
    out = _scratch(spark)
    rows = read(spark, d, "candidate").select("ord", "run_id", "id", "system", "uz_text", "latency_ms")
    bad = rows.select("run_id").distinct().select(F.concat(F.lit('{"ord": '), F.col("run_id").cast("string"), F.lit(', "id": "cut')).alias("value"))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).union(bad).write.text(out)
    return out


@query(_S_LINES)
def tolerant_scan(spark, d):
    from mezon.sources import readers

    return readers.read_tolerant(spark, _with_bad_lines(spark, d), _LINES)


@query("SELECT 'good' AS kind, count(*) AS n FROM candidate UNION ALL SELECT 'bad', count(DISTINCT run_id) FROM candidate")
def reported_scan(spark, d):
    from mezon.sources import readers

    good, bad = readers.read_reported(spark, _with_bad_lines(spark, d), _LINES)
    return good.agg(F.count("*").alias("n")).select(F.lit("good").alias("kind"), "n").union(bad.agg(F.count_if(F.col("line_no") >= 1).alias("n")).select(F.lit("bad"), "n"))


@query("SELECT run_id, system, id, 0::BIGINT AS n_twice FROM candidate GROUP BY ALL")
def resumed_append(spark, d):
    """Keys in a file after the same rows were appended twice, with how often they stand in it too much."""
    from mezon.sources import sinks

    out, keys = _scratch(spark), ["run_id", "system", "id"]
    rows = read(spark, d, "candidate").groupBy(*keys).agg(F.max("ord").alias("ord"))
    for _ in range(2):
        sinks.append_new(rows, out, keys)
    return spark.read.schema(rows.schema).json(out).groupBy(*keys).agg((F.count("*") - 1).alias("n_twice"))


@query("SELECT DISTINCT sha1('uz|' || en_text) AS key, en_text AS text FROM benchmark WHERE en_text IS NOT NULL")
def cache_round_trip(spark, d):
    """A translation cache written and loaded (the source stands for its translation)."""
    from mezon.sources import sinks

    out = _scratch(spark)
    rows = read(spark, d, "benchmark").where("en_text IS NOT NULL")
    sinks.flush_cache(rows.select(tx.cache_key("uz", F.col("en_text")).alias("key"), F.col("en_text").alias("text")), out)
    return sinks.load_cache(spark, out).select("key", "text")


@query(f"SELECT 'xwmt-' || printf('%05d', pos) AS id, en_text FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, {s_strip('en_text')} AS en_text, {s_strip('uz_text')} AS uz_text FROM refset) WHERE en_text <> '' AND uz_text <> ''")
def pair_source(spark, d):
    """Reference pairs through the reader of nested pairs."""
    from mezon.sources import readers

    r = read(spark, d, "refset")  # a fixed table of evaluation items: one task numbers it
    pos = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1).alias("pos")
    nested = r.select(pos, F.struct(F.col("en_text").alias("en"), F.col("uz_text").alias("uz")).alias("translation"))
    return readers.read_xwmt(lambda config: nested).select("id", "en_text")


@query("SELECT system, count(DISTINCT (run_id, id)) AS n FROM candidate GROUP BY system")
def stream_first_copies(spark, d):
    """Deliveries streamed through watermarked deduplication, counted by system; the delay covers the table."""
    from mezon.streaming import gates_stream as gs

    out = _scratch(spark)
    source = gs.answer_stream(spark, f"{d}/candidate.parquet*", read(spark, d, "candidate").schema)
    once = gs.first_copies(source.select("run_id", "system", "id", "received_at"), "received_at", ["run_id", "system", "id"], "3650 days")
    gs.append_to(once, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("system").agg(F.count("*").alias("n"))
