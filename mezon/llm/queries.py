"""Queries of the problems solved in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mezon.functions.pytext import APOSTROPHES, INVISIBLE, UZ_CYRILLIC
from mezon.llm import bitext, defects, language, leakage, packing, repetition, splitting, subjects
from mezon.operators.exact_dedup import segment_id
from mezon.session import cut

#: A document is about a subject from this share on; the least share that any segment can give.
ABOUT, ANY = 1 / 6, 2e-9


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def p1_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "bidoc", "bidoc_id", "en_text", "uz_text")
    items = _table(spark, sf_dir, "refset").select(F.col("en_text").alias("en"), F.col("uz_text").alias("uz"))
    return bitext.align_sentences(docs, "bidoc_id", "en_text", "uz_text", items)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_alignment(spark, sf_dir).select("bidoc_id", "en_no", "uz_no")


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "uzdoc", "uzdoc_id", "lang_label", "uz_text")
    return language.detect(df, "uzdoc_id", "uz_text", "lang_label", language.train(df, "uz_text", "lang_label", "uzdoc_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.col("label_lang").isNull() | (F.col("n_langs") > 1) | (F.col("label_lang") != F.col("lang"))
    return p2_segments(spark, sf_dir).where(wrong).select("uzdoc_id", "seg_no", "lang")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "candidate", "ord", "run_id", "system", "id", "uz_text")


def _repetition_model(spark: SparkSession, sf_dir: str) -> repetition.Regression:
    answers = _answers(spark, sf_dir).select("ord", "run_id", "system", segment_id(F.col("id")).alias("segment"), F.col("uz_text").alias("text"))
    references = _table(spark, sf_dir, "refset").where("uz_text IS NOT NULL").select(segment_id(F.col("id")).alias("segment"), F.col("uz_text").alias("reference"))
    counts = _table(spark, sf_dir, "chrf_flores", "run_id", "system", "degenerate")
    return repetition.Regression.train(*repetition.training_set(repetition.labelled_rows(answers, references, counts)))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(_answers(spark, sf_dir), "ord", "uz_text", _repetition_model(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = repetition.measure(_answers(spark, sf_dir), "ord", "uz_text", _repetition_model(spark, sf_dir), repetition.THRESHOLD)
    return scored.where("repeated_share >= 0.5").select("ord")


def p4_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact share of every delivery with a text, to four places."""
    scored = repetition.measure(_answers(spark, sf_dir), "ord", "uz_text", repetition.Regression())
    return scored.select("ord", F.round("repeated_share", 4).alias("repeated_share"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, sf_dir, "benchmark", "id", "en_text"), "id", "en_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("n_pieces > 1").select("id").distinct()


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir).select(F.col("ord").alias("key"), segment_id(F.col("id")).alias("segment"), F.col("uz_text").alias("text"))
    source = lambda name: _table(spark, sf_dir, name).select(segment_id(F.col("id")).alias("segment"), F.col("en_text").alias("source"))
    texts = _table(spark, sf_dir, "uzdoc", "uzdoc_id", "lang_label", "uz_text")
    model = language.train(texts, "uz_text", "lang_label", "uzdoc_id")
    return defects.defects(answers, source("benchmark").union(source("refset")), model).withColumnRenamed("key", "ord")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_labels(spark, sf_dir).where("rank = 1").select("ord", "defect")


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the sequences: what must hold of them, and whether there are no more than the tokens need and one."""
    packed = cut(p7_sequences(spark, sf_dir))
    per = packed.groupBy("seq_no").agg(F.sum("n_tokens").alias("n")).agg(
        F.count_if(F.col("n") > 2048).alias("n_overfull"), (F.max("seq_no") - F.count("*")).alias("n_unused"), F.count("*").alias("n_sequences")
    )
    docs = packed.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("piece_no").alias("distinct"), F.max("piece_no").alias("last"), F.min("n_tokens").alias("least"), F.sum("n_tokens").alias("tokens"),
    )
    whole = docs.agg(
        F.count("*").alias("n_docs"), F.count_if((F.col("n") != F.col("distinct")) | (F.col("n") != F.col("last"))).alias("n_broken"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= 2048)).alias("n_split_without_need"), F.sum("tokens").alias("tokens"),
    )
    # both are one row
    both = F.broadcast(per).join(F.broadcast(whole))
    return both.select("n_docs", "n_overfull", "n_unused", "n_broken", "n_split_without_need", (F.col("n_sequences") <= F.ceil(F.col("tokens") / 2048) + 1).alias("full"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "refset", "id", "en_text", "uz_text")
    return leakage.leaks(docs, "doc_id", "text", items, "id", ["en_text", "uz_text"])


def p9_subjects(spark: SparkSession, sf_dir: str, least: float = ABOUT) -> DataFrame:
    names = [r[0] for r in _table(spark, sf_dir, "subject_area", "subject").where("subject IS NOT NULL").distinct().collect()]
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "doc_subject")
    return subjects.classify(docs, "doc_id", "text", names, labels, "doc_id", "subject", least)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about each subject, and its shares summed over all documents.

    The row without subject has the documents about none, and what no subject takes of any document, so
    that weights add up to the number of documents. Null keys are left out.
    """
    shares = cut(p9_subjects(spark, sf_dir, ANY))
    about = F.coalesce("most", F.lit(0.0)) >= ABOUT * subjects.WHOLE
    weight = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6).alias("weight")
    by_subject = shares.withColumnRenamed("share", "most").groupBy("subject").agg(F.count_if(about).alias("n_docs"), weight(F.col("most")))
    taken = shares.groupBy("doc_id").agg(F.sum("share").alias("taken"), F.max("share").alias("most"))
    docs = _table(spark, sf_dir, "documents", "doc_id").where("doc_id IS NOT NULL").distinct().join(taken, "doc_id", "left")
    rest = F.greatest(1 - F.coalesce("taken", F.lit(0.0)), F.lit(0.0))
    none = docs.agg(F.count_if(~about).alias("n_docs"), weight(rest)).select(F.lit(None).cast("string").alias("subject"), "n_docs", "weight")
    return by_subject.union(none)


QUERIES = {
    "p1_found": p1_found,
    "p1_alignment": p1_alignment,
    "p2_found": p2_found,
    "p2_segments": p2_segments,
    "p4_found": p4_found,
    "p4_shares": p4_shares,
    "p4_repeated": p4_repeated,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_labels": p6_labels,
    "p7_sequences": p7_sequences,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"


def _s_letters(x: str) -> str:
    """Letters of a text in Latin script, as ``repetition.letters`` joins them."""
    x = f"lower(regexp_replace({x}, '[{APOSTROPHES.replace(chr(39), chr(39) * 2)}{INVISIBLE}]', '', 'g'))"
    x = f"regexp_replace(regexp_replace({x}, '(^|[^\\p{{L}}])е', '\\1ye', 'g'), '([аеёиоуўэюяъ])е', '\\1ye', 'g')"
    for cyrillic, latin in UZ_CYRILLIC.items():
        x = f"replace({x}, '{cyrillic}', '{latin}')"
    return f"regexp_replace({x}, '[^\\p{{L}}]+', '', 'g')"


_N = repetition.PASSAGE
# windows of PASSAGE letters; those seen before cover their letters, overlapping ones once
_S_SHARES = f"""WITH l AS (SELECT ord, {_s_letters('uz_text')} AS s FROM candidate WHERE uz_text IS NOT NULL),
w AS (SELECT ord, i, substr(s, i, {_N}) AS g FROM (SELECT ord, s, unnest(range(1, length(s) - {_N} + 2)) AS i FROM l)),
again AS (SELECT ord, i FROM (SELECT ord, i, row_number() OVER (PARTITION BY ord, g ORDER BY i) AS n FROM w) WHERE n > 1),
c AS (SELECT ord, sum(n) AS n FROM (SELECT ord, least({_N}, coalesce(i - lag(i) OVER (PARTITION BY ord ORDER BY i), {_N})) AS n FROM again) GROUP BY ord),
shares AS (SELECT ord, CASE WHEN s = '' THEN 0.0 ELSE coalesce(n, 0) / length(s) END AS share FROM l LEFT JOIN c USING (ord))"""
_S_ENDS = f"""(SELECT id, t, w, g, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR contains(g[i], chr(10)) OR contains(g[i], chr(13))
  OR regexp_matches(w[i], '[.!?…]["''”’»)\\]}}]*$')) AS ends
  FROM (SELECT id, t, regexp_split_to_array(t, '{_SPACE}') AS w, regexp_extract_all(t, '{_SPACE}') AS g FROM (SELECT DISTINCT id, regexp_replace(en_text, '^{_SPACE}|{_SPACE}$', '', 'g') AS t, en_text FROM benchmark WHERE en_text IS NOT NULL) WHERE t <> ''))"""
ORACLE = {
    "p4_found": _S_SHARES + " SELECT ord FROM shares WHERE share >= 0.5",
    "p4_repeated": _S_SHARES + " SELECT ord, round(share, 4) AS repeated_share FROM shares",
    "p5_found": f"""
SELECT DISTINCT id FROM benchmark
WHERE len(list_filter(regexp_split_to_array(en_text, '{_SPACE}'), lambda w: w <> '')) > 80""",
    "p5_pieces": f"""
WITH RECURSIVE x AS {_S_ENDS},
cut AS (SELECT row_number() OVER (ORDER BY id, t) AS r, * FROM x),
p AS (SELECT r, 1 AS no, 0 AS a, CASE WHEN len(w) <= 80 THEN len(w) ELSE coalesce(list_max(list_filter(ends, lambda e: e <= 80 AND e > 12)), 80) END AS b FROM cut
  UNION ALL SELECT r, no + 1, b - 12, CASE WHEN len(w) - (b - 12) <= 80 THEN len(w) ELSE coalesce(list_max(list_filter(ends, lambda e: e <= b - 12 + 80 AND e > b)), b - 12 + 80) END
  FROM p JOIN cut USING (r) WHERE b < len(w))
SELECT id, no::BIGINT AS piece_no, a::BIGINT AS first_word, (b - a)::BIGINT AS n_words, count(*) OVER (PARTITION BY r) AS n_pieces,
  array_to_string(list_transform(range(a + 1, b + 1), lambda i: w[i] || CASE WHEN i < b THEN g[i] ELSE '' END), '') AS piece FROM p JOIN cut USING (r)""",
    "p7_fill": "SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_overfull, 0::BIGINT AS n_unused, 0::BIGINT AS n_broken, 0::BIGINT AS n_split_without_need, true AS full FROM documents",
}
