"""Cutting source, answer and reference into aligned chunks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mezon.functions.text import let, sentences, word_count

MAX_WORDS = 80
_TEXTS = "array<string>"


def group_by_words(sents: Column, most: int = MAX_WORDS) -> Column:
    """Sentences packed greedily up to ``most`` words; a longer sentence stays whole."""

    def step(acc: Column, s: Column) -> Column:
        n = word_count(s)
        fits = (F.size(acc["out"]) > 0) & (acc["n"] + n <= most)
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.concat(F.element_at(acc["out"], -1), F.lit(" "), s)))
        return F.when(fits, F.struct((acc["n"] + n).alias("n"), grown.alias("out"))).otherwise(
            F.struct(n.alias("n"), F.concat(acc["out"], F.array(s)).alias("out"))
        )

    return F.aggregate(sents, F.struct(F.lit(0).alias("n"), F.array().cast(_TEXTS).alias("out")), step, lambda a: a["out"])


def split_k(sents: Column, k: Column) -> Column:
    """Exactly ``k`` contiguous groups of about equal length; there must be at least ``k`` sentences."""
    def run(a: Column) -> Column:
        return _split(a["s"], k, a["total"])

    total = F.aggregate(F.transform(sents, F.length), F.lit(0), lambda a, x: a + x)
    return let(F.struct(sents.alias("s"), total.alias("total")), run)


def _split(sents: Column, k: Column, total: Column) -> Column:
    n = F.size(sents)

    def step(acc: Column, s: Column) -> Column:
        chars, seen = acc["chars"] + F.length(s), acc["seen"] + 1
        now = F.concat(acc["open"], F.array(s))
        g = F.size(acc["out"])
        last = g >= k - 1
        close = ~last & ((chars * k >= (g + 1) * total) | (n - seen <= k - g - 1))
        done = F.concat(acc["out"], F.array(F.array_join(now, " ")))
        return F.struct(
            chars.alias("chars"), seen.alias("seen"),
            F.when(close, F.array().cast(_TEXTS)).otherwise(now).alias("open"), F.when(close, done).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("seen"), F.array().cast(_TEXTS).alias("open"), F.array().cast(_TEXTS).alias("out"))
    finish = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["out"], F.array(F.array_join(a["open"], " ")))).otherwise(a["out"])
    return F.aggregate(sents, start, step, finish)


def chunk_pairs(source: Column, answer: Column, reference: Column | None = None, most: int = MAX_WORDS) -> Column:
    """array<struct<src, mt, ref>>: one chunk, or as many as all sides can be cut into.

    The number is that of the source's greedy chunks, lowered to the sentences of the other sides;
    if it is lowered, the source is cut anew by length and a chunk may then exceed ``most`` words.
    """
    ref = reference if reference is not None else F.lit(None).cast("string")
    cut = F.struct(sentences(source).alias("src"), sentences(answer).alias("mt"), sentences(ref).alias("ref"))

    def with_sentences(x: Column) -> Column:
        return let(F.struct(x.alias("x"), group_by_words(x["src"], most).alias("packed")), lambda y: with_packed(y["x"], y["packed"]))

    def with_packed(x: Column, packed: Column) -> Column:
        few = F.least(F.size(packed), F.size(x["mt"]), F.when(ref.isNotNull(), F.size(x["ref"])).otherwise(F.lit(1 << 30)))
        single = (word_count(source) <= most) | (F.size(x["src"]) < 2) | (F.size(x["mt"]) < 2) | (few < 2)
        whole = F.array(F.struct(source.alias("src"), answer.alias("mt"), ref.alias("ref")))
        k = F.greatest(few, F.lit(1))
        sides = F.struct(
            F.when(F.size(packed) == k, packed).otherwise(split_k(x["src"], k)).alias("src"), split_k(x["mt"], k).alias("mt"), split_k(x["ref"], k).alias("ref")
        )

        def many(s: Column) -> Column:
            return F.zip_with(F.arrays_zip(s["src"], s["mt"]), F.coalesce(s["ref"], F.array().cast(_TEXTS)), lambda a, r: F.struct(a["src"].alias("src"), a["mt"].alias("mt"), r.alias("ref")))

        return F.when(single, whole).otherwise(let(sides, many))

    return let(cut, with_sentences)
