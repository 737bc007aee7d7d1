"""Entities that must survive a translation: finding, masking and restoring them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mezon.functions.text import placeholders, word_count

# The entity patterns (variables, links, addresses, phone numbers, amounts, codes) and word lists.
PATTERNS = [
    r"\{\{.*?\}\}",
    r"https?://[^\s]+",
    r"[\w.+-]+@[\w-]+\.[\w.-]+",
    r"\+?\d[\d\s()\-]{5,}\d",
    r"\d{1,3}(?:[.,]\d+)+",
    r"\d{3,}",
]
AMOUNT = r"\d{1,3}(?:[.,]\d+)+"
PROFANITY = r"\b(fuck\w*|shit\w*|damn|bitch\w*|asshole\w*|crap)\b"
KB_MIN_WORDS = 40


def _matches(c: Column, pattern: str) -> Column:
    """array<struct<start, neg_len, text>> of all matches: gaps and matches of one pattern interleave."""
    p = F.lit(f"(?U){pattern}")
    # zip_with pads the shorter side: the gap behind the last match has no hit and is left out
    pairs = F.filter(F.zip_with(F.split(c, f"(?U){pattern}", -1), F.regexp_extract_all(c, p, F.lit(0)), lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    empty = F.array().cast("array<struct<start:int,neg_len:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        span = F.struct(start.alias("start"), (-F.length(x["hit"])).alias("neg_len"), x["hit"].alias("text"))
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def spans(c: Column) -> Column:
    """Entity spans in order: earliest first, of several at one place the longest, none overlapping."""
    every = F.sort_array(F.concat(*(_matches(c, p) for p in PATTERNS)))
    empty = F.array().cast("array<struct<start:int,neg_len:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((x["start"] - x["neg_len"]).alias("end"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(x["start"] >= acc["end"], taken).otherwise(acc)

    return F.aggregate(every, F.struct(F.lit(0).alias("end"), empty.alias("out")), step, lambda acc: acc["out"])


def entities(c: Column) -> Column:
    return F.transform(spans(c), lambda s: s["text"])


def sentinel(i: Column) -> Column:
    """Token for entity ``i``: Xq, letters counted A..Z, AA.., qX."""
    letter = lambda n: F.chr((F.lit(65) + n).cast("long"))

    def step(acc: Column, _: Column) -> Column:
        more = F.struct((F.floor(acc["rest"] / 26) - 1).cast("int").alias("rest"), F.concat(letter(acc["rest"] % 26), acc["core"]).alias("core"))
        return F.when(acc["rest"] >= 0, more).otherwise(acc)

    # seven letters number more than an int can
    start = F.struct(i.cast("int").alias("rest"), F.lit("").alias("core"))
    core = F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda acc: acc["core"])
    return F.concat(F.lit("Xq"), core, F.lit("qX"))


def mask(c: Column) -> Column:
    """struct<masked, entries: array<struct<token, value>>> with every entity replaced by its sentinel."""
    entry = "array<struct<token:string,value:string>>"

    def step(acc: Column, s: Column) -> Column:
        token = sentinel(F.size(acc["entries"]))
        gap = F.substring(c, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            (s["start"] - s["neg_len"]).alias("at"),
            F.concat(acc["text"], gap, token).alias("text"),
            F.concat(acc["entries"], F.array(F.struct(token.alias("token"), s["text"].alias("value")))).alias("entries"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), F.array().cast(entry).alias("entries"))
    done = lambda acc: F.struct(F.concat(acc["text"], F.substr(c, acc["at"] + 1)).alias("masked"), acc["entries"].alias("entries"))
    return F.aggregate(spans(c), start, step, done)


def unmask(c: Column, entries: Column) -> Column:
    """Sentinels replaced by their values, also where case or spacing inside a sentinel has changed.

    Values are taken literally.
    """

    def step(text: Column, e: Column) -> Column:
        core = F.substr(e["token"], F.lit(3), F.length(e["token"]) - 4)
        loose = F.concat(F.lit("[Xx]q\\s*"), F.array_join(F.split(core, ""), "\\s*"), F.lit("\\s*q[Xx]"))
        quoted = F.regexp_replace(e["value"], "([\\\\$])", "\\\\$1")
        return F.when(F.contains(text, e["token"]), F.replace(text, e["token"], e["value"])).otherwise(F.regexp_replace(text, loose, quoted))

    return F.aggregate(entries, c, step)


def unrestored(c: Column, entries: Column) -> Column:
    """Values of entries that the text does not contain."""
    return F.transform(F.filter(entries, lambda e: ~F.contains(c, e["value"])), lambda e: e["value"])


def preserve(c: Column) -> Column:
    """What must survive verbatim: entities but amounts, and placeholders; distinct and sorted."""
    opaque = F.filter(entities(c), lambda e: ~F.rlike(e, F.lit(f"(?U)^(?:{AMOUNT})$")))
    return F.sort_array(F.array_union(opaque, placeholders(c)))


def edge(c: Column) -> Column:
    """Holds a placeholder or profanity."""
    return (F.size(placeholders(c)) > 0) | F.rlike(c, F.lit(f"(?iU){PROFANITY}"))


def category(role: Column, c: Column) -> Column:
    """edge (placeholder or profanity), tool_spoken (any entity), kb_passage (long assistant turn), else by role."""
    return (
        F.when(edge(c), "edge")
        .when(F.size(entities(c)) > 0, "tool_spoken")
        .when((role == "assistant") & (word_count(c) >= KB_MIN_WORDS), "kb_passage")
        .when(role == "assistant", "agent_reply")
        .otherwise("caller_turn")
    )
