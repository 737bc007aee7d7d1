"""Text functions as column expressions; all run inside the JVM.

Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators that Python also counts.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"
# Characters written for the Uzbek apostrophe, and the two canonical ones.
APOSTROPHES = "'‘’ʼʻ`´′‵"
TURNED_COMMA, TUTUQ = "ʻ", "ʼ"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` refers to it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def words(c: Column) -> Column:
    """Pieces between white space; none are empty."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def text_key(c: Column) -> Column:
    """Lower case with single spaces: equal keys mean the same text for deduplication."""
    return F.lower(F.array_join(words(c), " "))


def normalize_apostrophes(c: Column) -> Column:
    """o/g with any apostrophe get U+02BB; other apostrophes between ASCII letters become U+02BC."""
    c = F.regexp_replace(c, f"([oOgG])[{APOSTROPHES}]", f"$1{TURNED_COMMA}")
    rest = APOSTROPHES.replace(TURNED_COMMA, "").replace(TUTUQ, "")
    return F.regexp_replace(c, f"(?<=[a-zA-Z])[{rest}](?=[a-zA-Z])", TUTUQ)


def placeholders(c: Column) -> Column:
    """Distinct runs of six or more capitals standing alone, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit("(?U)\\b([A-Z]{6,})\\b"), F.lit(1))))


def sentences(c: Column, line_breaks: bool = True) -> Column:
    """Non-empty sentences, stripped.

    With ``line_breaks``: cut after . ! ? and the ellipsis before white space, and at line breaks; a
    text without pieces gives itself. Without: cut after . ! ? only, pieces as they are.
    """
    if not line_breaks:
        return F.filter(F.split(c, "(?U)(?<=[.!?])\\s+"), lambda s: s != "")
    parts = F.filter(F.transform(F.split(c, "(?U)(?<=[.!?…])\\s+|\\n+"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).when(c.isNotNull(), F.array(c))


def category_or_domain(category: Column, domain: Column) -> Column:
    """The category, else the domain, else 'all'."""
    return F.coalesce(category, domain, F.lit("all"))


def strip_reasoning(c: Column) -> Column:
    """Without <think> blocks, whatever their case and length."""
    return F.regexp_replace(c, "(?is)<think>.*?</think>", "")


def cache_key(target: str, c: Column) -> Column:
    """Key of a cached translation: SHA-1 of target code, pipe and sentence."""
    return F.sha1(F.concat(F.lit(target + "|"), c))


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, then an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def fmt(c: Column, digits: int = 4) -> Column:
    """A number with fixed decimals, a dash for null."""
    return F.when(c.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", c))


def fmt_duration(seconds: Column) -> Column:
    """m:ss below an hour, h:mm:ss from there on; --:-- for null, negative and infinite."""
    s = F.floor(seconds).cast("long")
    short, long = F.format_string("%d:%02d", F.floor(s / 60), s % 60), F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    known = (seconds >= 0) & (seconds < float("inf")) & ~F.isnan(seconds)
    return F.when(F.coalesce(known, F.lit(False)), F.when(s < 3600, short).otherwise(long)).otherwise("--:--")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# The prompts' wording.
_TRANSLATE = (
    "You are a professional English (en) to Uzbek (uz) translator. Your goal is to accurately convey the meaning and "
    "nuances of the original English text while adhering to Uzbek grammar, vocabulary, and cultural sensitivities.\n"
    "Produce only the Uzbek translation, without any additional explanations or commentary. Please translate the "
    "following English text into Uzbek:\n\n\n"
)
_CONTEXT = "Conversation context — the previous turn, for reference only, do NOT translate it:\n"
_JUDGE_CONTEXT = "Dialogue context (previous turn, background only):\n"
JUDGE_RUBRIC = (
    "You are an expert English→Uzbek (Latin script) translation evaluator using the MQM framework. Identify translation "
    "errors in the Uzbek candidate with respect to the English source. For each error give a category (mistranslation, "
    "omission, addition, grammar, spelling, terminology, wrong-script, entity-dropped, style, other) and a severity "
    "(critical, major, minor). Judge only the candidate turn; any provided context is background. Be strict and consistent."
)
_JUDGE = (
    "\n\nList every translation error as an object with `category`, `severity` (critical, major or minor) and `span` "
    "(the exact substring of the Uzbek candidate that is wrong). Then rate `adequacy` and `fluency` as integers from 1 "
    "to 5. If the translation is flawless, return an empty errors list."
)


def context_block(context: Column, head: str = _CONTEXT) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(head), context, F.lit("\n\n"))).otherwise("")


def translation_prompt(text: Column, context: Column | None = None) -> Column:
    prompt = F.concat(F.lit(_TRANSLATE), text)
    return prompt if context is None else F.concat(context_block(context), prompt)


def judge_prompt(source: Column, candidate: Column, context: Column) -> Column:
    return F.concat(
        context_block(context, _JUDGE_CONTEXT), F.lit("English source:\n"), source, F.lit("\n\nUzbek candidate:\n"), candidate, F.lit(_JUDGE)
    )
