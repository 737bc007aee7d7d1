"""Broken pairs of a source and its answer.

For every defect several noisy labelling functions vote for it, against it, or abstain. How far each
can be trusted is estimated by expectation maximisation from the counts of vote patterns alone: with
at most five functions a defect has at most 243 patterns, whatever the number of rows, and rows only
meet a broadcast of fixed size. A row keeps every defect whose posterior reaches its cutoff; the
cutoffs were validated on clean answers damaged on purpose (see the tests).

What the functions compare an answer with, besides its source, is the other answers to the same
segment: their median length and their commonest ending. Both are aggregated with partial sums. Equal
answers to a segment are judged once, however often they were delivered, and segments with a large
part of all answers are split for the join, so a hot segment is no hot spot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mezon.functions.pytext import clean, latin, split_sentences, words
from mezon.llm.language import MARGIN, Model
from mezon.llm.repetition import letters, repeated_share
from mezon.session import cut, shuffle_partitions

#: In order of precedence.
DEFECTS = ["empty", "refusal", "copied", "other_language", "truncated"]
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copied": 0.5, "other_language": 0.5, "truncated": 0.5}
#: Expected share of defective rows and how well a function is expected to vote, as pseudo-rows of the EM.
PRIOR, TRUST, PSEUDO = 0.03, 0.85, 0.02
ENDING = 6
#: Shares of the median length at which an answer counts as short, and as long enough.
SHORT, LONG_ENOUGH = 0.76, 0.86

_TAG = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|\{\{[^{}]*\}\}")
_ALNUM = re.compile(r"[^\W_]")
_NOT_ALNUM = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"\d{2,}")
_NAME = re.compile(r"(?<=[\w,] )[A-Z][a-z]{3,}")
# letters that Uzbek lacks, and spellings that mark it
_FOREIGN = re.compile("[ыщэәіңөүұһşçıöüğ]")
_MARKED = re.compile(r"(?i)[og]['‘’ʼʻ`´]|q(?!u)|[ўқғҳ]|sh|x")

# Words that stand for an answer but hold none.
PLACEHOLDERS = set("null none nan na empty blank undefined".split())

# How speakers decline, by language; matched in lower-case text without apostrophes.
_PHRASES = [
    "olmayman", "olmaymiz", "qilmayman", "mumkin emas", "bosh tort", "ruxsatim", "ruxsat etil", "rad et", "imkonim", "qoidalariga zid", "qoidalarga zid", "siyosatiga zid", "qodir emas",
    "олмайман", "олмаймиз", "қилмайман", "мумкин эмас", "бош торт", "рухсатим", "рад эт", "имконим", "қоидаларига зид", "қоидаларга зид",
    "cannot", "can not", "cant", "unable", "wont", "not able", "decline", "refuse", "not something i", "feel comfortable", "not allowed", "violate", "couldnt",
    "не могу", "не смогу", "нельзя", "не в состоянии", "отказ", "невозможно", "не разреш", "не имею",
    "алмаймын", "алмаймыз", "мүмкін емес", "болмайды", "бас тарт", "рұқсат",
    "yapamam", "edemem", "çeviremem", "olamam", "mümkün değil", "reddedi", "veremem", "yapamıyorum", "edemiyorum",
]
# What is declined, by language: the request, the text, its translation, the assistant itself.
_OBJECTS = [
    "sorov", "matn", "tarjima", "savol", "topshiri", "mazmun", "gapni", "qoida", "suniy intellekt", "ogirish", "bunday ish", "xabarni",
    "сўров", "матн", "таржима", "савол", "топшири", "мазмун", "гапни", "қоида", "сунъий интеллект", "суний интеллект", "ўгириш",
    "request", "this text", "translat", "content", "message", "passage", "sentence", "prompt", "language model", "assist", "help with", "rules", "policy", "an ai",
    "запрос", "текст", "перев", "содержан", "вопрос", "сообщени", "языков",
    "сұрау", "мәтін", "аудар", "мазмұн", "сұрақ", "өтініш",
    "istek", "isteğ", "metin", "metni", "çevir", "içeriğ", "içerik", "talebi", "soruya",
]
_DECLINES = re.compile("|".join(rf"\b{re.escape(p)}" for p in _PHRASES))
_ABOUT = re.compile("|".join(rf"\b{re.escape(p)}" for p in _OBJECTS))


def content(text: str | None) -> str:
    """Letters and digits of a text in Latin script and lower case, tags taken out; '' if nothing answers."""
    if not text:
        return ""
    bare = _TAG.sub(" ", text)
    squeezed = _NOT_ALNUM.sub("", latin(bare))
    return "" if squeezed in PLACEHOLDERS else squeezed


def _grams(s: str, n: int = 5) -> set[str]:
    return {s[i : i + n] for i in range(max(1, len(s) - n + 1))}


@lru_cache(maxsize=4096)
def _source(en: str | None) -> tuple:
    """What is compared of a source: letters and digits, their number without repeated sentences, text, declines, anchors, words, grams, loops, finished, trails off."""
    if not (en and _ALNUM.search(en)):
        return None, None, False, False, frozenset(), frozenset(), frozenset(), False, False, False
    squeezed, plain = _NOT_ALNUM.sub("", latin(en)), clean(en)
    once = _NOT_ALNUM.sub("", latin(" ".join(dict.fromkeys(split_sentences(en)))))
    declines = bool(_DECLINES.search(plain))
    anchors = frozenset(_NUMBER.findall(en)) | frozenset(w.lower() for w in _NAME.findall(en))
    end = en.rstrip()
    return (
        squeezed, len(once), declines, declines and bool(_ABOUT.search(plain)), anchors, frozenset(words(en)), frozenset(_grams(squeezed)),
        repeated_share(letters(en)) >= 0.5, end[-1:] in tuple(".!?"), end.endswith(("...", "…")),
    )


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def votes(uz: str | None, en: str | None, median: float, n_answers: int, ending: str | None, lang: tuple[float, float, float]) -> dict[str, list[int]]:
    """Votes of the labelling functions (1 for the defect, -1 against it, 0 no opinion) by defect.

    ``lang``: the whole text is in another language (1), Uzbek (-1) or unclear (0); shares of its
    sentences clearly in another language and clearly Uzbek.
    """
    raw = uz or ""
    source, once, declines_en, said, anchors, en_words, gb, loops_en, finished, trails = _source(en)
    has = source is not None
    body = content(uz)
    n, known = len(body), n_answers >= 3 and median > 0
    ratio = n / median if known else None
    to_source = n / once if once else None  # a source that repeats itself may be answered once
    out = {
        "empty": [
            _vote(not n, n > 0),
            _vote(not _ALNUM.search(raw), n >= 5),
            _vote(ratio is not None and ratio < 0.02, ratio is not None and ratio >= 0.1),
        ]
    }
    if not n:
        return out | {d: [0] * k for d, k in (("refusal", 4), ("copied", 4), ("other_language", 3), ("truncated", 4))}
    # refusal
    plain = clean(raw)
    declines = bool(_DECLINES.search(plain))
    refuses = declines and bool(_ABOUT.search(plain))
    raw_words, raw_letters = words(raw), letters(raw)
    kept = len(anchors & ({*raw_words, *_NUMBER.findall(raw)})) / len(anchors) if anchors else None
    out["refusal"] = [
        _vote(refuses, not refuses),
        _vote(declines and not declines_en, said or not declines),
        _vote(kept == 0, kept is not None and kept >= 0.5),
        _vote(refuses and len(split_sentences(raw)) <= 3, n > 400),
    ]
    # copied
    if has:
        a = set(raw_words)
        same = len(a & en_words) / max(len(a | en_words), 1)
        ga = _grams(body)
        inside = len(ga & gb) / len(ga)
        both = len(ga & gb) / len(ga | gb)
        out["copied"] = [_vote(same >= 0.75, same <= 0.5), _vote(both >= 0.7, both <= 0.45), _vote(inside >= 0.8, inside <= 0.5), _vote(body == source, abs(n - len(source)) > 0.3 * len(source))]
    else:
        out["copied"] = [0, 0, 0, 0]
    # other language
    whole, clear, uzbek = lang
    foreign = len(_FOREIGN.findall(plain)) / n
    marked = len(_MARKED.findall(raw)) / n
    out["other_language"] = [
        _vote(whole > 0, whole < 0),
        _vote(clear > 0.5, uzbek >= 0.5),
        _vote(foreign > 0.02 or marked < 0.004, marked > 0.02 and foreign < 0.02),
    ]
    # truncated
    end = body[-ENDING:]
    stops = raw.rstrip().endswith(("...", "…")) and not trails
    # an answer that repeats itself where its source does not went wrong in another way
    loops = not loops_en and repeated_share(raw_letters) >= 0.5
    sound = clear <= 0.5 and not refuses and not loops
    marks = raw.rstrip()[-1:] in tuple(".!?…\"”»)")
    out["truncated"] = [
        _vote(ratio is not None and ratio <= SHORT, ratio is not None and ratio >= LONG_ENOUGH) if sound else -1,
        _vote(to_source is not None and to_source < 0.6, to_source is not None and to_source > 0.9),
        _vote(known and ending is not None and end != ending, ending is not None and end == ending),
        _vote(stops or (finished and not marks), False),
    ]
    return out


def code(v: list[int]) -> int:
    """A vote pattern as a number in base three."""
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def label_model(counts: dict[int, int], functions: int, prior: float = PRIOR, rounds: int = 60) -> np.ndarray:
    """Posterior of the defect for every vote pattern, by expectation maximisation over pattern counts.

    Each function that votes has its own probability of voting for the defect on defective and on
    sound rows; not voting says nothing. They start from, and are held by pseudo-rows at, a function
    that is right with ``TRUST``.
    """
    patterns = 3**functions
    vote = np.array([[p // 3**i % 3 - 1 for i in range(functions)] for p in range(patterns)])
    n = np.array([counts.get(p, 0) for p in range(patterns)], float)
    held = PSEUDO * max(n.sum(), 1.0)
    # probability of voting for the defect, given that the function votes, on defective and on sound rows
    bad, good, share = np.full(functions, TRUST), np.full(functions, 1 - TRUST), prior
    for _ in range(rounds):
        odds = np.full(patterns, np.log(share / (1 - share)))
        for i in range(functions):
            odds += np.select([vote[:, i] > 0, vote[:, i] < 0], [np.log(bad[i] / good[i]), np.log((1 - bad[i]) / (1 - good[i]))], 0.0)
        post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        share = float(np.clip(((post * n).sum() + held * prior) / (n.sum() + held), 1e-4, 0.5))
        for i in range(functions):
            for_, against = vote[:, i] > 0, vote[:, i] < 0
            b, g = post * n, (1 - post) * n
            bad[i] = (b[for_].sum() + held * prior * TRUST) / (b[for_ | against].sum() + held * prior)
            good[i] = (g[for_].sum() + held * (1 - TRUST)) / (g[for_ | against].sum() + held)
    return post


FUNCTIONS = {"empty": 3, "refusal": 4, "copied": 4, "other_language": 3, "truncated": 4}


#: A segment with at least this share of all distinct answers is split into ``SALTS`` parts for the join; such segments number 1 / HOT_SHARE at most.
HOT_SHARE, SALTS = 1 / 500, 64


def _profiles(pairs: DataFrame) -> DataFrame:
    """segment, length (letters and digits), ending and number of copies of each distinct answer with content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [content(t) for t in b.column(1).to_pylist()]
            keep = pa.array([i for i, x in enumerate(bodies) if x], pa.int64())
            size, end = pa.array([len(x) for x in bodies if x], pa.int64()), pa.array([x[-ENDING:] for x in bodies if x], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), size, end, b.column(2).take(keep)], names=["segment", "size", "ending", "n"])

    return pairs.select("segment", "text", "n").mapInArrow(run, "segment string, size long, ending string, n long")


def _info(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """segment, source, exact median length, number of answers, commonest ending, number of distinct answers."""
    profiles = cut(_profiles(pairs))  # read twice
    common = profiles.groupBy("segment", "ending").agg(F.sum("n").alias("c")).groupBy("segment").agg(F.max_by("ending", F.struct("c", "ending")).alias("ending"))
    # counts per length, so what a group holds does not grow with its rows
    median = F.percentile("size", F.lit(0.5), F.col("n")).alias("median")
    stats = profiles.groupBy("segment").agg(median, F.sum("n").alias("n_answers"), F.count("*").alias("n_distinct")).join(common, "segment")
    one = sources.where("segment IS NOT NULL").groupBy("segment").agg(F.min("source").alias("source"))
    return cut(one.join(stats, "segment", "full"))


def vote_patterns(answers: DataFrame, sources: DataFrame, model: Model) -> DataFrame:
    """(hash, n, one pattern number per defect) of every distinct answer to a segment, ``n`` times given.

    ``answers``: key, segment, text; ``sources``: segment, source; ``hash`` is that of ``pair_hash``.
    """
    pairs = cut(answers.groupBy("segment", "text").agg(F.count("*").alias("n")))
    info = _info(pairs, sources)
    total = info.agg(F.sum("n_distinct")).first()[0] or 0
    hot = [r[0] for r in info.where((F.col("n_distinct") >= HOT_SHARE * total) & (F.col("n_distinct") >= 1000)).select("segment").collect()]
    part = F.when(F.col("segment").isin(hot), F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(0).cast("int") if hot else F.lit(0)
    parts = F.when(F.col("segment").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    both = pairs.withColumn("part", part).join(info.withColumn("part", F.explode(parts)), ["segment", "part"], "left")
    rows = both.select(pair_hash(), "n", "text", "source", F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "ending")
    # by hash: answers take Python work by their number, not by their segment's size
    rows = rows.repartition(shuffle_partitions(answers.sparkSession), "hash")
    shared = answers.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}

        def score(t: str) -> tuple[str | None, float]:
            # sentences repeat from answer to answer
            if t not in known:
                if len(known) > 50_000:
                    known.clear()
                known[t] = m.score(t)
            return known[t]

        def language(t: str | None) -> tuple[float, float, float]:
            if not t or not content(t):
                return 0.0, 0.0, 0.0
            sents = split_sentences(t)
            size = [len(s) for s in sents]
            total = max(sum(size), 1)
            sure = [(s, *score(x)) for x, s in zip(sents, size)]
            whole, c = m.score(" ".join(sents)) if len(sents) > 1 else sure[0][1:]
            whole = 0.0 if c < MARGIN / 2 else -1.0 if whole == "uz" else 1.0
            clear = sum(s for s, lang, c in sure if c >= MARGIN and lang != "uz")
            uzbek = sum(s for s, lang, c in sure if c >= MARGIN and lang == "uz")
            return whole, clear / total, uzbek / total

        for b in batches:
            found = [votes(*pair, language(pair[0])) for pair in zip(*(b.column(i).to_pylist() for i in range(2, 7)))]
            cols = [pa.array([code(v[d]) for v in found], pa.int32()) for d in DEFECTS]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["hash", "n", *DEFECTS])

    return rows.mapInArrow(run, "hash string, n long, " + ", ".join(f"{d} int" for d in DEFECTS))


def pair_hash() -> Column:
    """Of segment and text, either of which may be null."""
    return F.sha2(F.concat_ws("", *(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("segment", "text"))), 256).alias("hash")


def posteriors(patterns: DataFrame) -> dict[str, np.ndarray]:
    """Posterior by pattern for every defect; what reaches the driver is bounded by the number of patterns."""
    named = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("code")) for d in DEFECTS))).alias("x")
    counts: dict[str, dict[int, int]] = {d: {} for d in DEFECTS}
    for r in patterns.select("n", named).groupBy("x.defect", "x.code").agg(F.sum("n")).collect():
        counts[r[0]][r[1]] = r[2]
    return {d: label_model(counts[d], FUNCTIONS[d]) for d in DEFECTS}


def defects(answers: DataFrame, sources: DataFrame, model: Model, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(key, defect, posterior, rank) of every defect of every answer; rank 1 is the first that fits in the order of ``DEFECTS``.

    A null answer is empty. Answers whose segment has no source, or a null one, are judged by
    themselves and by other answers. Repeated sources of a segment count once (the least text);
    repeated answers are each judged. Empty tables give no rows.
    """
    cutoffs = CUTOFFS | (cutoffs or {})
    patterns = cut(vote_patterns(answers, sources, model))
    post = posteriors(patterns)
    shared = answers.sparkSession.sparkContext.broadcast(post)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post = shared.value
        for b in batches:
            p = np.column_stack([post[d][b.column(j + 2).to_numpy()] for j, d in enumerate(DEFECTS)])
            hit = p >= np.array([cutoffs[d] for d in DEFECTS])
            i, j = np.nonzero(hit)
            rank = np.cumsum(hit, axis=1)[i, j]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(i)), pa.array([DEFECTS[x] for x in j], pa.string()), pa.array(p[i, j]), pa.array(rank.astype(np.int64))],
                names=["hash", "defect", "posterior", "rank"],
            )

    found = patterns.mapInArrow(run, "hash string, defect string, posterior double, rank long")
    return answers.select("key", pair_hash()).join(found, "hash").select("key", "defect", "posterior", "rank")
