"""Corpus chrF++ and BLEU: n-gram counts and clipped matches per pair of texts, sums per group, F-score."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mezon.session import spread

CHAR_ORDER, WORD_ORDER, BETA, BLEU_ORDER = 6, 2, 2, 4
#: Texts whose n-grams a task keeps, as references and answers repeat.
KEPT_TEXTS = 500


def chrf_tokens(text: str) -> list[str]:
    """Words with one punctuation mark split off, the last if there is one, else the first."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def sentencepiece(model_file: str) -> Callable[[str], list[str]]:
    """A tokenizer for ``bleu`` from a SentencePiece model, readable on every executor; loaded once per worker."""
    loaded: list = []

    def pieces(text: str) -> list[str]:
        if not loaded:
            from sentencepiece import SentencePieceProcessor

            loaded.append(SentencePieceProcessor(model_file=model_file))
        return loaded[0].encode(text.strip(), out_type=str)

    return pieces


def _orders(seq, most: int) -> list[Counter]:
    if isinstance(seq, str):
        return [Counter(seq[i : i + n] for i in range(len(seq) - n + 1)) for n in range(1, most + 1)]
    return [Counter(zip(*(seq[j:] for j in range(n)))) for n in range(1, most + 1)]


def chrf_grams(text: str) -> list[Counter]:
    return _orders("".join(text.split()), CHAR_ORDER) + _orders(chrf_tokens(text), WORD_ORDER)


def _matches(df: DataFrame, group: list[str], grams_of: Callable[[str], list[Counter]], hyp: str, ref: str, alone: bool) -> DataFrame:
    """(group, kind, hyp_n, ref_n, match): totals and clipped matches by kind of n-gram.

    Each pair is counted where it stands and each task adds up its groups, so what is shuffled is a
    few sums per group. A null text counts as empty. Unless ``alone``, n-grams of an answer do not
    count where the reference has none of that order.
    """
    rows = spread(df.select(F.coalesce(F.col(hyp), F.lit("")).alias("__h"), F.coalesce(F.col(ref), F.lit("")).alias("__r"), *group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[Counter]] = {}

        def of(t: str) -> list[Counter]:
            if t not in kept:
                if len(kept) >= KEPT_TEXTS:
                    kept.clear()
                kept[t] = grams_of(t)
            return kept[t]

        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for h, r, *key in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, (a, b) in enumerate(zip(of(h), of(r))):
                    small, large = (a, b) if len(a) < len(b) else (b, a)
                    one = sums.setdefault((*key, kind), [0, 0, 0])
                    one[0] += a.total() if alone or b else 0
                    one[1] += b.total()
                    one[2] += sum(min(n, large[g]) for g, n in small.items() if g in large)
            keys = list(zip(*sums)) if sums else [()] * (len(group) + 1)
            kinds = [batch.column(i).type for i in range(2, batch.num_columns)] + [pa.int32()]
            numbers = list(zip(*sums.values())) if sums else [()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, kinds)), *(pa.array(n, pa.int64()) for n in numbers)], names=[*group, "kind", "hyp_n", "ref_n", "match"])

    schema = T.StructType([*(rows.schema[c] for c in group), *T._parse_datatype_string("kind int, hyp_n bigint, ref_n bigint, match bigint")])
    return rows.mapInArrow(run, schema).groupBy(*group, "kind").agg(*(F.sum(c).alias(c) for c in ("hyp_n", "ref_n", "match")))


def chrf_pp(df: DataFrame, group: list[str], hyp: str, ref: str) -> DataFrame:
    """(group, chrf_pp): corpus chrF++ (character 1..6-grams without spaces, word 1..2-grams, beta 2), 0 to 100."""
    m = _matches(df, group, chrf_grams, hyp, ref, alone=False)
    p, r = F.try_divide("match", "hyp_n"), F.try_divide("match", "ref_n")
    by = m.where("hyp_n > 0 AND ref_n > 0").groupBy(*group).agg(F.avg(p).alias("p"), F.avg(r).alias("r"))
    f = F.coalesce(F.try_divide((1 + BETA**2) * F.col("p") * F.col("r"), BETA**2 * F.col("p") + F.col("r")), F.lit(0.0))
    return by.select(*group, F.round(100 * f, 2).alias("chrf_pp"))


def bleu(df: DataFrame, group: list[str], hyp: str, ref: str, tokenize: Callable[[str], list[str]] = str.split) -> DataFrame:
    """(group, bleu): corpus BLEU-4 with brevity penalty over the tokens that ``tokenize`` gives, 0 to 100.

    Orders without any match are smoothed by halving (exponential smoothing).
    """
    m = _matches(df, group, lambda t: _orders(tokenize(t), BLEU_ORDER), hyp, ref, alone=True).where("hyp_n > 0 OR ref_n > 0")
    rows = m.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("kind", "hyp_n", "match"))).alias("o"),
        F.max(F.when(F.col("kind") == 0, F.col("hyp_n"))).alias("hl"), F.max(F.when(F.col("kind") == 0, F.col("ref_n"))).alias("rl"),
    )

    def step(acc: Column, x: Column) -> Column:
        zero = x["match"] == 0
        smooth = F.when(zero, acc["s"] * 2).otherwise(acc["s"])
        p = F.when(zero, F.try_divide(F.lit(1.0), smooth * x["hyp_n"])).otherwise(F.try_divide(x["match"].cast("double"), x["hyp_n"]))
        return F.struct(smooth.alias("s"), (acc["l"] + F.coalesce(F.log(p), F.lit(-1e9))).alias("l"))

    mean = F.aggregate("o", F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("l")), step, lambda a: a["l"] / BLEU_ORDER)
    brevity = F.when(F.col("hl") >= F.col("rl"), 0.0).otherwise(1 - F.try_divide(F.col("rl").cast("double"), F.col("hl").cast("double")))
    return rows.select(*group, F.round(100 * F.exp(mean + F.coalesce(brevity, F.lit(-1e9))), 2).alias("bleu"))
