"""Cutting oversized texts into pieces at natural boundaries, with overlap.

Words are what Unicode white space separates. For each text the word spans give prefix offsets and
the words that end a sentence or line form one sorted boundary array; each piece ends at the last
boundary within the limit (binary search), else it is cut hard at the limit. The next piece steps
back by the overlap. Work per text is linear plus one search per piece, so very long texts are fine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezon.session import spread

_WORD = re.compile(r"\S+")
_END = ".!?…"
# Closing marks that may follow an end mark.
_CLOSING = "\"'”’»)]}"


def word_spans(text: str) -> np.ndarray:
    return np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)


def boundaries(text: str, spans: np.ndarray) -> np.ndarray:
    """Word counts after which a sentence or a line ends, ascending; the text's end is the last."""
    out = []
    for i, (a, b) in enumerate(spans[:-1]):
        gap = text[b : spans[i + 1, 0]]
        if "\n" in gap or "\r" in gap or text[a:b].rstrip(_CLOSING)[-1:] in tuple(_END):
            out.append(i + 1)
    return np.array([*out, len(spans)], np.int64)


def cut_points(n: int, ends: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open word ranges of the pieces of ``n`` words.

    Each piece has at most ``limit`` words and shares exactly ``overlap`` with the one before it, so
    a boundary only counts if the piece gets past its overlap.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    out, start = [], 0
    while n - start > limit:
        k = int(np.searchsorted(ends, start + limit, side="right")) - 1
        end = int(ends[k]) if k >= 0 and ends[k] > start + overlap else start + limit
        out.append((start, end))
        start = end - overlap
    if n:
        out.append((start, n))
    return out


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(piece_no, first word, words, text) of each piece; white space inside a piece is kept."""
    spans = word_spans(text)
    n = len(spans)
    ends = boundaries(text, spans) if n > limit else np.array([n])
    return [(i + 1, a, b - a, text[spans[a, 0] : spans[b - 1, 1]]) for i, (a, b) in enumerate(cut_points(n, ends, limit, overlap))]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 80, overlap: int = 12) -> DataFrame:
    """Pieces (``key``, piece_no, first_word, n_words, n_pieces, piece) of every distinct (key, text).

    A text within the limit is one piece; a null, empty or blank text has none. Rows repeated in
    full count once; one key with different texts gives the pieces of each. The key keeps its type and may be null.
    """
    rows = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).distinct())
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ps = pieces_of(t, limit, overlap)
                at += [i] * len(ps)
                out += [(*p, len(ps)) for p in ps]
            no, first, n, piece, total = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int64()), pa.array(first, pa.int64()),
                    pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(piece, pa.string()),
                ],
                names=["k", "piece_no", "first_word", "n_words", "n_pieces", "piece"],
            )

    schema = f"k {kind}, piece_no long, first_word long, n_words long, n_pieces long, piece string"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)
