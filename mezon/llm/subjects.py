"""Subject areas of documents by a distributed topic model.

Latent Dirichlet allocation over segments: a document draws topic proportions from a Dirichlet prior,
each segment (a sentence, or a run of words where a text has no sentence marks) draws a topic from
them, and its words come from the topic. Hand labels enter as the prior: a labelled document favours
the topics of its labels, without forbidding others, so wrong and incomplete labels are outvoted. One
topic per subject starts from the words of the documents labelled with it; further background topics
take up what stands in documents of every label (courtesy, small talk, news).

Fitting is expectation maximisation over all documents. Each pass reads the tokenised documents once,
with the word-by-topic table as a broadcast of fixed size (``BUCKETS`` hashed words), and returns sums
of the same fixed size. Topics are mapped to subjects by inspecting their top terms: a topic is about
the subject that most of them tell, that is, under whose label they stand far more often than under
the others; a topic whose top terms mostly tell no subject is background.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezon.functions.pytext import split_sentences, words
from mezon.session import cut, spread

BUCKETS, STEM = 1 << 15, 7
BACKGROUND, PASSES = 8, 8
#: A sentence of more than ``LONG`` words is cut at its inner marks into clauses of at least
#: ``CLAUSE`` words, and where it has none into runs of about ``RUN_WORDS`` words.
RUN_WORDS, LONG, CLAUSE = 10, 36, 5
#: At the start a word counts for a subject by what exceeds so many times its mean share under the other labels.
EXCESS = 0.5
#: A term whose count under a subject's label is less than so many times what is expected from the others,
#: or not so many standard deviations above it, says nothing for the subject.
TELLING, SIGMAS = 3.0, 4.0
#: Pseudo-counts of the Dirichlet priors: topics of a labelled document, topics of any document, words of a topic.
LABEL_PRIOR, PRIOR, WORD_PRIOR = 1.5, 0.3, 0.02
#: A segment hardly ever belongs to a topic with certainty: so much of a wanted proportion is enough.
WHOLE = 0.96
#: Top terms of a topic that are inspected, how often a term must stand under a label to count, and the
#: share of them that must tell the subject the topic is mapped to (less where the topic started from that subject).
TOP_TERMS, LEAST_SEEN, AGREEMENT, OWN_AGREEMENT = 40, 3, 0.45, 0.2
_CLAUSE_END = re.compile(r"[,;:—–]\s")


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word[:STEM]) % BUCKETS


def _content(text: str) -> list[str]:
    """Words without numbers and single letters, which carry no subject."""
    return [x for x in words(text) if not x[0].isdigit() and len(x) > 1]


def segments(text: str | None) -> list[list[int]]:
    """Hashed words of each segment; segments without words are left out."""
    out: list[list[str]] = []
    for s in split_sentences(text):
        whole = _content(s)
        if len(whole) <= LONG:
            out.append(whole)
            continue
        clauses: list[list[str]] = []
        for c in map(_content, _CLAUSE_END.split(s)):
            if clauses and (len(c) < CLAUSE or len(clauses[-1]) < CLAUSE):
                clauses[-1] += c
            else:
                clauses.append(c)
        for c in clauses:
            k = -(-len(c) // RUN_WORDS) if len(c) > LONG else 1
            out += [c[i * len(c) // k : (i + 1) * len(c) // k] for i in range(k)]
    return [[bucket(x) for x in seg] for seg in out if seg]


def _tokenised(docs: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """k, words (all segments in a row), ends (end of each segment), given (numbers of the labelled subjects)."""
    rows = spread(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs = [segments(t) for t in b.column(1).to_pylist()]
            flat = pa.array([[x for s in d for x in s] for d in segs], pa.list_(pa.int32()))
            ends = pa.array([np.cumsum([len(s) for s in d]).tolist() for d in segs], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat, ends], names=["k", "words", "ends"])

    tokens = rows.mapInArrow(run, f"k {kind}, words array<int>, ends array<int>").where(F.size("ends") > 0)
    return cut(tokens.join(labels, "k", "left"))


class _Batch:
    """Arrays of one batch of documents: words, the segment of each, the document of each segment, labels."""

    def __init__(self, b: pa.RecordBatch, subjects: int):
        w, e, g = b.column(1), b.column(2), b.column(3)
        self.n = b.num_rows
        self.words = w.flatten().to_numpy().astype(np.int64)
        per_doc = np.diff(e.offsets.to_numpy())
        self.doc = np.repeat(np.arange(self.n), per_doc)
        local = e.flatten().to_numpy().astype(np.int64)
        start = np.r_[0, np.cumsum(np.diff(w.offsets.to_numpy()))[:-1]]
        ends = local + np.repeat(start, per_doc)
        self.starts = np.r_[0, ends[:-1]] if len(ends) else ends
        self.given = np.zeros((self.n, subjects), bool)
        for i, x in enumerate(g.to_pylist()):
            for s in x or ():
                self.given[i, s] = True

    def posterior(self, logw: np.ndarray, rounds: int = 4) -> np.ndarray:
        """Topic posterior of each segment, topic proportions of each document settled in a few rounds."""
        topics = logw.shape[1]
        if not len(self.starts):
            return np.zeros((0, topics))
        # sums of a segment's few words: single precision is enough and moves half the bytes
        like = np.add.reduceat(logw.astype(np.float32)[self.words], self.starts, axis=0).astype(float)
        prior = np.full((self.n, topics), PRIOR)
        prior[:, : self.given.shape[1]] += LABEL_PRIOR * self.given
        theta = prior / prior.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            p = like + np.log(theta)[self.doc]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            theta = prior.copy()
            np.add.at(theta, self.doc, p)
            theta /= theta.sum(axis=1, keepdims=True)
        return p


def _sums(weight_of, topics: int, subjects: int):
    """Weighted word counts by topic of one partition, as (cell, value) with cell = word * topics + topic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, topics))
        for b in batches:
            if not b.num_rows:
                continue
            x = _Batch(b, subjects)
            weights, size = weight_of(x), np.diff(np.r_[x.starts, len(x.words)])
            for t in range(topics):
                total[:, t] += np.bincount(x.words, np.repeat(weights[:, t], size), BUCKETS)
        at = np.flatnonzero(total.ravel() > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "value"])

    return run


def _gather(tokens: DataFrame, weight_of, topics: int, subjects: int) -> np.ndarray:
    """Sums over all documents; what reaches the driver has at most BUCKETS * topics rows."""
    got = tokens.mapInArrow(_sums(weight_of, topics, subjects), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(BUCKETS * topics)
    out[got["cell"].to_numpy(np.int64)] = got["value"].to_numpy()
    return out.reshape(BUCKETS, topics)


def _log_words(counts: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Log word probabilities by topic, smoothed towards the corpus."""
    smooth = counts + WORD_PRIOR * counts.sum(axis=0, keepdims=True).clip(1) * mean[:, None] + 1e-6
    return np.log(smooth / smooth.sum(axis=0, keepdims=True))


def top_terms(counts: np.ndarray, mean: np.ndarray, n: int = TOP_TERMS) -> list[np.ndarray]:
    """The words of each topic that weigh most against the corpus."""
    share = counts / counts.sum(axis=0, keepdims=True).clip(1e-9)
    weigh = share * np.log((share + 1e-9) / (mean[:, None] + 1e-9))
    return [np.argsort(-weigh[:, t], kind="stable")[:n] for t in range(counts.shape[1])]


def start(labelled: np.ndarray, corpus: np.ndarray, background: int) -> np.ndarray:
    """First word counts by topic: what labelled documents have in excess, and the corpus for the rest.

    Words that stand alike in documents of every label start in the background. Background topics are
    the corpus with each word's share shaken, alike on every run.
    """
    size = labelled.sum(axis=0, keepdims=True).clip(1e-9)
    share = labelled / size
    others = (share.sum(axis=1, keepdims=True) - share) / max(labelled.shape[1] - 1, 1)
    excess = np.maximum(labelled - EXCESS * size * others, 0)
    shake = np.random.default_rng(13).gamma(2.0, 0.5, (BUCKETS, background))
    return np.column_stack([excess, corpus[:, None] * shake])


def telling(labelled: np.ndarray) -> np.ndarray:
    """Whether a word tells a subject.

    Its count under the label must be ``TELLING`` times what its mean share under the others lets expect,
    and exceed that by ``SIGMAS`` standard deviations: a courtesy that stands under one label somewhat
    more often than under others does so by chance.
    """
    size = labelled.sum(axis=0, keepdims=True)
    share = labelled / size.clip(1e-9)
    expected = (share.sum(axis=1, keepdims=True) - share) / max(labelled.shape[1] - 1, 1) * size
    return (labelled >= LEAST_SEEN) & (labelled >= TELLING * expected) & (labelled >= expected + SIGMAS * np.sqrt(expected.clip(0.5)))


def inspected(logw: np.ndarray, labelled: np.ndarray, subject_of: np.ndarray) -> np.ndarray:
    """Word probabilities in which a subject's topic gains nothing from terms that do not tell the subject.

    Such a term gets half the greatest probability it has in a background topic, so that a segment of
    such terms alone stays in the background whatever the document is about. Terms seen too rarely
    under any label are left as fitted.
    """
    out, rest, tells = logw.copy(), subject_of < 0, telling(labelled)
    if not rest.any():
        return out
    for t, s in enumerate(subject_of):
        if s >= 0:
            dull = (labelled.sum(axis=1) >= LEAST_SEEN) & ~tells[:, s]
            out[dull, t] = logw[dull][:, rest].max(axis=1) - np.log(2)
    return out


def fit(tokens: DataFrame, subjects: int, background: int = BACKGROUND, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(log word probabilities by topic, subject of each topic or -1)."""
    topics = subjects + background

    def labelled(x: _Batch) -> np.ndarray:
        w = np.zeros((len(x.starts), topics))
        given = x.given[x.doc]
        w[:, :subjects] = given / given.sum(axis=1, keepdims=True).clip(1)
        w[:, subjects] = 1.0
        return w

    counts = _gather(tokens, labelled, topics, subjects)
    corpus = counts[:, subjects]
    mean = corpus / max(corpus.sum(), 1)
    by_label = counts[:, :subjects]
    counts = start(by_label, corpus, background)
    for _ in range(passes):
        shared = tokens.sparkSession.sparkContext.broadcast(_log_words(counts, mean))
        counts = _gather(tokens, lambda x, shared=shared: x.posterior(shared.value), topics, subjects)
    tells = telling(by_label)
    subject_of = np.full(topics, -1)
    for t, top in enumerate(top_terms(counts, mean)):
        agree = tells[top].mean(axis=0)
        best = int(np.argmax(agree)) if subjects else -1
        if counts[:, t].sum() > 0 and best >= 0 and agree[best] >= (OWN_AGREEMENT if best == t else AGREEMENT):
            subject_of[t] = best
    return inspected(_log_words(counts, mean), by_label, subject_of), subject_of


def classify(
    docs: DataFrame, key: str, text: str, subjects: list[str], labels: DataFrame, label_key: str, label: str, least: float = 1 / 6
) -> DataFrame:
    """(``key``, subject, share) of each subject that has at least ``least`` (times ``WHOLE``) of a document's topic proportions.

    Labels are read without case and surrounding space; null and unknown ones are ignored, doubled
    ones count once. Documents without words, and null keys, give no row; a table without labels
    gives none either, as nothing then names the topics. Repeated keys are classified row by row and
    the largest share is given.
    """
    names = sorted(subjects)
    number = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s.lower()), F.lit(i))])
    given = labels.select(F.col(label_key).alias("k"), number[F.lower(F.trim(F.col(label)))].alias("s")).where("k IS NOT NULL AND s IS NOT NULL")
    tokens = _tokenised(docs, key, text, given.groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("given")))
    logw, subject_of = fit(tokens, len(names))
    shared = docs.sparkSession.sparkContext.broadcast((logw, subject_of))
    kind = tokens.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logw, subject_of = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _Batch(b, len(names))
            # labels shape the model only: what is reported rests on the text
            x.given[:] = False
            p = x.posterior(logw)
            by = np.column_stack([p[:, subject_of == s].sum(axis=1) for s in range(len(names))])
            # topic proportions of the document: the mean over its segments, without the prior
            share = np.zeros((x.n, len(names)))
            np.add.at(share, x.doc, by)
            share /= np.bincount(x.doc, minlength=x.n).clip(1)[:, None]
            i, s = np.nonzero(share >= least * WHOLE)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(i)), pa.array([names[y] for y in s], pa.string()), pa.array(share[i, s])], names=["k", "subject", "share"]
            )

    found = tokens.mapInArrow(run, f"k {kind}, subject string, share double")
    return found.groupBy("k", "subject").agg(F.max("share").alias("share")).withColumnRenamed("k", key)
