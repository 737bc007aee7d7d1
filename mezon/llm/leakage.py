"""Evaluation items leaking into a corpus: BM25 over the items with block-max pruning, then an exact check.

The evaluation set is the indexed side. Every passage (overlapping window of words) of every corpus
document is a query, and all items whose BM25 score reaches their own threshold are retrieved. An
item's threshold is the least score that a passage with the wanted share of its words can have, so
the search loses nothing that the check would accept. Blocks of items whose summed block maxima stay
below the lowest threshold in the block are skipped (the pivot test of block-max WAND, over whole
blocks). The check then looks for the item's words in order within one passage.

Items are grouped by length, each group with windows twice as wide as the widest passage that the
check accepts for it, so a long item does not widen the windows of short ones.

Words are compared without case, apostrophes and script. A word stands for every indexed word within
one edit (two from eight letters), so what an item matches does not depend on the other items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezon.functions.pytext import words
from mezon.session import spread

K1, B, BLOCK = 1.2, 0.75, 16
#: Characters of evaluation texts indexed at once (an index of some 100 MB at most); a larger set is
#: searched in several passes over the corpus, with the same result.
PART_CHARS = 4_000_000
#: Words of a corpus passage that may stand between two matched words.
GAP = 8
#: Shortest and longest word that may be misspelt.
FUZZY = range(4, 41)


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether ``a`` and ``b`` differ by at most ``most`` insertions, deletions, changes or swaps of neighbours."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def _deletes(w: str, n: int) -> set[str]:
    out, edge = {w}, {w}
    for _ in range(n):
        edge = {x[:i] + x[i + 1 :] for x in edge for i in range(len(x))}
        out |= edge
    return out


class Vocabulary:
    """Numbers of the indexed words, and all words within the edits allowed of a given one.

    Two words within so many edits share a form with so many letters left out; hashes of these forms
    are kept in sorted arrays, and what they find is compared letter by letter.
    """

    def __init__(self, texts: list[list[str]]):
        self.number: dict[str, int] = {}
        for text in texts:
            for w in text:
                self.number.setdefault(w, len(self.number))
        self.words = list(self.number)
        forms, owners = [], []
        for n, w in enumerate(self.words):
            if len(w) >= FUZZY.start and len(w) <= FUZZY.stop + 1 and not w.isdigit():
                of = [xxhash.xxh64_intdigest(d) for d in _deletes(w, 2 if len(w) >= 7 else 1)]
                forms.append(np.array(of, np.uint64))
                owners.append(np.full(len(of), n, np.int32))
        f, o = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((forms, np.uint64), (owners, np.int32)))
        order = np.argsort(f, kind="stable")
        self.forms, self.owners = f[order], o[order]
        self.known: dict[str, tuple[int, ...]] = {}

    def terms(self, w: str) -> tuple[int, ...]:
        """Numbers of all indexed words that ``w`` stands for, itself included."""
        found = self.known.get(w)
        if found is None:
            same = self.number.get(w)
            near = {same} - {None}
            if len(w) in FUZZY and not w.isdigit():
                most = 2 if len(w) >= 8 else 1
                own = np.array([xxhash.xxh64_intdigest(d) for d in _deletes(w, most)], np.uint64)
                lo, hi = np.searchsorted(self.forms, own), np.searchsorted(self.forms, own, side="right")
                close = {int(o) for a, b in zip(lo, hi) if b > a for o in self.owners[a:b]}
                near |= {o for o in close - near if within_edits(w, self.words[o], most)}
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[w] = tuple(sorted(near))
        return found


class ItemGroup:
    """Postings of evaluation texts of about one length, by word, with block maxima and thresholds."""

    def __init__(self, texts: list[tuple[object, np.ndarray, int]]):
        self.ids = [i for i, _, _ in texts]
        self.entries = [e for _, e, _ in texts]
        self.need = [n for _, _, n in texts]
        #: Words from the first to the last matched one of the widest passage that is accepted.
        self.reach = max(self.need) * (GAP + 1)
        n = len(texts)
        df = Counter(t for e in self.entries for t in set(e.tolist()))
        idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        mean = sum(map(len, self.entries)) / n
        posts: dict[int, list[tuple[int, float]]] = {t: [] for t in df}
        self.theta = np.zeros(n)
        self.where: list[dict[int, list[int]]] = []
        for e, seq in enumerate(self.entries):
            tf = Counter(seq.tolist())
            norm = K1 * (1 - B + B * len(seq) / mean)
            impact = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            for t, x in impact.items():
                posts[t].append((e, x))
            left = self.need[e]
            for per_word, c in sorted((impact[t] / tf[t], tf[t]) for t in tf):  # the cheapest way to the wanted share
                take = min(left, c)
                self.theta[e] += per_word * take
                left -= take
            where: dict[int, list[int]] = {}
            for j, t in enumerate(seq.tolist()):
                where.setdefault(t, []).append(j)
            self.where.append(where)
        self.theta *= 1 - 1e-9
        self.blocks = -(-n // BLOCK)
        self.block_theta = np.full(self.blocks, np.inf)
        np.minimum.at(self.block_theta, np.arange(n) // BLOCK, self.theta)
        self.post = {t: (np.array([e for e, _ in p]), np.array([x for _, x in p])) for t, p in posts.items()}
        self.block_max = {}
        for t, (e, x) in self.post.items():
            b, start = np.unique(e // BLOCK, return_index=True)
            self.block_max[t] = b, np.maximum.reduceat(x, start)

    def retrieve(self, terms: np.ndarray) -> np.ndarray:
        """Entries whose score for the passage reaches their threshold."""
        unique = [t for t in np.unique(terms).tolist() if t in self.post]
        if not unique:
            return np.empty(0, np.int64)
        b = [self.block_max[t] for t in unique]
        bound = np.bincount(np.concatenate([x[0] for x in b]), np.concatenate([x[1] for x in b]), self.blocks)
        alive = bound >= self.block_theta
        if not alive.any():
            return np.empty(0, np.int64)
        p = [self.post[t] for t in unique]
        e, x = np.concatenate([x[0] for x in p]), np.concatenate([x[1] for x in p])
        keep = alive[e // BLOCK]
        score = np.bincount(e[keep], x[keep], len(self.entries))
        return np.flatnonzero(score >= self.theta)

    def holds(self, places: list[int], terms: list[int], e: int) -> bool:
        """Whether enough of the entry's words stand in order in the passage, never more than GAP words apart.

        ``terms[i]`` is a word that the passage's word at ``places[i]`` stands for; places ascend.
        """
        where, need = self.where[e], self.need[e]
        hits = [(i, j) for i, t in zip(places, terms) if t in where for j in where[t]]
        if len({i for i, _ in hits}) < need:
            return False
        recent: list[tuple[int, int, int]] = []  # (place in passage, place in entry, chain length)
        for i, j in hits:
            if recent and i - recent[0][0] > GAP + 1:
                recent = [r for r in recent if i - r[0] <= GAP + 1]
            best = 1 + max((n for p, q, n in recent if p < i and q < j), default=0)
            if best >= need:
                return True
            recent.append((i, j, best))
        return False


class ItemIndex:
    """Evaluation texts (id, words) in groups by length over one vocabulary."""

    def __init__(self, texts: list[tuple[object, list[str]]], share: float):
        texts = [(i, w) for i, w in texts if w]
        self.vocabulary = Vocabulary([w for _, w in texts])
        groups: dict[int, list[tuple[object, np.ndarray, int]]] = {}
        for i, w in texts:
            need = max(1, math.ceil(share * len(w) - 1e-9))
            numbers = np.array([self.vocabulary.number[x] for x in w], np.int64)
            groups.setdefault(need.bit_length(), []).append((i, numbers, need))
        self.groups = [ItemGroup(g) for _, g in sorted(groups.items())]

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, terms, number of words): every indexed word that a word of the text stands for, with its place."""
        stands = [self.vocabulary.terms(w) for w in words(text)]
        sizes = [len(x) for x in stands]
        return np.repeat(np.arange(len(stands)), sizes), np.array([t for x in stands for t in x], np.int64), len(stands)

    def leaked(self, text: str) -> set:
        places, terms, n = self.read(text)
        found = set()
        for g in self.groups:
            for a in range(0, max(1, n - g.reach), g.reach):
                lo, hi = np.searchsorted(places, (a, a + 2 * g.reach))
                passage = None
                for e in g.retrieve(terms[lo:hi]).tolist():
                    if g.ids[e] not in found:
                        passage = passage or (places[lo:hi].tolist(), terms[lo:hi].tolist())
                        if g.holds(*passage, e):
                            found.add(g.ids[e])
        return found


def leaks(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_texts: list[str], share: float = 0.6
) -> DataFrame:
    """(``key``, item_id) of each document that contains at least ``share`` of the words of an item's text.

    Null or wordless texts, on either side, match nothing; an empty table gives no rows; equal pairs
    from repeated rows are given once. ``item_key`` must be a string column. Larger evaluation sets
    are searched in parts of about ``PART_CHARS`` characters, each broadcast in turn.
    """
    rows = spread(corpus.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    slim = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), *(F.col(c).alias(f"t{n}") for n, c in enumerate(item_texts)))
    size = sum((F.coalesce(F.length(f"t{n}"), F.lit(0)) for n in range(len(item_texts))), F.lit(0))
    parts = max(1, math.ceil((slim.agg(F.sum(size)).first()[0] or 0) / PART_CHARS))
    found = []
    for p in range(parts):
        got = slim.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect()
        index = ItemIndex([(r[0], words(t)) for r in got for t in r[1:] if t], share)
        shared = corpus.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                at: list[int] = []
                out: list[str] = []
                for n, t in enumerate(batch.column(1).to_pylist()):
                    hit = sorted(index.leaked(t)) if index.groups else []
                    at += [n] * len(hit)
                    out += hit
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["k", "item_id"])

        found.append(rows.mapInArrow(run, f"k {kind}, item_id string"))
    return reduce(DataFrame.unionAll, found).distinct().withColumnRenamed("k", key)
