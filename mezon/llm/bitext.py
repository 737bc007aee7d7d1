"""Sentence alignment of bilingual documents.

1. A lexicon is induced by log-likelihood ratios: how often two words stand in corresponding blocks
   of a document, against chance. Blocks are equal shares of the words on either side, of bounded
   size, so that work grows with the length of a document and not with its square.
2. Every sentence pair is scored by the share of its words, weighted by rarity, that the other side
   translates; maximum-weight assignment (Hungarian method) picks partners, and a pair below the
   null score is worse than none.
3. What the partners leave unexplained is scored and assigned again, next to the partner, until that
   adds no pair: these are sentences merged or split by the translation.
4. The lexicon is estimated a second time from the pairs found, and the assignment repeated.

The statistics cover all documents. Words are compared in Latin script, without case and apostrophes,
by their first letters (Uzbek inflects at the end of words).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mezon.functions.pytext import split_sentences, words
from mezon.session import cut, spread

STEM = 6
#: Words of a block on either side at most.
BLOCK_WORDS = 120
#: Least log-likelihood ratio of a lexicon entry (p < 0.001).
MIN_LLR = 10.83
#: A pair must score more than this; a second partner must explain more than this share of what was left.
NULL_SCORE, NULL_REST = 0.42, 0.55
#: One of the two sentences must be translated to at least this share.
MOST_COVERED = 0.62
#: A sentence takes part in a further assignment if this share of its weight is unexplained.
REST_SHARE = 0.2
#: Lexicons up to this size are broadcast; larger ones are joined to the documents.
BROADCAST_ROWS = 3_000_000
#: Word pairs of a document that are looked up at once.
WORD_PAIRS = 2_000_000
_PAIR, _EN, _UZ, _BLOCKS = range(4)


def _hash(w: str) -> int:
    return xxhash.xxh32_intdigest(w[:STEM])


def hashed(text: str | None) -> list[np.ndarray]:
    """Word hashes of each sentence."""
    return [np.array([_hash(w) for w in words(s)], np.int64) for s in split_sentences(text)]


def blocks(en: list[np.ndarray], uz: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words of corresponding shares of both sides."""
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (en, uz))
    if not len(a) or not len(b):
        return []
    k = -(-max(len(a), len(b)) // BLOCK_WORDS)
    return [(np.unique(x), np.unique(y)) for x, y in zip(np.array_split(a, k), np.array_split(b, k)) if len(x) and len(y)]


class _Counts:
    """Counts of words and word pairs, folded whenever many are waiting."""

    def __init__(self):
        self.kinds: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.ns: list[np.ndarray] = []
        self.size = 0

    def add(self, kind: int, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        self.kinds.append(np.full(len(keys), kind, np.int64))
        self.keys.append(keys)
        self.ns.append(np.ones(len(keys), np.int64) if n is None else n)
        self.size += len(keys)

    def pair(self, x: np.ndarray, y: np.ndarray) -> None:
        self.add(_PAIR, ((x[:, None] << 32) | y[None, :]).ravel())
        self.add(_EN, x)
        self.add(_UZ, y)
        self.add(_BLOCKS, np.zeros(1, np.int64))

    def fold(self) -> None:
        if not self.keys:
            return
        kind, key, n = np.concatenate(self.kinds), np.concatenate(self.keys), np.concatenate(self.ns)
        order = np.lexsort((key, kind))
        kind, key, n = kind[order], key[order], n[order]
        at = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
        self.kinds, self.keys, self.ns = [kind[at]], [key[at]], [np.add.reduceat(n, at)]
        self.size = len(at)

    def batch(self) -> pa.RecordBatch:
        self.fold()
        empty = [np.empty(0, np.int64)]
        cols = [np.concatenate(x or empty) for x in (self.kinds, self.keys, self.ns)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "key", "n"])


def _count(pairs_of):
    """Partial counts of one partition; ``pairs_of`` gives the word sets that correspond, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, folded = _Counts(), 0
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns)):
                for x, y in pairs_of(*row):
                    c.pair(x, y)
                if c.size > max(2_000_000, 2 * folded):
                    c.fold()
                    folded = c.size
                    if folded > 4_000_000:
                        yield c.batch()
                        c, folded = _Counts(), 0
        yield c.batch()

    return run


def _lexicon(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, weight) entries and (side, word, rarity) of all words, from counts by kind and key."""
    total = counts.where(F.col("kind") == _BLOCKS).agg(F.sum("n")).first()[0] or 0
    side = lambda kind, name: counts.where(F.col("kind") == kind).select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"))
    pairs = counts.where(F.col("kind") == _PAIR).select(
        F.col("key").alias("pair"), F.shiftrightunsigned("key", 32).alias("e"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("f"), F.col("n").alias("c")
    )
    both = pairs.where("c >= 2").join(side(_EN, "e"), "e").join(side(_UZ, "f"), "f")
    n = F.lit(float(total))
    a, b, c = F.col("c").cast("double"), F.col("n_e").cast("double"), F.col("n_f").cast("double")

    def cell(k, row, col):  # k log(k / expected)
        return F.when(k > 0, k * F.log(F.greatest(k, F.lit(1e-9)) * n / (row * col))).otherwise(0.0)

    llr = 2 * (cell(a, b, c) + cell(b - a, b, F.greatest(n - c, F.lit(1e-9))) + cell(c - a, F.greatest(n - b, F.lit(1e-9)), c) + cell(n - b - c + a, F.greatest(n - b, F.lit(1e-9)), F.greatest(n - c, F.lit(1e-9))))
    scored = both.withColumn("llr", llr).where((F.col("llr") >= MIN_LLR) & (a * n > b * c))
    weight = (2 * a / (b + c)).cast("float")
    lex = scored.select("pair", weight.alias("weight"))
    rarity = counts.where(F.col("kind").isin(_EN, _UZ)).select("kind", "key", F.log1p(n / F.col("n")).cast("float").alias("rarity"))
    return lex, rarity


class Lexicon:
    """Entries sorted by pair, and rarities sorted by word, as arrays; ``unknown`` is the rarity of all other words."""

    def __init__(self, pairs, weights, words_by_side: dict[int, tuple[np.ndarray, np.ndarray]], unknown: float):
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.weights, self.sides = pairs[order], weights[order], words_by_side
        self.unknown = unknown

    def rarity(self, side: int, words_: np.ndarray) -> np.ndarray:
        keys, r = self.sides[side]
        if not len(keys):
            return np.full(len(words_), self.unknown)
        at = np.minimum(np.searchsorted(keys, words_), len(keys) - 1)
        return np.where(keys[at] == words_, r[at], self.unknown).astype(float)

    def table(self, en: np.ndarray, uz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse (place in en, place in uz, weight), sorted, of the entries between two sorted word lists; equal words have weight 1."""
        lo, hi = np.searchsorted(self.pairs, en << 32), np.searchsorted(self.pairs, en << 32 | 0xFFFFFFFF, side="right")
        n = hi - lo
        e = np.repeat(np.arange(len(en)), n)
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        f, w = self.pairs[at] & 0xFFFFFFFF, self.weights[at].astype(float)
        u = np.minimum(np.searchsorted(uz, f), max(len(uz) - 1, 0))
        ok = uz[u] == f if len(uz) else np.zeros(len(f), bool)
        same, i, j = np.intersect1d(en, uz, return_indices=True)
        e, u, w = np.r_[e[ok], i], np.r_[u[ok], j], np.r_[w[ok], np.ones(len(same))]
        order = np.lexsort((w, u, e))
        e, u, w = e[order], u[order], w[order]
        last = np.r_[(e[1:] != e[:-1]) | (u[1:] != u[:-1]), True] if len(e) else np.zeros(0, bool)
        return e[last], u[last], w[last]


def hungarian(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment with the greatest sum; pairs without positive gain are left out.

    Shortest augmenting paths with potentials; rows may stay alone at gain 0.
    """
    n, m = gain.shape
    if not n or not m:
        return []
    # each row has its own null column of gain 0
    cost = np.full((n, m + n), 0.0)
    cost[:, :m] = np.where(gain > 0, -gain, 1e9)
    cost[:, m:] = 1e9
    cost[np.arange(n), m + np.arange(n)] = 0.0
    width = m + n
    u, v = np.zeros(n + 1), np.zeros(width + 1)
    owner, way = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(width + 1, np.inf), np.zeros(width + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better] = cur[better]
            way[1:][better] = j0
            masked = np.where(free, least[1:], np.inf)
            j1 = int(masked.argmin()) + 1
            delta = masked[j1 - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def assign(score: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Best assignment over the given pairs, one connected component at a time."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in score:
        parent[root(("e", i))] = root(("u", j))
    groups: dict = {}
    for i, j in score:
        groups.setdefault(root(("e", i)), []).append((i, j))
    out = []
    for pairs in groups.values():
        if len(pairs) == 1:
            out += pairs
            continue
        rows, cols = sorted({i for i, _ in pairs}), sorted({j for _, j in pairs})
        r, c = {x: k for k, x in enumerate(rows)}, {x: k for k, x in enumerate(cols)}
        gain = np.zeros((len(rows), len(cols)))
        for i, j in pairs:
            gain[r[i], c[j]] = score[i, j]
        out += [(rows[a], cols[b]) for a, b in hungarian(gain)]
    return out


class _Side:
    """Distinct words of each sentence of one side, as places in the side's vocabulary, and their weights."""

    def __init__(self, sents: list[np.ndarray], vocab: np.ndarray, rare: np.ndarray):
        each = [np.unique(np.searchsorted(vocab, s)) for s in sents]
        self.start = np.r_[0, np.cumsum([len(x) for x in each])]
        self.words = np.concatenate(each).astype(np.int64)
        self.of = np.repeat(np.arange(len(sents)), np.diff(self.start))
        self.weight = rare[self.words].astype(float)
        self.full = self.total()
        # in how many sentences each word stands, and which
        order = np.argsort(self.words, kind="stable")
        self.sents, self.first = self.of[order], np.searchsorted(self.words[order], np.arange(len(vocab) + 1))

    def total(self) -> np.ndarray:
        return np.bincount(self.of, self.weight, len(self.start) - 1)

    def prefix(self) -> np.ndarray:
        """Places of each sentence's rarest words, as many as hold more than what a pair may leave untranslated."""
        count = np.diff(self.first)[self.words]
        order = np.lexsort((self.words, count, self.of))
        before = np.cumsum(self.weight[order]) - self.weight[order]
        before -= np.repeat(before[np.minimum(self.start[:-1], max(len(before) - 1, 0))], np.diff(self.start))
        return order[before <= (1 - MOST_COVERED) * self.full[self.of[order]] + 1e-9]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. of each range, one after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _met(side: _Side, other: _Side, entry: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sentence pairs (side * sentences of other + other) in which a prefix word of ``side`` is translated.

    ``entry``: the other side's words, sorted by this side's, of which word x has first[x] to first[x + 1].
    """
    at, m = side.prefix(), len(other.start) - 1
    x = side.words[at]
    size = first[x + 1] - first[x]
    y, i = entry[_ranges(first[x], size)], np.repeat(side.of[at], size)
    there = other.first[y + 1] - other.first[y]
    return np.unique(np.repeat(i, there) * m + other.sents[_ranges(other.first[y], there)])


class _Document:
    """Sentence pairs of a document that can correspond, and their scores; nothing is as large as all pairs."""

    def __init__(self, en: list[np.ndarray], uz: list[np.ndarray], lex: Lexicon):
        ev, uv = np.unique(np.concatenate(en)), np.unique(np.concatenate(uz))
        self.en, self.uz = _Side(en, ev, lex.rarity(_EN, ev)), _Side(uz, uv, lex.rarity(_UZ, uv))
        self.n, self.m, self.width = len(en), len(uz), len(uv)
        self.e, self.u, self.w = lex.table(ev, uv)
        self.first = np.searchsorted(self.e, np.arange(len(ev) + 1))
        self.there = self.uz.of * self.width + self.uz.words
        self.entries = np.bincount(self.en.of, np.diff(self.first)[self.en.words], self.n).astype(np.int64)

    def candidates(self) -> np.ndarray:
        """Every pair (en * m + uz) of which one side may be translated to the share ``MOST_COVERED``.

        Less than that is translated if none of a sentence's prefix words is, so nothing is lost.
        """
        there = _met(self.en, self.uz, self.u, self.first)
        order = np.lexsort((self.e, self.u))
        back = _met(self.uz, self.en, self.e[order], np.searchsorted(self.u[order], np.arange(len(self.uz.first))))
        return np.union1d(there, back % self.n * self.m + back // self.n)

    def words_of(self, i: np.ndarray, j: np.ndarray):
        """(pair, place in en, place in uz, weight) of all entries between the words of sentences i[k] and j[k]."""
        size = self.en.start[i + 1] - self.en.start[i]
        p = _ranges(self.en.start[i], size)
        x = self.en.words[p]
        entries = self.first[x + 1] - self.first[x]
        at = _ranges(self.first[x], entries)
        pair = np.repeat(np.repeat(np.arange(len(i)), size), entries)
        key = j[pair] * self.width + self.u[at]
        q = np.minimum(np.searchsorted(self.there, key), len(self.there) - 1)
        hit = self.there[q] == key
        return pair[hit], np.repeat(p, entries)[hit], q[hit], self.w[at[hit]]

    def covered(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of sentence i[k]'s and of j[k]'s remaining weight that the other translates."""
        out = np.zeros((2, len(i)))
        size = np.cumsum(self.entries[i])
        left = self.en.total(), self.uz.total()
        # some million word pairs at a time
        for part in np.split(np.arange(len(i)), np.searchsorted(size, np.arange(WORD_PAIRS, size[-1], WORD_PAIRS)) if len(i) else []):
            pair, p, q, w = self.words_of(i[part], j[part])
            if not len(pair):
                continue
            order = np.argsort(pair * len(self.there) + q)
            # pairs and the en side's words come in order; the strongest entry of each word of a pair counts
            for s, (side, x, of, strength) in enumerate(((self.en, p, pair, w), (self.uz, q[order], pair[order], w[order]))):
                at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (of[1:] != of[:-1])])
                got = np.bincount(of[at], side.weight[x[at]] * np.maximum.reduceat(strength, at), len(part))
                out[s, part] = got / np.maximum(left[s][(i, j)[s][part]], 1e-9)
        return out[0], out[1]

    def explain(self, i: np.ndarray, j: np.ndarray) -> None:
        """Take out the words that the pairs translate."""
        _, p, q, w = self.words_of(i, j)
        live = (w >= 0.15) & (self.en.weight[p] > 0) & (self.uz.weight[q] > 0)
        self.en.weight[p[live]] = 0
        self.uz.weight[q[live]] = 0


def align(en: list[np.ndarray], uz: list[np.ndarray], lex: Lexicon) -> list[tuple[int, int, float, bool]]:
    """(en_no, uz_no, score, second partner) of the sentences, numbered from 1."""
    if not any(map(len, en)) or not any(map(len, uz)):
        return []
    doc = _Document(en, uz, lex)
    n, m = doc.n, doc.m
    pairs: list[tuple[int, int, float, bool]] = []
    known: set[int] = set()
    for turn in count():  # each pair is found once, so this ends
        if turn == 0:
            at = doc.candidates()
        else:
            beside = {(i - 1 + a) * m + j - 1 + b for i, j, *_ in pairs for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)) if 0 <= i - 1 + a < n and 0 <= j - 1 + b < m}
            at = np.array(sorted(beside - known), np.int64)
        i, j = at // m, at % m
        ce, cu = doc.covered(i, j)
        mean = (ce + cu) / 2 - 0.02 * np.abs(i / n - j / m)  # among equals the nearer
        if turn == 0:
            gain = mean - NULL_SCORE
            ok = (gain > 0) & (np.maximum(ce, cu) >= MOST_COVERED)
        else:
            gain = np.maximum(mean, np.minimum(np.maximum(ce, cu), 2 * mean)) - NULL_REST
            ok = (gain > 0) & (doc.en.total() >= REST_SHARE * doc.en.full)[i] & (doc.uz.total() >= REST_SHARE * doc.uz.full)[j]
        score = {(int(a), int(b)): float(g) for a, b, g in zip(i[ok], j[ok], gain[ok])}
        if not score:
            break
        of = dict(zip(at[ok].tolist(), mean[ok].tolist()))
        found = assign(score)
        pairs += [(a + 1, b + 1, of[a * m + b], turn > 0) for a, b in found]
        known |= {a * m + b for a, b in found}
        # what the partners explain is taken out before the next turn; no sentence is in two of the pairs
        doc.explain(np.array([a for a, _ in found]), np.array([b for _, b in found]))
    return sorted(pairs)


def _rows(df: DataFrame, key: str, en: str, uz: str) -> DataFrame:
    """Documents with text on both sides, split and hashed once: key, array of sentences (arrays of hashes) per side."""
    slim = spread(df.where(F.col(en).isNotNull() & F.col(uz).isNotNull()).select(F.col(key).alias("k"), F.col(en).alias("en"), F.col(uz).alias("uz")))
    kind = slim.schema["k"].dataType.simpleString()
    nested = pa.list_(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [pa.array([[s.tolist() for s in hashed(t)] for t in b.column(c).to_pylist()], nested) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *sides], names=["k", "en", "uz"])

    return slim.mapInArrow(run, f"k {kind}, en array<array<bigint>>, uz array<array<bigint>>")


def _arrays(sents: list[list[int]]) -> list[np.ndarray]:
    return [np.array(s, np.int64) for s in sents]


def _fit(rows: DataFrame, pairs_of) -> tuple[DataFrame, DataFrame]:
    counts = rows.mapInArrow(_count(pairs_of), "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    return _lexicon(cut(counts))


def _aligned(rows: DataFrame, fitted: tuple[DataFrame, DataFrame], schema: str, emit) -> DataFrame:
    """``emit(key, en, uz, pairs)`` of every document, with the lexicon broadcast or, beyond the bound, joined by row number ``n``."""
    lex, rarity = (cut(x) for x in fitted)
    spark = rows.sparkSession
    # a word without rarity counts as the rarest of the corpus, whichever part of the lexicon a document gets
    unknown = rarity.agg(F.max("rarity")).first()[0] or 1.0
    names = T._parse_datatype_string(schema).names
    if lex.count() + rarity.count() <= BROADCAST_ROWS:
        p, r = lex.toPandas(), rarity.toPandas().sort_values("key")
        sides = {k: (g["key"].to_numpy(np.int64), g["rarity"].to_numpy()) for k, g in ((k, r[r["kind"] == k]) for k in (_EN, _UZ))}
        shared = spark.sparkContext.broadcast(Lexicon(p["pair"].to_numpy(np.int64), p["weight"].to_numpy(np.float32), sides, unknown))
        source = rows.select("k", "en", "uz")
        lexicon_of = lambda extra: shared.value
    else:
        # every document gets the entries and rarities of its own words
        flat = lambda c, kind: rows.select("n", F.explode(F.array_distinct(F.flatten(c))).alias("key"), F.lit(kind).cast("long").alias("kind"))
        own_r = flat("en", _EN).union(flat("uz", _UZ)).join(rarity, ["kind", "key"])
        own_r = own_r.groupBy("n").agg(F.collect_list(F.struct("kind", "key", "rarity")).alias("own_r"))
        own_l = flat("en", _EN).select("n", F.col("key").alias("e")).join(lex.withColumn("e", F.shiftrightunsigned("pair", 32)), "e")
        own_l = own_l.withColumn("f", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(flat("uz", _UZ).select("n", F.col("key").alias("f")), ["n", "f"], "left_semi")
        own_l = own_l.groupBy("n").agg(F.collect_list(F.struct("pair", "weight")).alias("own_l"))
        source = rows.join(own_r, "n", "left").join(own_l, "n", "left").select("k", "en", "uz", "own_r", "own_l")

        def lexicon_of(extra):
            r, p = extra
            by = {k: sorted((x["key"], x["rarity"]) for x in r or () if x["kind"] == k) for k in (_EN, _UZ)}
            sides = {k: (np.array([x for x, _ in v], np.int64), np.array([y for _, y in v])) for k, v in by.items()}
            return Lexicon(np.array([x["pair"] for x in p or ()], np.int64), np.array([x["weight"] for x in p or ()], np.float32), sides, unknown)

    kinds = [pa.from_numpy_dtype(np.int64) if f.dataType.simpleString() == "bigint" else None for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                en, uz = _arrays(row[1]), _arrays(row[2])
                out += emit(row[0], en, uz, align(en, uz, lexicon_of(row[3:])))
            cols = list(zip(*out)) if out else [()] * len(names)
            types = [b.schema.field(0).type if n == "k" else k for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types or [None] * len(cols))], names=names)

    return source.mapInArrow(run, schema)


def align_sentences(df: DataFrame, key: str, en: str, uz: str, parallel: DataFrame | None = None) -> DataFrame:
    """(``key``, en_no, uz_no, score) of the sentences that are translations of one another.

    A sentence that covers two of the other side appears twice; one without counterpart does not
    appear. Documents with a null or empty side give no rows, and an empty table gives none. Rows
    that repeat a key are aligned each for itself and their pairs given once. ``parallel`` (columns
    ``en`` and ``uz``) is further translated text for the lexicon.
    """
    rows = cut(_rows(df, key, en, uz).withColumn("n", F.monotonically_increasing_id()))
    more = _rows(parallel.select(F.lit(None).cast("long").alias("k"), "en", "uz"), "k", "en", "uz").select("en", "uz") if parallel is not None else None
    texts = rows.select("en", "uz")
    first = _fit(texts.union(more) if more is not None else texts, lambda a, b: blocks(_arrays(a), _arrays(b)))
    pair_schema = "en array<bigint>, uz array<bigint>"

    def sure(_k, en_, uz_, pairs):
        return [(en_[i - 1].tolist(), uz_[j - 1].tolist()) for i, j, s, second in pairs if s >= 0.6 and not second]

    matched = _aligned(rows, first, pair_schema, sure)
    if more is not None:
        matched = matched.union(more.select(F.flatten("en"), F.flatten("uz")))
    second = _fit(matched, lambda a, b: [(np.unique(np.array(a, np.int64)), np.unique(np.array(b, np.int64)))] if a and b else [])
    kind = rows.schema["k"].dataType.simpleString()
    found = _aligned(rows, second, f"k {kind}, en_no bigint, uz_no bigint, score double", lambda k, en_, uz_, pairs: [(k, i, j, s) for i, j, s, _ in pairs])
    return found.groupBy("k", "en_no", "uz_no").agg(F.max("score").alias("score")).withColumnRenamed("k", key)
