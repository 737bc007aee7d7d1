"""Exact removal of repeated deliveries with quotient hash tables.

An identifier is written as a fixed-width block of 64-bit lanes and permuted by a bijection. The
first lane of the permuted block gives the quotient (shard and slot); all remaining bits are stored
in full as the remainder, so two identifiers meet in a table only if they are equal: there are no
false matches, whatever the hash does. Identifiers are inserted once; later copies only update the
stored choice of the delivery to keep.

Plan: per input partition a table absorbs the copies it sees (so that a message holding a third of
all rows leaves each partition as one entry), entries travel once, by quotient shard, and each shard
is merged in its own table. Rows never leave their partition with their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from mezon.session import cut

#: Bytes of one width class; an identifier takes the smallest multiple that holds it.
LANE_BYTES, CLASS_BYTES = 8, 32
#: Entries a map-side table holds before it is passed on.
TABLE_ENTRIES = 1 << 18

_MULT = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def segment_id(c: Column) -> Column:
    """The segment an id names: case, white space, invisible marks and dash variants are repaired.

    Null stays null.
    """
    c = F.regexp_replace(c, "[\\p{Pd}\\u2212\\u00AD]", "-")
    c = F.regexp_replace(c, "(?U)[\\s\\p{Cf}\\p{Cc}]+", "")
    return F.lower(c)


def has_text(c: Column) -> Column:
    """Not null and not empty after stripping Unicode white space."""
    return F.coalesce(F.regexp_replace(c, "(?U)[\\s\\x1c-\\x1f]+", "") != "", F.lit(False))


def fixed_width(ids: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Identifiers as rows of lanes by width class: class -> (positions, uint64[n, lanes]).

    The last lane holds the length, so that padding cannot make two identifiers equal.
    """
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    classes = np.maximum(1, -(-sizes // CLASS_BYTES))
    out = {}
    for k in np.unique(classes):
        at, width = np.flatnonzero(classes == k), int(k) * CLASS_BYTES
        raw = b"".join(ids[i].ljust(width, b"\0") for i in at)
        lanes = np.frombuffer(raw, dtype="<u8").reshape(len(at), width // LANE_BYTES)
        out[int(k)] = at, np.column_stack([lanes, sizes[at].astype(np.uint64)])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (odd multiplications and xor-shifts)."""
    x = x * np.uint64(_MULT[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MULT[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MULT[2])
    return x ^ (x >> np.uint64(31))


def permute(lanes: np.ndarray) -> np.ndarray:
    """A bijection of blocks: lane 0 takes in a hash of the others and is mixed, the others stay.

    Given the others, lane 0 can be computed back, so equal outputs mean equal inputs.
    """
    out = lanes.copy()
    acc = np.zeros(len(lanes), np.uint64)
    for j in range(1, lanes.shape[1]):
        acc = _mix(acc + lanes[:, j] + np.uint64(j))
    out[:, 0] = _mix(lanes[:, 0] + acc)
    return out


class QuotientTable:
    """Remainders stored by quotient, each with the delivery to keep so far.

    The layout is that of a quotient filter: entries lie in order of quotient, those of one quotient
    form a run, and ``offsets`` gives each run's start. Insertion is in batches: new entries wait
    until they are as many as the table holds, then are merged by quotient and remainder and equal
    blocks folded into one, so that each entry is moved a logarithmic number of times.
    """

    WAITING = 1 << 15

    def __init__(self, lanes: int, bits: int = 12):
        self.bits = bits
        self.blocks = np.empty((0, lanes), np.uint64)
        self.best = np.empty((0,), np.int64)  # last ord with text, -1 for none
        self.full = np.empty((0,), bool)  # has any copy with text
        self.first = np.empty((0,), np.int64)  # first ord of all
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def __len__(self) -> int:
        return len(self.blocks)

    def insert(self, blocks: np.ndarray, best: np.ndarray, full: np.ndarray, first: np.ndarray) -> None:
        self.waiting.append((blocks, best, full, first))
        if sum(len(w[0]) for w in self.waiting) >= max(self.WAITING, len(self)):
            self.settle()

    def settle(self) -> None:
        """Merge what waits; needed before the entries are read."""
        if not self.waiting:
            return
        parts = [(self.blocks, self.best, self.full, self.first), *self.waiting]
        self.waiting = []
        blocks, best, full, first = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort(blocks.T[::-1])  # by lane 0 (quotient, then its low bits), then the other lanes
        blocks, best, full, first = blocks[order], best[order], full[order], first[order]
        new = np.ones(len(blocks), bool)
        new[1:] = (blocks[1:] != blocks[:-1]).any(axis=1)
        at = np.flatnonzero(new)
        lowest = np.iinfo(np.int64).min
        self.blocks = blocks[at]
        if len(at):
            self.full = np.logical_or.reduceat(full, at)
            self.best = np.maximum.reduceat(np.where(full, best, lowest), at)
            self.first = np.minimum.reduceat(first, at)

    def offsets(self) -> np.ndarray:
        """Start of each quotient's run; the last element is the size."""
        quotients = self.blocks[:, 0] >> np.uint64(64 - self.bits)
        return np.searchsorted(quotients, np.arange((1 << self.bits) + 1, dtype=np.uint64))

    def find(self, block: np.ndarray) -> int:
        """Position of a permuted block, or -1."""
        q = int(block[0] >> np.uint64(64 - self.bits))
        lo, hi = self.offsets()[q : q + 2]
        hit = np.flatnonzero((self.blocks[lo:hi] == block).all(axis=1))
        return int(lo + hit[0]) if len(hit) else -1


_ENTRY = "shard long, block binary, best long, full boolean, first long"


def _entries(table: QuotientTable, shard_bits: int) -> pa.RecordBatch:
    table.settle()
    b = np.ascontiguousarray(table.blocks)
    shard = (b[:, 0] >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(b), np.int64)
    width = b.shape[1] * LANE_BYTES
    block = pa.Array.from_buffers(pa.binary(width), len(b), [None, pa.py_buffer(b.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(shard), block, pa.array(np.where(table.full, table.best, 0)), pa.array(table.full), pa.array(table.first)],
        names=["shard", "block", "best", "full", "first"],
    )


def _collect(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, QuotientTable] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ident, ord_, full = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for k, (at, lanes) in fixed_width(ident).items():
                t = tables.setdefault(k, QuotientTable(lanes.shape[1]))
                t.insert(permute(lanes), ord_[at], full[at], ord_[at])
                if len(t) > TABLE_ENTRIES:
                    yield _entries(tables.pop(k), shard_bits)
        for t in tables.values():
            yield _entries(t, shard_bits)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of shard; one shard's tables are in memory at a time."""
    current, tables = None, {}

    def done() -> pa.RecordBatch:
        for t in tables.values():
            t.settle()
        keep = np.concatenate([np.where(t.full, t.best, t.first) for t in tables.values()])
        return pa.RecordBatch.from_arrays([pa.array(keep)], names=["kept"])

    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if shard[lo] != current:
                if tables:
                    yield done()
                current, tables = shard[lo], {}
            part = batch.slice(lo, hi - lo)
            blocks = part.column(1).to_pylist()
            best, full, first = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
            for w in np.unique(sizes):
                at = np.flatnonzero(sizes == w)
                lanes = np.frombuffer(b"".join(blocks[i] for i in at), dtype=np.uint64).reshape(len(at), -1)
                t = tables.setdefault(int(w), QuotientTable(lanes.shape[1]))
                t.insert(lanes, best[at], full[at], first[at])
    if tables:
        yield done()


def kept_deliveries(df: DataFrame, keys: list[Column], order: str, text: str, shard_rows: int = 1 << 20) -> DataFrame:
    """One row (``kept``: value of ``order``) per distinct identifier.

    Kept is the last delivery by ``order`` whose ``text`` has content, else the first. Rows whose
    ``order`` is null cannot be told apart and are left out; null key parts equal each other and
    differ from the empty string. Repeated rows with the same ``order`` are one delivery. An empty
    table gives no rows. ``order`` must be a whole number: a cast could drop rows or join them.
    ``shard_rows`` bounds the entries merged in one table.
    """
    if not isinstance(df.schema[order].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{order} is {df.schema[order].dataType.simpleString()}; the order of arrival must be a whole number")
    # length-prefixed parts: no two different key tuples give the same bytes
    parts = [F.coalesce(F.concat(F.octet_length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-")) for k in keys]
    slim = df.where(F.col(order).isNotNull()).select(
        F.encode(F.concat(*parts), "UTF-8").alias("ident"), F.col(order).cast("long").alias("ord"), has_text(F.col(text)).alias("full")
    )
    rows = df.count()
    shard_bits = max(8, int(np.ceil(np.log2(max(1, rows / shard_rows)))))
    entries = slim.mapInArrow(_collect(shard_bits), _ENTRY)
    return entries.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merge, "kept long")


def repeated_deliveries(df: DataFrame, keys: list[Column], order: str, text: str) -> DataFrame:
    """The deliveries (``order`` only) that are not the kept copy of their message."""
    kept = cut(kept_deliveries(df, keys, order, text))
    every = df.where(F.col(order).isNotNull()).select(F.col(order)).distinct()
    return every.join(kept, F.col(order) == F.col("kept"), "left_anti")


def keep_once(df: DataFrame, keys: list[Column], order: str, text: str) -> DataFrame:
    """Each message once, with all its columns (extra columns of any name pass through)."""
    kept = cut(kept_deliveries(df, keys, order, text)).withColumnRenamed("kept", "__kept")
    return df.join(kept, F.col(order) == F.col("__kept"), "left_semi").dropDuplicates([order])
