"""Once-seen and twice-seen Bloom filters over 64-bit hashes, built in parallel.

Each task packs the slots its hashes fall on, sorted and delta-coded, by shard; one
task per shard then merges the packs of all tasks. (once, twice) pairs of filters
merge in any order: twice = twice1 | twice2 | (once1 & once2), once = once1 | once2.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK_SCHEMA = "shard int, pack binary"


def _code(sorted_slots: np.ndarray) -> bytes:
    return zlib.compress(np.diff(sorted_slots, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1)


def _decode(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.uint32), dtype=np.uint64).astype(np.int64)


def pack_slots(hashes: np.ndarray, bits: int, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, pack) of one task's hashes, repeats included: the packs say which
    slots were hit, and which of them more than once. ``shards`` divides ``bits``,
    both powers of two."""
    slots = np.sort(hashes & np.uint64(bits - 1))
    first = np.ones(len(slots), bool)
    first[1:] = slots[1:] != slots[:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(slots)))
    slots = slots[first]
    width = bits // shards
    bounds = np.searchsorted(slots, np.arange(shards + 1, dtype=np.uint64) * np.uint64(width))
    for k in range(shards):
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            own = (slots[a:b] - np.uint64(k * width)).astype(np.uint32)
            once, twice = _code(own), _code(own[counts[a:b] > 1])
            yield k, len(once).to_bytes(4, "little") + once + twice


class SeenFilters:
    """The once-seen and twice-seen filter of one shard."""

    def __init__(self, width: int):
        self.once = np.zeros(width, bool)
        self.twice = np.zeros(width, bool)

    def add(self, pack: bytes) -> None:
        n = int.from_bytes(pack[:4], "little")
        slots = _decode(pack[4 : 4 + n])
        self.twice[slots[self.once[slots]]] = True
        self.once[slots] = True
        self.twice[_decode(pack[4 + n :])] = True

    def bytes(self, twice: bool) -> bytes:
        return np.packbits(self.twice if twice else self.once, bitorder="little").tobytes()


class Seen:
    """A whole filter; ``hits`` says which hashes may be in it."""

    def __init__(self, bits: int, shards: dict[int, bytes], n_shards: int):
        size = bits // 8 // n_shards
        self.bits = bits
        self.table = np.zeros(bits // 8, np.uint8)
        for k, raw in shards.items():
            self.table[k * size : (k + 1) * size] = np.frombuffer(raw, np.uint8)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes & np.uint64(self.bits - 1)
        return (self.table[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sized(docs: DataFrame, text_col: str, bytes_per_bit: int, most: int) -> tuple[int, int]:
    """(bits, shards) of filters over the texts of ``docs``: a power of two in
    proportion to their bytes, between 2^20 and ``most``."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    bits = 1 << 20
    while bits < min(total // bytes_per_bit, most):
        bits *= 2
    return bits, max(1, bits >> 20)


def merge_packs(packs: DataFrame, bits: int, shards: int, twice: bool = True) -> Seen:
    """The twice-seen or the once-seen filter from a DataFrame with PACK_SCHEMA: ``bits`` / 8 bytes,
    whatever the input's size, so it is safe to collect and to broadcast."""
    width = bits // shards

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: dict[int, SeenFilters] = {}
        for b in batches:
            for k, pack in zip(b.column("shard").to_pylist(), b.column("pack").to_pylist()):
                if k not in own:
                    own[k] = SeenFilters(width)
                own[k].add(pack)
        for k, f in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([f.bytes(twice)], pa.binary())], ["shard", "pack"])

    merged = packs.repartition(shards, "shard").mapInArrow(merge, PACK_SCHEMA)
    return Seen(bits, {r["shard"]: r["pack"] for r in merged.collect()}, shards)


def filter_of(rows: DataFrame, bits: int, shards: int) -> Seen:
    """The once-seen filter of the hashes in the one column of ``rows``."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def flush() -> pa.RecordBatch:
            got = list(pack_slots(np.concatenate(held), bits, shards))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([p for _, p in got], pa.binary())], ["shard", "pack"])

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += b.num_rows
            if size >= 1 << 20:
                yield flush()
                size = 0
        if size:
            yield flush()

    return merge_packs(rows.mapInArrow(pack, PACK_SCHEMA), bits, shards, twice=False)


def sifted(docs: DataFrame, key_col: str, known: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` whose key stays, the least one of those with the same key. ``known`` has one row for each
    key: (``key_col``, n: rows that have it, stays).

    Two filters of ``max_bits`` / 8 bytes at most are broadcast, of keys that stay and of keys that go or have several
    rows. A row in only one of them is settled where it is; only rows in both, mostly by chance, are shuffled
    and joined, so the result is exact whatever the filters let through.
    """
    spark, names = docs.sparkSession, docs.columns
    bits = min(1 << 20, max_bits)
    while bits < min(16 * known.count(), max_bits):
        bits *= 2
    shards = max(1, min(64, bits >> 18))
    hashed = F.xxhash64(F.col(key_col))
    stay = spark.sparkContext.broadcast(filter_of(known.filter("stays").select(hashed), bits, shards))
    rest = spark.sparkContext.broadcast(filter_of(known.filter("not stays or n > 1").select(hashed), bits, shards))

    @F.pandas_udf("int")
    def found(h: pd.Series) -> pd.Series:
        h = h.to_numpy().astype(np.int64).view(np.uint64)
        return pd.Series(stay.value.hits(h) + 2 * rest.value.hits(h).astype(np.int32))

    told = docs.withColumn("_limpid_found", found(hashed))
    sure = told.filter("_limpid_found = 1").select(*names)
    each = told.filter("_limpid_found = 3").groupBy(key_col).agg(F.min(F.struct(*names)).alias("_limpid_least"))
    return sure.unionByName(each.join(known.filter("stays"), key_col, "left_semi").select("_limpid_least.*"))
