"""Jaccard join of documents' word n-grams with a token-group matrix.

Documents are partitioned into groups of similar ones: those whose index prefixes share their
most frequent token. Each group's token union bounds the overlap that a query can have
with any member; a group is opened, and its members compared exactly, only where the
bound reaches the threshold.

Which (query, group) pairs to look at comes from the matrix of tokens and groups over
prefixes: two sets of Jaccard similarity t share a token among the first
n - ceil(t n) + 1 of each under any common order of tokens. The order here puts rare
tokens first, by counts over the whole input, so a passage that very many documents
share yields no pairs unless the documents consist of it.

Documents with equal sets are one class. Only classes are grouped and compared; their links and
components carry over to the copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import drop_staged, short_batches, sliced, staged
from limpid.llm.components import connected_components
from limpid.llm.sketch import PACK_SCHEMA, merge_packs, pack_slots

SPACE = 36  # bits of the hash that counts are kept by
LEVELS = (2, 16, 256)  # documents with a token from which its level is 1, 2, 3
TILE = 256  # members and queries of a comparison task's unit
FLUSH = 1 << 20
WORDS = 150_000

_M = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z is lower-cased. A text of
    fewer words has the whole sequence as one; without words it is empty."""
    words = text.encode().lower().split() if text else []  # bytes: splits at ASCII white space, lowers A-Z
    if not words:
        return np.zeros(0, np.uint64)
    get = _words.get
    h = []
    for w in words:
        x = get(w)
        if x is None:
            x = xxhash.xxh3_64_intdigest(w)
            if len(_words) < WORDS:
                _words[w] = x
        h.append(x)
    h = np.array(h, np.uint64)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = _mix(out * _M + h[j : len(h) - k + 1 + j])
    return np.unique(out)


def set_key(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any of that similarity."""
    return (n * percent + 99) // 100


def _code(x: np.ndarray) -> bytes:
    """Sorted values, as differences, byte plane by byte plane."""
    return zlib.compress(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _decode(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_tokens(tokens: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, pack) of the tokens of many documents: values with their counts."""
    values, counts = np.unique(tokens >> np.uint64(64 - SPACE), return_counts=True)
    bounds = np.searchsorted(values, (np.arange(shards + 1, dtype=np.uint64) << np.uint64(SPACE)) // np.uint64(shards))
    for k in range(shards):
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            many = np.flatnonzero(counts[a:b] > 1).astype(np.uint64)
            parts = (_code(values[a:b]), _code(many), zlib.compress(counts[a:b][many.astype(np.int64)].astype(np.uint32).tobytes(), 1))
            yield k, b"".join(len(p).to_bytes(4, "little") for p in parts) + b"".join(parts)


def unpack(pack: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes = [int.from_bytes(pack[4 * k : 4 * k + 4], "little") for k in range(3)]
    at = np.cumsum([12, *sizes])
    values = _decode(pack[at[0] : at[1]])
    counts = np.ones(len(values), np.int64)
    counts[_decode(pack[at[1] : at[2]]).astype(np.int64)] = np.frombuffer(zlib.decompress(pack[at[2] : at[3]]), np.uint32)
    return values, counts


class Levels:
    """A table of 2-bit levels of how many documents hold a token: a Bloom filter with
    one hash and four states. ``slots`` / 4 bytes, whatever the input's size."""

    def __init__(self, slots: int, shards: dict[int, bytes], n_shards: int):
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        size = slots // 4 // n_shards
        self.table = np.zeros(slots // 4, np.uint8)
        for k, raw in shards.items():
            self.table[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(raw), np.uint8)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        slots = tokens >> self.shift
        return (self.table[(slots >> np.uint64(2)).astype(np.int64)] >> ((slots & np.uint64(3)) * np.uint64(2)).astype(np.uint8)) & 3


def summed(got: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and their counts of several such lists together."""
    values, counts = (np.concatenate([g[j] for g in got]) for j in (0, 1))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts], np.add.reduceat(counts, starts)


def count_levels(packs: DataFrame, slots: int, shards: int) -> Levels:
    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in sliced(batches):
            for k, pack in zip(b.column("shard").to_pylist(), b.column("pack").to_pylist()):
                got = own.setdefault(k, [])
                got.append(unpack(pack))
                if len(got) > 1 and sum(len(v) for v, _ in got[1:]) >= max(FLUSH, len(got[0][0])):
                    own[k] = [summed(got)]  # so that no more than twice a shard's distinct tokens are held
        for k, got in own.items():
            values, total = summed(got)
            level = np.searchsorted(np.array(LEVELS), total, side="right").astype(np.uint8)
            at = (values >> np.uint64(SPACE - slots.bit_length() + 1)).astype(np.int64) - k * (slots // shards)
            dense = np.zeros(slots // shards, np.uint8)
            np.maximum.at(dense, at[level > 0], level[level > 0])
            q = dense.reshape(-1, 4)
            raw = (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(raw, 1)], pa.binary())], ["shard", "pack"])

    merged = packs.repartition(shards, "shard").mapInArrow(merge, PACK_SCHEMA)
    with short_batches(packs.sparkSession):
        return Levels(slots, {r["shard"]: bytes(r["pack"]) for r in merged.collect()}, shards)


def prefix(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Those of the index prefix, rarest first, that another document may hold."""
    n = len(tokens)
    p = n - least_overlap(n, percent) + 1
    order = np.lexsort((tokens, levels))[:p]
    return tokens[order][levels[order] > 0]


class Group:
    """A group's members, with the union of their tokens."""

    def __init__(self, members: list[tuple[bytes, np.ndarray, int]]):
        self.keys = [m[0] for m in members]
        self.size = np.array([len(m[1]) for m in members])
        self.weight = np.array([m[2] for m in members], np.int64)
        flat = np.concatenate([m[1] for m in members])
        owner = np.repeat(np.arange(len(members)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.union, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def links(self, key: bytes, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The members linked with a query. The group stays closed if its union, or its
        members' sizes, rule all of them out."""
        n = len(tokens)
        fits = (100 * self.size >= percent * n) & (100 * n >= percent * self.size)
        if not fits.any():
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.union, tokens)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == tokens]
        # overlap o with a set of s: 100 o >= percent (n + s - o)
        if (100 + percent) * len(at) < percent * (n + self.size[fits].min()):
            return np.zeros(0, np.int64)
        a, b = self.starts[at], self.ends[at]
        span = b - a
        index = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span - a, span)
        shared = np.bincount(self.owner[index], minlength=len(self.size))
        linked = np.flatnonzero(100 * shared >= percent * (n + self.size - shared))
        return np.array([k for k in linked if self.keys[k] != key], np.int64)


def compare(members: list, queries: list, percent: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, bytes]]]:
    """Of one tile: (query, weight of its links), and edges that span the links."""
    group, parent = Group(members), {}

    def find(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    counts, edges = [], []
    for key, tokens in queries:
        if len(found := group.links(key, tokens, percent)):
            counts.append((key, int(group.weight[found].sum())))
            for k in found:
                if (a := find(key)) != (b := find(group.keys[k])):
                    parent[max(a, b)] = min(a, b)
                    edges.append((key, group.keys[k]))
    return counts, edges


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, max_slots: int = 1 << 27) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, n_links).

    A document's set holds its distinct ``shingle``-word n-grams. Two documents link when
    100 * intersection >= ``percent`` * union, in exact arithmetic on 64-bit hashes.
    component_id is the smallest id reachable over links, the document's own included;
    n_links counts the other documents linked with it, copies included. Null and empty texts and those
    without words have no shingle, no link and their own id. Null ids are carried through; they never
    become a component's id unless all ids in it are null. Repeated rows are copies of
    one another. An empty table gives an empty result; other columns are not read.

    The table of token levels has ``max_slots`` / 4 bytes (32 MB) at most. On larger
    inputs it tells frequent tokens less sharply; the result stays exact.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    total = narrow.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slots = 1 << 20
    while slots < min(total // 4, max_slots):
        slots *= 2
    shards = 8
    while shards < min(total >> 24, slots >> 10):
        shards *= 2

    # Pass one: each document's class, and all tokens, packed, to count documents by token.

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ["i", "n", "key", "row", "shard", "pack"]

        def flush(ids: pa.DataType) -> pa.RecordBatch:
            rows = list(pack_tokens(np.concatenate(held), shards))
            held.clear()
            none = [pa.nulls(len(rows), ids), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names)

        ids = None
        for b in sliced(batches):
            ids = b.column("i").type
            n, keys, hashes = [], [], []
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                s = shingle_set(t, shingle)
                hashes.append(row_hash(i, t))
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                held.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield flush(ids)
                    size = 0
            r = len(n)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(hashes, pa.int64()), pa.nulls(r, pa.int32()), pa.nulls(r, pa.binary())], names)
        if size:
            yield flush(ids)

    both = staged(narrow.mapInArrow(first, f"i {kind}, n long, key binary, row long, shard int, pack binary"), "sets")
    levels = spark.sparkContext.broadcast(count_levels(both.filter("shard is not null").select("shard", "pack"), slots, shards))
    members = staged(both.filter("shard is null").select("i", "n", "key", "row"), "documents")
    drop_staged(both)

    # Pass two: index prefixes, without the tokens that one document holds alone.
    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            toks, keys, sizes = [], [], []
            for t in b.column("t").to_pylist():
                if len(s := shingle_set(t, shingle)):
                    own = prefix(s, levels.value.of(s), percent)
                    toks.append(own)
                    keys += [set_key(s)] * len(own)
                    sizes += [len(s)] * len(own)
            flat = np.concatenate(toks) if toks else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64), pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], ["tok", "key", "n"])

    index = staged(narrow.select("t").mapInArrow(second, "tok long, key binary, n long").distinct(), "index")
    levels.destroy()  # the index is written
    shared = staged(index.groupBy("tok").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    postings = staged(index.join(shared, "tok"), "postings")
    drop_staged(index, shared)

    # Groups: each class goes with the most frequent token of its prefix, TILE of them to a group.
    home = postings.groupBy("key").agg(F.max_by("tok", F.struct("m", "tok")).alias("g"))
    parts = home.groupBy("g").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    home = staged(home.join(parts, "g").select("key", "g", F.pmod(F.xxhash64("key"), "parts").alias("part")), "groups")
    matrix = (
        postings.join(home, "key")
        .groupBy("tok", "g", "part")
        .agg(F.count("*").alias("holders"), F.min("key").alias("holder"), F.min("n").alias("small"), F.max("n").alias("large"))
    )
    matrix = staged(matrix, "matrix")
    alone = (F.col("holders") == 1) & (F.col("holder") == F.col("key"))
    sizes_meet = (F.col("n") * percent <= F.col("large") * 100) & (F.col("small") * percent <= F.col("n") * 100)
    pairs = staged(postings.join(matrix, "tok").filter(~alone & sizes_meet).select("key", "g", "part").distinct(), "pairs")
    drop_staged(postings, matrix)
    chunks = pairs.groupBy("g", "part").agg(F.ceil(F.count("*") / TILE).alias("chunks"))
    queries = pairs.join(chunks, ["g", "part"]).select("key", "g", "part", F.pmod(F.xxhash64("key", F.lit(1)), "chunks").alias("chunk"), F.lit(2).alias("role"))
    stock = home.join(chunks, ["g", "part"]).select("key", "g", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"))
    # a class that is member and query of one tile goes there once
    roles = queries.unionByName(stock).groupBy("g", "part", "chunk", "key").agg(F.sum("role").alias("role"))
    classes = members.filter("key is not null").groupBy("key").agg(
        F.min("i").alias("least"), F.count("*").alias("copies"), F.min("row").alias("row")
    )
    classes = staged(classes, "classes")
    roles = staged(roles.join(classes.select("key", "copies"), "key"), "roles")
    drop_staged(pairs, home)

    # Pass three: whole sets, only of the classes compared and from one document each.
    wanted = staged(roles.select("key").distinct().join(classes, "key").select("row"), "wanted")
    bits = 1 << 20
    while bits < min(16 * wanted.count(), 1 << 28):
        bits *= 2
    n_shards = max(1, min(64, bits >> 18))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            h = b.column("row").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows = list(pack_slots(h, bits, n_shards))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["shard", "pack"])

    chosen = spark.sparkContext.broadcast(merge_packs(wanted.mapInArrow(pack, PACK_SCHEMA), bits, n_shards, twice=False))

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keys, sets = [], []
            texts = b.column("t").to_pylist()
            rows = [row_hash(i, t) for i, t in zip(b.column("i").to_pylist(), texts)]
            for k in np.flatnonzero(chosen.value.hits(np.array(rows, np.int64).view(np.uint64))):
                if len(s := shingle_set(texts[k], shingle)):
                    keys.append(set_key(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])

    sets = staged(narrow.mapInArrow(third, "key binary, set binary"), "whole-sets")
    chosen.destroy()
    drop_staged(wanted)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, own, asked = None, None, [], []

        def done() -> pa.RecordBatch:
            counts, edges = compare(own, asked, percent) if own and asked else ([], [])
            a = [c[0] for c in counts] + [e[0] for e in edges]
            b = [None] * len(counts) + [e[1] for e in edges]
            n = [c[1] for c in counts] + [None] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for batch in sliced(batches):
            cols = [batch.column(c).to_pylist() for c in ("g", "part", "chunk", "role", "key", "set", "copies")]
            for g, part, chunk, role, key, raw, copies in zip(*cols):
                if now != (g, part, chunk):
                    if now:
                        yield done()
                    now, last, own, asked = (g, part, chunk), None, [], []
                if key == last:
                    continue  # a repeated row
                last, tokens = key, np.frombuffer(raw, np.uint64)
                if role & 2:
                    asked.append((key, tokens))
                if role & 1:
                    own.append((key, tokens, copies))
        if now:
            yield done()

    laid = roles.join(sets, "key").repartition("g", "part", "chunk").sortWithinPartitions("g", "part", "chunk", "key")
    found = staged(laid.select("g", "part", "chunk", "role", "key", "set", "copies").mapInArrow(tiles, "a binary, b binary, n long"), "links")
    drop_staged(roles, sets)
    labels = connected_components(found.filter("b is not null").select("a", "b"))
    degrees = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("linked"))

    least = labels.join(classes, F.col("node") == F.col("key")).groupBy("root").agg(F.min("least").alias("component"))
    labels = labels.join(least, "root").select(F.col("node").alias("key"), "component")
    info = (
        classes.join(labels, "key", "left")
        .filter("copies > 1 or component is not null")
        .join(degrees.withColumnRenamed("a", "key"), "key", "left")
        .select("key", F.coalesce("component", "least").alias("component"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"))
    )
    info = staged(info, "components")  # a plain scan on each side lets a skewed join be split
    drop_staged(found, classes)
    return members.join(info, "key", "left").select(
        F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "i").alias("component_id"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_links")
    )


def row_hash(doc_id: object, text: str | None) -> int:
    h = xxhash.xxh3_64_intdigest((text or "").encode(), seed=xxhash.xxh3_64_intdigest(repr(doc_id)))
    return h - (1 << 64) if h >> 63 else h
