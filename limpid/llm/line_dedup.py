"""Line deduplication with a once-seen and a twice-seen Bloom filter.

Pass one builds both filters over all line keys. Pass two sends on only the keys that
the twice-seen filter suspects; those alone shuffle, to be confirmed exactly and to
choose the occurrence that stays. Pass three rewrites the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import drop_staged, extended, sliced, staged
from limpid.llm.sketch import PACK_SCHEMA, merge_packs, pack_slots, sized

BLANKS = b" \t\n\v\f\r"
FLUSH = 1 << 18  # hashes of a task held before they are packed


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """For each line its key, or None if the key has under ``min_chars`` code points."""
    keys: list[bytes | None] = []
    for line in text.encode().lower().split(b"\n"):  # bytes.lower: A-Z only
        key = line.strip(BLANKS)
        n = len(key)
        if n < min_chars or n < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars:
            keys.append(None)
        else:
            keys.append(key)
    return keys


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _low(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def document_hashes(text: str, min_chars: int) -> list[bytes]:
    """The distinct key hashes of one document."""
    return [key_hash(k) for k in {k for k in line_keys(text, min_chars) if k is not None}]


def row_key(doc_id: object, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{doc_id}\n{text}".encode())


class Confirmed:
    """Sorted table of confirmed key hashes and the id that keeps each line."""

    def __init__(self, digests: list[bytes], keep: list):
        order = np.argsort(low := _low(digests), kind="stable") if digests else np.zeros(0, np.int64)
        self.low = low[order] if digests else np.zeros(0, np.uint64)
        self.all = np.array([np.frombuffer(d, np.uint64)[1] for d in digests], np.uint64)[order] if digests else self.low
        self.keep = [keep[k] for k in order]

    def dropped(self, digests: list[bytes], doc_id: object) -> set[bytes]:
        if not digests or not len(self.low):
            return set()
        out = set()
        low = _low(digests)
        at = np.searchsorted(self.low, low)
        for k in np.flatnonzero((at < len(self.low)) & (self.low[np.minimum(at, len(self.low) - 1)] == low)):
            high = np.frombuffer(digests[k], np.uint64)[1]
            j = at[k]
            while j < len(self.low) and self.low[j] == low[k]:
                if self.all[j] == high and self.keep[j] is not None and self.keep[j] != doc_id:
                    out.add(digests[k])
                j += 1
        return out


def rewrite(text: str, drop: set[bytes], min_chars: int) -> tuple[str, int, int]:
    """(text without the lines whose key hash is in ``drop``, lines, dropped)."""
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    kept = [x for x, key in zip(lines, line_keys(text, min_chars)) if key is None or key_hash(key) not in drop]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    max_filter_bits: int = 1 << 28,
    broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """``docs``, with the text rewritten, and two more columns _n_lines, _n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased. Keys of ``min_chars`` code points or more that occur in ``min_docs``
    documents or more lose all their lines except in the document with the largest
    id that holds them. Every row counts as a document, repeated ones too; of rows
    with the same largest id each keeps its lines. Ids may be of any type that sorts; null ids are below all others; a
    key that only rows without id hold loses nothing. Null and empty text have one
    empty line and become empty. An empty table gives an empty result. Input columns with the names of added ones give way to them.

    Filters of ``max_filter_bits`` / 8 bytes at most are broadcast; on larger inputs the filter suspects more
    keys, which then shuffle, and the result stays exact. The confirmed keys are
    broadcast if they number ``broadcast_keys`` or fewer (24 bytes each); otherwise
    the keys to drop are joined to the rows that suspects came from.
    """
    import pyarrow as pa

    spark, docs = docs.sparkSession, docs.drop("_n_lines", "_n_dropped")
    id_name, text_name = f"`{id_col}`", f"`{text_col}`"
    id_schema = extended(docs.select(F.col(id_name).alias("i")).schema, "key binary, row binary")
    narrow = docs.select(F.col(id_name).alias("i"), F.coalesce(F.col(text_name), F.lit("")).alias("t"))
    filter_bits, shards = sized(narrow, "t", 4, max_filter_bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            rows = list(pack_slots(_low(held), filter_bits, shards))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["shard", "pack"])

        for b in sliced(batches):
            for t in b.column("t").to_pylist():
                held += document_hashes(t, min_chars)
                if len(held) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    seen = spark.sparkContext.broadcast(merge_packs(narrow.select("t").mapInArrow(pack, PACK_SCHEMA), filter_bits, shards))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, keys, rows = [], [], []
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                found = document_hashes(t, min_chars)
                if found and (hit := seen.value.hits(_low(found))).any():
                    own = [found[k] for k in np.flatnonzero(hit)]
                    keys += own
                    ids += [i] * len(own)
                    rows += [row_key(i, t)] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("i").type), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], ["i", "key", "row"])

    suspects = staged(narrow.mapInArrow(suspect, id_schema), "suspects")
    confirmed = staged(
        suspects.groupBy("key").agg(F.count("*").alias("docs"), F.max("i").alias("keep")).filter(F.col("docs") >= min_docs).select("key", "keep"),
        "confirmed",
    )
    schema = docs.schema
    names = docs.columns
    out_schema = extended(schema, "_n_lines long, _n_dropped long")

    def written(b: pa.RecordBatch, results: list[tuple[str, int, int]]) -> pa.RecordBatch:
        cols = [b.column(k) for k in range(len(names))]
        cols[names.index(text_col)] = pa.array([r[0] for r in results], pa.string())
        counts = [pa.array([r[k] for r in results], pa.int64()) for k in (1, 2)]
        return pa.RecordBatch.from_arrays(cols + counts, [*names, "_n_lines", "_n_dropped"])

    at_id, at_text = names.index(id_col), names.index(text_col)
    if confirmed.count() <= broadcast_keys:
        drop_staged(suspects)
        got = confirmed.toArrow()
        held = spark.sparkContext.broadcast(Confirmed(got.column("key").to_pylist(), got.column("keep").to_pylist()))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                results = []
                for i, t in zip(b.column(at_id).to_pylist(), b.column(at_text).to_pylist()):
                    t = t or ""
                    results.append(rewrite(t, held.value.dropped(document_hashes(t, min_chars), i), min_chars))
                yield written(b, results)

        return docs.mapInArrow(apply, out_schema)

    lost = (
        suspects.join(confirmed, "key")
        .filter(F.col("keep").isNotNull() & ~F.col("i").eqNullSafe(F.col("keep")))
        .groupBy("row")
        .agg(F.collect_set("key").alias("_limpid_drop"))  # at most the lines of one document
    )
    row_of = F.udf(lambda i, t: row_key(i, t or ""), "binary", useArrow=True)
    with_drops = docs.withColumn("_limpid_row", row_of(F.col(id_name), F.col(text_name))).join(
        lost.withColumnRenamed("row", "_limpid_row"), "_limpid_row", "left"
    )

    def apply_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            drops = b.column(len(names)).to_pylist()
            yield written(b, [rewrite(t or "", set(d or ()), min_chars) for t, d in zip(b.column(at_text).to_pylist(), drops)])

    return with_drops.select(*[F.col(f"`{c}`") for c in names], "_limpid_drop").mapInArrow(apply_joined, out_schema)
