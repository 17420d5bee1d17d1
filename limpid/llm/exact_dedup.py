"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts the hashes that fall on each slot of a one-hash Bloom filter and
keeps the slots hit twice as a bitmap. Pass two probes every row against that bitmap:
a hash on a slot hit once is certainly unique and its row passes straight through;
only the rows left over, possibly repeated, shuffle to be grouped exactly.

The bitmap is broadcast, so its size is bounded. Input that would fill it is written in ranges of the hash, each of
which has a filter and both passes of its own, so that it never fills up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from functools import reduce

from limpid.llm.common import staged

BITMAP_BITS = 32768  # bits of one value of bitmap_construct_agg
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does so, far faster, where all is ASCII."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def filter_bits(rows: int, bits_per_row: int, most: int) -> int:
    bits = BITMAP_BITS
    while bits < min(rows * bits_per_row, most):
        bits *= 2
    return bits


def ranges_of(rows: int, bits: int, least: int = 4) -> int:
    """How many ranges give each row ``least`` bits of a filter."""
    return max(1, -(-rows * least // bits))


def _range(digest: Column, n: int) -> Column:
    """The range of a hash, from other bits than its slot."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(digest), 40), F.lit(n)).cast("int")


def _slot(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def twice_seen(hashed: DataFrame, bits: int, digest: str = "text_sha256") -> DataFrame:
    """Pass one: rows (bucket, bitmap) of the slots that two rows or more fall on.

    The slots are pre-aggregated before they shuffle, so a hash that a third of
    all rows share arrives once from each task.
    """
    slots = hashed.select(_slot(F.col(digest), bits).alias("slot")).groupBy("slot").agg(F.count("*").alias("hits"))
    return (
        slots.filter("hits > 1")
        .groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.expr(f"slot % {BITMAP_BITS}")).alias("bitmap"))
    )


def mark_suspects(hashed: DataFrame, bitmaps: DataFrame, bits: int, digest: str = "text_sha256") -> DataFrame:
    """Pass two: adds ``suspect``. The bitmaps hold ``bits`` / 8 bytes at most."""
    byte = "cast(conv(hex(substring(bitmap, cast(_slot % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast(_slot % 8 as int)) & 1 = 1")
    return (
        hashed.withColumn("_slot", _slot(F.col(digest), bits))
        .join(
            F.broadcast(bitmaps.withColumnRenamed("bucket", "_bucket")),
            F.expr(f"_slot div {BITMAP_BITS}") == F.col("_bucket"),
            "left",
        )
        .withColumn("suspect", F.coalesce(bit, F.lit(False)))
        .drop("_slot", "_bucket", "bitmap")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 29,
) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row
    with the largest id stays; rows that tie on it (repeated rows) leave exactly
    one. A null text counts as empty; a null id is smaller than any other, and
    keep_id is null where all ids of the group are. An empty table gives an empty
    result; other columns, whatever their names, are not read.

    A filter has ``bits_per_row`` bits a row and ``max_filter_bits`` (64 MB) at most, which bounds what is
    broadcast at a time. Beyond four bits a row less than that, hashes go in ranges, one after another.
    """
    rows = docs.count()
    bits = filter_bits(rows, bits_per_row, max_filter_bits)
    n = ranges_of(rows, bits)
    hashed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(F.col(f"`{text_col}`")).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
    hashed = staged(hashed.withColumn("_part", _range(F.col("text_sha256"), n)), "hashes", "_part") if n > 1 else staged(hashed, "hashes")
    parts = [hashed.filter(F.col("_part") == k).drop("_part") for k in range(n)] if n > 1 else [hashed]
    return reduce(DataFrame.unionByName, (_exact(part, bits) for part in parts)).withColumnRenamed("doc_id", id_col)


def _exact(hashed: DataFrame, bits: int) -> DataFrame:
    """Both passes over the rows of one range."""
    bitmaps = staged(twice_seen(hashed, bits), "bloom")
    marked = mark_suspects(hashed, bitmaps, bits)
    suspects = marked.filter("suspect")
    groups = suspects.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "_row")).alias("_best"), F.count("*").alias("group_size")
    )
    groups = staged(groups, "groups")  # a plain scan on each side lets a skewed join be split
    repeated = suspects.join(groups, "text_sha256").select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
    )
    unique = marked.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return unique.unionByName(repeated)


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bits: int = 1 << 29
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps. They are written once, with their numbers, so that what is
    kept can be told by number."""
    rows = staged(docs.withColumn("_limpid_row", F.monotonically_increasing_id()), "rows")
    chosen = exact_dedup(rows.select(F.struct(f"`{id_col}`", "_limpid_row").alias("i"), F.col(f"`{text_col}`").alias("t")), "i", "t", bits_per_row, max_filter_bits)
    gone = chosen.filter("not kept").select(F.col("i._limpid_row").alias("_limpid_row"))
    return rows.join(gone, "_limpid_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
