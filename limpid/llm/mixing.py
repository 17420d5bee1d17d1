"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected so
that the weights meet a target entropy, or no source repeats more often than a limit.
The weights are then realised as block permutations: every source is a stream of seeded permutations
of its documents, an epoch after another and each in an order of its own, and each block of the budget takes its share
of every stream.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limpid.llm.common import drop_staged, staged

GRID = 16  # parts of an interval that one aggregate looks at
SUPER = 4096  # buckets whose sums are added up before the running sum
#: Scripts written without spaces between words; each character counts as a token.
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space, where each character of a script without spaces
    counts by itself; 0 of null. A native estimate: ``mix_sources`` takes exact counts as a column."""
    plain = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    dense = F.regexp_count(text, F.lit(rf"[{_DENSE}]|[^\x20\x09-\x0D{_DENSE}]+"))
    return F.coalesce(F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(dense), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).alias("tokens"), F.count("*").alias("docs"))


def measure(sizes: DataFrame, total: int, budget: float, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, most repetitions) of the weights at each exponent, in one aggregate."""
    aggs = []
    for x in exponents:
        powered = F.pow(F.col("tokens") / total, F.lit(x))
        aggs += [F.sum(powered), F.sum(powered * F.log(powered)), F.max(powered / F.col("tokens"))]
    r = sizes.agg(*aggs).first()
    return [(math.log(r[k]) - r[k + 1] / r[k], r[k + 2] / r[k] * budget) for k in range(0, len(r), 3)]


def bisect_exponent(sizes: DataFrame, budget: float, entropy: float | None = None, repetitions: float | None = None, steps: int = 8) -> float:
    """The exponent in [0, 1] for which the weights' entropy, as a share of that of uniform
    weights, is ``entropy``, and raised from there as far as ``repetitions`` asks.

    Entropy and repetitions both fall as the exponent rises. What cannot be met gives the nearer end: 0 or 1.
    Each of the ``steps`` is one aggregate over the table of sources that cuts the interval into GRID parts; the number of
    sources is not bounded.
    """
    n, total = sizes.agg(F.count("*"), F.sum("tokens")).first()
    if not n or n == 1:
        return 1.0

    def solve(low: float, too_low) -> float:
        high = 1.0
        for step in range(steps):
            points = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            ok = [not too_low(x) for x in measure(sizes, total, budget, points)]
            if ok[0]:
                return low
            k = ok.index(True) if any(ok) else GRID
            low, high = points[k - 1], points[k]
        return high

    at = 0.0
    if entropy is not None:
        at = solve(at, lambda x: x[0] > entropy * math.log(n))
    if repetitions is not None:
        at = solve(at, lambda x: x[1] > repetitions)
    return at


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None,
    entropy: float | None = 0.97, repetitions: float | None = 4.0, budget: int | None = None, block_tokens: int = 1 << 22, bucket_docs: int = 1024, seed: int = 11,
) -> DataFrame:
    """``docs``, each row as often as it was drawn, with five more columns: _tokens, _weight
    (its source's), _epoch (which permutation of the source), _block and _order (position key in the block).

    Tokens are those of ``tokens_col``, or else ``token_count`` of the text. ``budget`` tokens are drawn, as many as the
    input has by default and none if it is 0; a source's stream is cut before the document that would
    start at or beyond its share, so it overshoots by less than one document. Blocks hold about ``block_tokens`` tokens, each
    in the target proportions. A null source is a source of its own; rows without tokens are never drawn
    (null or empty text, white space only); null and repeated ids are rows like others, and equal rows have places of
    their own. An empty table gives an empty result. Input columns with the names of added ones give way to them.

    The rows are written once, with their tokens and numbers; an epoch orders them by a hash of seed, epoch, id and row
    number. A document's place is a prefix sum in three steps: over runs of SUPER buckets, over buckets of about
    ``bucket_docs`` documents of its source and epoch, then within its bucket, so no source meets in one task.
    """
    docs = docs.drop("_tokens", "_weight", "_epoch", "_block", "_order")
    names = docs.columns
    own = [F.col(f"`{c}`") for c in names]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    tokens = F.coalesce(F.col(f"`{tokens_col}`").cast("long"), F.lit(0)) if tokens_col else token_count(F.col(f"`{text_col}`"))
    counted = docs.select(*own, tokens.alias("_tokens"), key.alias("_limpid_source"), F.monotonically_increasing_id().alias("_limpid_row"))
    counted = staged(counted, "tokens").filter("_tokens > 0")
    sizes = staged(source_tokens(counted, "_limpid_source", "_tokens"), "sources")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    if total and budget > 0:
        exponent = bisect_exponent(sizes, budget, entropy, repetitions)
        norm = sizes.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(exponent)))).first()[0]
    else:
        exponent, norm = 1.0, 1.0
    blocks = max(1, budget // block_tokens)
    goals = sizes.select(
        F.col("source").alias("_limpid_source"),
        F.col("tokens").alias("_limpid_size"),
        F.ceil(F.col("docs") / bucket_docs).alias("_limpid_buckets"),
        (F.pow(F.col("tokens") / max(1, total), F.lit(exponent)) / norm).alias("_weight"),
    ).withColumn("_limpid_goal", F.col("_weight") * budget)
    goals = staged(goals.withColumn("_limpid_epochs", F.ceil(F.col("_limpid_goal") / F.col("_limpid_size")).cast("long")).filter("_limpid_epochs > 0"), "goals")
    drop_staged(sizes)
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_limpid_epochs") - 1)).alias("_epoch")
    rank = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_epoch"), F.col(f"`{id_col}`"), F.col("_limpid_row")), 1)
    bucket = F.floor(F.col("_limpid_rank") / F.lit(float(1 << 63)) * F.col("_limpid_buckets")).cast("long")

    def dealt(columns: list) -> DataFrame:
        """Every row once for each epoch of its source, with its rank and its bucket in it."""
        each = counted.join(goals, "_limpid_source").select(*columns, "_tokens", "_limpid_source", "_limpid_row", "_limpid_buckets", epochs)
        return each.withColumn("_limpid_rank", rank).withColumn("_limpid_bucket", bucket).withColumn("_limpid_super", F.floor(F.col("_limpid_bucket") / SUPER).cast("long"))

    stream = ["_limpid_source", "_epoch"]
    sums = dealt([F.col(f"`{id_col}`")]).groupBy(*stream, "_limpid_super", "_limpid_bucket").agg(F.sum("_tokens").alias("_limpid_sum"))
    sums = staged(sums, "bucket-sums")
    before = lambda name, w: F.coalesce(F.sum(name).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row for each SUPER x bucket_docs documents of a source and epoch
    coarse = sums.groupBy(*stream, "_limpid_super").agg(F.sum("_limpid_sum").alias("_limpid_all"))
    coarse = coarse.select(*stream, "_limpid_super", before("_limpid_all", W.partitionBy(*stream).orderBy("_limpid_super")).alias("_limpid_far"))
    fine = sums.withColumn("_limpid_near", before("_limpid_sum", W.partitionBy(*stream, "_limpid_super").orderBy("_limpid_bucket")))
    places = fine.join(coarse, [*stream, "_limpid_super"]).join(goals.select("_limpid_source", "_limpid_size", "_weight", "_limpid_goal"), "_limpid_source")
    start = F.col("_limpid_far") + F.col("_limpid_near") + F.col("_epoch") * F.col("_limpid_size")
    # buckets beyond the goal hold nothing that is drawn
    places = places.select(*stream, "_limpid_bucket", start.alias("_limpid_before"), "_weight", "_limpid_goal").filter("_limpid_before < _limpid_goal")
    places = staged(places, "buckets")
    drop_staged(sums)
    placed = dealt(own).join(places, [*stream, "_limpid_bucket"])
    within = before("_tokens", W.partitionBy(*stream, "_limpid_bucket").orderBy("_limpid_rank", "_limpid_row"))
    drawn = placed.withColumn("_limpid_start", F.col("_limpid_before") + within).filter("_limpid_start < _limpid_goal")
    place = F.col("_limpid_start") / F.col("_limpid_goal")
    block = F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("long")
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("_epoch"), F.col(f"`{id_col}`"), F.col("_limpid_row")), 1)
    return drawn.select(*own, "_tokens", "_weight", "_epoch", block.alias("_block"), order.alias("_order"))
