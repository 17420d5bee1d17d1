"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 512  # rows that a Python worker turns into Python objects at a time


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own, which is
    then set so that later calls agree on it; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="limpid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets Arrow batches of ``SLICE`` rows at most: both the JVM, outside its heap,
    and the Python worker hold a batch whole. The session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) < SLICE:
        spark.conf.set(name, str(SLICE))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in folders ``by`` a column if one is named, and read it back.

    Cuts the lineage: a lost executor costs no more than rereading the files.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/limpid/{uuid.uuid4().hex}-{tag}"
    with short_batches(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._limpid_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables made by ``staged`` once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._limpid_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator, rows: int = SLICE) -> Iterator:
    """Arrow batches cut into runs of ``rows`` rows, to bound a worker's memory."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def extended(schema: T.StructType, added: str) -> T.StructType:
    """A schema with the columns of the DDL text ``added`` behind it; all may be null."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*schema, *T._parse_datatype_string(added)]])


def bounded_sample(rows: DataFrame, label: Column, ident: Column, text: Column, per_label: int, bytes_per_label: int, max_labels: int) -> dict[object, list[str]]:
    """Of each label some whole texts, lowest hash of ident and text first: ``per_label`` at most, and no
    more once they have ``bytes_per_label`` bytes; longer texts are not taken.

    What comes to the driver is bounded by the arguments, whatever the input: rows of equal ident and text count
    once, a null ident is like any other. Rows without label or text are left out; more than ``max_labels``
    labels raise ValueError. The order of texts is that of the hashes.
    """
    known = rows.select(label.alias("label"), F.xxhash64(ident.cast("string"), text).alias("order"), text.alias("text"))
    known = known.filter(F.col("label").isNotNull() & (F.octet_length("text") <= bytes_per_label))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.approx_count_distinct("order").alias("n")).limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, int(min(1.0, (2 * per_label + 20) / max(1, v)) * (1 << 30)))])
    near = known.withColumn("place", F.pmod("order", F.lit(1 << 30))).filter(F.col("place") <= share[F.col("label")])
    first = W.partitionBy("label").orderBy("place", "order")  # over some 2 per_label rows a label
    sizes = near.select("label", "place", "order", F.octet_length("text").alias("size")).distinct()
    ranked = sizes.select("label", "order", F.row_number().over(first).alias("n"), F.coalesce(F.sum("size").over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    chosen = ranked.filter((F.col("n") <= per_label) & (F.col("before") < bytes_per_label))
    taken = near.join(F.broadcast(chosen.select("label", "order", "n")), ["label", "order"]).groupBy("label", "n").agg(F.min("text").alias("text")).collect()
    out: dict[object, list[str]] = {k: [] for k in counts}
    for r in sorted(taken, key=lambda r: r["n"]):
        out[r["label"]].append(r["text"])
    return out
