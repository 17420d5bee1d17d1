"""What the query catalogues share: tables, the shared folder, and the sanitiser as SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from limpid.functions import charsets as C

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, dealt out anew if its files make fewer tasks than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share. Without that setting
    only a local session gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set")
        root = "file://" + tempfile.mkdtemp(prefix=f"{name}-")
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def clean_sql(text: str = "text", most: int | None = None, collapse: bool = True, trim: bool = True) -> str:
    """The default sanitiser in SQL; without ``collapse`` the end is trimmed last, after ``most`` characters."""
    x = f"regexp_replace({text}, '^[{C.WS}]+', '')" if trim else text
    if collapse:
        x = f"regexp_replace(regexp_replace({x}, '[{C.WS}]+$', ''), '[{C.WS}]+', ' ', 'g')"
    x = f"regexp_replace({x}, '[{C.CONTROLS}{C.INVISIBLE}]', '', 'g')"
    x = f"substr({x}, 1, {most})" if most else x
    return f"regexp_replace({x}, '[{C.WS}]+$', '')" if trim and not collapse else x
