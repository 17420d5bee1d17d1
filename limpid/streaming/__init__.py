"""Policies over Structured Streaming: stateless projections, so batch code runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from limpid.functions.text import vault
from limpid.operators.policy import Policy, compile_policy


def apply_policy(df: DataFrame, columns: dict[str, Policy]) -> DataFrame:
    """The named columns processed; batch or streaming."""
    return df.withColumns({c: compile_policy(p)(F.col(f"`{c}`")) for c, p in columns.items()})


def vault_sink(df: DataFrame, column: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Keeps a token table up to date: of each batch only values not yet in it are added."""

    def add(batch: DataFrame, _: int) -> None:
        new = vault(batch, column, **options)
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            new = new.join(spark.read.schema(new.schema).parquet(path), "token", "left_anti")
        new.write.mode("append").parquet(path)

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
