"""Sources and sinks: file readers and writers, and CSV and key/value text inside a column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    reader = spark.read.options(**({"header": True, "multiLine": True, "quote": '"', "escape": '"'} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.options(**({"header": True, "quote": '"', "escape": '"'} if kind == "csv" else {}) | options).mode(mode).format(kind).save(path)


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of cells. A quote anywhere toggles quoting, two inside quotes are one; LF, CR
    and CRLF end a row; a final line end adds no row."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter has one character")
    rows, row, cell, quoted, at = [], [], [], False, 0
    token = re.compile(rf'"|\r\n|\r|\n|{re.escape(delimiter)}')
    while at < len(text):
        m = token.search(text, at)
        cell.append(text[at : m.start() if m else len(text)])
        if not m:
            at = len(text)
            break
        at = m.end()
        if m[0] == '"':
            if quoted and text[at : at + 1] == '"':
                cell.append('"')
                at += 1
            else:
                quoted = not quoted
        elif quoted:
            cell.append(m[0])
        else:
            row.append("".join(cell))
            cell = []
            if m[0] != delimiter:
                rows.append(row)
                row = []
    if quoted:
        raise ValueError("invalid-csv")
    if row or any(cell):
        rows.append([*row, "".join(cell)])
    return rows


def stringify_csv(rows: list[list[str]], delimiter: str = ",") -> str:
    return "\n".join(delimiter.join(f'"{c.replace(chr(34), chr(34) * 2)}"' if re.search(rf'["\r\n{re.escape(delimiter)}]', c) else c for c in r) for r in rows)


def csv_cell(col: Column, delimiter: str = ",") -> Column:
    """One cell, quoted if it has to be."""
    return F.when(col.rlike(f'["\\r\\n\\x{{{ord(delimiter):X}}}]'), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(col)


def csv_row(cols: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[F.coalesce(csv_cell(c, delimiter), F.lit("")) for c in cols])


def parse_csv_column(col: Column, delimiter: str = ",") -> Column:
    """ARRAY<ARRAY<STRING>> of CSV text; null if its quotes don't close."""
    from limpid.functions.text import per_text

    def run(s: str) -> list[list[str]] | None:
        try:
            return parse_csv(s, delimiter)
        except ValueError:
            return None

    return per_text(run, "array<array<string>>")(col)


def kv_entries(col: Column, separator: str = " ", equals: str = "=") -> Column:
    """ARRAY<STRUCT<k, v>> in order, repeats kept; an entry without ``equals`` has a null value."""
    sep = "".join(f"\\x{{{ord(c):X}}}" for c in separator)

    def entry(e: Column) -> Column:
        at = F.locate(equals, e)
        return F.struct(F.when(at > 0, F.substring(e, F.lit(1), at - 1)).otherwise(e).alias("k"), F.when(at > 0, F.substring(e, at + len(equals), F.length(e))).alias("v"))

    return F.transform(F.split(col, sep), entry)


def kv_text(entries: Column, separator: str = " ", equals: str = "=") -> Column:
    return F.array_join(F.transform(entries, lambda e: F.when(e["v"].isNull(), e["k"]).otherwise(F.concat(e["k"], F.lit(equals), e["v"]))), separator)


def kv_drop(col: Column, keys: list[str], separator: str = " ", equals: str = "=") -> Column:
    """Key/value text without the entries of some keys."""
    return kv_text(F.filter(kv_entries(col, separator, equals), lambda e: e["v"].isNull() | ~e["k"].isin(*keys)), separator, equals)
