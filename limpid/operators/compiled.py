"""A policy with all its faces: text, records, JSON, validation, detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from limpid.functions import detect as D
from limpid.operators.policy import Policy, compile_policy, validate_text
from limpid.operators.scrub import detect_all
from limpid.operators.structured import Structured, process_json, walk


@dataclass(frozen=True)
class CompiledPolicy:
    """Without ``structured``, JSON is written anew with no rule and so not scrubbed."""

    policy: Policy = Policy()
    structured: Structured | None = None

    def process(self, col: Column) -> Column:
        return compile_policy(self.policy)(col)

    def process_value(self, df: DataFrame) -> DataFrame:
        """Text columns by the policy, structs, arrays and maps by ``structured``, where a column's
        own fields are the top level; the rest as they are."""
        cols = {}
        for f in df.schema:
            col = F.col(f"`{f.name}`")
            if isinstance(f.dataType, S.StringType):
                cols[f.name] = self.process(col)
            elif self.structured and isinstance(f.dataType, (S.StructType, S.ArrayType, S.MapType)):
                cols[f.name] = walk(col, f.dataType, self.structured)
            else:
                cols[f.name] = col
        return df.select(*[c.alias(n) for n, c in cols.items() if c is not None])

    def process_json(self, col: Column, permissive: bool = True) -> Column:
        return process_json(col, self.structured or Structured(), permissive)

    def validate(self, col: Column, kind: S.DataType = S.StringType()) -> Column:
        """STRUCT<ok, issues> of one value; all is well if the policy has no field."""
        return validate_text(col, self.policy, kind)

    def detect(self, col: Column) -> Column:
        """Findings; none if the policy doesn't scrub."""
        if self.policy.scrub is None:
            return F.array().cast(f"array<{D.FINDING}>")
        return detect_all(col, self.policy.scrub)
