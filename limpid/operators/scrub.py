"""Scrubbing: what is found is redacted, masked, hashed, tokenised, cut or dropped."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions import detect as D
from limpid.functions.text import DEFAULT_TOKEN_KEY

ACTIONS = ("keep", "redact", "replace", "mask", "hash", "hmac", "tokenize", "truncate", "drop")
MOST_FINDINGS = 5000
TOO_MANY = "[REDACTED]"  # stands for a whole text with more findings than that
RESULT = f"struct<text:string,findings:array<{D.FINDING}>,redactedCount:int>"


@dataclass(frozen=True)
class Action:
    """How one type is scrubbed. What is None comes from the policy's default action, then from ``BUILT_IN``."""

    action: str | None = None
    placeholder: str | None = None
    mask_char: str | None = None
    preserve_start: int | None = None
    preserve_end: int | None = None
    preserve_length: bool | None = None
    algorithm: str | None = None
    hash_length: int | None = None
    key: str | None = None  # of hmac
    hmac_length: int | None = None  # of hmac and of tokens
    token_prefix: str | None = None
    token_key: str | None = None
    max_length: int | None = None
    suffix: str | None = None
    level: str | None = None  # of detection; not inherited
    enabled: bool | None = None  # None: as the type is by default; not inherited


#: What an action is where nothing else is said.
BUILT_IN = Action(
    action="redact", placeholder="[REDACTED]", mask_char="*", preserve_start=0, preserve_end=0, preserve_length=True, algorithm="sha256", hash_length=12,
    hmac_length=12, token_prefix="tok_", token_key=DEFAULT_TOKEN_KEY, max_length=4, suffix="…",
)
_OWN = ("level", "enabled")


def inherit(*chain: Action) -> Action:
    """Each option from the first action of ``chain`` that says it; level and enabled from the first alone."""
    names = [f.name for f in fields(Action) if f.name not in _OWN]
    said = {n: next((v for a in chain if (v := getattr(a, n)) is not None), None) for n in names}
    return replace(chain[0], **said)


@dataclass(frozen=True)
class ScrubPolicy:
    level: str = "balanced"
    default: Action = field(default_factory=Action)
    types: dict[str, Action] = field(default_factory=dict)
    pii: bool = True
    secrets: bool = True
    max_length: int = 1_000_000  # characters that are searched at a time
    utf16: bool = False  # offsets of findings in UTF-16 units

    def __post_init__(self):
        for a in (BUILT_IN, self.default, *self.types.values()):
            own = inherit(a, self.default, BUILT_IN)
            if own.action not in ACTIONS:
                raise ValueError(f"unknown action {own.action!r}")
            if own.action == "hmac" and not own.key:
                raise ValueError("hmac needs a key")

    def of(self, kind: str) -> Action:
        """The action of a type with all its options."""
        return inherit(self.types[kind], self.default, BUILT_IN) if kind in self.types else inherit(self.default, BUILT_IN)

    def what(self) -> D.Detect:
        """The enabled types with their levels; nothing if all of them are kept as they are."""
        kinds = (D.PII_TYPES if self.pii else ()) + (D.SECRET_TYPES if self.secrets else ())
        own = {k: self.types.get(k, Action()) for k in kinds}
        on = [k for k in kinds if (k not in D.OPT_IN if own[k].enabled is None else own[k].enabled)]
        if all(self.of(k).action == "keep" for k in on):
            on = []
        return D.Detect(tuple((k, own[k].level or self.level) for k in on), self.max_length, self.utf16)

    def trigger(self) -> str:
        """A Java pattern that every text matches in which something is to be scrubbed."""
        return D.trigger(D.Detect(tuple(x for x in self.what().levels if self.of(x[0]).action != "keep")))


def apply_action(value: str, a: Action) -> str:
    if a.action == "keep":
        return value
    if a.action in ("redact", "replace"):
        return a.placeholder
    if a.action == "mask":
        n, s, e = len(value), a.preserve_start, a.preserve_end
        return value if s + e >= n else value[:s] + a.mask_char * (n - s - e) + value[n - e :] if a.preserve_length else a.mask_char * 8
    if a.action == "hash":
        return hashlib.new(a.algorithm, value.encode()).hexdigest()[: a.hash_length]
    if a.action == "hmac":
        return hmac.new(a.key.encode(), value.encode(), a.algorithm).hexdigest()[: a.hmac_length]
    if a.action == "tokenize":
        return a.token_prefix + hmac.new(a.token_key.encode(), value.encode(), "sha256").hexdigest()[: a.hmac_length]
    if a.action == "truncate":
        return value if len(value) <= a.max_length else value[: a.max_length] + a.suffix
    return ""


def compile_scrubber(policy: ScrubPolicy) -> Callable[[str], tuple[str, list[D.Finding], int]]:
    """(text, findings, how many were not kept) of one Python string; actions are resolved here, once."""
    what = policy.what()
    actions = {kind: policy.of(kind) for kind, _ in what.levels}
    plain = replace(what, utf16=False)

    def run(text: str) -> tuple[str, list[D.Finding], int]:
        found = D.find(text, plain)
        redacted = sum(actions[f[0]].action != "keep" for f in found)
        shown = D.utf16_offsets(text, found) if policy.utf16 else found
        if len(found) > MOST_FINDINGS:
            return TOO_MANY, shown, redacted
        out, at = [], 0
        for kind, a, b, _ in found:
            out += [text[at:a], apply_action(text[a:b], actions[kind])]
            at = b
        return "".join(out) + text[at:], shown, redacted

    return run


def scrub_text(text: str, policy: ScrubPolicy) -> tuple[str, list[D.Finding], int]:
    return compile_scrubber(policy)(text)


def scrub(col: Column, policy: ScrubPolicy = ScrubPolicy()) -> Column:
    """The scrubbed text. Rows without a trigger stay in the JVM."""
    if not policy.what().levels:
        return col
    one = compile_scrubber(policy)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else one(x)[0] for x in s], dtype=object)

    return F.coalesce(run.asNondeterministic()(F.when(col.rlike(policy.trigger()), col)), col)


def scrub_detailed(col: Column, policy: ScrubPolicy = ScrubPolicy()) -> Column:
    """STRUCT<text, findings, redactedCount>. Rows without a trigger stay in the JVM."""
    one = compile_scrubber(policy)
    names = ("type", "start", "end", "confidence")

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [("", [], 0) if x is None else one(x) for x in s]
        return pd.DataFrame({"text": [r[0] for r in rows], "findings": [[dict(zip(names, f)) for f in r[1]] for r in rows], "redactedCount": [r[2] for r in rows]})

    clean = F.struct(col.alias("text"), F.array().cast(f"array<{D.FINDING}>").alias("findings"), F.lit(0).alias("redactedCount"))
    if not policy.what().levels:
        return F.when(col.isNotNull(), clean)
    hit = col.rlike(policy.trigger())
    found = run.asNondeterministic()(F.when(hit, col))
    return F.when(hit, found).when(col.isNotNull(), clean)


scrub_pii = scrub_secrets = scrub


def detect_all(col: Column, policy: ScrubPolicy = ScrubPolicy()) -> Column:
    return D.detect(col, policy.what(), policy.trigger())


def findings_report(df: DataFrame, column: str, policy: ScrubPolicy = ScrubPolicy()) -> DataFrame:
    """(type, findings, rows): how often each type was found."""
    kinds = detect_all(F.col(f"`{column}`"), policy)["type"]
    each = df.select(kinds.alias("kinds")).select(F.explode(F.array_distinct("kinds")).alias("type"), "kinds")
    counted = each.select("type", F.size(F.filter("kinds", lambda k: k == F.col("type"))).cast("long").alias("n"))
    return counted.groupBy("type").agg(F.sum("n").alias("findings"), F.count("*").alias("rows"))
