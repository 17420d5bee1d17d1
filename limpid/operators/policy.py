"""Policies: sanitise, case, coerce, scrub, truncate, compiled once into a Column; and profiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from limpid.functions import normalize as N
from limpid.functions import text as T
from limpid.operators.scrub import Action, ScrubPolicy, scrub
from limpid.operators.validate import Field, validate_value, valid


@dataclass(frozen=True)
class Truncate:
    """A text of more than ``max_length`` characters is cut and gets the suffix beyond them; with
    ``by_bytes`` its UTF-8 bytes count, and the suffix is inside."""

    max_length: int = 8
    suffix: str = "…"
    by_bytes: bool = False


@dataclass(frozen=True)
class Policy:
    """None turns a stage off; sanitising and scrubbing are on by default. ``validate`` is what a value
    must be; it is checked by ``validate_text`` and never by processing."""

    sanitize: T.Sanitize | None = T.Sanitize()
    case: str | None = None
    coerce: str | None = None  # integer, float, boolean, date, phone, uuid, string
    scrub: ScrubPolicy | None = ScrubPolicy()
    truncate: Truncate | None = None
    validate: Field | None = None


COERCIONS: dict[str, Callable[[Column], Column]] = {
    "integer": lambda c: N.to_integer(c).cast("string"),
    "float": lambda c: N.number_to_string(N.to_float(c)),
    "boolean": lambda c: N.to_boolean(c, "string"),
    "date": N.normalize_date,
    "phone": N.normalize_phone,
    "uuid": N.normalize_uuid,
    "string": lambda c: F.lit(None).cast("string"),  # a text is one already
}


def compile_policy(p: Policy) -> Callable[[Column], Column]:
    """A Column function; stages that are off add nothing to the plan. What can't be coerced stays text."""
    stages: list[Callable[[Column], Column]] = []
    if p.sanitize:
        stages.append(lambda c: T.sanitize(c, p.sanitize))
    if p.case:
        stages.append(lambda c: N.normalize_case(c, p.case))
    if p.coerce and p.coerce != "string":
        stages.append(lambda c: F.coalesce(COERCIONS[p.coerce](c), c))
    if p.scrub:
        stages.append(lambda c: scrub(c, p.scrub))
    if p.truncate:
        stages.append(lambda c: T.truncate(c, p.truncate.max_length, p.truncate.suffix, p.truncate.by_bytes))
    return T.pipe(*stages)


def process_text(col: Column, p: Policy = Policy()) -> Column:
    return compile_policy(p)(col)


def validate_text(col: Column, p: Policy, kind: S.DataType = S.StringType()) -> Column:
    """STRUCT<ok, issues> of a value by the policy's field; all is well without one."""
    return valid() if p.validate is None else validate_value(col, kind, p.validate)


def merge(base: Policy, **changes) -> Policy:
    """A policy with some parts replaced. Of ``sanitize`` and ``scrub`` a dict replaces single options;
    scrub types are merged one by one."""
    for name in ("sanitize", "scrub"):
        new, old = changes.get(name), getattr(base, name)
        if name == "scrub" and old is not None and new is not None:
            own = new if isinstance(new, dict) else new.__dict__
            new = {**own, "types": {**old.types, **own.get("types", {})}} if isinstance(new, dict) else replace(new, types={**old.types, **new.types})
        if isinstance(new, dict):
            new = replace(old, **new) if old is not None else (T.Sanitize if name == "sanitize" else ScrubPolicy)(**new)
        if name in changes:
            changes[name] = new
    return replace(base, **changes)


#: The ready-made profiles.
PROFILES: dict[str, Policy] = {
    "identifier": Policy(T.Sanitize(collapse="", form="NFKC", max_chars=128), "lower", scrub=None, validate=Field("string", min_length=1, max_length=128, pattern=r"^[a-z0-9][a-z0-9_-]*\z")),
    "email": Policy(T.Sanitize(collapse=None, form="NFC", max_chars=254), "lower", scrub=None, validate=Field("string", format="email", max_length=254)),
    "phone": Policy(T.Sanitize(max_chars=40), coerce="phone", scrub=None, validate=Field("string", format="phone")),
    "numeric": Policy(T.Sanitize(collapse=None, max_chars=64), coerce="float", scrub=None, validate=Field("string", max_length=64)),
    "url": Policy(T.Sanitize(collapse=None, max_chars=2048), scrub=None, validate=Field("string", format="url", max_length=2048)),
    "humanName": Policy(T.Sanitize(form="NFC", max_chars=100), scrub=None, validate=Field("string", min_length=1, max_length=100)),
    "freeText": Policy(T.Sanitize(form="NFC", max_chars=10_000)),
    "logData": Policy(T.Sanitize(trim="none", collapse=None, max_chars=100_000)),
    "llmInput": Policy(T.Sanitize(form="NFC", max_chars=50_000)),
    "analytics": Policy(T.Sanitize(form="NFC", max_chars=10_000), scrub=ScrubPolicy(default=Action("hash", hash_length=16))),
}
