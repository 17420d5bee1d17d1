"""Field rules over structs, JSON, CSV and key/value records.

With a known schema the rule of every leaf is found once, on the driver, and becomes part of
one projection. Keys of maps choose among the rules row by row, natively for maps of text. Arrays and maps
whose rules name single elements or need Python, and JSON, CSV and key/value text in a column, are
walked in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as S

from limpid.functions import text as T
from limpid.functions import normalize as N
from limpid.operators.policy import COERCIONS
from limpid.operators.scrub import ScrubPolicy, scrub, scrub_text
from limpid.operators.validate import Field, validate
from limpid.sources.codecs import parse_csv, stringify_csv


@dataclass(frozen=True)
class Rule:
    """One field's pipeline: replace, cap, replacements, sanitise, case, coerce, scrub. A coercion that succeeds ends it."""

    replace: str | None = None  # stands for the whole value
    max_chars: int | None = None
    replacements: tuple[tuple[str, str], ...] = ()
    sanitize: T.Sanitize | None = None
    case: str | None = None
    coerce: str | None = None
    scrub: ScrubPolicy | None = None
    mask: dict | None = None
    drop: bool = False
    default: object = None  # instead of a text that is blank once it is processed
    nested: Structured | None = None  # rules of its own for an object's or array's inside
    validate: Field | None = None

    @property
    def native(self) -> bool:
        clean = self.sanitize is None or (self.sanitize.native and self.sanitize.form is None)
        return clean and self.scrub is None and self.coerce != "date"


@dataclass(frozen=True)
class Structured:
    rules: dict[str, Rule] = field(default_factory=dict)
    fallback: Rule | None = None
    max_depth: int = 10
    max_keys: int = 10_000
    max_array: int = 100_000
    max_string: int = 1_000_000  # a longer text is cut


class SanitizationError(ValueError):
    """Carries a code; never the data."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def matches(pattern: str, path: str, key: str) -> bool:
    if pattern == "*" or pattern in (path, key):
        return True
    if pattern.endswith(".*") and (path == pattern[:-2] or path.startswith(pattern[:-1])):
        return True
    return pattern.startswith("*.") and (path.endswith(pattern[1:]) or key.endswith(pattern[1:]))


def find_rule(policy: Structured, path: str, key: str) -> Rule | None:
    """The first rule of that very path or key wins, then the first whose pattern matches, then the fallback."""
    for name, rule in policy.rules.items():
        if name in (path, key):
            return rule
    return next((r for p, r in policy.rules.items() if matches(p, path, key)), policy.fallback)


def apply_rule(col: Column, rule: Rule | None, most: int = 1_000_000, blank: bool = True) -> Column:
    """A text column by its rule. With ``blank``, a text that comes out blank gets the default."""
    x = F.substring(col, 1, most)
    if rule is None:
        return x
    if rule.replace is not None:
        x = F.when(col.isNotNull(), F.lit(rule.replace))
    x = F.substring(x, 1, rule.max_chars) if rule.max_chars else x
    x = T.compile_replacements(list(rule.replacements))(x)
    x = T.sanitize(x, rule.sanitize) if rule.sanitize else x
    x = {"lower": F.lower, "upper": F.upper, "fold": T.fold}[rule.case](x) if rule.case else x
    y = scrub(x, rule.scrub) if rule.scrub else x
    y = T.mask(y, start=rule.mask.get("start", 0), end=rule.mask.get("end", 0)) if rule.mask else y
    y = F.coalesce(COERCIONS[rule.coerce](x), y) if rule.coerce and rule.coerce != "string" else y
    return F.when(T.js_trim(y) == "", F.lit(rule.default).cast("string")).otherwise(y) if rule.default is not None and blank else y


def _by_key(policy: Structured, path: str, key: Column, then: Callable[[Rule | None], Column]) -> Column:
    """``then`` of the rule that a map's entry of that key has, chosen row by row."""
    whole = F.concat(F.lit(f"{path}." if path else ""), key)
    out = None
    exact = [((whole == p) | (key == p), r) for p, r in policy.rules.items()]
    for p, r in policy.rules.items():
        hit = F.lit(p == "*")
        if p.endswith(".*"):
            hit = hit | (whole == p[:-2]) | whole.startswith(p[:-1])
        if p.startswith("*."):
            hit = hit | whole.endswith(p[1:])
        exact.append((hit, r))
    for hit, r in exact:
        out = F.when(hit, then(r)) if out is None else out.when(hit, then(r))
    return then(policy.fallback) if out is None else out.otherwise(then(policy.fallback))


def _all_rules(policy: Structured) -> list[Rule]:
    own = [*policy.rules.values(), *([policy.fallback] if policy.fallback else [])]
    return own + [r for x in own if x.nested for r in _all_rules(x.nested)]


def _kept_type(dt: S.DataType, policy: Structured, path: str, key: str) -> S.DataType:
    """The type of a value inside an array or map: without the fields that are dropped wherever they are."""
    if isinstance(dt, S.BinaryType):
        return S.StringType()
    if isinstance(dt, S.ArrayType):
        return S.ArrayType(_kept_type(dt.elementType, policy, f"{path}[]", key))
    if isinstance(dt, S.MapType):
        return S.MapType(dt.keyType, _kept_type(dt.valueType, policy, f"{path}.", key))
    if isinstance(dt, S.StructType):
        kept = []
        for f in dt:
            at = f"{path}.{f.name}" if path else f.name
            rule = find_rule(policy, at, f.name)
            if not (rule and rule.drop):
                nested = rule.nested if rule and rule.nested and isinstance(f.dataType, (S.StructType, S.ArrayType, S.MapType)) else None
                kept.append(S.StructField(f.name, _kept_type(f.dataType, nested, "", "") if nested else _kept_type(f.dataType, policy, at, f.name)))
        return S.StructType(kept or [dt[0]]) if len(dt) else dt
    return dt


def _plain(v: object) -> object:
    """A row and what it holds as dictionaries and lists."""
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def _shaped(v: object, dt: S.DataType) -> object:
    """A processed value in the type it is to have; dropped elements and fields are null."""
    if v is None or v is _DROP:
        return None
    if isinstance(dt, S.StructType):
        return {f.name: _shaped(v.get(f.name), f.dataType) for f in dt}
    if isinstance(dt, S.ArrayType):
        return [_shaped(x, dt.elementType) for x in v]
    if isinstance(dt, S.MapType):
        return {k: _shaped(x, dt.valueType) for k, x in v.items()}
    return str(v) if isinstance(dt, S.StringType) and not isinstance(v, str) else v


def _in_python(col: Column, dt: S.DataType, policy: Structured, path: str, key: str, depth: int) -> Column:
    """An array or map walked in Arrow batches, value by value."""
    out = _kept_type(dt, policy, path, key)
    run = F.udf(lambda v: None if v is None else _shaped(process_value(_plain(v), policy, path, key, depth), out), returnType=out, useArrow=True)
    return run(col)


def _walk(col: Column, dt: S.DataType, policy: Structured, path: str, key: str, depth: int) -> Column | None:
    """The processed column, or None if it is dropped."""
    if depth > policy.max_depth:
        raise SanitizationError("too-deep")
    rule = find_rule(policy, path, key) if path else None
    if rule and rule.drop:
        return None
    if rule and rule.nested and isinstance(dt, (S.StructType, S.ArrayType, S.MapType)):
        return _walk(col, dt, rule.nested, "", "", 0)
    if isinstance(dt, S.BinaryType):
        return apply_rule(T.decode_bytes(col), rule, policy.max_string, blank=False)
    if isinstance(dt, S.StringType):
        return apply_rule(col, rule, policy.max_string)
    if isinstance(dt, S.StructType):
        if len(dt) > policy.max_keys:
            raise SanitizationError("too-large")
        kept = [(f.name, _walk(col.getField(f.name), f.dataType, policy, f"{path}.{f.name}" if path else f.name, f.name, depth + 1)) for f in dt]
        return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c in kept if c is not None])) if any(c is not None for _, c in kept) else None
    if isinstance(dt, (S.ArrayType, S.MapType)):
        native = all(r.native for r in _all_rules(policy)) and not any("[" in p for p in policy.rules)
        if not native or (isinstance(dt, S.MapType) and not (isinstance(dt.keyType, S.StringType) and isinstance(dt.valueType, S.StringType))) or _holds_map(dt, S.ArrayType):
            return _in_python(col, dt, policy, path, key, depth)
        too_many = F.size(col) > (policy.max_array if isinstance(dt, S.ArrayType) else policy.max_keys)
        safe = F.when(too_many, F.raise_error(F.lit("too-large"))).otherwise(col)
        if isinstance(dt, S.MapType):
            if depth + 1 > policy.max_depth:
                raise SanitizationError("too-deep")
            stay = F.map_filter(safe, lambda k, v: ~_by_key(policy, path, k, lambda r: F.lit(bool(r and r.drop))))
            return F.transform_values(stay, lambda k, v: _by_key(policy, path, k, lambda r: apply_rule(v, r, policy.max_string)))
        if _walk(F.lit(None).cast(dt.elementType), dt.elementType, policy, f"{path}[]", key, depth + 1) is None:
            return F.transform(safe, lambda x: F.lit(None).cast(dt.elementType))
        return F.transform(safe, lambda x: _walk(x, dt.elementType, policy, f"{path}[]", key, depth + 1))
    return col


def _holds_map(dt: S.DataType, outer: type) -> bool:
    """Whether an array holds a map or an array of its own, whose rules hang on the element's path."""
    if not isinstance(dt, outer):
        return False
    inner = dt.elementType
    while isinstance(inner, S.StructType) and len(inner) == 1:
        inner = inner[0].dataType
    return isinstance(inner, (S.MapType, S.ArrayType)) or (isinstance(inner, S.StructType) and any(isinstance(f.dataType, (S.MapType, S.ArrayType)) for f in inner))


def walk(col: Column, dt: S.DataType, policy: Structured) -> Column | None:
    """A struct, array or map column as a record of its own; None if nothing of it stays."""
    return _walk(col, dt, policy, "", "", 0)


def process_frame(df: DataFrame, policy: Structured) -> DataFrame:
    """Every column by its rule; dropped ones go. Structs keep their shape, without dropped fields."""
    cols = [(f.name, _walk(F.col(f"`{f.name}`"), f.dataType, policy, f.name, f.name, 1)) for f in df.schema]
    return df.select(*[c.alias(n) for n, c in cols if c is not None])


def validate_record(df: DataFrame, policy: Structured) -> Column:
    """STRUCT<ok, issues>: top-level columns by the field of their rule. A null counts as absent, so none is missed."""
    rules = {c: find_rule(policy, c, c) for c in df.columns}
    fields = {c: replace(r.validate, required=False, nullable=True) for c, r in rules.items() if r and r.validate}
    return validate(df, fields)


_WORDS = {**dict.fromkeys(N.TRUE_WORDS, "true"), **dict.fromkeys(N.FALSE_WORDS, "false")}
#: The coercions of ``COERCIONS`` for one Python string.
COERCE_TEXT: dict[str, Callable[[str], str | None]] = {
    "boolean": lambda s: _WORDS.get(T.trim_text(s).lower()),
    "integer": N.integer_text,
    "float": lambda s: None if (x := N.number_text(s)) is None else N.number_show(float(x)),
    "date": lambda s: N.format_date(N.parse_date(s)),
    "phone": N.phone_text,
    "uuid": N.uuid_text,
    "string": lambda s: None,
}


def apply_rule_text(s: str, rule: Rule | None, most: int = 1_000_000) -> str:
    x = s[:most]
    if rule is None:
        return x
    x = x if rule.replace is None else rule.replace
    x = x[: rule.max_chars] if rule.max_chars else x
    for a, b in rule.replacements:
        x = x.replace(a, b) if a else x
    x = T.sanitize_text(x, rule.sanitize) if rule.sanitize else x
    x = {"lower": str.lower, "upper": str.upper, "fold": T.fold_text}[rule.case](x) if rule.case else x
    if rule.coerce and (v := COERCE_TEXT[rule.coerce](x)) is not None:
        return v
    x = scrub_text(x, rule.scrub)[0] if rule.scrub else x
    if rule.mask:
        a, e = rule.mask.get("start", 0), rule.mask.get("end", 0)
        x = x if a + e >= len(x) else x[:a] + "*" * (len(x) - a - e) + x[len(x) - e :]
    return x


_DROP = object()


def process_value(v: object, policy: Structured, path: str = "", key: str = "", depth: int = 0) -> object:
    """A value of JSON's kinds by its rules. A dropped text is ``_DROP``, which arrays turn into null."""
    if depth > policy.max_depth:
        raise SanitizationError("too-deep")
    if isinstance(v, (bytes, bytearray)):
        rule = find_rule(policy, path, key)
        if len(v) > 8_000_000:
            raise SanitizationError("too-large")
        return _DROP if rule and rule.drop else apply_rule_text(bytes(v).decode(errors="replace").removeprefix("\ufeff"), rule, policy.max_string)
    if isinstance(v, str):
        rule = find_rule(policy, path, key)
        if rule and rule.drop:
            return _DROP
        out = apply_rule_text(v, rule, policy.max_string)
        return rule.default if rule and rule.default is not None and not T.trim_text(out) else out
    if isinstance(v, list):
        if len(v) > policy.max_array:
            raise SanitizationError("too-large")
        out = [process_value(x, policy, f"{path}[{k}]", key, depth + 1) for k, x in enumerate(v)]
        return [None if x is _DROP else x for x in out]
    if isinstance(v, dict):
        if len(v) > policy.max_keys:
            raise SanitizationError("too-large")
        out = {}
        for k, x in v.items():
            at = f"{path}.{k}" if path else str(k)
            rule = find_rule(policy, at, str(k))
            if rule and rule.drop:
                continue
            inside = rule.nested if rule and rule.nested and isinstance(x, (dict, list)) else None
            done = process_value(x, inside) if inside else process_value(x, policy, at, str(k), depth + 1)
            if done is not _DROP:
                out[k] = done
        return out
    return v


def _number(raw: str) -> int | float:
    """A JSON number as a double would print it: whole ones without a fraction."""
    x = float(raw)
    return int(x) if abs(x) < 1e21 and x == int(x) else x


def _no_constant(_: str) -> None:
    raise ValueError("not JSON")


def process_json_text(s: str, policy: Structured) -> str:
    """Numbers are printed shortest, 1.0 as 1; one beyond a double's range becomes null."""
    if len(s) > 10_000_000:
        raise SanitizationError("too-large")
    try:
        v = json.loads(s, parse_float=lambda x: _number(x) if abs(float(x)) < float("inf") else None, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        raise SanitizationError("invalid-json") from None
    out = process_value(v, policy)
    return json.dumps(None if out is _DROP else out, ensure_ascii=False, separators=(",", ":"))


def _permissive(fn: Callable[[str], str], permissive: bool) -> Callable[[str], str | None]:
    def run(s: str) -> str | None:
        try:
            return fn(s)
        except SanitizationError:
            if not permissive:
                raise
            return None

    return run


def _detailed(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("struct<text:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            try:
                rows.append((None if x is None else fn(x), None))
            except SanitizationError as e:
                rows.append((None, e.code))
        return pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    return run


def process_json(col: Column, policy: Structured, permissive: bool = True) -> Column:
    """JSON text in, JSON text out; a bad document gives null, or fails unless ``permissive``."""
    return T.per_text(_permissive(lambda s: process_json_text(s, policy), permissive))(col)


def process_json_detailed(col: Column, policy: Structured) -> Column:
    """STRUCT<text, error>: where a document is bad its text is null and ``error`` holds the code, never data."""
    return _detailed(lambda s: process_json_text(s, policy))(col)


def process_csv_text(
    s: str, policy: Structured = Structured(), delimiter: str = ",", header: bool = True, max_rows: int = 100_000, max_cell: int = 1_000_000,
    columns: list[Rule | None] | None = None,
) -> str:
    """CSV text by a rule for each column: ``columns`` by place, or else the policy's by the very name, which without a
    header is the place. Other columns have the fallback, cells beyond the first row none. A dropped cell is empty;
    a cell is cut at ``max_cell``; defaults don't apply."""
    try:
        rows = parse_csv(s, delimiter)
    except ValueError:
        raise SanitizationError("invalid-csv") from None
    if len(rows) > max_rows + header:
        raise SanitizationError("too-large")
    if not rows:
        return ""
    names = rows[0] if header else [str(k) for k in range(len(rows[0]))]
    if columns is None:
        rules = [policy.rules.get(n, policy.fallback) for n in names]
    else:
        rules = [(columns[k] if k < len(columns) else None) or policy.fallback for k in range(len(names))]
    out = rows[:1] if header else []
    for row in rows[len(out) :]:
        own = [rules[k] if k < len(rules) else None for k in range(len(row))]
        out.append(["" if r and r.drop else apply_rule_text(c, r, max_cell) for c, r in zip(row, own)])
    return stringify_csv(out, delimiter)


def process_csv(col: Column, policy: Structured = Structured(), permissive: bool = True, **options) -> Column:
    """CSV text in, CSV text out; bad or too long text gives null, or fails unless ``permissive``."""
    return T.per_text(_permissive(lambda s: process_csv_text(s, policy, **options), permissive))(col)


def process_csv_detailed(col: Column, policy: Structured = Structured(), **options) -> Column:
    """STRUCT<text, error>, as ``process_json_detailed``."""
    return _detailed(lambda s: process_csv_text(s, policy, **options))(col)


def process_kv_text(s: str, policy: Structured, separator: str = " ", equals: str = "=") -> str:
    """Key/value text by the rule of the very key, or else the fallback; what holds no ``equals`` stays as it is."""
    out = []
    for entry in s.split(separator):
        k, eq, v = entry.partition(equals)
        rule = policy.rules.get(k, policy.fallback) if eq else None
        if not (rule and rule.drop):
            out.append(f"{k}{eq}{apply_rule_text(v, rule)}" if eq else entry)
    return separator.join(out)


def process_kv(col: Column, policy: Structured, **options) -> Column:
    return T.per_text(lambda s: process_kv_text(s, policy, **options))(col)
