"""Validation of rows against a schema: STRUCT<ok, issues>. Messages never hold values. A field that the schema
of the data lacks is absent (``required``); a null is a value (``null``, unless the field is nullable)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions import charsets as C
from limpid.functions.detect import PATTERNS
from limpid.functions.normalize import normalize_date

ISSUES = "array<struct<path:string,code:string,message:string>>"
# The shapes that formats accept.
_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"
_URL = rf"^(?i:https?)://[^/$.?#{C.WS_TRIM}][^\n\r\x{{2028}}\x{{2029}}][^{C.WS_TRIM}]*\z"
_IPV4 = "^" + PATTERNS["ipv4"][2:-2] + r"\z"
_IPV6 = r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}\z"
_HEX32 = r"^[0-9A-Fa-f]{32}\z"
# End of fixed values.
FORMATS: dict[str, Callable[[Column], Column]] = {
    "email": lambda c: c.rlike(_EMAIL) & (F.char_length(c) <= 254),
    "uuid": lambda c: F.regexp_replace(c, f"[{{}}{C.WS_TRIM}-]", "").rlike(_HEX32),
    "date": lambda c: normalize_date(c).isNotNull() & ~c.rlike(r"^\s*-?[0-9]+\s*\z"),
    "url": lambda c: c.rlike(_URL) & (F.char_length(c) <= 2048),
    "ipv4": lambda c: c.rlike(_IPV4),
    "ipv6": lambda c: c.rlike(_IPV6),
    "phone": lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).between(7, 15),
}
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Field:
    """What one field must be. ``type`` may list several kinds."""

    type: str | tuple[str, ...] | None = None
    required: bool = False
    nullable: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min: float | None = None
    max: float | None = None
    enum: tuple | None = None
    pattern: str | None = None
    format: str | None = None
    custom: Callable[[Column], Column] | None = None
    fields: dict[str, Field] = field(default_factory=dict)
    items: Field | None = None
    no_unknown: bool = False


def _issue(bad: Column, path: Column, code: str, message: str | Column) -> Column:
    """The issue where ``bad``; its message begins with the path, or with "value" where that is empty."""
    name = F.when(path == "", F.lit("value")).otherwise(path)
    said = F.concat(name, F.lit(" "), message if isinstance(message, Column) else F.lit(message))
    return F.when(bad, F.array(F.struct(path.alias("path"), F.lit(code).alias("code"), said.alias("message")))).otherwise(F.array().cast(ISSUES))


def _kind_name(dt: T.DataType) -> str:
    """What messages call a value of a type."""
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (*_NUMBERS, T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    return "boolean" if isinstance(dt, T.BooleanType) else "array" if isinstance(dt, T.ArrayType) else "object"


def _is(kind: str, col: Column, dt: T.DataType) -> Column:
    text, whole, real = isinstance(dt, T.StringType), isinstance(dt, _NUMBERS), isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType))
    if kind in FORMATS:
        return FORMATS[kind](col) if text else F.lit(kind == "date" and isinstance(dt, (T.DateType, T.TimestampType)))
    if kind in ("integer", "number") and real:
        whole_part = F.floor(col) == col
        if isinstance(dt, T.DecimalType):
            return whole_part if kind == "integer" else F.lit(True)
        finite = ~F.isnan(col) & (F.abs(col) < float("inf"))
        return finite & whole_part if kind == "integer" else finite
    return F.lit({"string": text, "integer": whole, "number": whole, "boolean": isinstance(dt, T.BooleanType), "array": isinstance(dt, T.ArrayType), "object": isinstance(dt, (T.StructType, T.MapType))}[kind])


def _checks(col: Column, dt: T.DataType | None, f: Field, path: Column) -> Column:
    if dt is None:  # absent from the schema
        return _issue(F.lit(f.required), path, "required", "is required")
    kinds = () if f.type is None else (f.type,) if isinstance(f.type, str) else f.type
    right = F.lit(True)
    if kinds:
        right = F.lit(False)
        for k in kinds:
            right = right | _is(k, col, dt)
    text, many = isinstance(dt, T.StringType), isinstance(dt, T.ArrayType)
    real = isinstance(dt, (T.FloatType, T.DoubleType))
    parts = []
    if text or many:
        size = F.char_length(col) if text else F.size(col)
        long = lambda word: F.concat(F.lit(f"is too {word} (length "), size.cast("string"), F.lit(")"))
        if f.min_length is not None:
            parts.append(_issue(size < f.min_length, path, "minLength", long("short")))
        if f.max_length is not None:
            parts.append(_issue(size > f.max_length, path, "maxLength", long("long")))
    if real or isinstance(dt, (*_NUMBERS, T.DecimalType)):
        number = ~F.isnan(col) if real else F.lit(True)
        if f.min is not None:
            parts.append(_issue(number & (col < f.min), path, "range", "is below minimum"))
        if f.max is not None:
            parts.append(_issue(number & (col > f.max), path, "range", "is above maximum"))
    if f.enum is not None:
        parts.append(_issue(~col.isin(*f.enum), path, "enum", "is not an allowed value"))
    if text and f.pattern is not None:
        parts.append(_issue(~col.rlike(f.pattern), path, "pattern", "does not match required pattern"))
    if f.format is not None:
        parts.append(_issue(~FORMATS[f.format](col) if text else F.lit(True), path, "format", f"is not a valid {f.format}"))
    if f.custom is not None:
        parts.append(_issue(~F.coalesce(f.custom(col), F.lit(False)), path, "custom", "failed custom validation"))
    if isinstance(dt, T.StructType) and (f.fields or f.no_unknown):
        parts.append(_fields(lambda n: col.getField(n), dt, f.fields, f.no_unknown, path))
    if many and f.items is not None:
        each = F.transform(col, lambda x, k: _checks(x, dt.elementType, f.items, F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))))
        parts.append(F.flatten(each))
    inner = F.concat(*parts) if parts else F.array().cast(ISSUES)
    wrong = _issue(F.lit(True), path, "type", f"must be {'/'.join(kinds)} (got {_kind_name(dt)})") if kinds else inner
    missing = _issue(F.lit(not f.nullable), path, "null", "must not be null")
    return F.when(col.isNull(), missing).when(~F.coalesce(right, F.lit(False)), wrong).otherwise(inner)


def _fields(get: Callable[[str], Column], dt: T.StructType, fields: dict[str, Field], no_unknown: bool, path: Column | None) -> Column:
    at = lambda n: F.when(path == "", F.lit(n)).otherwise(F.concat(path, F.lit(f".{n}"))) if path is not None else F.lit(n)
    types = {x.name: x.dataType for x in dt}
    parts = [_checks(get(n) if n in types else F.lit(None), types.get(n), f, at(n)) for n, f in fields.items()]
    if no_unknown:
        parts += [_issue(get(n).isNotNull(), at(n), "unknown", "is not allowed") for n in types if n not in fields]
    return F.concat(*parts) if parts else F.array().cast(ISSUES)


def validate(df: DataFrame, schema: dict[str, Field], no_unknown: bool = False, max_issues: int = 32, cross: list[tuple[str, str, Column]] = ()) -> Column:
    """STRUCT<ok, issues> of each row: fields in order, then unknown ones, then ``cross`` rules
    (path, code, condition that must hold)."""
    issues = _fields(lambda n: F.col(f"`{n}`"), df.schema, schema, no_unknown, None)
    for path, code, holds in cross:
        issues = F.concat(issues, _issue(~F.coalesce(holds, F.lit(False)), F.lit(path), code, "breaks a rule across fields"))
    return F.struct((F.size(issues) == 0).alias("ok"), F.slice(issues, 1, max_issues).alias("issues"))


def compile_validator(schema: dict[str, Field], **options) -> Callable[[DataFrame], Column]:
    """``validate`` with its schema and options fixed."""
    return lambda df: validate(df, schema, **options)


def validate_value(col: Column, dt: T.DataType, f: Field, max_issues: int = 32) -> Column:
    """STRUCT<ok, issues> of one value; its path is empty."""
    issues = _checks(col, dt, f, F.lit(""))
    return F.struct((F.size(issues) == 0).alias("ok"), F.slice(issues, 1, max_issues).alias("issues"))


def valid() -> Column:
    """STRUCT<ok, issues> of what nothing is asked of."""
    return F.struct(F.lit(True).alias("ok"), F.array().cast(ISSUES).alias("issues"))
