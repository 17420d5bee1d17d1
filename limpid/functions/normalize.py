"""Normalisation and coercion: null where a value is not of the kind asked for."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from limpid.functions import charsets as C
from limpid.functions import text as T

#: Words for true and for false.
TRUE_WORDS = ("1", "true", "yes", "y", "on", "t", "enabled", "active")
FALSE_WORDS = ("0", "false", "no", "n", "off", "f", "disabled", "inactive")
#: Characters that group digits.
GROUPING = r" '\x{2019}\x{A0}\x{2009}"
SAFE = (1 << 53) - 1


def normalize_case(col: Column, mode: str | None = "lower", form: str | None = None) -> Column:
    x = T.normal_form(col, form) if form else col
    return {"lower": F.lower, "upper": F.upper, "fold": T.fold}[mode](x) if mode else x


def normalize_whitespace(col: Column, collapse_to: str = " ", trim: bool = True) -> Column:
    """Runs become the separator; one at each end goes with ``trim``."""
    x = F.regexp_replace(col, f"[{C.WS_NORMAL}]+", T._quoted(collapse_to))
    if not trim or not collapse_to:
        return x
    sep = "".join(f"\\x{{{ord(c):X}}}" for c in collapse_to)
    return F.regexp_replace(F.regexp_replace(x, f"^{sep}", ""), f"{sep}\\z", "")


def normalize_number(col: Column) -> Column:
    """A number's canonical text, or null.

    Of point and comma the last is the decimal mark and the other groups digits; a single
    kind alone is the decimal mark, so '1,000' is 1.
    """
    s = T.js_trim(col)
    plain = T.let(F.when(F.length(s) <= 64, F.regexp_replace(s, f"[{GROUPING}]", "")), _one_mark)
    return F.when(col.isNotNull(), T.let(plain, _canonical_number))


def number_text(raw: str) -> str | None:
    """``normalize_number`` of one Python string."""
    s = T.trim_text(raw)
    if len(s) > 64:
        return None
    s = re.sub("[ '\u2019\u00a0\u2009]", "", s)
    dot, comma = s.rfind("."), s.rfind(",")
    if dot >= 0 and comma > dot:
        s = s.replace(".", "").replace(",", ".")
    else:
        s = s.replace(",", "" if dot >= 0 and comma >= 0 else ".")
    m = re.fullmatch(r"([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?)([0-9]+))?", s)
    if not m or not (m[2] or m[3]):
        return None
    fraction = (m[3] or "").rstrip("0")
    body = (m[2].lstrip("0") or ("0" if m[2] else "")) + ("." + fraction if fraction else "") or "0"
    power = f"e{'-' if m[4] == '-' else ''}{m[5].lstrip('0') or '0'}" if m[5] else ""
    return ("-" if m[1] == "-" and re.search("[1-9]", m[2] + fraction) else "") + body + power


def _one_mark(x: Column) -> Column:
    """The text with a point as its only mark."""
    dot, comma = F.locate(".", F.reverse(x)), F.locate(",", F.reverse(x))
    return (
        F.when((dot > 0) & (comma > 0) & (dot < comma), F.replace(x, F.lit(","), F.lit("")))
        .when((dot > 0) & (comma > 0), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(F.replace(x, F.lit(","), F.lit(".")))
    )


def _canonical_number(x: Column) -> Column:
    shape = r"^([+-]?)(\d*)(?:\.(\d*))?(?:[eE]([+-]?)(\d+))?\z"
    part = lambda k: F.regexp_extract(x, shape, k)
    whole = F.regexp_replace(part(2), r"^0+(?=\d)", "")
    fraction = F.regexp_replace(F.concat(F.lit("."), part(3)), r"\.?0*\z", "")
    body = T.let(F.concat(whole, fraction), lambda b: F.when(b == "", F.lit("0")).otherwise(b))
    power = F.regexp_replace(part(5), r"^0+(?=\d)", "")
    exponent = F.when(part(5) == "", F.lit("")).otherwise(F.concat(F.lit("e"), F.when(part(4) == "-", F.lit("-")).otherwise(F.lit("")), power))
    sign = F.when(x.startswith("-") & x.rlike(r"^-[0.]*[1-9]"), F.lit("-")).otherwise(F.lit(""))
    return F.when(x.rlike(shape) & x.rlike(r"^[+-]?\.?\d"), F.concat(sign, body, exponent))


def normalize_boolean(col: Column, output: str = "string", true_words=TRUE_WORDS, false_words=FALSE_WORDS) -> Column:
    s = F.lower(T.js_trim(col))
    x = F.when(s.isin(*true_words), F.lit(True)).when(s.isin(*false_words), F.lit(False))
    return x if output == "boolean" else x.cast("int") if output == "number" else x.cast("string")


_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?\s*(Z|[+-]\d\d:?\d\d)?)?", re.A)
_US = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})(?:[ ,T]+(\d{1,2}):(\d\d)(?::(\d\d))?\s*([AaPp][Mm])?)?", re.A)
_EU = re.compile(r"(\d{1,2})\.(\d{1,2})\.(\d{4})(?:[ ,T]+(\d{1,2}):(\d\d)(?::(\d\d))?)?", re.A)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def parse_date(raw: str) -> tuple[datetime, bool] | None:
    """(moment in UTC, whether a date alone) of a date in one of the known shapes."""
    s = raw.strip()
    if not s or len(s) > 64:
        return None
    try:
        if re.fullmatch(r"-?\d{10,13}", s, re.A):
            return _EPOCH + timedelta(milliseconds=int(s) * (1000 if len(s) <= 10 else 1)), False
        if m := _ISO.fullmatch(s):
            y, mo, d, h, mi, sec = (int(x or 0) for x in m.groups()[:6])
            at = datetime(y, mo, d, h, mi, sec, int((m[7] or "0").ljust(6, "0")[:6]) // 1000 * 1000, timezone.utc)
            if m[8] and m[8] != "Z":
                z = m[8].replace(":", "")
                at -= timedelta(minutes=int(z[0] + "1") * (int(z[1:3]) * 60 + int(z[3:5])))
            return (at, m[4] is None) if (at.year, at.month, at.day) == (y, mo, d) else None
        if m := _US.fullmatch(s):
            mo, d, y, h, mi, sec = (int(x or 0) for x in m.groups()[:6])
            if m[7]:
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + (12 if m[7].lower() == "pm" else 0)
            return datetime(y, mo, d, h, mi, sec, tzinfo=timezone.utc), m[4] is None
        if m := _EU.fullmatch(s):
            d, mo, y, h, mi, sec = (int(x or 0) for x in m.groups()[:6])
            return datetime(y, mo, d, h, mi, sec, tzinfo=timezone.utc), m[4] is None
        at = parsedate_to_datetime(s)
        return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc), False
    except (ValueError, OverflowError, TypeError, IndexError):
        return None


def format_date(found: tuple[datetime, bool] | None, output: str = "iso") -> str | None:
    if not found:
        return None
    at, only = found
    ms = (at - _EPOCH) // timedelta(milliseconds=1)
    if output in ("epoch-ms", "epoch-s"):
        return str(ms if output == "epoch-ms" else ms // 1000)
    return at.strftime("%Y-%m-%d") if only or output == "date" else at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _is_whole(col: Column) -> Column:
    return F.typeof(col).isin("tinyint", "smallint", "int", "bigint")


def _is_real(col: Column) -> Column:
    return F.typeof(col).rlike("^(float|double|decimal)")


def _show_millis(ms: Column, output: str) -> Column:
    """Milliseconds since 1970 as text, in UTC whatever the session's zone."""
    if output in ("epoch-ms", "epoch-s"):
        return (ms if output == "epoch-ms" else F.floor(ms / 1000)).cast("string")
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")).cast("string")
    if output == "date":
        return day
    t = F.pmod(ms, F.lit(86_400_000))
    parts = [F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000]
    return F.concat(day, F.lit("T"), F.format_string("%02d:%02d:%02d.%03dZ", *parts))


def normalize_date(col: Column, output: str = "iso") -> Column:
    """Text in one of the known shapes, or a number: below 1e12 seconds since 1970, else milliseconds."""
    s = col.cast("string")
    n = s.try_cast("double")
    ms = F.when(n < 1e12, n * 1000).otherwise(n)
    ms = F.when(ms.between(-62_167_219_200_000, 253_402_300_799_999), ms.cast("bigint"))
    number = _is_whole(col) | _is_real(col)
    text = T.per_text(lambda x: format_date(parse_date(x), output))(F.when(~number & s.rlike(r"\d"), s))
    return F.when(number, _show_millis(ms, output)).otherwise(text)


def normalize_identifier(col: Column, separator: str = "-", case: str | None = "lower", diacritics: bool = True, max_length: int | None = None) -> Column:
    x = T.normal_form(col, "NFKC")
    x = F.regexp_replace(x, r"[-_.: \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+", T._quoted(separator))
    if separator:
        sep = "".join(f"\\x{{{ord(c):X}}}" for c in separator)
        x = F.regexp_replace(x, f"^(?:{sep})+|(?:{sep})+\\z", "")
    x = x if diacritics else T.strip_diacritics(x)
    x = normalize_case(x, case) if case else x
    return F.substring(x, 1, max_length) if max_length else x


def normalize_uuid(col: Column) -> Column:
    s = T.js_trim(col)
    h = F.lower(F.regexp_replace(s, f"[{{}}{C.WS_TRIM}-]", ""))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(h.rlike(r"^[0-9a-f]{32}\z") & (F.length(s) <= 40), F.concat_ws("-", *parts))


def uuid_text(raw: str) -> str | None:
    """``normalize_uuid`` of one Python string."""
    s = T.trim_text(raw)
    h = re.sub(rf"[{{}}{C.to_python(C.WS_TRIM)}-]", "", s).lower()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])) if len(s) <= 40 and re.fullmatch("[0-9a-f]{32}", h) else None


def normalize_phone(col: Column, default_prefix: str | None = None) -> Column:
    """Digits, with a plus if the number has one or begins with 00. ``default_prefix`` (+1) goes before the
    others, unless they begin with it already; those only get the plus."""
    return _phone_number(T.js_trim(col), default_prefix)


def _phone_number(s: Column, default_prefix: str | None) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    zeros = digits.startswith("00") & (F.length(digits) > 2)
    number = F.when(zeros, F.substring(digits, 3, 64)).otherwise(digits)
    good = (F.length(s) <= 40) & s.rlike(r"^\+?[0-9 .()/\x2D]+\z") & F.length(number).between(7, 15)
    local = number
    if default_prefix:
        code = default_prefix.replace("+", "")
        local = F.when(number.startswith(code), F.concat(F.lit("+"), number)).otherwise(F.concat(F.lit(default_prefix), number))
    return F.when(good, F.when(s.startswith("+") | zeros, F.concat(F.lit("+"), number)).otherwise(local))


def normalize_phone_extension(col: Column, default_prefix: str | None = None) -> Column:
    """STRUCT<number, ext> of a phone number with a trailing ext, x or #."""
    s = T.js_trim(col)
    shape = rf"(?i)[{C.WS_TRIM}]*(?:ext|x|#)[{C.WS_TRIM}]*\.?:?[{C.WS_TRIM}]*([0-9]{{1,6}})[{C.WS_TRIM}]*\z"
    has = s.rlike(shape)
    number = _phone_number(F.when(has, T.js_trim(F.regexp_replace(s, shape, ""))).otherwise(s), default_prefix)
    return F.when(number.isNotNull() & (F.length(s) <= 40), F.struct(number.alias("number"), F.when(has, F.regexp_extract(s, shape, 1)).alias("ext")))


def phone_text(raw: str) -> str | None:
    """``normalize_phone`` of one Python string."""
    s = T.trim_text(raw)
    digits = re.sub("[^0-9]", "", s)
    zeros = digits.startswith("00") and len(digits) > 2
    number = digits[2:] if zeros else digits
    if len(s) > 40 or not re.fullmatch(r"\+?[0-9 .()/-]+", s) or not 7 <= len(number) <= 15:
        return None
    return ("+" if zeros or s.startswith("+") else "") + number


def canonical_string(col: Column, case: str | None = "lower") -> Column:
    """A key for deduplication: NFKC, trimmed, single spaces, lower case."""
    x = F.regexp_replace(T.js_trim(T.normal_form(col, "NFKC")), f"[{C.WS_TRIM}]+", " ")
    return normalize_case(x, case) if case else x


def to_integer(col: Column, policy: str = "lenient", low: int | None = None, high: int | None = None, base: int = 10) -> Column:
    """Text or a typed value: booleans are 1 and 0, numbers must be whole."""
    s = T.js_trim(col.cast("string"))
    number = col.cast("string").try_cast("double")
    typed = F.when(F.typeof(col) == "boolean", (col.cast("string") == "true").cast("bigint")).when(
        _is_real(col), F.when(F.floor(number).cast("double") == number, number.try_cast("bigint"))
    )
    x = s if policy == "strict" else F.regexp_replace(s, f"[_,'\\x{{2019}}{C.WS_TRIM}]", "")
    hexed = F.when(x.rlike(r"^0x[0-9A-Fa-f]{1,13}\z"), F.conv(F.substring(x, 3, 64), 16, 10).try_cast("bigint"))
    if base == 16 and policy != "strict":
        hexed = F.coalesce(hexed, F.when(x.rlike(r"^-0x[0-9A-Fa-f]{1,13}\z"), -F.conv(F.substring(x, 4, 64), 16, 10).try_cast("bigint")))
    sign = "-?" if policy == "strict" else "[+-]?"
    plain = F.when(x.rlike(rf"^{sign}\d+\z"), x.try_cast("bigint")) if base != 16 else F.lit(None).cast("bigint")
    v = F.coalesce(typed, F.coalesce(hexed, plain) if policy != "strict" else plain)
    good = v.between(-SAFE, SAFE) & ((F.typeof(col) != "string") | (F.length(s) <= 32))
    good = good & (v >= low) if low is not None else good
    return F.when(good & (v <= high) if high is not None else good, v)


def integer_text(raw: str) -> str | None:
    """``to_integer`` of one Python string, leniently, as text."""
    s = T.trim_text(raw)
    x = re.sub(rf"[_,'\u2019{C.to_python(C.WS_TRIM)}]", "", s)
    if len(s) > 32 or not (m := re.fullmatch("(0x[0-9A-Fa-f]{1,13})|[+-]?[0-9]+", x)):
        return None
    v = int(x, 16 if m[1] else 10)
    return str(v) if abs(v) <= SAFE else None


def to_float(col: Column, low: float | None = None, high: float | None = None, allow_nan: bool = False, allow_infinity: bool = False) -> Column:
    """Text or a typed value: booleans are 1 and 0 in any range. Only numbers, not text, may be NaN or infinite, if allowed."""

    def checked(v: Column) -> Column:
        good = F.abs(v) < float("inf")
        good = good & (v >= low) if low is not None else good
        return F.when(good & (v <= high) if high is not None else good, v)

    number = col.cast("string").try_cast("double")
    odd = (F.isnan(number) & F.lit(allow_nan)) | ((F.abs(number) == float("inf")) & F.lit(allow_infinity))
    typed = F.when(F.typeof(col) == "boolean", (col.cast("string") == "true").cast("double")).when(_is_real(col) & odd, number)
    return F.coalesce(typed, T.let(normalize_number(col.cast("string")).try_cast("double"), checked))


def to_boolean(col: Column, output: str = "boolean", policy: str = "lenient", true_words=TRUE_WORDS, false_words=FALSE_WORDS) -> Column:
    """Text by its words; a number is true unless 0, or under ``strict`` must be 0 or 1."""
    number = col.cast("string").try_cast("double")
    typed = F.when(number == 0, F.lit(False)).when((number == 1) | (F.lit(policy != "strict") & number.isNotNull()), F.lit(True))
    x = F.when(_is_whole(col) | _is_real(col), typed).otherwise(normalize_boolean(col.cast("string"), "boolean", true_words, false_words))
    return x if output == "boolean" else x.cast("int") if output == "number" else x.cast("string")


def to_date(col: Column, output: str = "date-obj") -> Column:
    if output != "date-obj":
        return normalize_date(col, output)
    return F.timestamp_millis(normalize_date(col, "epoch-ms").try_cast("bigint"))


def number_show(x: float | None) -> str | None:
    """A double's shortest decimal text; null if not finite."""
    if x is None or not abs(x) < float("inf"):
        return None
    if x == 0:
        return "0"
    r = repr(float(x))
    mantissa, _, power = r.partition("e")
    mantissa = mantissa.removesuffix(".0")
    if not power:
        return mantissa
    p = int(power)
    return format(Decimal(r), "f") if -7 < p < 0 else format(int(float(x))) if 0 <= p < 21 else f"{mantissa}e{p:+d}"


def number_to_string(col: Column) -> Column:
    """``number_show`` of a column; only numbers with an exponent go through Python."""
    odd = col.cast("string").contains("E")
    plain = F.when(col == 0, F.lit("0")).otherwise(F.regexp_replace(col.cast("string"), r"\.0\z", ""))
    finite = ~F.isnan(col) & (F.abs(col) < float("inf"))
    return F.when(finite, F.coalesce(F.udf(number_show, "string", useArrow=True)(F.when(odd & finite, col)), plain))


def coerce_with_fallback(col: Column, fallback: bool | int | float | str) -> Column:
    """Coerced to the kind of ``fallback``, or that."""
    if isinstance(fallback, bool):
        v = to_boolean(col)
    elif isinstance(fallback, int):
        v = to_integer(col)
    elif isinstance(fallback, float):
        v = to_float(col)
    else:
        v = col
    return F.coalesce(v, F.lit(fallback))


