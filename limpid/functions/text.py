"""Sanitising, case, Unicode and generic transforms, as Column expressions.

Everything is native unless it needs a Unicode normal form, a byte budget or a user's
Python function; those go through one Arrow-batched UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions import charsets as C

_WS = re.compile(f"[{C.to_python(C.WS)}]")
_REMOVED = re.compile(f"[{C.to_python(C.CONTROLS)}]")
_HIDDEN = re.compile(f"[{C.to_python(C.INVISIBLE)}]")
_BIDI = re.compile(f"[{C.to_python(C.BIDI)}]")
_EDGES = re.compile(rf"^[{C.to_python(C.WS_TRIM)}]+|[{C.to_python(C.WS_TRIM)}]+\Z")


def per_text(fn: Callable[[str], object], kind: str = "string") -> Callable[[Column], Column]:
    """An Arrow-batched UDF of one text column; null stays null."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in s], dtype=object)

    return run


def let(col: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(col)`` with ``col`` computed once: expressions that use a value often don't multiply."""
    return F.element_at(F.transform(F.array(col), fn), 1)


@dataclass(frozen=True)
class Sanitize:
    """Options of ``sanitize``; allow and block are sets of characters or, with ``regex``, patterns by character."""

    trim: str = "both"  # both, start, end, none
    collapse: str | None = " "  # separator for runs of white space; None keeps them
    controls: bool = True
    zero_width: bool = True
    bidi: bool = True
    allow: str | None = None
    block: str | None = None
    regex: bool = False
    replacement: str = ""
    max_chars: int | None = None
    max_bytes: int | None = None
    form: str | None = None

    @property
    def native(self) -> bool:
        budget = self.max_bytes is not None or (self.max_chars is not None and (self.collapse is None or len(self.collapse) != 1 or len(self.replacement) > 1))
        return not (budget or self.regex)


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def _class(chars: str) -> str:
    return "".join(f"\\x{{{ord(c):X}}}" for c in chars)


def sanitize(col: Column, o: Sanitize = Sanitize()) -> Column:
    """One clean pass: trim, collapse white space, drop controls and invisible characters.

    White space is told apart before controls and invisible characters, on the text as it was, so a control
    between two blanks leaves two separators. A budget that native functions can't count goes to Python only
    where the text is long enough to reach it.
    """
    if o.native:
        return _sanitize_native(normal_form(col, o.form) if o.form else col, o)
    small = all(len(x) <= 1 and x.isascii() for x in (o.replacement, o.collapse or ""))
    if o.regex or not small:
        return per_text(lambda s: sanitize_text(s, o))(col)
    x = normal_form(col, o.form) if o.form else col  # no step below makes it longer
    fits = F.char_length(x) <= o.max_chars if o.max_chars is not None else F.lit(True)
    if o.max_bytes is not None:
        fits = fits & (F.octet_length(x) <= o.max_bytes)
    counted = replace(o, form=None)
    rest = per_text(lambda s: sanitize_text(s, counted))(F.when(~fits, x))
    return F.when(fits, _sanitize_native(x, replace(counted, max_chars=None, max_bytes=None))).otherwise(rest)


def _unclean(col: Column, o: Sanitize, gone: str) -> Column:
    """Whether a step of the sanitiser would change the text: one search for a single class, and what is
    cheaper to ask of the ends."""
    start, end = o.trim in ("both", "start"), o.trim in ("both", "end")
    if o.collapse == " ":
        found = col.rlike(f"[{C.WS.replace(chr(92) + 'x20', '')}{gone}]") | col.contains("  ")
        ends = [col.startswith(" ")] * start + [col.endswith(" ")] * end
    elif o.collapse is not None:
        return col.rlike(f"[{C.WS}{gone}]")
    else:
        found = col.rlike(f"[{gone}]") if gone else F.lit(False)
        ends = [F.substring(col, 1, 1).rlike(f"[{C.WS}]")] * start + [F.substring(col, -1, 1).rlike(f"[{C.WS}]")] * end
    return reduce(lambda x, y: x | y, ends, found)


def _sanitize_native(col: Column, o: Sanitize) -> Column:
    x = col
    if o.trim in ("both", "start"):
        x = F.regexp_replace(x, f"^[{C.WS}]+", "")
    if o.trim in ("both", "end") and o.collapse is not None:
        x = F.regexp_replace(x, f"[{C.WS}]+\\z", "")
    if o.collapse is not None:
        x = F.regexp_replace(x, f"[{C.WS}]+", _quoted(o.collapse))
    gone = (C.CONTROLS if o.controls else "") + (C.INVISIBLE if o.zero_width else C.BIDI if o.bidi else "")
    if gone:
        x = F.regexp_replace(x, f"[{gone}]", _quoted(o.replacement))
    spared = "" if o.collapse is None else C.WS + _class(o.collapse)
    if o.allow is not None:
        x = F.regexp_replace(x, f"[^{_class(o.allow)}{spared}{_class(o.replacement)}]", _quoted(o.replacement))
    if o.block is not None:
        x = F.regexp_replace(x, f"[{_class(o.block)}]" if o.collapse is None else f"[{_class(o.block)}&&[^{spared}]]", _quoted(o.replacement))
    if o.allow is None and o.block is None:
        x = F.when(_unclean(col, o, gone), x).otherwise(col)  # texts on which no step would do anything stay as they are
    if o.max_chars is not None:
        x = F.substring(x, 1, o.max_chars)
    if o.trim in ("both", "end") and o.collapse is None:
        x = F.regexp_replace(x, f"[{C.WS}]+\\z", "")
    return x


def sanitize_text(s: str, o: Sanitize) -> str:
    """The same for one Python string, with every option."""
    if o.form:
        s = unicodedata.normalize(o.form, s)
    if o.trim in ("both", "start"):
        s = re.sub(rf"^{_WS.pattern}+", "", s)
    if o.trim in ("both", "end") and o.collapse is not None:
        s = re.sub(rf"{_WS.pattern}+\Z", "", s)
    out: list[str] = []
    chars = size = 0
    at, n = 0, len(s)

    def ok(c: str) -> bool:
        for rule, wanted in ((o.allow, True), (o.block, False)):
            if rule is not None and (bool(re.search(rule, c)) if o.regex else c in rule) != wanted:
                return False
        return True

    while at < n:
        c = s[at]
        at += 1
        cost = 1
        if o.collapse is not None and _WS.match(c):
            while at < n and _WS.match(s[at]):
                at += 1
            piece = o.collapse
        elif (o.controls and _REMOVED.match(c)) or (o.zero_width and _HIDDEN.match(c)) or (o.bidi and _BIDI.match(c)) or not ok(c):
            piece, cost = o.replacement, len(o.replacement)
        else:
            piece = c
        chars += cost
        size += len(piece.encode("utf-8", "surrogatepass"))
        if (o.max_chars is not None and chars > o.max_chars) or (o.max_bytes is not None and size > o.max_bytes):
            break
        out.append(piece)
    s = "".join(out)
    return re.sub(rf"{_WS.pattern}+\Z", "", s) if o.trim in ("both", "end") and o.collapse is None else s


def decode_bytes(col: Column) -> Column:
    """Binary as text, malformed UTF-8 replaced, without a leading byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(col.cast("string")), "^\\x{FEFF}", "")


def sanitize_bytes(col: Column, o: Sanitize = Sanitize()) -> Column:
    return sanitize(decode_bytes(col), o)


def is_valid_utf8(col: Column) -> Column:
    return F.is_valid_utf8(col.cast("string"))


def is_ascii(col: Column) -> Column:
    return ~col.rlike(r"[^\x00-\x7F]")


def normal_form(col: Column, form: str = "NFC") -> Column:
    """A Unicode normal form; ASCII rows never reach Python as text."""
    fn = lambda s: s if unicodedata.is_normalized(form, s) else unicodedata.normalize(form, s)
    return F.coalesce(per_text(fn)(F.when(~is_ascii(col), col)), col)


def lower(col: Column) -> Column:
    return F.lower(col)


def upper(col: Column) -> Column:
    return F.upper(col)


def fold(col: Column) -> Column:
    """Case folding: lower case, and where the text holds one of four special letters, those spelled out."""
    low = F.lower(col)
    spelled = F.replace(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s")), F.lit("K"), F.lit("k"))
    return F.when(col.rlike("[ßİſ\\x{212A}]"), spelled).otherwise(low)


def fold_text(s: str) -> str:
    """``fold`` of one Python string."""
    low = s.lower()
    return low.replace("ß", "ss").replace("ſ", "s").replace("\u212a", "k") if re.search("[ßİſ\u212a]", s) else low


def equal_fold(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def strip_diacritics(col: Column) -> Column:
    def strip(s: str) -> str:
        d = unicodedata.normalize("NFD", s)
        t = re.sub("[̀-ͯ]", "", d)
        return s if t == d else t

    return F.coalesce(per_text(strip)(F.when(~is_ascii(col), col)), col)


def js_trim(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, f"^[{C.WS_TRIM}]+", ""), f"[{C.WS_TRIM}]+\\z", "")


def trim_text(s: str) -> str:
    """``js_trim`` of one Python string."""
    return _EDGES.sub("", s)


def replace_all(col: Column, what: str, to: str) -> Column:
    return F.replace(col, F.lit(what), F.lit(to)) if what else col


def compile_replacements(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """Literal replacements in order; empty ones are skipped."""
    return lambda col: reduce(lambda x, p: replace_all(x, *p), pairs, col)


def replace_pattern(col: Column, pattern: str, to: str, every: bool = False) -> Column:
    """``to`` may refer to groups as $1. Only the first match unless ``every``."""
    if every:
        return F.regexp_replace(col, pattern, to)
    at = F.regexp_instr(col, F.lit(pattern))
    hit = F.regexp_substr(col, F.lit(pattern))
    head = F.substring(col, F.lit(1), at - 1)
    tail = F.substring(col, at + F.length(hit), F.length(col))
    return F.when(at > 0, F.concat(head, F.regexp_replace(hit, pattern, to), tail)).otherwise(col)


def map_chars(col: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(character, index)`` of every code point; null drops it."""
    return F.array_join(F.transform(F.split(col, ""), fn), "")


def filter_chars(col: Column, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.filter(F.split(col, ""), keep), "")


def filter_alnum(col: Column, extra: str = "") -> Column:
    return F.regexp_replace(col, f"[^A-Za-z0-9{_class(extra)}]", "")


def mask(col: Column, char: str = "*", start: int = 0, end: int = 0, keep_length: bool = True) -> Column:
    """Masked but for ``start`` and ``end`` characters, or without ``keep_length`` eight marks; a text no longer
    than both comes back as it is."""
    n = F.char_length(col)
    if not keep_length:
        return F.when(n <= start + end, col).when(col.isNotNull(), F.lit(char * 8))
    tail = F.substring(col, n - end + 1, F.lit(end)) if end else F.lit("")
    return F.when(n <= start + end, col).otherwise(F.concat(F.substring(col, 1, start), F.repeat(F.lit(char), n - start - end), tail))


def redact(col: Column, placeholder: str = "[REDACTED]") -> Column:
    return F.when(col.isNotNull(), F.lit(placeholder))


def hash_value(col: Column, alg: str = "sha256", length: int | None = None) -> Column:
    x = F.sha2(col, int(alg[3:]))
    return F.substring(x, 1, length) if length else x


def hmac_value(col: Column, key: str, alg: str = "sha256", length: int | None = None) -> Column:
    """HMAC from two hashes; the plan holds the padded key blocks, not the key."""
    import hashlib

    bits, block = int(alg[3:]), 64 if alg == "sha256" else 128
    raw = key.encode()
    raw = (hashlib.new(alg, raw).digest() if len(raw) > block else raw).ljust(block, b"\0")
    pads = [F.unhex(F.lit(bytes(b ^ p for b in raw).hex())) for p in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(pads[0], F.encode(col, "UTF-8")), bits))
    x = F.sha2(F.concat(pads[1], inner), bits)
    return F.substring(x, 1, length) if length else x


DEFAULT_TOKEN_KEY = "limpid-public-token-key"


def tokenize(col: Column, prefix: str = "tok_", key: str = DEFAULT_TOKEN_KEY, length: int = 16) -> Column:
    """A stable token of a value. The default key is public: set your own."""
    return F.concat(F.lit(prefix), hmac_value(col, key, length=length))


def vault(df: DataFrame, column: str, **options) -> DataFrame:
    """(token, value) of the distinct values of a column, to be kept as a table of its own."""
    return df.select(F.col(column).alias("value")).filter("value is not null").distinct().select(tokenize(F.col("value"), **options).alias("token"), "value")


def truncate(col: Column, max_length: int = 8, suffix: str = "…", by_bytes: bool = False) -> Column:
    """The suffix goes beyond the maximum for characters, and inside it for bytes."""
    if not by_bytes:
        return F.when(F.char_length(col) > max_length, F.concat(F.substring(col, 1, max_length), F.lit(suffix))).otherwise(col)

    def cut(s: str) -> str:
        raw = s.encode()
        room = max(0, max_length - len(suffix.encode()))
        return s if len(raw) <= max_length else raw[:room].decode(errors="replace") + suffix

    return F.when(F.octet_length(col) <= max_length, col).otherwise(per_text(cut)(F.when(F.octet_length(col) > max_length, col)))


def with_default(col: Column, default: str) -> Column:
    return F.when(col.isNull() | (js_trim(col) == ""), F.lit(default)).otherwise(col)


def null_if_empty(col: Column) -> Column:
    return F.when(js_trim(col) != "", col)


def pipe(*fns: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda col: reduce(lambda x, f: f(x), fns, col)
