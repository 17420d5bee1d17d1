"""SQL functions for a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from limpid.functions import normalize as N
from limpid.functions import text as T
from limpid.functions.charsets import CONTROLS, INVISIBLE, WS, WS_TRIM
from limpid.functions.detect import Detect, find
from limpid.operators.scrub import ScrubPolicy, compile_scrubber

_quote = lambda s: s.replace("\\", "\\\\")
_WORDS = {**dict.fromkeys(N.TRUE_WORDS, True), **dict.fromkeys(N.FALSE_WORDS, False)}


def _native() -> dict[str, tuple[str, str, str]]:
    """Functions that are SQL themselves: name -> (parameters, type, body)."""
    ws, gone, trim = _quote(WS), _quote(CONTROLS + INVISIBLE), _quote(WS_TRIM)
    ends = f"regexp_replace(s, '^[{ws}]+|[{ws}]+\\\\z', '')"
    ipad, opad = (bytes(b ^ p for b in T.DEFAULT_TOKEN_KEY.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
    special, kelvin = "[ßİſ\u212a]", "\u212a"
    return {
        "text_sanitize": ("s STRING", "STRING", f"regexp_replace(regexp_replace({ends}, '[{ws}]+', ' '), '[{gone}]', '')"),
        "text_trim": ("s STRING", "STRING", f"regexp_replace(s, '^[{trim}]+|[{trim}]+\\\\z', '')"),
        "text_is_ascii": ("s STRING", "BOOLEAN", "NOT s RLIKE '[^\\\\x00-\\\\x7F]'"),
        "text_fold": ("s STRING", "STRING", f"if(s RLIKE '{special}', replace(replace(replace(lower(s), 'ß', 'ss'), 'ſ', 's'), '{kelvin}', 'k'), lower(s))"),
        "text_mask": ("s STRING, a INT, b INT", "STRING", "if(char_length(s) <= a + b, s, concat(left(s, a), repeat('*', char_length(s) - a - b), right(s, b)))"),
        "text_redact": ("s STRING", "STRING", "if(s IS NULL, s, '[REDACTED]')"),
        "text_hash": ("s STRING, n INT", "STRING", "left(sha2(s, 256), n)"),
        "text_token": ("s STRING", "STRING", f"concat('tok_', left(sha2(concat(unhex('{opad}'), unhex(sha2(concat(unhex('{ipad}'), encode(s, 'UTF-8')), 256))), 256), 16))"),
        "text_truncate": ("s STRING, n INT", "STRING", "if(char_length(s) > n, concat(left(s, n), '…'), s)"),
        "text_alnum": ("s STRING", "STRING", "regexp_replace(s, '[^A-Za-z0-9]', '')"),
        "text_default": ("s STRING, d STRING", "STRING", f"if(s IS NULL OR regexp_replace(s, '[{trim}]+', '') = '', d, s)"),
        "text_null_if_empty": ("s STRING", "STRING", f"if(regexp_replace(s, '[{trim}]+', '') = '', NULL, s)"),
        "bytes_text": ("b BINARY", "STRING", "regexp_replace(make_valid_utf8(cast(b AS STRING)), '^\\\\x{FEFF}', '')"),
    }


def _python() -> dict[str, tuple[object, str]]:
    """Functions in Arrow batches: name -> (function of one text, type)."""
    scrubbed = compile_scrubber(ScrubPolicy())
    return {
        "text_scrub": (lambda s: scrubbed(s)[0], "string"),
        "text_nfkc": (lambda s: T.unicodedata.normalize("NFKC", s), "string"),
        "text_number": (N.number_text, "string"),
        "text_integer": (lambda s: None if (x := N.integer_text(s)) is None else int(x), "bigint"),
        "text_boolean": (lambda s: _WORDS.get(T.trim_text(s).lower()), "boolean"),
        "text_date": (lambda s: N.format_date(N.parse_date(s)), "string"),
        "text_phone": (N.phone_text, "string"),
        "text_uuid": (N.uuid_text, "string"),
    }


def _batched(fn, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in s], dtype=object)

    return run


def register(spark: SparkSession) -> list[str]:
    """Registers the functions of this module and the table function explode_findings(text). Returns their names."""
    native, python, what = _native(), _python(), Detect.of()
    for name, (given, kind, body) in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    for name, (fn, kind) in python.items():
        spark.udf.register(name, _batched(fn, kind))

    @F.udtf(returnType="type string, start int, end int, confidence double")
    class ExplodeFindings:
        def eval(self, text: str):
            yield from find(text, what)

    spark.udtf.register("explode_findings", ExplodeFindings)
    return [*native, *python, "explode_findings"]
