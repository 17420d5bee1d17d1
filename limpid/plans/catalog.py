"""One query for each operator over the driver's tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import charsets as C
from limpid.functions import detect as D
from limpid.functions import normalize as N
from limpid.functions import text as T
from limpid.operators import policy as P
from limpid.operators.compiled import CompiledPolicy
from limpid.operators import structured as S
from limpid.operators.validate import Field, validate
from limpid.plans.base import Query, clean_sql, shared_path, table
from limpid.sources import codecs
from limpid.streaming import apply_policy

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, source: str, columns: Callable[[DataFrame], list] | None, sql: str | None, frame: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return frame(df) if frame else df.select(*columns(df))

    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _col(name: str, source: str, key: str, fn: Callable, sql: str | None, alias: str = "value") -> None:
    """A query (key, value): ``fn`` makes the value."""
    _add(name, source, lambda df: [key, fn().alias(alias)], sql and f"SELECT {key}, {sql} AS {alias} FROM {source}")


def _text() -> F.Column:
    return F.col("text")


_clean = clean_sql()

# Sanitise
_col("sanitize_documents", "documents", "doc_id", lambda: T.sanitize(_text()), _clean)
_col("sanitize_pages", "pages", "page_id", lambda: T.sanitize(F.col("html")), _clean.replace("text", "html"))
_col("sanitize_separator", "documents", "doc_id", lambda: T.sanitize(_text(), T.Sanitize(collapse="-")), _clean.replace("' '", "'-'"))
_col("sanitize_keep_space", "documents", "doc_id", lambda: T.sanitize(_text(), T.Sanitize(collapse=None)),
     f"regexp_replace(regexp_replace(regexp_replace(text, '^[{C.WS}]+', ''), '[{C.CONTROLS}{C.INVISIBLE}]', '', 'g'), '[{C.WS}]+$', '')")
_col("sanitize_max_chars", "documents", "doc_id", lambda: T.sanitize(_text(), T.Sanitize(max_chars=100)), f"substring({_clean}, 1, 100)")
_col("sanitize_allow", "documents", "doc_id", lambda: T.sanitize(_text(), T.Sanitize(allow="abcdefghijklmnopqrstuvwxyz")), f"regexp_replace({_clean}, '[^a-z ]', '', 'g')")
_col("sanitize_block", "documents", "doc_id", lambda: T.sanitize(_text(), T.Sanitize(block="aeiou", replacement="*")), f"regexp_replace({_clean}, '[aeiou]', '*', 'g')")
_col("sanitize_max_bytes", "documents", "doc_id", lambda: T.sanitize(_text(), T.Sanitize(max_bytes=64)),
     f"substr({_clean}, 1, list_max(list_filter(range(0, 65), lambda k: strlen(substr({_clean}, 1, k)) <= 64)))")
_col("sanitize_form_nfkc", "documents", "doc_id", lambda: T.sanitize(F.concat(F.lit("ﬁ １² e\u0301 "), _text()), T.Sanitize(form="NFKC")), "'fi 12 é ' || " + _clean.replace("text", "nfc_normalize(text)") + "")
_col("sanitize_bytes", "documents", "doc_id", lambda: T.sanitize_bytes(F.encode(_text(), "UTF-8")), _clean)


def _maybe_broken() -> F.Column:
    """Bytes: a character cut off, a stray one, or none amiss behind a byte order mark or not."""
    kind = F.col("doc_id") % 4
    return F.when(kind == 1, F.unhex(F.lit("6162E282"))).when(kind == 2, F.unhex(F.lit("FF78"))).when(kind == 3, F.unhex(F.lit("EFBBBFC3A9"))).otherwise(F.unhex(F.lit("C3A9")))


_add("utf8_lengths", "documents", lambda df: ["doc_id", F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), T.is_valid_utf8(_maybe_broken()).alias("valid"), T.decode_bytes(_maybe_broken()).alias("decoded")],
     "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, doc_id % 4 <> 1 AND doc_id % 4 <> 2 AS valid, CASE doc_id % 4 WHEN 1 THEN 'ab' || chr(65533) WHEN 2 THEN chr(65533) || 'x' ELSE 'é' END AS decoded FROM documents")

# Unicode and case
_col("is_ascii", "documents", "doc_id", lambda: T.is_ascii(_text()), r"NOT regexp_matches(text, '[^\x00-\x7F]')")
_col("lower", "documents", "doc_id", lambda: T.lower(_text()), "lower(text)")
_col("upper", "documents", "doc_id", lambda: T.upper(_text()), "replace(upper(text), 'ẞ', 'SS')")
_fold = "CASE WHEN regexp_matches(text, '[ßİſK]') THEN replace(replace(replace(lower(text), 'ß', 'ss'), 'ſ', 's'), 'K', 'k') ELSE lower(text) END"
_folded = "replace(replace(replace(lower(text), 'ß', 'ss'), 'ſ', 's'), 'K', 'k') || 'ss'"
_col("fold", "documents", "doc_id", lambda: T.fold(_text()), _fold)
_add("equal_fold", "documents", lambda df: ["doc_id", T.equal_fold(_text(), F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.concat("text", F.lit("ß")))).alias("value"), T.equal_fold(F.concat(_text(), F.lit("ß")), F.concat(F.upper("text"), F.lit("SS"))).alias("spelled")],
     f"SELECT doc_id, doc_id % 2 = 0 AND {_fold} = {_fold.replace('text', 'replace(upper(text), chr(7838), chr(83) || chr(83))')} AS value, {_folded} = lower(replace(upper(text), chr(7838), chr(83) || chr(83))) || 'ss' AS spelled FROM documents")
_col("normal_form_nfc", "documents", "doc_id", lambda: T.normal_form(_text(), "NFC"), "nfc_normalize(text)")
_col("strip_diacritics", "documents", "doc_id", lambda: T.strip_diacritics(_text()), "strip_accents(text)")

# Normalise and coerce
_col("normalize_case", "conversations", "conv_id", lambda: N.normalize_case(_text()), "lower(text)")
_ws = f"regexp_replace(text, '[{C.WS_NORMAL}]+', ' ', 'g')"
_col("normalize_whitespace", "conversations", "conv_id", lambda: N.normalize_whitespace(_text()), f"regexp_replace(regexp_replace({_ws}, '^ ', ''), ' $', '')")


def _money() -> F.Column:
    return F.format_string("+00%s", F.col("c_acctbal").cast("decimal(12,2)").cast("string"))


_col("normalize_number", "customer", "c_custkey", lambda: N.normalize_number(F.when(F.col("c_acctbal") >= 0, _money())),
     r"CASE WHEN c_acctbal >= 0 THEN regexp_replace(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '0+$', ''), '\.$', '') END")
_col("normalize_boolean", "orders", "o_orderkey", lambda: N.normalize_boolean(F.col("o_orderstatus")), "CASE WHEN o_orderstatus = 'F' THEN 'false' END")
_col("normalize_date", "orders", "o_orderkey", lambda: N.normalize_date(F.date_format("o_orderdate", "MM/dd/yyyy")), "strftime(o_orderdate, '%Y-%m-%d')")
_col("normalize_date_iso", "orders", "o_orderkey", lambda: N.normalize_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z')")
_col("normalize_identifier", "customer", "c_custkey", lambda: N.normalize_identifier(F.concat(F.lit("  "), F.col("c_name"), F.lit("_ "), F.col("c_mktsegment"), F.lit(" "))),
     "trim(regexp_replace(lower('  ' || c_name || '_ ' || c_mktsegment || ' '), '[-_.: ]+', '-', 'g'), '-')")
_md5 = "md5(c_name)"
_col("normalize_uuid", "customer", "c_custkey", lambda: N.normalize_uuid(F.concat(F.lit("{"), F.upper(F.md5("c_name")), F.lit("}"))),
     f"substr({_md5}, 1, 8) || '-' || substr({_md5}, 9, 4) || '-' || substr({_md5}, 13, 4) || '-' || substr({_md5}, 17, 4) || '-' || substr({_md5}, 21)")
_col("normalize_phone", "customer", "c_custkey", lambda: N.normalize_phone(F.concat(F.lit("+1 (415) 555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))), "'+1415555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')")
_add("normalize_phone_extension", "customer", lambda df: ["c_custkey", N.normalize_phone_extension(F.concat(F.lit("415-555-0132 ext "), F.col("c_custkey").cast("string")))["ext"].alias("value")], "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS value FROM customer")
_col("canonical_string", "documents", "doc_id", lambda: N.canonical_string(_text()), f"lower(regexp_replace(regexp_replace(text, '^[{C.WS_TRIM}]+|[{C.WS_TRIM}]+$', '', 'g'), '[{C.WS_TRIM}]+', ' ', 'g'))")
_col("to_integer", "orders", "o_orderkey", lambda: N.to_integer(F.concat(F.lit(" "), F.format_number(F.col("o_orderkey"), 0), F.lit(" "))), "CAST(o_orderkey AS BIGINT)")
_col("to_integer_hex", "orders", "o_orderkey", lambda: N.to_integer(F.concat(F.lit("0x"), F.hex("o_orderkey"))), "CAST(o_orderkey AS BIGINT)")
_col("to_integer_typed", "part", "p_partkey", lambda: N.to_integer(F.floor(F.col("p_retailprice")).cast("double") + F.col("p_size") % 2 / 2), "CASE WHEN p_size % 2 = 0 THEN CAST(floor(p_retailprice) AS BIGINT) END")
_col("to_boolean_number", "part", "p_partkey", lambda: N.to_boolean(F.col("p_size") - 1, "string"), "CASE WHEN p_size <> 1 THEN 'true' ELSE 'false' END")
# a number under 1e12 is read as seconds, so milliseconds before September 2001 are out of range
_col("normalize_date_number", "orders", "o_orderkey", lambda: N.normalize_date(F.unix_millis(F.col("o_orderdate").cast("timestamp")) / F.when(F.col("o_orderkey") % 2 == 0, 1000).otherwise(1)),
     "CASE WHEN o_orderkey % 2 = 0 OR epoch_ms(o_orderdate) >= 1000000000000 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') END")
_col("to_float", "customer", "c_custkey", lambda: N.to_float(F.col("c_acctbal").cast("decimal(12,2)").cast("string")), "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE)")
_col("to_boolean", "labels", "doc_id", lambda: N.to_boolean(F.col("quality")), "quality = 1")
_col("to_date", "orders", "o_orderkey", lambda: N.to_date(F.date_format("o_orderdate", "dd.MM.yyyy")).cast("date"), "CAST(o_orderdate AS DATE)")
_col("number_to_string", "part", "p_partkey", lambda: N.number_to_string(F.col("p_retailprice")), r"regexp_replace(CAST(p_retailprice AS VARCHAR), '\.0$', '')")
_col("coerce_with_fallback", "orders", "o_orderkey", lambda: N.coerce_with_fallback(F.substring("o_orderpriority", 1, F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(9)), 7),
     "CAST(CASE WHEN o_orderkey % 2 = 0 AND regexp_matches(o_orderpriority, '^[0-9]') THEN substr(o_orderpriority, 1, 1) ELSE '7' END AS BIGINT)")

# Transforms
_col("mask", "customer", "c_custkey", lambda: T.mask(F.col("c_name"), start=2, end=3), "substr(c_name, 1, 2) || repeat('*', length(c_name) - 5) || right(c_name, 3)")
_col("redact", "customer", "c_custkey", lambda: T.redact(F.when(F.col("c_acctbal") > 0, F.col("c_name")), "<" + "hidden>"), "CASE WHEN c_acctbal > 0 THEN '<hidden>' END")
_col("hash_value", "customer", "c_custkey", lambda: T.hash_value(F.col("c_name"), length=16), "left(sha256(c_name), 16)")


def _hmac_sql(column: str, key: str) -> str:
    pads = [bytes(b ^ p for b in key.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({column}))))"


_col("hmac_value", "customer", "c_custkey", lambda: T.hmac_value(F.col("c_name"), "k1"), _hmac_sql("c_name", "k1"))
_col("tokenize", "customer", "c_custkey", lambda: T.tokenize(F.col("c_name")), f"'tok_' || left({_hmac_sql('c_name', T.DEFAULT_TOKEN_KEY)}, 16)")
_add("token_vault", "customer", None, f"SELECT DISTINCT 'tok_' || left({_hmac_sql('c_mktsegment', T.DEFAULT_TOKEN_KEY)}, 16) AS token, c_mktsegment AS value FROM customer", lambda df: T.vault(df, "c_mktsegment"))
_col("truncate", "documents", "doc_id", lambda: T.truncate(_text(), 20), "CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '…' ELSE text END")
_fit = "list_max(list_filter(range(0, 18), lambda k: strlen(substr(text, 1, k)) <= 17))"
_col("truncate_bytes", "documents", "doc_id", lambda: T.truncate(_text(), 20, by_bytes=True),
     f"CASE WHEN strlen(text) <= 20 THEN text ELSE substr(text, 1, {_fit}) || CASE WHEN strlen(substr(text, 1, {_fit})) < 17 THEN chr(65533) ELSE '' END || '…' END")
_col("replace_all", "documents", "doc_id", lambda: T.compile_replacements([("the", "THE"), ("", "x"), ("THE ", "_")])(_text()), "replace(replace(text, 'the', 'THE'), 'THE ', '_')")
_col("replace_pattern", "documents", "doc_id", lambda: T.replace_pattern(_text(), "([aeiou])n", "<$1>"), r"regexp_replace(text, '([aeiou])n', '<\1>')")
_col("filter_alnum", "pages", "page_id", lambda: T.filter_alnum(F.col("url"), "-"), "regexp_replace(url, '[^A-Za-z0-9-]', '', 'g')")
_col("filter_chars", "customer", "c_custkey", lambda: T.filter_chars(F.col("c_name"), lambda c: c.between("0", "9")), "regexp_replace(c_name, '[^0-9]', '', 'g')")
_col("map_chars", "customer", "c_custkey", lambda: T.map_chars(F.col("c_name"), lambda c, k: F.when(k % 2 == 0, F.upper(c)).otherwise(c)),
     "list_reduce(list_transform(range(1, length(c_name) + 1), lambda k: CASE WHEN k % 2 = 1 THEN upper(c_name[k]) ELSE c_name[k] END), lambda a, b: a || b)")
_col("with_default", "orders", "o_orderkey", lambda: T.with_default(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), "none"), "CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE 'none' END")
_col("null_if_empty", "orders", "o_orderkey", lambda: T.null_if_empty(F.translate("o_orderstatus", "O", " ")), "CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END")

# Detection: pattern types are native and comparable; the whole engine is tested against fixtures
for _kind in ("email", "ipv4", "uuid", "mac"):
    _p = D.PATTERNS[_kind].replace("'", "''")
    _col(f"detect_{_kind}", "documents", "doc_id", lambda k=_kind: F.array_join(D.extract(_text(), k), ","), f"array_to_string(regexp_extract_all(text, '{_p}'), ',')")
    _col(f"redact_{_kind}", "documents", "doc_id", lambda k=_kind: D.redact_native(_text(), k), f"regexp_replace(text, '{_p}', '[REDACTED]', 'g')")
_digits = "lpad(CAST(c_custkey * 7919 AS VARCHAR), 9, '0')"
_col("aba_check", "customer", "c_custkey", lambda: D.aba_check(F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "0")),
     f"(3 * (CAST({_digits}[1] AS INT) + CAST({_digits}[4] AS INT) + CAST({_digits}[7] AS INT)) + 7 * (CAST({_digits}[2] AS INT) + CAST({_digits}[5] AS INT) + CAST({_digits}[8] AS INT)) + CAST({_digits}[3] AS INT) + CAST({_digits}[6] AS INT) + CAST({_digits}[9] AS INT)) % 10 = 0 AND {_digits} <> '000000000'")
_pan = "'4000000' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')"
_luhn = "+".join(f"CASE WHEN {k} % 2 = 1 THEN (2 * CAST(({_pan})[{k}] AS INT)) // 10 + (2 * CAST(({_pan})[{k}] AS INT)) % 10 ELSE CAST(({_pan})[{k}] AS INT) END" for k in range(1, 17))
_col("luhn_check", "customer", "c_custkey", lambda: D.luhn_check(F.concat(F.lit("4000000"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))), f"({_luhn}) % 10 = 0")
_iban = "'GB' || lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0') || 'NWBK' || lpad(CAST(c_custkey AS VARCHAR), 14, '0')"
_col("iban_check", "customer", "c_custkey", lambda: D.iban_check(F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 98).cast("string"), 2, "0"), F.lit("NWBK"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))),
     "CAST('23321120' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || '1611' || lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1")
_add("emails_by_source_rollup", "documents", None,
     f"SELECT source, lang, CAST(sum(len(regexp_extract_all(text, '{D.PATTERNS['email']}'))) AS BIGINT) AS emails, count(*) AS docs FROM documents GROUP BY ROLLUP (source, lang)",
     lambda df: df.select("source", "lang", F.size(D.extract(_text(), "email")).alias("n")).rollup("source", "lang").agg(F.sum("n").alias("emails"), F.count("*").alias("docs")))

# Structured data
_json = S.Structured({"k": S.Rule(drop=True)})
_col("process_json_identity", "events", "event_id", lambda: S.process_json(F.col("props"), S.Structured()), "replace(props, ': ', ':')")
_col("process_json_drop", "events", "event_id", lambda: S.process_json(F.concat(F.lit('{"a":{"b":"'), F.col("event_type"), F.lit('","k":1},"k":"x","l":["'), F.col("event_type"), F.lit('"],"props":'), F.col("props"), F.lit("}")), _json),
     """'{"a":{"b":"' || event_type || '"},"l":["' || event_type || '"],"props":{}}'""")
_add("process_json_detailed", "events", None, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN replace(props, ': ', ':') END AS value, CASE WHEN event_id % 2 <> 0 THEN 'invalid-json' END AS error FROM events",
     lambda df: df.select("event_id", S.process_json_detailed(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("props", F.lit("{"))), S.Structured()).alias("r")).select("event_id", F.col("r.text").alias("value"), "r.error"))


def _kv() -> F.Column:
    return F.concat(F.lit("id="), F.col("c_custkey").cast("string"), F.lit(" secret="), F.col("c_mktsegment"), F.lit(" plain"))


_col("kv_drop", "customer", "c_custkey", lambda: codecs.kv_drop(_kv(), ["secret"]), "'id=' || c_custkey || ' plain'")
_col("process_kv", "customer", "c_custkey", lambda: S.process_kv(_kv(), S.Structured({"secret": S.Rule(case="lower")})), "'id=' || c_custkey || ' secret=' || lower(c_mktsegment) || ' plain'")
_col("csv_row", "part", "p_partkey", lambda: codecs.csv_row([F.col("p_name"), F.concat(F.col("p_brand"), F.lit(',"x"'))]), """p_name || ',"' || replace(p_brand || ',"x"', '"', '""') || '"'""")


def _csv() -> F.Column:
    return F.concat(F.lit("name,brand\n "), F.col("p_name"), F.lit(' ,"'), F.col("p_brand"), F.lit('"\n'))


_col("process_csv", "part", "p_partkey", lambda: S.process_csv(_csv(), S.Structured({"name": S.Rule(sanitize=T.Sanitize()), "brand": S.Rule(case="upper")})), "'name,brand' || chr(10) || trim(p_name) || ',' || upper(p_brand)")
_add("parse_csv", "part", None, "SELECT p_partkey, p_brand AS value FROM part", lambda df: df.select("p_partkey", codecs.parse_csv_column(_csv())[1][1].alias("value")))
_add("process_frame", "customer", None, "SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS c_name, c_nationkey, lower(c_mktsegment) AS c_mktsegment FROM customer",
     lambda df: S.process_frame(df, S.Structured({"c_name": S.Rule(mask={"start": 1}), "c_acctbal": S.Rule(drop=True), "c_mktsegment": S.Rule(case="lower")})))

# Validation
_schema = {"c_custkey": Field("integer", required=True, min=1), "c_name": Field("string", min_length=5, max_length=40, pattern="^Customer"), "c_acctbal": Field("number", min=0, max=9000), "c_mktsegment": Field("string", enum=("BUILDING", "MACHINERY"))}
_add("validate", "customer", None, """
    SELECT c_custkey, CAST(a + b + c + d + e + f AS BIGINT) AS issues, a + b + c + d + e + f = 0 AS ok FROM (
        SELECT c_custkey, CAST(c_custkey < 1 AS INT) AS a, CAST(length(c_name) < 5 OR length(c_name) > 40 AS INT) AS b, CAST(NOT regexp_matches(c_name, '^Customer') AS INT) AS c,
               CAST(c_acctbal < 0 OR c_acctbal > 9000 AS INT) AS d, CAST(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS INT) AS e, CAST(c_nationkey > 20 AS INT) AS f FROM customer)""",
     lambda df: df.select("c_custkey", validate(df, _schema, cross=[("c_nationkey", "nation", F.col("c_nationkey") <= 20)]).alias("v")).select("c_custkey", F.size("v.issues").cast("long").alias("issues"), "v.ok"))
_add("validate_record", "customer", None, "SELECT c_custkey, c_acctbal >= 0 AS ok FROM customer",
     lambda df: df.select("c_custkey", S.validate_record(df, S.Structured({"c_acctbal": S.Rule(validate=Field("number", required=True, min=0))}))["ok"].alias("ok")))
_add("process_frame_nested", "customer", None, "SELECT c_custkey, upper(c_mktsegment) AS segment, c_nationkey AS nation FROM customer",
     lambda df: S.process_frame(df.select("c_custkey", F.struct(F.lower("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")).alias("r")),
                                S.Structured({"r": S.Rule(nested=S.Structured({"segment": S.Rule(case="upper"), "name": S.Rule(drop=True)}))})).select("c_custkey", "r.*"))
_add("validation_report", "customer", None, """
    SELECT path, code, count(*) AS count FROM (
        SELECT unnest([CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN {'path': 'c_acctbal', 'code': 'range'} END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN {'path': 'c_mktsegment', 'code': 'enum'} END, CASE WHEN c_custkey < 1 THEN {'path': 'c_custkey', 'code': 'range'} END]) AS i FROM customer
    ) t, LATERAL (SELECT i.path AS path, i.code AS code) WHERE i IS NOT NULL GROUP BY path, code""", lambda df: df.select(F.explode(validate(df, _schema)["issues"]).alias("i")).groupBy("i.path", "i.code").count())

# Policies and profiles
_col("policy_pipeline", "documents", "doc_id", lambda: P.process_text(_text(), P.Policy(case="lower", scrub=None, truncate=P.Truncate(50))), f"CASE WHEN length({_clean}) > 50 THEN substr(lower({_clean}), 1, 50) || '…' ELSE lower({_clean}) END")
_add("compiled_policy", "customer", None, "SELECT c_custkey, '[' || lower(c_name) || ']' AS who FROM customer",
     lambda df: CompiledPolicy(P.Policy(case="lower", scrub=None)).process_value(df.select("c_custkey", F.concat(F.lit(" ["), F.col("c_name"), F.lit("]")).alias("who"))))
# Around the row-wise core: deduplication by canonical key, joins on hashed keys, streams
_add("dedupe_canonical", "documents", None, f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {ORACLES['canonical_string'][len('SELECT doc_id, '):].split(' AS value')[0]} AS k FROM documents) GROUP BY k",
     lambda df: df.select("doc_id", F.xxhash64(N.canonical_string(_text())).alias("h"), F.md5(N.canonical_string(_text())).alias("k")).groupBy("h", "k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies"))


def _hashed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda c: T.hmac_value(F.col(c).cast("string"), "join-key")
    left = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders")).select(token("o_custkey").alias("who"), "orders")
    right = table(spark, sf_dir, "customer").select(token("c_custkey").alias("who"), "c_mktsegment")
    return left.join(right, "who").groupBy("c_mktsegment").agg(F.sum("orders").alias("orders"))


QUERIES["join_on_hashed_key"] = _hashed_join
ORACLES["join_on_hashed_key"] = "SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sanitiser over a stream of the documents' files, written to the shared folder and read back."""
    path = shared_path(spark, "limpid-stream")
    source = table(spark, sf_dir, "documents")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet" if whole else "documents.parquet")
    stream = reader.parquet(f"{sf_dir}/documents.parquet" if whole else sf_dir)
    policy = P.Policy(scrub=None)
    done = apply_policy(stream.select("doc_id", "text"), {"text": policy}).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    done.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", F.col("text").alias("value"))


QUERIES["stream_sanitize"] = _streamed
ORACLES["stream_sanitize"] = ORACLES["sanitize_documents"]

from limpid.plans import finding_queries, more_queries  # noqa: E402

for _more in (finding_queries, more_queries):
    QUERIES |= _more.QUERIES
    ORACLES |= _more.ORACLES
