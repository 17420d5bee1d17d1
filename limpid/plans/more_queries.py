"""Queries of profiles, field rules, validation, codecs, files and SQL functions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from limpid.functions import charsets as C
from limpid.functions import normalize as N
from limpid.functions import text as T
from limpid.functions.sql import register
from limpid.operators import policy as P
from limpid.operators import structured as S
from limpid.operators.scrub import ScrubPolicy
from limpid.operators.validate import Field, validate, validate_value
from limpid.plans.base import Query, clean_sql, shared_path, table
from limpid.sources import codecs

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, source: str, frame: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: frame(table(spark, sf_dir, source))
    ORACLES[name] = sql


def _value(name: str, source: str, key: str, given: str, fn: Callable, sql: str) -> None:
    """(key, value): ``fn`` of the text ``given``, which is SQL of both dialects; ``sql`` is over ``s``."""
    _add(name, source, lambda df: df.selectExpr(key, f"{given} AS s").select(key, fn(F.col("s")).alias("value")), f"SELECT {key}, {sql} AS value FROM (SELECT *, {given} AS s FROM {source})")


# Profiles; those that scrub are with the findings
_TURN = "conv_id * 1000 + turn AS id"
for _name, _sql in {
    "email": "lower(" + clean_sql("nfc_normalize(text)", 254, collapse=False) + ")",
    "url": clean_sql("text", 2048, collapse=False),
    "humanName": clean_sql("nfc_normalize(text)", 100),
}.items():
    _add(f"profile_{_name}", "conversations", lambda df, p=_name: df.selectExpr(_TURN, "text").select("id", P.process_text(F.col("text"), P.PROFILES[p]).alias("value")), f"SELECT {_TURN}, {_sql} AS value FROM conversations")
_gap = "chr(57344)"  # stands for the empty separator, which counts as a character
_value("profile_identifier", "customer", "c_custkey", "concat('  ', c_name, ' _X_ ', c_mktsegment, repeat(' ab', c_custkey % 50 + 1), ' ')", lambda c: P.process_text(c, P.PROFILES["identifier"]),
       f"lower(replace(substr(regexp_replace(trim(s), '[{C.WS}]+', {_gap}, 'g'), 1, 128), {_gap}, ''))")
_value("profile_phone", "customer", "c_custkey", "case when c_custkey % 3 = 0 then concat(' 00 (415) 555-', right(concat('000', cast(c_custkey as string)), 4)) when c_custkey % 3 = 1 then c_name else concat('+1.415.', cast(c_custkey as string)) end",
       lambda c: P.process_text(c, P.PROFILES["phone"]), "CASE WHEN c_custkey % 3 = 0 THEN '+' || regexp_replace(substr(s, 4), '[^0-9]', '', 'g') WHEN c_custkey % 3 = 1 OR length(s) < 10 THEN trim(s) ELSE '+1415' || c_custkey END")
_value("profile_numeric", "customer", "c_custkey", "case when c_custkey % 2 = 0 then concat(' +1,', right(concat('00', cast(c_custkey as string)), 3), '.50') else c_mktsegment end", lambda c: P.process_text(c, P.PROFILES["numeric"]),
       "CASE WHEN c_custkey % 2 = 0 THEN '1' || right('00' || c_custkey, 3) || '.5' ELSE s END")
for _name, _given, _sql in (
    ("identifier", "case when c_custkey % 3 = 0 then lower(c_mktsegment) when c_custkey % 3 = 1 then '' else repeat('a', 120 + c_custkey % 20) end", "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'minLength,pattern' ELSE CASE WHEN length(s) > 128 THEN 'maxLength' ELSE '' END END"),
    ("email", "case when c_custkey % 2 = 0 then concat(repeat('a', c_custkey % 300), 'x@b.co') else concat('x@', c_name) end", "CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN length(s) > 254 THEN 'maxLength,format' ELSE '' END ELSE 'format' END"),
    ("phone", "concat('tel ', repeat('1', c_custkey % 20))", "CASE WHEN c_custkey % 20 BETWEEN 7 AND 15 THEN '' ELSE 'format' END"),
    ("url", "case when c_custkey % 2 = 0 then concat('https://ex.org/', c_name) else concat('http://', repeat('a', c_custkey % 3), '.org/') end", "CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN contains(s, ' ') THEN 'format' ELSE '' END WHEN c_custkey % 3 = 0 THEN 'format' ELSE '' END"),
    ("humanName", "substr(repeat(c_name, 10), 1, c_custkey % 150)", "CASE WHEN s = '' THEN 'minLength' WHEN length(s) > 100 THEN 'maxLength' ELSE '' END"),
    ("numeric", "repeat('1', c_custkey % 80)", "CASE WHEN length(s) > 64 THEN 'maxLength' ELSE '' END"),
):
    _value(f"profile_validate_{_name}", "customer", "c_custkey", _given, lambda c, p=_name: F.array_join(F.transform(P.validate_text(c, P.PROFILES[p])["issues"], lambda i: i["code"]), ","), _sql)
_merged = P.merge(P.PROFILES["humanName"], sanitize={"max_chars": 5}, case="upper", truncate=P.Truncate(3, "~"))
_value("policy_merge", "customer", "c_custkey", "concat(' ', c_mktsegment)", lambda c: P.process_text(c, _merged), "substr(upper(trim(s)), 1, 3) || '~'")
_value("policy_coerce_uuid", "customer", "c_custkey", "case when c_custkey % 2 = 0 then concat('{', upper(md5(c_name)), '}') else c_name end", lambda c: P.process_text(c, P.Policy(coerce="uuid", scrub=None)),
       "CASE WHEN c_custkey % 2 = 0 THEN substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21) ELSE s END".replace("md5(c_name)", "lower(regexp_replace(s, '[{}]', '', 'g'))"))

# Sanitising and transforms
_value("sanitize_bidi_only", "customer", "c_custkey", "concat('a\u202eb\u200b', c_name)", lambda c: T.sanitize(c, T.Sanitize(zero_width=False)), "'ab' || chr(8203) || c_name")
_value("sanitize_keep_bidi", "customer", "c_custkey", "concat('a\u202eb\u200b', c_name)", lambda c: T.sanitize(c, T.Sanitize(zero_width=False, bidi=False)), "s")
_value("sanitize_regex", "customer", "c_custkey", "c_name", lambda c: T.sanitize(c, T.Sanitize(allow="[a-z0-9]", block="[05]", regex=True, replacement="?")), "regexp_replace(s, '[^a-z1-46-9]', '?', 'g')")
_value("sanitize_log", "customer", "c_custkey", "concat('  ', c_name, chr(9), c_name, '  ')", lambda c: T.sanitize(c, T.Sanitize(collapse=None, max_chars=25)), "rtrim(substr(ltrim(s), 1, 25), ' ' || chr(9))")
_value("pipe", "customer", "c_custkey", "c_name", lambda c: T.pipe(T.upper, lambda x: T.replace_all(x, "0", ""), lambda x: T.truncate(x, 10, "."))(c), "CASE WHEN length(replace(s, '0', '')) > 10 THEN substr(replace(upper(s), '0', ''), 1, 10) || '.' ELSE replace(upper(s), '0', '') END")
_value("mask_fixed", "customer", "c_custkey", "substr(c_name, 1, c_custkey % 6)", lambda c: T.mask(c, start=1, end=1, keep_length=False), "CASE WHEN length(s) <= 2 THEN s ELSE '********' END")
_value("normalize_phone_prefix", "customer", "c_custkey", "concat(case when c_custkey % 2 = 0 then '1 ' else '' end, '(415) 55', right(concat('00000', cast(c_custkey as string)), 5))", lambda c: N.normalize_phone(c, "+1"),
       "'+1' || regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN substr(s, 2) ELSE s END, '[^0-9]', '', 'g')")
_add("normalize_phone_ext", "customer", lambda df: df.selectExpr("c_custkey", "concat('415-555-0132', element_at(array(' ext: ', ' x', '#', ' Ext .:'), cast(c_custkey % 4 + 1 as int)), cast(c_custkey as string)) AS s").select("c_custkey", N.normalize_phone_extension(F.col("s")).alias("r")).select("c_custkey", "r.number", "r.ext"),
     "SELECT c_custkey, '4155550132' AS number, CAST(c_custkey AS VARCHAR) AS ext FROM customer")

# Field rules
_entries = lambda df: df.select("c_custkey", F.create_map(F.lit("name"), F.col("c_name"), F.lit("pin"), F.lit("1234"), F.lit("seg.ment"), F.col("c_mktsegment")).alias("m"))
_map_rules = S.Structured({"m.pin": S.Rule(drop=True), "*.ment": S.Rule(case="lower"), "name": S.Rule(mask={"start": 1})})
_add("rules_in_map", "customer", lambda df: S.process_frame(_entries(df), _map_rules).select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "&").alias("value")),
     "SELECT c_custkey, 'name=' || substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) || '&seg.ment=' || lower(c_mktsegment) AS value FROM customer")
_add("rules_of_elements", "customer", lambda df: S.process_frame(df.select("c_custkey", F.array("c_name", "c_mktsegment", F.lit("x a@b.co")).alias("l")), S.Structured({"l[0]": S.Rule(drop=True), "l[1]": S.Rule(case="lower"), "l[2]": S.Rule(scrub=ScrubPolicy())})).select("c_custkey", F.col("l")[0].alias("a"), F.col("l")[1].alias("b"), F.col("l")[2].alias("c")),
     "SELECT c_custkey, CAST(NULL AS VARCHAR) AS a, lower(c_mktsegment) AS b, 'x [REDACTED]' AS c FROM customer")
_add("rules_precedence", "customer", lambda df: S.process_frame(df.select("c_custkey", F.struct(F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"), F.lit(" ").alias("c")).alias("r")), S.Structured({"r.*": S.Rule(case="lower"), "a": S.Rule(replace="fixed", case="upper"), "*.r.b": S.Rule(drop=True), "r.c": S.Rule(default="none")})).select("c_custkey", "r.*"),
     "SELECT c_custkey, 'FIXED' AS a, lower(c_mktsegment) AS b, 'none' AS c FROM customer")
_value("process_json_rules", "customer", "c_custkey", """concat('{"u":{"name":"', c_name, '","pin":"', cast(c_custkey as string), '"},"l":["', c_mktsegment, '",1.50,null],"when":"03/05/2024","blank":"  "}')""",
       lambda c: S.process_json(c, S.Structured({"u": S.Rule(nested=S.Structured({"pin": S.Rule(drop=True), "name": S.Rule(case="upper")})), "l[0]": S.Rule(case="lower"), "when": S.Rule(coerce="date"), "blank": S.Rule(default="-")})),
       """'{"u":{"name":"' || upper(c_name) || '"},"l":["' || lower(c_mktsegment) || '",1.5,null],"when":"2024-03-05","blank":"-"}'""")
_value("process_csv_places", "customer", "c_custkey", "concat('h,i', chr(10), c_name, ',', c_mktsegment, ',', c_name)", lambda c: S.process_csv(c, columns=[S.Rule(case="upper"), S.Rule(drop=True)]), "'h,i' || chr(10) || upper(c_name) || ',,' || c_name")
_add("process_csv_errors", "customer", lambda df: df.select("c_custkey", S.process_csv_detailed(F.expr("case c_custkey % 3 when 0 then concat(c_name, '\"') when 1 then repeat('x\n', 4) else c_name end"), max_rows=2).alias("r")).select("c_custkey", "r.text", "r.error"),
     "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS text, CASE c_custkey % 3 WHEN 0 THEN 'invalid-csv' WHEN 1 THEN 'too-large' END AS error FROM customer")
_value("process_kv_fallback", "customer", "c_custkey", "concat('id=', c_name, ';x;k=', c_mktsegment, ';k=2')", lambda c: S.process_kv(c, S.Structured({"k": S.Rule(case="lower")}, fallback=S.Rule(mask={"end": 1})), separator=";"),
       "'id=' || repeat('*', length(c_name) - 1) || right(c_name, 1) || ';x;k=' || lower(c_mktsegment) || ';k=2'")

# Validation
_FORMAT = {
    "email": ("case when c_custkey % 2 = 0 then concat('u', cast(c_custkey as string), '@b..co') else concat('u@', cast(c_custkey as string)) end", "c_custkey % 2 = 0"),
    "uuid": ("case when c_custkey % 2 = 0 then concat('{', md5(c_name), '}') else substr(md5(c_name), 2) end", "c_custkey % 2 = 0"),
    "date": ("case when c_custkey % 3 = 0 then concat('2024-02-', right(concat('0', cast(c_custkey % 32 as string)), 2)) when c_custkey % 3 = 1 then c_name else '03/05/2024 10:30' end", "CASE c_custkey % 3 WHEN 0 THEN c_custkey % 32 BETWEEN 1 AND 29 WHEN 1 THEN false ELSE true END"),
    "url": ("concat(case c_custkey % 4 when 0 then 'HTTP://' when 1 then 'https://.' when 2 then 'ftp://' else 'https://' end, 'ex.org/', cast(c_custkey as string))", "c_custkey % 4 IN (0, 3)"),
    "ipv4": ("concat('10.0.', cast(c_custkey % 300 as string), '.1')", "c_custkey % 300 < 256"),
    "ipv6": ("concat(repeat('ab:', cast(c_custkey % 10 as int)), 'cd')", "c_custkey % 10 BETWEEN 2 AND 7"),
    "phone": ("concat('a', repeat('1 ', cast(c_custkey % 20 as int)))", "c_custkey % 20 BETWEEN 7 AND 15"),
}
for _name, (_given, _sql) in _FORMAT.items():
    _value(f"format_{_name}", "customer", "c_custkey", _given, lambda c, f=_name: validate_value(c, StringType(), Field(format=f))["ok"], _sql)
_nullable = lambda c: F.when(F.col("c_custkey") % 3 != 0, F.col(c))
_add("validate_codes", "customer", lambda df: (lambda d: d.select("c_custkey", F.array_join(F.transform(validate(d, {"n": Field(), "s": Field(nullable=True, max_length=8), "x": Field("number"), "r": Field(fields={"l": Field(items=Field("string", min_length=9))}), "gone": Field(required=True)}, no_unknown=True, max_issues=5)["issues"], lambda i: F.concat_ws("|", i["path"], i["code"], i["message"])), ";").alias("value")))(
    df.select("c_custkey", _nullable("c_name").alias("n"), _nullable("c_mktsegment").alias("s"), F.when(F.col("c_custkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("x"), F.struct(F.array("c_mktsegment").alias("l")).alias("r"))),
    """SELECT c_custkey, array_to_string(list_filter([
        CASE WHEN c_custkey % 3 = 0 THEN 'n|null|n must not be null' END, CASE WHEN c_custkey % 3 <> 0 AND length(c_mktsegment) > 8 THEN 's|maxLength|s is too long (length ' || length(c_mktsegment) || ')' END,
        CASE WHEN c_custkey % 2 = 0 THEN 'x|type|x must be number (got number)' END, CASE WHEN length(c_mktsegment) < 9 THEN 'r.l[0]|minLength|r.l[0] is too short (length ' || length(c_mktsegment) || ')' END,
        'gone|required|gone is required', 'c_custkey|unknown|c_custkey is not allowed'], lambda x: x IS NOT NULL)[1:5], ';') AS value FROM customer""")
_add("validate_types", "part", lambda df: df.select("p_partkey", *[validate_value(F.col(c), df.schema[c].dataType, Field(k))["ok"].alias(f"{c}_{k}") for c, k in (("p_size", "integer"), ("p_retailprice", "integer"), ("p_retailprice", "number"), ("p_name", "string"), ("p_name", "array"), ("p_size", "string"), ("p_name", "object"), ("p_size", "boolean"), ("p_name", "email"))]),
     "SELECT p_partkey, true AS p_size_integer, p_retailprice = floor(p_retailprice) AS p_retailprice_integer, true AS p_retailprice_number, true AS p_name_string, false AS p_name_array, false AS p_size_string, false AS p_name_object, false AS p_size_boolean, false AS p_name_email FROM part")


# Files
def _through(kind: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, "limpid-files")
        df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit(' "x", y')).alias("who"), "c_acctbal")
        codecs.write(df, path, kind, **options)
        return codecs.read(spark, path, kind, df.schema, **options).select("c_custkey", "who", "c_acctbal")

    return query


for _kind in ("parquet", "json", "csv", "orc"):
    QUERIES[f"files_{_kind}"] = _through(_kind)
    ORACLES[f"files_{_kind}"] = """SELECT c_custkey, c_name || ' "x", y' AS who, c_acctbal FROM customer"""


# SQL
def _in_sql(statement: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark)
        table(spark, sf_dir, "customer").createOrReplaceTempView("limpid_customer")
        return spark.sql(statement)

    return query


QUERIES["sql_functions"] = _in_sql("""
    SELECT c_custkey, text_sanitize(concat('  ', c_name, '  x ')) AS a, text_mask(c_name, 1, 2) AS b, text_hash(c_name, 8) AS c, text_scrub(concat(c_mktsegment, ' a@b.co')) AS d, text_fold(c_mktsegment) AS e,
           text_number('1.000,50') AS f, text_integer(concat(' ', cast(c_custkey as string), ' ')) AS g, text_boolean('Yes') AS h, text_date('03/05/2024') AS i, text_phone('+1 (415) 555-0132') AS j,
           text_uuid(upper(md5(c_name))) AS k, text_truncate(c_name, 4) AS l, text_alnum(c_name) AS m, text_token(c_name) AS n FROM limpid_customer""")
ORACLES["sql_functions"] = f"""
    SELECT c_custkey, c_name || ' x' AS a, substr(c_name, 1, 1) || repeat('*', length(c_name) - 3) || right(c_name, 2) AS b, left(sha256(c_name), 8) AS c, c_mktsegment || ' [REDACTED]' AS d, lower(c_mktsegment) AS e,
           '1000.5' AS f, c_custkey AS g, true AS h, '2024-03-05' AS i, '+14155550132' AS j,
           substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21) AS k,
           substr(c_name, 1, 4) || '…' AS l, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS m, 'tok_' || left({{hmac}}, 16) AS n FROM customer"""
QUERIES["sql_explode_findings"] = _in_sql("SELECT c_custkey, f.type, f.start, f.end FROM limpid_customer, LATERAL explode_findings(concat(c_mktsegment, ' a@b.co')) f")
ORACLES["sql_explode_findings"] = "SELECT c_custkey, 'email' AS type, CAST(length(c_mktsegment) + 1 AS INTEGER) AS start, CAST(length(c_mktsegment) + 7 AS INTEGER) AS \"end\" FROM customer"


def _hmac(value: str, key: str) -> str:
    pads = [bytes(b ^ p for b in key.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({value}))))"


ORACLES["sql_functions"] = ORACLES["sql_functions"].replace("{hmac}", _hmac("c_name", T.DEFAULT_TOKEN_KEY))
