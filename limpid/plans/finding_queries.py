"""Queries of detection, scrubbing and the policies that scrub, with the SQL of ``finding_sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions import detect as D
from limpid.functions import text as T
from limpid.operators import policy as P
from limpid.operators.scrub import Action, ScrubPolicy, findings_report, scrub, scrub_detailed
from limpid.plans import finding_sql as Q
from limpid.plans.base import Query, clean_sql, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_DOCUMENTS = "SELECT doc_id AS id, text FROM documents"


def _add(name: str, source: str, frame: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: frame(table(spark, sf_dir, source))
    ORACLES[name] = sql


# Each type by itself at each level, over texts that hold it and texts that nearly do. The texts are SQL of both dialects.
_k = "cast(c_custkey as string)"
_n = lambda size, by=1, plus=0: f"right(concat('{'0' * size}', cast(c_custkey * {by} + {plus} as string)), {size})"
_x = lambda size, at=1: f"substr(md5({_k}), {at}, {size})"
_pick = lambda *texts: "case c_custkey % " + f"{len(texts)} " + " ".join(f"when {i} then {t}" for i, t in enumerate(texts)) + " end"
_SAMPLES = {
    "email": _pick(f"concat('write to u.', {_k}, '+x@ex-7.co.org, now')", f"concat('a@b', {_k}, ' and @x')", f"concat({_k}, '@host.x1 c@d.museum')"),
    "phone": _pick(f"concat('call +1 (415) 555-', {_n(4)}, '.')", f"concat('00', {_n(9, 7919, 100000)}, ' or ', {_n(6)})", f"concat('tel 415-555-', {_n(4)}, ' / 12:30')", f"concat('no ', {_n(9, 991)}, ', (020) 7946 ', {_n(4)})", f"concat('ref ', {_n(4)}, '-', {_n(4)}, ' x ', {_n(12, 99991)})"),
    "card": _pick(f"concat('pay 4111 1111 1111 1111 or 4000000', {_n(9)})", f"concat('5500-0000-0000-', {_n(4)}, ' x')", f"concat('3782822463', {_n(5)}, 'a 30569309025904 ', {_k})"),
    "iban": _pick(f"concat('to GB', {_n(2, 7)}, ' NWBK 6016 1331 9268 19 or GB29 NWBK 6016 1331 9268 19')", f"concat('DE', {_n(2)}, '370400440532013', {_n(3)}, '; DE89370400440532013000.')"),
    "bankAcct": _pick(f"concat('routing 021000021 ', {_n(9, 7919)})", f"concat('account no: ', {_n(8, 17)}, ' acct ', {_n(5)})", f"concat('a/c # ', {_n(17, 1234577)}, ' or ', {_n(9, 123457)})"),
    "ssn": _pick(f"concat(right({_n(3, 37)}, 3), '-', {_n(2, 3)}, '-', {_n(4)})", f"concat('id ', {_n(3, 41)}, ' ', {_n(2)}, ' ', {_n(4)})", f"concat('n', {_n(9, 654321)}, ' ', {_n(9, 654321)})"),
    "passport": _pick(f"concat('Passport no AB', {_n(7)})", f"concat('part AB', {_n(7)})", f"concat('my passport, then {'x ' * 30}C', {_n(6)}, ' D', {_n(5)})"),
    "license": _pick(f"concat('Driver id AB', {_n(6)})", f"concat('lot AB', {_n(6)})", f"concat('licence ', {_n(4)}, '-', {_n(3)}, '-', {_n(4)})", f"concat('DL# X', {_n(5)}, ' {'y ' * 40}Z', {_n(5)})"),
    "ipv4": _pick(f"concat('from 10.0.', cast(c_custkey % 300 as string), '.', cast(c_custkey % 260 as string), ':80')", f"concat('v1.2.3 ', {_k}, '.1.1.1.1')"),
    "ipv6": _pick(f"concat('at 2001:db8:0:0:0:0:0:', {_x(4)}, ' ok')", f"concat('fe80::', {_x(3)}, ' ::1 ', {_x(2)}, '::')", f"concat('time 12:34:', {_n(2)}, ' std::x a:b')"),
    "mac": _pick(f"concat('if ', {_x(2)}, ':', {_x(2, 3)}, ':', {_x(2, 5)}, ':', {_x(2, 7)}, ':', {_x(2, 9)}, ':', {_x(2, 11)}, ' up')", f"concat('AA-BB-CC-DD-EE-', upper({_x(2)}), ' aa:bb:cc:dd:ee')"),
    "uuid": _pick(f"concat('id ', {_x(8)}, '-', {_x(4, 9)}, '-', {_x(4, 13)}, '-', {_x(4, 17)}, '-', {_x(12, 21)}, '!')", f"concat({_x(8)}, '-', {_x(4)}, '-', {_x(4)}, '-', {_x(4)}, '-', {_x(11)}, ' g')"),
    "urlSensitive": _pick(f"concat('see https://user:p', {_k}, '@ex.com/a, or')", f"concat('HTTP://ex.com/?a=1&Token=', {_k}, '.')", f"concat('https://ex.com/', {_k}, '?page=2 https://a@b/')", f"concat('(http://x.y/z?q=', {_k}, '#pwd=1)')"),
    "dob": _pick(f"concat('DOB: 19', {_n(2)}, '-05-17')", f"concat('born 05/17/20', {_n(2)}, ' or 17.05.19', {_n(2)})", f"concat('built 19', {_n(2)}, '/05/17')", f"concat('date of birth {'z ' * 28}19', {_n(2)}, '.12.31')"),
    "postal": _pick(f"concat('zip ', {_n(5)}, '-', {_n(4)})", f"concat('postal code ', {_n(5)}, ' x ', {_n(6)})", f"concat('lot ', {_n(5)}, ' SW', cast(c_custkey % 10 as string), 'A 1AA')", f"concat('pin code {'w ' * 18}', {_n(5)}, ' EC1A1BB')"),
    "personName": _pick(f"concat('Dr. Ada Lovelace ', {_k})", "concat('customer: Grace Brewster Hopper x')", f"concat('mr smith ', {_k}, ' name Bob')"),
    "address": _pick(f"concat('at ', {_k}, ' Long Acre Street, now')", f"concat({_k}, ' High Rd. ', {_k}, ' nowhere')"),
    "bearer": _pick(f"concat('Authorization: Bearer abc.def~', {_n(12)}, '== x')", f"concat('bearer ', {_n(12)})"),
    "jwt": _pick(f"concat('x eyJh', {_x(4)}, '.', {_x(8)}, '.', {_x(8)}, ' y')", f"concat('eyJh', {_x(4)}, '.', {_x(8)})"),
    "privateKey": _pick(f"concat('a -----BEGIN RSA PRIVATE KEY-----\n', {_x(32)}, '\n-----END RSA PRIVATE KEY----- b')", f"concat('-----BEGIN PRIVATE KEY-----', {_x(32)}, ' -----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----')", f"concat('-----BEGIN PUBLIC KEY-----', {_x(9)})"),
    "aws": _pick(f"concat('AKIA', upper({_x(16)}), ' x')", f"concat('ASIA', upper({_x(16)}), 'Z AKIA', {_n(9)})"),
    "gcp": _pick(f"concat('AIza', {_x(32)}, 'a-_ x')", f"concat('AIza', {_x(32)}, ' x')"),
    "github": _pick(f"concat('ghp_', {_x(32)}, {_x(8)}, ' github_pat_', {_x(22)})", f"concat('ghp_', {_x(32)}, ' ghx_', {_x(32)}, 'abcdef')"),
    "gitlab": _pick(f"concat('glpat-', {_x(20)}, '.')", f"concat('glpat-', {_x(19)}, ' ')"),
    "slack": _pick(f"concat('xoxb-', {_x(10)}, ' ')", f"concat('xoxb-', {_x(9)}, ' xoxz-', {_x(12)})"),
    "stripe": _pick(f"concat('sk_live_', {_x(16)}, ' pk_test_', {_x(20)})", f"concat('sk_live_', {_x(15)}, ' sk_prod_', {_x(16)})"),
    "openai": _pick(f"concat('sk-', {_x(20)}, ' ')", f"concat('sk-', {_x(19)}, ' ask-', {_x(20)})"),
    "genericKey": _pick(f"concat('Api_Key = \"', {_x(16)}, '\"')", f"concat('password: ', {_x(15)})", f"concat('access-key=', {_x(32)}, ' token ', {_x(32)})"),
    "urlCreds": _pick(f"concat('ftp://me:', {_x(8)}, '@host/x y')", f"concat('ftp://host/', {_x(8)}, ' http://me@host')"),
}
_LEVELS = ("strict", "balanced", "loose")


def _spans(kind: str, level: str) -> Column:
    found = D.detect(F.col("text"), D.Detect(((kind, level),)))
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["start"], f["end"], f["confidence"])), ",").alias(level)


def _type_sql(kind: str, sample: str) -> str:
    source = f"SELECT c_custkey AS id, {sample} AS text FROM customer"
    shown = "array_to_string(list_transform(kept, lambda f: f.a || ':' || f.b || ':' || f.c), ',')"
    each = [f"({Q.findings(source, ((kind, lv),))} SELECT id, {shown} AS {lv} FROM found) AS t_{lv}" for lv in _LEVELS]
    return f"SELECT id AS c_custkey, strict, balanced, loose FROM {each[0]} JOIN {each[1]} USING (id) JOIN {each[2]} USING (id)"


for _kind, _sample in _SAMPLES.items():
    _add(f"find_{_kind}", "customer", lambda df, k=_kind, s=_sample: df.selectExpr("c_custkey", f"{s} AS text").select("c_custkey", *[_spans(k, lv) for lv in _LEVELS]), _type_sql(_kind, _sample))

# All types together
_HITS = "SELECT id AS doc_id, h.kind AS type, h.a AS start, h.b AS \"end\", h.c AS confidence FROM (SELECT id, unnest(kept) AS h FROM found)"
for _level in _LEVELS:
    _add(f"detect_all_{_level}", "documents", lambda df, lv=_level: df.select("doc_id", F.explode(D.detect(F.col("text"), D.Detect.of(lv))).alias("f")).select("doc_id", "f.*"), Q.findings(_DOCUMENTS, D.Detect.of(_level).levels) + _HITS)
_add("detect_secrets", "documents", lambda df: df.select("doc_id", F.explode(D.detect(F.col("text"), D.Detect.of(pii=False))).alias("f")).select("doc_id", "f.*"), Q.findings(_DOCUMENTS, D.Detect.of(pii=False).levels) + _HITS)
_add("findings_report", "documents", lambda df: findings_report(df, "text"),
     Q.findings(_DOCUMENTS, D.Detect.of().levels) + "SELECT kind AS type, count(*) AS findings, count(DISTINCT id) AS rows FROM (SELECT id, unnest(kept).kind AS kind FROM found) GROUP BY kind")
# texts in which findings of many types touch and overlap
_CROWD = " || ' ' || ".join(f"({_SAMPLES[k]})" for k in ("bankAcct", "urlSensitive", "urlCreds", "card", "phone", "genericKey", "iban", "ssn", "email", "postal", "dob", "ipv6", "personName", "address"))
_CROWDED = f"SELECT c_custkey AS id, {_CROWD} AS text FROM customer"
for _level in _LEVELS:
    _what = D.Detect.of(_level, enabled={})
    _add(f"resolve_overlaps_{_level}", "customer", lambda df, w=_what: df.selectExpr("c_custkey AS doc_id", f"{_CROWD} AS text").select("doc_id", F.explode(D.detect(F.col("text"), w)).alias("f")).select("doc_id", "f.*"), Q.findings(_CROWDED, _what.levels) + _HITS)


def _hmac(value: str, key: str) -> str:
    pads = [bytes(b ^ p for b in key.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]
    return f"sha256(unhex('{pads[1]}') || unhex(sha256(unhex('{pads[0]}') || encode({value}))))"


def _scrub(name: str, policy: ScrubPolicy, value: str, source: str = _DOCUMENTS, column: str = "text") -> None:
    """A scrub query over documents, or over the crowded texts, and its SQL: ``value`` stands for a finding."""
    crowd = source == _CROWDED
    key, origin = ("c_custkey", "customer") if crowd else ("doc_id", "documents")
    made = lambda df: df.selectExpr(f"{key}", f"{_CROWD} AS text") if crowd else df
    _add(name, origin, lambda df: made(df).select(key, scrub(F.col("text"), policy).alias("value")), Q.findings(source, policy.what().levels) + f"SELECT id AS {key}, {Q.scrubbed(value)} AS value FROM found")


_scrub("scrub_documents", ScrubPolicy(), "'[REDACTED]'")
_scrub("scrub_crowded", ScrubPolicy(), "'[REDACTED]'", _CROWDED)
_scrub("scrub_strict", ScrubPolicy("strict", default=Action("replace", placeholder="<$1>")), "'<$1>'", _CROWDED)
_scrub("scrub_mask", ScrubPolicy(default=Action("mask")), "repeat('*', length(raw))")
_scrub("scrub_mask_ends", ScrubPolicy(default=Action("mask", mask_char="#", preserve_start=2, preserve_end=3)), "CASE WHEN length(raw) <= 5 THEN raw ELSE substr(raw, 1, 2) || repeat('#', length(raw) - 5) || substr(raw, -3) END", _CROWDED)
_scrub("scrub_mask_fixed", ScrubPolicy(default=Action("mask", preserve_length=False)), "'********'", _CROWDED)
_scrub("scrub_hash", ScrubPolicy(default=Action("hash")), "left(sha256(raw), 12)")
_scrub("scrub_hmac", ScrubPolicy(default=Action("hmac", key="k", hmac_length=20)), f"left({_hmac('raw', 'k')}, 20)", _CROWDED)
_scrub("scrub_tokenize", ScrubPolicy(default=Action("tokenize")), f"'tok_' || left({_hmac('raw', T.DEFAULT_TOKEN_KEY)}, 12)")
_scrub("scrub_truncate", ScrubPolicy(default=Action("truncate")), "CASE WHEN length(raw) > 4 THEN substr(raw, 1, 4) || '…' ELSE raw END")
_scrub("scrub_drop", ScrubPolicy(default=Action("drop")), "''")
_scrub("scrub_pii_only", ScrubPolicy(secrets=False), "'[REDACTED]'", _CROWDED)
_scrub("scrub_secrets_only", ScrubPolicy(pii=False), "'[REDACTED]'", _CROWDED)
_add("scrub_keep", "documents", lambda df: df.select("doc_id", scrub(F.col("text"), ScrubPolicy(default=Action("keep"))).alias("value")), "SELECT doc_id, text AS value FROM documents")
_scrub("scrub_email_only", ScrubPolicy(types={k: Action(enabled=False) for k in (*D.PII_TYPES, *D.SECRET_TYPES) if k != "email"}), "'[REDACTED]'")
_scrub("scrub_mixed_levels", ScrubPolicy(types={"phone": Action(level="strict"), "license": Action(level="loose"), "card": Action("hmac", key="k"), "email": Action("keep"), "personName": Action(enabled=True)}),
       f"CASE kind WHEN 'card' THEN left({_hmac('raw', 'k')}, 12) WHEN 'email' THEN raw ELSE '[REDACTED]' END", _CROWDED)
_scrub("scrub_inherited", ScrubPolicy(default=Action("hash", hash_length=6), types={"email": Action(hash_length=20), "ipv6": Action("mask"), "ssn": Action(level="strict")}),
       "CASE kind WHEN 'email' THEN left(sha256(raw), 20) WHEN 'ipv6' THEN repeat('*', length(raw)) ELSE left(sha256(raw), 6) END", _CROWDED)
_add("scrub_detailed", "documents", lambda df: df.select("doc_id", scrub_detailed(F.col("text"), ScrubPolicy(types={"ipv4": Action("keep")})).alias("r")).select("doc_id", "r.text", F.size("r.findings").alias("n"), "r.redactedCount"),
     Q.findings(_DOCUMENTS, ScrubPolicy().what().levels) + f"SELECT id AS doc_id, {Q.scrubbed(chr(67) + 'ASE WHEN kind = ' + Q.quoted('ipv4') + ' THEN raw ELSE ' + Q.quoted('[REDACTED]') + ' END')} AS text, CAST(len(kept) AS INTEGER) AS n, CAST(len(list_filter(kept, lambda f: f.kind <> 'ipv4')) AS INTEGER) AS \"redactedCount\" FROM found")

# Policies that scrub: what is cleaned is the source of the findings
_CONVERSATIONS = "conv_id * 1000 + turn"


def _cleaned(column: str, form: bool, most: int, **options) -> str:
    return clean_sql(f"nfc_normalize({column})" if form else column, most, **options)


_SCRUBBING = {
    "freeText": (_cleaned("text", True, 10_000), "'[REDACTED]'"),
    "logData": (clean_sql("text", 100_000, collapse=False, trim=False), "'[REDACTED]'"),
    "llmInput": (_cleaned("text", True, 50_000), "'[REDACTED]'"),
    "analytics": (_cleaned("text", True, 10_000), "left(sha256(raw), 16)"),
}
for _name, (_sql, _value) in _SCRUBBING.items():
    _source = f"SELECT doc_id AS id, {_sql} AS text FROM documents"
    _add(f"profile_{_name}", "documents", lambda df, p=_name: df.select("doc_id", P.process_text(F.col("text"), P.PROFILES[p]).alias("value")), Q.findings(_source, ScrubPolicy().what().levels) + f"SELECT id AS doc_id, {Q.scrubbed(_value)} AS value FROM found")
QUERIES["policy_free_text"], ORACLES["policy_free_text"] = QUERIES["profile_freeText"], ORACLES["profile_freeText"]
