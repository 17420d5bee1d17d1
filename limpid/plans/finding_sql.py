"""Detection and scrubbing as DuckDB SQL, to check the engine by: the findings of every type from its
pattern and its conditions, overlaps resolved, and what scrubbing makes of a text.

Only the patterns are shared with ``limpid.functions.detect``; look-around and checksums are said anew.
"""

from __future__ import annotations

import re

from limpid.functions import detect as D

_PATTERNS = D.PATTERNS | {
    # without look-ahead, which the dialect lacks
    "ssn": r"\b(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])[ -]?(?:0[1-9]|[1-9][0-9])[ -]?(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})\b",
}
_SECRETS = D.SECRETS | {"privateKey": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:-{0,4}[^-])*-----END [A-Z ]{0,40}PRIVATE KEY-----"}
_SPACE = r"[ \t\n\x0B\f\r]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _near(size: int, words: tuple[str, ...]) -> str:
    part = f"substr(low, greatest(pos - {size}, 0) + 1, pos + {size} - greatest(pos - {size}, 0))"
    return "(" + " OR ".join(f"contains({part}, {quoted(w)})" for w in words) + ")"


def _luhn(digits: str) -> str:
    twice = f"2 * CAST(reverse({digits})[k] AS INT)"
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 0 THEN ({twice}) // 10 + ({twice}) % 10 ELSE CAST(reverse({digits})[k] AS INT) END)) % 10 = 0"


def _iban(s: str) -> str:
    turned = f"substr({s}, 5) || substr({s}, 1, 4)"
    values = f"list_transform(string_split({turned}, ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))"
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), {values}), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"


def _aba(s: str) -> str:
    return f"({' + '.join(f'{w} * CAST({s}[{k}] AS INT)' for k, w in enumerate((3, 7, 1) * 3, 1))}) % 10 = 0 AND {s} <> '000000000'"


def _by_level(level: str, strict: str, balanced: str, loose: str) -> str:
    return {"strict": strict, "balanced": balanced, "loose": loose}[level]


def _rules(kind: str, level: str) -> list[tuple[str, int, str, str, str]]:
    """(pattern, group, start, end, confidence) of a type: of each match ``raw`` with its group ``own`` at offset ``pos``."""
    whole = ("pos", "pos + length(raw)")
    lax = level != "strict"
    if kind in _SECRETS:
        return [(_SECRETS[kind], 0, *whole, str(D.SECRET_CONFIDENCE.get(kind, 0.95)))]
    simple = {"ipv4": "0.9", "mac": "0.9", "uuid": "0.95", "address": "0.6", "ipv6": "CASE WHEN length(raw) >= 3 THEN 0.85 END"}
    if kind in simple:
        return [(_PATTERNS[kind], 0, *whole, simple[kind])]
    if kind == "email":
        return [(_PATTERNS[kind], 0, *whole, rf"CASE WHEN length(raw) > 254 THEN NULL WHEN regexp_matches(raw, '\.[A-Za-z]{{2,24}}$') THEN 0.92 WHEN {lax} THEN 0.4 END")]
    if kind == "phone":
        cut = rf"regexp_replace(raw, '[. \t\n\x0B\f\r()/-]+$', '')"
        n, plus, paren, gaps = f"length(regexp_replace({cut}, '[^0-9]', '', 'g'))", f"regexp_matches({cut}, '^(\\+|00)')", f"regexp_matches({cut}, '[()]')", rf"regexp_matches({cut}, '[. \t\n\x0B\f\r()/-]')"
        said = _by_level(
            level, f"WHEN {plus} THEN 0.9 WHEN {paren} OR ({gaps} AND {n} >= 10) THEN 0.8",
            f"WHEN (NOT {gaps} AND NOT {plus} AND {n} < 10) OR ({n} <= 9 AND NOT ({plus} OR {paren})) THEN NULL WHEN {plus} OR {paren} THEN 0.88 ELSE 0.65",
            f"WHEN {plus} THEN 0.85 ELSE 0.45",
        )
        return [(_PATTERNS[kind], 0, "pos", f"pos + length({cut})", f"CASE WHEN {n} NOT BETWEEN 7 AND 15 THEN NULL {said} END")]
    if kind == "card":
        cut = f"regexp_replace(raw, '[{D.CARD_GAPS.replace('-', '')}-]+$', '')"
        digits = f"regexp_replace({cut}, '[^0-9]', '', 'g')"
        return [(_PATTERNS[kind], 0, "pos", f"pos + length({cut})", f"CASE WHEN length({digits}) NOT BETWEEN 13 AND 19 THEN NULL WHEN {_luhn(digits)} THEN 0.95 WHEN {level == 'loose'} THEN 0.35 END")]
    if kind == "iban":
        s = f"upper(regexp_replace(raw, '{_SPACE}', '', 'g'))"
        return [(_PATTERNS[kind], 0, *whole, f"CASE WHEN length({s}) BETWEEN 15 AND 34 AND {_iban(s)} THEN 0.95 END")]
    if kind == "bankAcct":
        tail = ("pos + length(raw) - length(own)", "pos + length(raw)")
        return [
            (_PATTERNS["routing"], 0, *whole, f"CASE WHEN NOT ({_aba('raw')}) THEN NULL WHEN {_near(60, D.BANK_WORDS)} THEN 0.85 ELSE 0.6 END"),
            (_PATTERNS["account"], 1, *tail, f"CASE WHEN length(own) >= 6 THEN 0.75 WHEN {lax} THEN 0.6 END"),
        ]
    if kind == "ssn":
        return [(_PATTERNS[kind], 0, *whole, f"CASE WHEN contains(raw, '-') THEN 0.85 WHEN {lax} THEN 0.6 END")]
    if kind == "passport":
        return [(_PATTERNS[kind], 0, *whole, f"CASE WHEN {_near(60, D.PASSPORT_WORDS)} THEN 0.8 {_by_level(level, '', 'ELSE 0.35', 'ELSE 0.5')} END")]
    if kind == "license":
        return [(_PATTERNS[kind], 0, *whole, f"CASE WHEN {_near(60, D.LICENSE_WORDS)} THEN 0.7 WHEN {level == 'loose'} AND regexp_matches(raw, '^[A-Z]') THEN 0.3 END")]
    if kind == "urlSensitive":
        cut = "regexp_replace(raw, '[.,;:!?]+$', '')"
        rest = f"regexp_extract({cut}, '://([\\s\\S]*)$', 1)"
        login = f"regexp_matches(regexp_extract({rest}, '^[^/?#]*'), '^[^@:]+:[^@]+@')"
        asked = f"regexp_matches(lower(regexp_extract({rest}, '\\?([\\s\\S]*)$', 1)), '({'|'.join(D.SENSITIVE_PARAMS)})=')"
        return [(_PATTERNS["url"], 0, "pos", f"pos + length({cut})", f"CASE WHEN {login} THEN 0.92 WHEN {asked} THEN 0.78 END")]
    if kind == "dob":
        return [(_PATTERNS[kind], 0, *whole, f"CASE WHEN {_near(60, D.DOB_WORDS)} THEN {_by_level(level, '0.75', '0.75', '0.8')} {_by_level(level, '', '', 'ELSE 0.4')} END")]
    if kind == "postal":
        near, plus4 = _near(40, D.POSTAL_WORDS), "contains(raw, '-')"
        said = _by_level(
            level, f"CASE WHEN {plus4} THEN 0.8 WHEN {near} THEN 0.65 END", f"CASE WHEN {plus4} THEN 0.7 WHEN {near} THEN 0.65 END", f"CASE WHEN {near} OR {plus4} THEN 0.7 ELSE 0.35 END"
        )
        return [(_PATTERNS["zip"], 0, *whole, said), (_PATTERNS["uk_post"], 0, *whole, "0.7")]
    if kind == "personName":
        tail = ("pos + length(raw) - length(own)", "pos + length(raw)")
        return [(_PATTERNS["honorific"], 0, *whole, "0.6"), (_PATTERNS["name_context"], 1, *tail, f"CASE WHEN {lax} THEN 0.5 END")]
    raise ValueError(kind)


def findings(source: str, levels: tuple[tuple[str, str], ...]) -> str:
    """A WITH list that ends in ``found``: (id, text, kept), kept being the list of findings that stay, in order.
    ``source`` selects (id, text)."""
    parts = []
    for order, (kind, level) in enumerate(levels):
        for pattern, group, start, end, confidence in _rules(kind, level):
            p = quoted(re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), pattern))
            parts.append(f"""
                SELECT id, {quoted(kind)} AS kind, {start} AS a, {end} AS b, CAST({confidence} AS DOUBLE) AS c, {D.PRIORITY.get(kind, 0)} AS priority, {order} AS rank, {D.THRESHOLDS[level]} AS least FROM (
                    SELECT id, low, raw, own, CAST(sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS pos FROM (
                        SELECT id, low, k, raw, own, gap, lag(raw) OVER (PARTITION BY id ORDER BY k) AS before FROM (
                            SELECT id, low, unnest(m) AS raw, unnest(o) AS own, unnest(g[1 : len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS k FROM (
                                SELECT id, low, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS o, string_split_regex(text, {p}) AS g FROM src
                            ) WHERE len(m) > 0
                        )
                    )
                )""")
    every = " UNION ALL ".join(parts)
    return f"""
        WITH src AS MATERIALIZED (SELECT id, text, lower(text) AS low FROM ({source})),
        each AS (SELECT * FROM ({every}) WHERE c >= least),
        listed AS (
            SELECT id, list([{{'kind': kind, 'a': CAST(a AS INTEGER), 'b': CAST(b AS INTEGER), 'c': c}}] ORDER BY a, c DESC, priority DESC, b - a DESC, rank) AS l FROM each GROUP BY id
        ),
        found AS (
            SELECT src.id, src.text, coalesce(list_reduce(l, lambda x, y: CASE WHEN y[1].a >= x[len(x)].b THEN list_concat(x, y) ELSE x END), []) AS kept
            FROM src LEFT JOIN listed ON src.id = listed.id
        )"""


def scrubbed(value: str, kinds: tuple[str, ...] = ()) -> str:
    """The text of ``found`` with each finding replaced by ``value``, an expression over ``raw`` and ``kind``."""
    before = "CASE WHEN k = 1 THEN 0 ELSE kept[k - 1].b END"
    piece = f"substr(text, {before} + 1, (CASE WHEN k > len(kept) THEN length(text) ELSE kept[k].a END) - ({before}))"
    raw = "substr(text, kept[k].a + 1, kept[k].b - kept[k].a)"
    new = f"CASE WHEN k > len(kept) THEN '' ELSE {value.replace('raw', raw).replace('kind', 'kept[k].kind')} END"
    return f"CASE WHEN text IS NULL THEN NULL WHEN len(kept) > {5000} THEN '[REDACTED]' ELSE array_to_string(list_transform(range(1, len(kept) + 2), lambda k: {piece} || {new}), '') END"
