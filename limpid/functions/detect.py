"""Detection of personal data and secrets.

``find`` scans one text with every enabled detector, drops findings under the level's
threshold and resolves overlaps: the earliest start wins, then confidence, then
priority, then length. ``detect`` runs it over a column in Arrow batches, fed only the rows
that pass a native trigger. ``NATIVE`` holds the detectors that are a pattern and a
checksum alone as Column expressions, for single-type queries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists, priorities, thresholds, confidences.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?){1,8}",
    "phone": r"(?:\+|00)?(?:[0-9][.\s\-()/]*){7,20}",
    "card": r"\b(?:[0-9][ \-.\u2015\u2010\u2011]?){13,19}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{0,4}\b",
    "routing": r"\b[0-9]{9}\b",
    "account": r"(?i:\b(?:account|acct\.?|a/c)(?:\s*(?:no|number|#))?\s*:?\s*([0-9]{4,17})\b)",
    "ssn": r"\b(?!000|666|9[0-9][0-9])[0-9]{3}[ -]?(?!00)[0-9]{2}[ -]?(?!0000)[0-9]{4}\b",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
    "license": r"\b(?:[A-Z]{1,2}[0-9]{5,9}|[0-9]{3,4}[ -]?[0-9]{3,4}[ -]?[0-9]{3,4})\b",
    "ipv4": r"\b(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\b",
    "ipv6": r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4})",
    "mac": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "uuid": r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b",
    "url": r"(?i:\bhttps?://(?:[^\s\"'<>)|]+))",
    "dob": r"\b(?:(?:19|20)[0-9]{2}[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12][0-9]|3[01])[-/.](?:19|20)[0-9]{2}|(?:0[1-9]|[12][0-9]|3[01])[.](?:0[1-9]|1[0-2])[.](?:19|20)[0-9]{2})\b",
    "zip": r"\b[0-9]{5}(?:-[0-9]{4})?\b",
    "uk_post": r"\b[A-Z]{1,2}[0-9][A-Z0-9]?\s?[0-9][A-Z]{2}\b",
    "honorific": r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mx)\.?\s+[A-Z][a-z]{1,30}(?:\s+[A-Z][a-z]{1,30}){0,2}\b",
    "name_context": r"(?:name|full[\s-]?name|customer|patient|client|contact|attn)\s*:?\s*([A-Z][a-z]{1,30}(?:\s+[A-Z][a-z]{1,30}){1,2})",
    "address": r"\b[0-9]{1,6}\s+[A-Z0-9][A-Za-z0-9.'-]{1,30}(?:\s+[A-Za-z0-9.'-]{1,30}){0,4}\s+(?:St(?:reet)?|Ave(?:nue)?|Rd|Road|Blvd|Boulevard|Ln|Lane|Dr(?:ive)?|Ct|Court|Pl(?:ace)?|Ter(?:race)?|Way|Cir(?:cle)?)\b",
}
SENSITIVE_PARAMS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_token", "auth", "ssn", "dob", "card", "session")
DOB_WORDS = ("dob", "date of birth", "birthdate", "birth date", "born")
PASSPORT_WORDS = ("passport",)
LICENSE_WORDS = ("driver", "licence", "license", "dl no", "dl#", "id card")
BANK_WORDS = ("account", "acct", "routing", "aba", "iban", "sort code")
POSTAL_WORDS = ("zip", "postal", "postcode", "pin code")
THRESHOLDS = {"strict": 0.7, "balanced": 0.5, "loose": 0.3}
PRIORITY = {
    "urlSensitive": 100, "iban": 90, "card": 85, "ssn": 80, "email": 75, "ipv4": 70, "ipv6": 70, "mac": 70, "uuid": 70,
    "bankAcct": 60, "passport": 60, "phone": 50, "dob": 45, "postal": 40, "license": 35, "address": 30, "personName": 20,
}
CARD_GAPS = " -.\u2015\u2010\u2011"
OPT_IN = ("personName", "address")
MAX_MATCHES = 100_000
OVERLAP = 200
# End of fixed values.

#: From public token formats.
SECRETS = {
    "bearer": r"\b[Bb]earer\s+[A-Za-z0-9._~+/-]{16,}=*",
    "jwt": r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}",
    "privateKey": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?!-----)[\s\S])*-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "aws": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "gcp": r"\bAIza[A-Za-z0-9_-]{35}",
    "github": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})",
    "gitlab": r"\bglpat-[A-Za-z0-9_-]{20,}",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}",
    "openai": r"\bsk-[A-Za-z0-9_-]{20,}",
    "genericKey": r"(?i:(?:api[_-]?key|secret|token|password|passwd|pwd|access[_-]?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{16,})",
    "urlCreds": r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"']{1,128}:[^\s/@\"']{1,128}@[^\s\"'<>]+",
}
SECRET_CONFIDENCE = {"genericKey": 0.7, "bearer": 0.85, "openai": 0.9, "urlCreds": 0.9}

_RE = {k: re.compile(p, re.A) for k, p in PATTERNS.items()}
_SECRET_RE = {k: re.compile(p, re.A) for k, p in SECRETS.items()}
PII_TYPES = tuple(sorted(PRIORITY))
SECRET_TYPES = tuple(SECRETS)
FINDING = "struct<type:string,start:int,end:int,confidence:double>"
Finding = tuple[str, int, int, float]


def luhn_valid(s: str) -> bool:
    d = [int(c) for c in re.sub(r"[^0-9]", "", s)]
    odd, even = d[-1::-2], d[-2::-2]
    return 13 <= len(d) <= 19 and (sum(odd) + sum(x * 2 - 9 * (x > 4) for x in even)) % 10 == 0


def iban_valid(s: str) -> bool:
    s = re.sub(r"\s", "", s).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def aba_valid(s: str) -> bool:
    return bool(re.fullmatch(r"[0-9]{9}", s)) and sum(int(c) * w for c, w in zip(s, (3, 7, 1) * 3)) % 10 == 0 and s != "0" * 9


class _Text:
    def __init__(self, text: str):
        self.text, self._low = text, None

    def near(self, at: int, words: tuple[str, ...], size: int) -> bool:
        if self._low is None:
            self._low = self.text.lower() if len(self.text.lower()) == len(self.text) else self.text
        part = self._low[max(0, at - size) : at + size]
        return any(w in part for w in words)

    def each(self, name: str) -> Iterator[re.Match]:
        for k, m in enumerate(_RE[name].finditer(self.text)):
            if k >= MAX_MATCHES:
                return
            yield m


def _email(t: _Text, level: str) -> Iterator:
    if "@" not in t.text:
        return
    for m in t.each("email"):
        good = bool(re.fullmatch(r"[A-Za-z]{2,24}", m[0].rpartition(".")[2]))
        if len(m[0]) <= 254 and (good or level != "strict"):
            yield m.start(), m.end(), 0.92 if good else 0.4


def _phone(t: _Text, level: str) -> Iterator:
    for m in t.each("phone"):
        raw = re.sub(r"[.\s\-()/]+\Z", "", m[0])
        n = len(re.sub(r"[^0-9]", "", raw))
        if not 7 <= n <= 15:
            continue
        marked, paren, seps = raw.startswith(("+", "00")), bool(re.search("[()]", raw)), bool(re.search(r"[.\s\-()/]", raw))
        if level == "strict":
            if not (marked or paren or (seps and n >= 10)):
                continue
            c = 0.9 if marked else 0.8
        elif level == "balanced":
            if (not seps and not marked and n < 10) or (n <= 9 and not (marked or paren)):
                continue
            c = 0.88 if marked or paren else 0.65
        else:
            c = 0.85 if marked else 0.45
        yield m.start(), m.start() + len(raw), c


def _card(t: _Text, level: str) -> Iterator:
    for m in t.each("card"):
        raw = m[0].rstrip(CARD_GAPS)
        a, b = m.start(), m.start() + len(raw)
        n = sum(c not in CARD_GAPS for c in raw)
        if not 13 <= n <= 19 or t.text[a - 1 : a].isdigit() or t.text[b : b + 1].isdigit():
            continue
        if luhn_valid(raw):
            yield a, b, 0.95
        elif level == "loose":
            yield a, b, 0.35


def _iban(t: _Text, level: str) -> Iterator:
    for m in t.each("iban"):
        if 15 <= len(re.sub(r"\s", "", m[0])) <= 34 and iban_valid(m[0]):
            yield m.start(), m.end(), 0.95


def _bank(t: _Text, level: str) -> Iterator:
    for m in t.each("routing"):
        if aba_valid(m[0]):
            yield m.start(), m.end(), 0.85 if t.near(m.start(), BANK_WORDS, 60) else 0.6
    for m in t.each("account"):
        if len(m[1]) >= 6 or level != "strict":
            yield m.start(1), m.end(1), 0.75 if len(m[1]) >= 6 else 0.6


def _ssn(t: _Text, level: str) -> Iterator:
    for m in t.each("ssn"):
        dashed = "-" in m[0]
        if dashed or level != "strict":
            yield m.start(), m.end(), 0.85 if dashed else 0.6


def _passport(t: _Text, level: str) -> Iterator:
    for m in t.each("passport"):
        if t.near(m.start(), PASSPORT_WORDS, 60):
            yield m.start(), m.end(), 0.8
        elif level != "strict":
            yield m.start(), m.end(), 0.5 if level == "loose" else 0.35


def _license(t: _Text, level: str) -> Iterator:
    for m in t.each("license"):
        if t.near(m.start(), LICENSE_WORDS, 60):
            yield m.start(), m.end(), 0.7
        elif level == "loose" and m[0][0].isalpha():
            yield m.start(), m.end(), 0.3


def _plain(name: str, confidence: float, least: int = 0) -> Callable:
    def run(t: _Text, level: str) -> Iterator:
        return ((m.start(), m.end(), confidence) for m in t.each(name) if len(m[0]) >= least)

    return run


def _url(t: _Text, level: str) -> Iterator:
    if "://" not in t.text:
        return
    for m in t.each("url"):
        raw = m[0].rstrip(".,;:!?")
        rest = raw.split("://", 1)[1]
        authority, query = re.split(r"[/?#]", rest, maxsplit=1)[0], rest.partition("?")[2].lower()
        if re.match(r"[^@:]+:[^@]+@", authority):
            yield m.start(), m.start() + len(raw), 0.92
        elif any(f"{p}=" in query for p in SENSITIVE_PARAMS):
            yield m.start(), m.start() + len(raw), 0.78


def _dob(t: _Text, level: str) -> Iterator:
    for m in t.each("dob"):
        if t.near(m.start(), DOB_WORDS, 60):
            yield m.start(), m.end(), 0.8 if level == "loose" else 0.75
        elif level == "loose":
            yield m.start(), m.end(), 0.4


def _postal(t: _Text, level: str) -> Iterator:
    for m in t.each("zip"):
        near, long = t.near(m.start(), POSTAL_WORDS, 40), "-" in m[0]
        if level == "loose":
            yield m.start(), m.end(), 0.7 if near or long else 0.35
        elif long:
            yield m.start(), m.end(), 0.8 if level == "strict" else 0.7
        elif near:
            yield m.start(), m.end(), 0.65
    for m in t.each("uk_post"):
        yield m.start(), m.end(), 0.7


def _person(t: _Text, level: str) -> Iterator:
    for m in t.each("honorific"):
        yield m.start(), m.end(), 0.6
    if level != "strict":
        for m in t.each("name_context"):
            yield m.start(1), m.end(1), 0.5


DETECTORS: dict[str, Callable] = {
    "email": _email, "phone": _phone, "card": _card, "iban": _iban, "bankAcct": _bank, "ssn": _ssn, "passport": _passport,
    "license": _license, "ipv4": _plain("ipv4", 0.9), "ipv6": _plain("ipv6", 0.85, 3), "mac": _plain("mac", 0.9), "uuid": _plain("uuid", 0.95),
    "urlSensitive": _url, "dob": _dob, "postal": _postal, "personName": _person, "address": _plain("address", 0.6),
}


def resolve_overlaps(found: list[Finding]) -> list[Finding]:
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f[1], -f[3], -PRIORITY.get(f[0], 0), f[1] - f[2])):
        if not out or f[1] >= out[-1][2]:
            out.append(f)
    return out


@dataclass(frozen=True)
class Detect:
    """What to look for: a level for each enabled type."""

    levels: tuple[tuple[str, str], ...]
    max_length: int = 1_000_000  # a longer text is searched in parts that overlap by OVERLAP
    utf16: bool = False  # offsets of ``detect`` in UTF-16 units

    def __post_init__(self):
        if self.max_length <= OVERLAP:
            raise ValueError(f"max_length must be over {OVERLAP}")

    @staticmethod
    def of(level: str = "balanced", enabled: dict[str, bool] | None = None, pii: bool = True, secrets: bool = True, max_length: int = 1_000_000, utf16: bool = False) -> Detect:
        """Given ``enabled``, everything not explicitly false is on, the opt-in types too."""
        types = (PII_TYPES if pii else ()) + (SECRET_TYPES if secrets else ())
        on = [t for t in types if (enabled.get(t, True) if enabled is not None else t not in OPT_IN)]
        return Detect(tuple((t, level) for t in on), max_length, utf16)


def find(text: str | None, what: Detect) -> list[Finding]:
    """The findings of one text, in order; offsets are code points."""
    found: list[Finding] = []
    size, at = len(text or ""), 0
    while at < size:
        end = min(size, at + what.max_length)
        t = _Text(text[at:end] if at or end < size else text)
        for kind, level in what.levels:
            if kind in DETECTORS:
                found += [(kind, a + at, b + at, c) for a, b, c in DETECTORS[kind](t, level) if c >= THRESHOLDS[level]]
            else:
                c = SECRET_CONFIDENCE.get(kind, 0.95)
                if c >= THRESHOLDS[level]:
                    found += [(kind, m.start() + at, m.end() + at, c) for m in _SECRET_RE[kind].finditer(t.text)]
        if end == size:
            break
        at = end - OVERLAP
    return resolve_overlaps(found)


def utf16_offsets(text: str, found: list[Finding]) -> list[Finding]:
    """Findings with offsets in UTF-16 units."""
    if text.isascii() or not any(c > "\uffff" for c in text):
        return found
    out, at, wide = [], 0, 0
    for kind, a, b, c in found:  # in order and without overlap
        wide += sum(x > "\uffff" for x in text[at:a])
        first = a + wide
        wide += sum(x > "\uffff" for x in text[a:b])
        out.append((kind, first, b + wide, c))
        at = b
    return out


def trigger(what: Detect) -> str:
    """A cheap Java pattern that every text with a finding matches."""
    kinds = {k for k, _ in what.levels}
    parts = ["@"] if kinds & {"email", "urlCreds", "urlSensitive"} else []
    if kinds & {"phone", "card", "iban", "bankAcct", "ssn", "passport", "license", "ipv4", "dob", "postal", "address"}:
        parts.append("[0-9]")
    parts += ["::|[0-9A-Fa-f]:"] if "ipv6" in kinds else []
    parts += ["[0-9A-Fa-f]{2}[:-]"] if kinds & {"mac", "uuid"} else []
    parts += ["(?i:https?://)"] if "urlSensitive" in kinds else []
    parts += ["(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mx)|(?i:name|customer|patient|client|contact|attn)"] if "personName" in kinds else []
    parts += ["(?i:bearer|key|secret|token|passw|pwd)|eyJ|A[KS]IA|AIza|gh[pousr]_|github_pat_|glpat-|xox|[sr]k[-_]|pk_|://"] if kinds & set(SECRET_TYPES) else []
    return "|".join(parts) or "(?!)"


def detect(col: Column, what: Detect = Detect.of(), guard: str | None = None) -> Column:
    """ARRAY<STRUCT<type, start, end, confidence>>, offsets in code points or UTF-16 units; null for null.
    Only texts that match ``guard``, a Java pattern, are searched: the trigger of ``what`` by default."""
    none = F.array().cast(f"array<{FINDING}>")
    if not what.levels:
        return F.when(col.isNotNull(), none)

    @F.pandas_udf(f"array<{FINDING}>")
    def run(s: pd.Series) -> pd.Series:
        shown = utf16_offsets if what.utf16 else lambda _, found: found
        return pd.Series([None if x is None else [dict(zip(("type", "start", "end", "confidence"), f)) for f in shown(x, find(x, what))] for x in s], dtype=object)

    hit = run.asNondeterministic()(F.when(col.rlike(trigger(what) if guard is None else guard), col))
    return F.when(col.isNotNull(), F.coalesce(hit, none))


# Native single-type detection. No bare \b, \w or \s: Java's \b knows more letters than ASCII.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def native_pattern(kind: str) -> str:
    p = PATTERNS[kind].replace(r"\s", r"[ \t\n\x0B\f\r]")
    head, tail = p.startswith(r"\b"), p.endswith(r"\b")
    return (_L if head else "") + p[2 * head : len(p) - 2 * tail] + (_R if tail else "")


def extract(col: Column, kind: str) -> Column:
    """All matches of a pattern-only type, as text."""
    found = F.regexp_extract_all(col, F.lit(native_pattern(kind)), F.lit(0))
    if kind == "card":
        return F.filter(found, lambda x: luhn_check(x))
    if kind == "iban":
        return F.filter(found, lambda x: iban_check(x))
    return found


def redact_native(col: Column, kind: str, placeholder: str = "[REDACTED]") -> Column:
    return F.regexp_replace(col, native_pattern(kind), placeholder)


def luhn_check(col: Column) -> Column:
    d = F.regexp_replace(col, r"[^0-9]", "")
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def iban_check(col: Column) -> Column:
    s = F.upper(F.regexp_replace(col, r"[ \t\n\x0B\f\r]", ""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return s.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (F.when(s.rlike(r"^[A-Z0-9]+\z"), rest) == 1)


def aba_check(col: Column) -> Column:
    weights = F.array(*[F.lit(w) for w in (3, 7, 1) * 3])
    total = F.aggregate(F.zip_with(F.split(col, ""), weights, lambda c, w: (F.ascii(c) - 48) * w), F.lit(0), lambda a, x: a + x)
    return col.rlike(r"^[0-9]{9}\z") & (col != "000000000") & (F.when(col.rlike(r"^[0-9]{9}\z"), total) % 10 == 0)
