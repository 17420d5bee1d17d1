"""Secret scans with a worklist of decoded layers.

A text is scanned; what is encoded in it is decoded into new layers (URL and Unicode escapes in place
in the whole text, base64 and compressed bytes inside it run by run), which are scanned in turn until
no new layer appears. Escapes of either kind give a layer one step below, and, where escapes are left in it, one more
in which they are all resolved to the end, in one pass, however deep they are nested. Every layer maps its
characters to a span of the original text.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import extended, sliced

CHUNK = 1 << 18  # bytes that a compressed stream gives at a time
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?:(?ai:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORD = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U000([0-9A-Fa-f]{5})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE_END = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
_WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_LINE_END.pattern}[A-Za-z0-9+/_-]+)+={{0,2}}")
_SPLIT = re.compile(r"[/_-]")
_HEXES = frozenset("0123456789abcdefABCDEF")
_REACH = 10  # characters of the longest escape
_ODD = re.compile(rb"[\x00-\x08\x0e-\x1f]")
#: What a text must hold for a span or a further layer to come of it.
_HINT = re.compile(r"(?ai:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{16}")


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind, end) of one layer: leftmost, non-overlapping per kind."""
    out = []
    if _WORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


@dataclass
class Layer:
    """Decoded text. ``marks``: (start in this layer, start, end in the original)
    of its pieces, in order; a piece of None end maps character by character."""

    text: str
    marks: list[tuple[int, int, int | None]]
    stepped: bool = False  # whether it is a step in which escapes were decoded

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The original's span of characters [start, end) of this layer."""
        return self._at(start)[0], self._at(max(start, end - 1))[1]

    def part(self, start: int, end: int, to: int) -> list[tuple[int, int, int | None]]:
        """The marks of characters [start, end) in a layer that holds them from ``to`` on."""
        out = []
        for k in range(bisect.bisect_right(self.marks, start, key=lambda m: m[0]) - 1, len(self.marks)):
            at, first, last = self.marks[k]
            if at >= end:
                break
            lo = max(at, start)
            out.append((to + lo - start, first if last is not None else first + lo - at, last))
        return out

    def decoded(self, found: list[tuple[int, int, str]]) -> Layer:
        """This layer with each [start, end) of ``found``, in order, replaced by its character."""
        pieces, marks, size, at = [], [], 0, 0
        for a, b, c in [*found, (len(self.text), len(self.text), "")]:
            if a > at:
                pieces.append(self.text[at:a])
                marks += self.part(at, a, size)
                size += a - at
            if c:
                pieces.append(c)
                marks.append((size, *self.span(a, b)))
                size += 1
            at = b
        return Layer("".join(pieces), marks, True)

    def resolved(self) -> Layer:
        """This layer without escapes: characters go on a stack, where one that completes an escape is
        taken off again with it; what the escape stands for may complete another."""
        chars: list[str] = []
        first: list[int] = []  # where in this layer a character of the stack begins
        last: list[int] = []
        escapes = set("%\\")
        since = _REACH  # characters put on the stack since the last that can begin an escape
        for k, c in enumerate(self.text):
            chars.append(c)
            first.append(k)
            last.append(k + 1)
            since = 0 if c in escapes else since + 1
            while since < _REACH and (n := _completed(chars)):
                code = int("".join(chars[-n + (1 if chars[-n] == "%" else 2) :]), 16)
                if chars[-n] == "%":
                    new = chr(code) if code < 0x80 else chr(0xDC00 + code)
                else:
                    new = chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else "\ufffd"
                at = first[-n]
                del chars[-n:], first[-n:], last[-n:]
                chars.append(new)
                first.append(at)
                last.append(k + 1)
                since = next((j for j in range(min(_REACH, len(chars))) if chars[-1 - j] in escapes), _REACH)
        found, k = [], 0  # bytes of URL escapes side by side make up characters
        while k < len(chars):
            j = k
            while j < len(chars) and "\udc80" <= chars[j] <= "\udcff":
                j += 1
            if j > k:
                raw = bytes(ord(c) - 0xDC00 for c in chars[k:j])
                for c in raw.decode(errors="surrogateescape"):
                    n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
                    found.append((first[k], last[k + n - 1], c if n > 1 else "\ufffd"))
                    k += n
                continue
            if last[k] - first[k] > 1:
                found.append((first[k], last[k], chars[k]))
            k += 1
        return self.decoded(found)

    def _at(self, pos: int) -> tuple[int, int]:
        at, first, last = self.marks[bisect.bisect_right(self.marks, pos, key=lambda m: m[0]) - 1]
        return (first, last) if last is not None else (first + pos - at, first + pos - at + 1)


def _completed(chars: list[str]) -> int:
    """How many characters on top of the stack are a whole escape."""
    if chars[-1] not in _HEXES:
        return 0
    if len(chars) > 2 and chars[-3] == "%" and chars[-2] in _HEXES:
        return 3
    for n, mark in ((4, "x"), (6, "u"), (10, "U")):
        if len(chars) >= n and chars[-n] == "\\" and chars[1 - n] == mark and all(c in _HEXES for c in chars[2 - n :]) and (n < 10 or chars[-8:-5] == ["0"] * 3):
            return n
    return 0


def _text(raw: bytes) -> str | None:
    """``raw`` as text if it plausibly is: valid UTF-8 without odd controls."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not any(c < " " and c not in "\t\n\r\f\v" for c in text) else None


def packed(raw: bytes) -> bool:
    """Whether ``raw`` begins like gzip or zlib."""
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0)


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip or zlib stream in pieces of up to CHUNK: those of all members, what follows the last one
    as it is, and of a broken stream those before the break."""
    member, plain = zlib.decompressobj(47), False
    for chunk in chunks:
        while chunk and not plain:
            try:
                out = member.decompress(chunk, CHUNK)
            except zlib.error:
                return
            if out:
                yield out
            chunk = member.unconsumed_tail
            if member.eof:
                chunk = member.unused_data
                if chunk:
                    plain = not packed(chunk)
                member = zlib.decompressobj(47)
            elif not chunk:
                while out:  # what it still holds back
                    try:
                        out = member.decompress(b"", CHUNK)
                    except zlib.error:
                        return
                    if out:
                        yield out
        if chunk:
            yield chunk


def unpacked(raw: bytes, most: int) -> Iterator[bytes]:
    """What ``raw`` holds below all its compressed layers, in windows of up to ``most`` bytes that overlap by half;
    ``raw`` itself if it is not compressed."""
    met: set[bytes] = set()
    while packed(raw):
        mark = hashlib.sha256(raw).digest()
        if mark in met:  # bytes that unfold to themselves
            return
        met.add(mark)
        stream = inflated([raw])
        head = next(stream, b"")
        if not head:
            break
        parts, size = [head], len(head)
        while size <= most and (part := next(stream, None)):
            parts.append(part)
            size += len(part)
        raw = b"".join(parts)
        if size <= most:
            continue
        rest: Iterator[bytes] = itertools.chain([raw], stream)
        while packed(raw):  # layers beyond one window are unfolded as streams
            rest = inflated(rest)
            if not (raw := next(rest, b"")):
                return
            rest = itertools.chain([raw], rest)
        yield from _windows(rest, most)
        return
    yield raw


def _windows(stream: Iterable[bytes], most: int) -> Iterator[bytes]:
    held, fresh, step = bytearray(), False, max(1, most // 2)
    for part in stream:
        for k in range(0, len(part), step):
            held += part[k : k + step]
            fresh = True
            while len(held) >= most:
                yield bytes(held[:most])
                del held[:step]
                fresh = len(held) > most - step
    if fresh:
        yield bytes(held)


def _segments(raw: bytes, cuts: list[int], code: str) -> tuple[str, list[int]]:
    """``raw`` as text whatever it holds, and where in it the bytes from each of ``cuts`` on begin."""
    pieces, at, size = [], [], 0
    for a, b in zip(cuts, [*cuts[1:], len(raw)]):
        at.append(size)
        pieces.append(raw[a:b].decode(code, "replace"))
        size += len(pieces[-1])
    return "".join(pieces), at


def _lenient(raw: bytes, cuts: list[int]) -> Iterator[tuple[str, list[int]]]:
    """The readings of bytes that are no clean UTF-8 in which something may be found: UTF-8 and, with a zero
    byte, UTF-16 of either order from either byte on."""
    for code, odd in (("utf-8", 0), *((("utf-16-le", 0), ("utf-16-le", 1)) if b"\0" in raw else ())):
        if _HINT.search(raw[odd:].decode(code, "replace")):
            yield _segments(raw, cuts if code == "utf-8" else [c + (c + odd) % 2 for c in cuts], code)


def _texts(raw: bytes, most: int) -> Iterator[str]:
    """The texts of what ``raw`` holds."""
    for window in unpacked(raw, most):
        if text := _text(window):
            yield text
        else:
            yield from (t for t, _ in _lenient(window, [0]))


def _clean_from(raw: bytes, cuts: list[int]) -> int | None:
    """The first of ``cuts`` from which on ``raw`` is plausible text."""
    bad = len(raw) - m.start() if (m := _ODD.search(raw[::-1])) else 0
    for k, c in enumerate(cuts):
        if bad <= c < len(raw):
            try:
                raw[c:].decode()
                return k
            except UnicodeDecodeError as e:
                bad = c + e.end
    return None


def _base64(run: str, starts: list[int], most: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts that ``run`` holds, each with (place in the text, place in the run) of its parts. A payload may begin
    at any of ``starts``; as four characters are three bytes, the run is decoded once from each of the first four."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for o in range(min(4, len(body))):
        part = body[o : len(body) - ((len(body) - o) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        begins = [o, *(p for p in starts if p > o and p % 4 == o)]
        cuts = [(p - o) // 4 * 3 for p in begins]
        deep = {c for c in cuts if packed(raw[c : c + 3])}
        at = raw.find(b"\x1f\x8b\x08")
        while at >= 0:
            deep.add(at)
            at = raw.find(b"\x1f\x8b\x08", at + 1)
        for c in sorted(deep):
            if next(inflated([raw[c:]]), b""):
                place = begins[bisect.bisect_right(cuts, c) - 1]
                yield from ((t, [(0, place)]) for t in _texts(raw[c:], most))
        if (k := _clean_from(raw, cuts)) is not None:
            yield raw[cuts[k] :].decode(), [(0, begins[k])]
            if k == o == 0:
                return
        yield from ((t, list(zip(places, begins))) for t, places in _lenient(raw, cuts))


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """Base64 runs as (run, (place in the run, place in the text) of its lines, end in the text): those of
    one line, and those joined over line ends."""
    for m in _BASE64.finditer(text):
        yield m[0], [(0, m.start())], m.end()
    if "\n" in text or "\\n" in text:
        for m in _WRAPPED.finditer(text):
            lines, at, size, spots = [], m.start(), 0, []
            for e in [*_LINE_END.finditer(m[0]), None]:
                end = m.start() + e.start() if e else m.end()
                lines.append(text[at:end])
                spots.append((size, at))
                size += end - at
                at = m.start() + e.end() if e else end
            yield "".join(lines), spots, m.end()


def unwrap(layer: Layer, most: int) -> Iterator[Layer]:
    """The layers below ``layer``: the whole text with its URL escapes decoded in place, the same with its
    Unicode escapes, both resolved to the end, and what each base64 run holds."""
    text = layer.text
    steps = []
    if "%" in text:
        found = []
        for m in _URL.finditer(text):
            at = m.start()
            for c in unquote_to_bytes(m[0]).decode(errors="surrogateescape"):
                odd = "\udc80" <= c <= "\udcff"  # a byte that is no UTF-8
                end = at + 3 * (1 if odd else len(c.encode()))
                found.append((at, end, "\ufffd" if odd else c))
                at = end
        if found:
            steps.append(found)
    if "\\" in text:
        found = []
        for m in _ESCAPED.finditer(text):
            code = int(m[1] or m[2] or m[3], 16)
            found.append((m.start(), m.end(), chr(code) if code < 0xD800 or 0xDFFF < code <= 0x10FFFF else "\ufffd"))
        if found:
            steps.append(found)
    if not layer.stepped:
        stepped = [layer.decoded(found) for found in steps]
        yield from stepped
        if len(steps) > 1 or any(_URL.search(x.text) or _ESCAPED.search(x.text) for x in stepped):
            yield layer.resolved()
    for run, spots, end in _runs(text):
        starts = sorted({*(at for at, _ in spots), *(m.end() for m in _SPLIT.finditer(run))})
        for inner, parts in _base64(run, starts, most):
            marks = []
            for at, place in parts:
                line, first = spots[bisect.bisect_right(spots, place, key=lambda x: x[0]) - 1]
                marks.append((at, *layer.span(first + place - line, end)))
            yield Layer(inner, marks)


def find_secrets(text: str, most: int = 1 << 24) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as sorted (start, kind, end).

    The worklist ends at a fixpoint: a decoded text met before, at the same place, is
    not unwrapped again, so cycles and repeats stop.
    """
    base = scan(text)
    spans = set(base)
    work = [Layer(text, [(0, 0, None)])]
    met = {(hashlib.sha256(text.encode()).digest(), 0)}
    while work:
        for inner in unwrap(work.pop(), most):
            at = inner.marks[0][1]
            mark = (hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest(), at)
            if mark in met:
                continue
            met.add(mark)
            for start, kind, end in scan(inner.text):
                a, b = inner.span(start, end)
                spans.add((a, kind, b))
            work.append(inner)
    return base, sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_inflated: int = 1 << 24) -> DataFrame:
    """One row per document: (id, base, spans), arrays of (kind, start, end).

    Offsets are code points of the original text, ends exclusive; a span found in a
    decoded layer is that of the encoded characters it came from. ``base`` holds the
    spans of the text as it stands, ``spans`` those and the decoded ones. A null text
    counts as empty and has none; ids are carried through, null and repeated ones too;
    an empty table gives an empty result. Compressed layers are unfolded to their end, all members of them
    and however deep; one of more than ``max_inflated`` bytes is scanned in windows of so many that overlap
    by half, so memory stays bounded, and only a single secret or encoded run of more than half a window,
    in a layer of more than one, may be seen in parts.
    """
    import pyarrow as pa

    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [find_secrets(t or "", max_inflated) for t in b.column("t").to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[j]] for f in found], pa.list_(span)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("i"), *cols], ["i", "base", "spans"])

    each = "array<struct<kind:string,start:bigint,end:bigint>>"
    narrow = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    schema = extended(narrow.select("i").schema, f"base {each}, spans {each}")
    return narrow.mapInArrow(run, schema).withColumnRenamed("i", id_col)
