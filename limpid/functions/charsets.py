"""Character classes as Java regular expressions, built once."""

#: White space as the sanitiser sees it.
WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: As normalisation of white space sees it (no VT, no U+0085).
WS_NORMAL = r"\x09\x0A\x0C\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: What trimming removes (no U+0085).
WS_TRIM = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: C0 controls except TAB to CR, DEL, C1 controls.
CONTROLS = r"\x00-\x08\x0E-\x1F\x7F-\x{9F}"
#: Bidirectional formatting.
BIDI = r"\x{61C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
#: Invisible characters, the bidirectional ones included.
INVISIBLE = (
    r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{FFA0}\x{1D173}-\x{1D17A}\x{E0001}\x{E0020}\x{E007F}"
)


def to_python(klass: str) -> str:
    """The same class for Python's ``re``."""
    import re

    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", klass)
