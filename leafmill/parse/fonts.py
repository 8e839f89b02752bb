"""Fonts as text extraction needs them: codes to Unicode and to widths.

Unicode comes from a ToUnicode map, else from the encoding: its base, and differences by glyph name. Names are
resolved by rule (``uniXXXX``, ``uXXXXX``, single letters, Unicode's own names), with a short list of fixed values for
those of ASCII and Latin that rules don't reach. Widths come from the font's dictionaries; a standard font without
widths uses 0.5 em for each glyph and 0.25 em for the space, since no metrics are at hand.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from leafmill.parse.document import Document
from leafmill.parse.tokens import END, Keyword, Name, PdfError, Reader, Ref, Text

#: Glyph names of ASCII and typographic marks.
GLYPHS = dict(
    pair.split("=", 1)
    for pair in "exclam=! quotedbl=\" numbersign=# dollar=$ percent=% ampersand=& quotesingle=' parenleft=( parenright=) asterisk=* plus=+ comma=, hyphen=- period=. slash=/ "
    "zero=0 one=1 two=2 three=3 four=4 five=5 six=6 seven=7 eight=8 nine=9 colon=: semicolon=; less=< equal== greater=> question=? at=@ bracketleft=[ backslash=\\ bracketright=] "
    "asciicircum=^ underscore=_ grave=` braceleft={ bar=| braceright=} asciitilde=~ quoteleft=‘ quoteright=’ quotedblleft=“ quotedblright=” quotesinglbase=‚ quotedblbase=„ "
    "endash=– emdash=— bullet=• ellipsis=… dagger=† daggerdbl=‡ fi=ﬁ fl=ﬂ ff=ﬀ ffi=ﬃ ffl=ﬄ Euro=€ trademark=™ germandbls=ß ae=æ AE=Æ oe=œ OE=Œ oslash=ø Oslash=Ø "
    "guillemotleft=« guillemotright=» guilsinglleft=‹ guilsinglright=› sterling=£ yen=¥ cent=¢ section=§ paragraph=¶ copyright=© registered=® degree=° mu=µ".split()
) | {"space": " ", "nbspace": " "}

#: Name endings of accents, and the combining marks they stand for.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dieresis": "̈", "ring": "̊", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}

_BASES = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman", "StandardEncoding": "ascii"}


def glyph_text(name: str) -> str:
    """Text of a glyph by its name; empty if unknown."""
    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    for prefix, least in (("uni", 4), ("u", 4)):
        digits = name[len(prefix) :]
        if name.startswith(prefix) and len(digits) >= least and all(c in "0123456789ABCDEFabcdef" for c in digits):
            groups = [digits[i : i + 4] for i in range(0, len(digits), 4)] if prefix == "uni" and len(digits) % 4 == 0 else [digits]
            return "".join(chr(int(g, 16)) for g in groups if int(g, 16) < 0x110000)
    for ending, mark in ACCENTS.items():
        if len(name) == len(ending) + 1 and name.endswith(ending):
            return unicodedata.normalize("NFC", name[0] + mark)
    if "_" in name:
        return "".join(map(glyph_text, name.split("_")))
    try:
        return unicodedata.lookup(("GREEK CAPITAL LETTER " if name[0].isupper() else "GREEK SMALL LETTER ") + name.upper())
    except KeyError:
        return ""


@cache
def _base(kind: str) -> dict[int, str]:
    return {c: bytes([c]).decode(kind, "ignore") for c in range(32, 256)}


def read_cmap(data: bytes) -> tuple[dict[tuple[int, int], str], list[tuple[int, int, int]]]:
    """Texts by (code, bytes), and code spaces (bytes, low, high) of a ToUnicode map."""
    r, out, spaces, pending = Reader(data, references=False), {}, [], []
    text = lambda raw: raw.decode("utf-16-be", "replace")
    while (v := r.value()) is not END:
        if not isinstance(v, Keyword):
            pending.append(v)
            continue
        if v == b"endcodespacerange":
            spaces += [(len(a), int.from_bytes(a), int.from_bytes(b)) for a, b in zip(pending[::2], pending[1::2]) if isinstance(a, Text) and isinstance(b, Text)]
        elif v == b"endbfchar":
            for code, to in zip(pending[::2], pending[1::2]):
                if not isinstance(code, Text):
                    raise PdfError("InvalidFontData", "bfchar")
                out[int.from_bytes(code), len(code)] = text(to) if isinstance(to, Text) else glyph_text(str(to))
        elif v == b"endbfrange":
            for low, high, to in zip(pending[::3], pending[1::3], pending[2::3]):
                if not isinstance(low, Text) or not isinstance(high, Text) or not isinstance(to, Text | list):
                    raise PdfError("InvalidFontData", "bfrange")
                first, last = int.from_bytes(low), int.from_bytes(high)
                if last - first > 0xFFFF:
                    raise PdfError("InvalidFontData", "bfrange is too long")
                for i in range(last - first + 1):
                    if isinstance(to, list):
                        if i < len(to):
                            out[first + i, len(low)] = text(to[i])
                        continue
                    # the last unit counts on
                    number = (int.from_bytes(to) + i) & (1 << 8 * len(to)) - 1
                    out[first + i, len(low)] = text(number.to_bytes(len(to)))
        pending = []
    return out, spaces


class _Placed:
    """Texts, advances and lengths of the codes met so far, in one size and matrix; ``odd`` codes aren't one character, and
    ``same`` says that all are their own Latin-1."""

    def __init__(self):
        self.known, self.odd, self.same = b"", b"", True
        self.texts: dict[int, str] = {}
        self.advances, self.lengths = np.zeros(256), np.zeros(256)


class Font:
    """Codes, texts and widths (in em) of one font."""

    def __init__(self, doc: Document, d: dict):
        self.name = str(d.get("BaseFont", ""))
        self.composite = d.get("Subtype") == "Type0"
        self.unicode: dict[tuple[int, int], str] = {}
        spaces: list = []
        if isinstance(d.get("ToUnicode"), Ref):
            self.unicode, spaces = read_cmap(doc.stream(d["ToUnicode"]))
        self.sizes = sorted({s[0] for s in spaces} | {n for _, n in self.unicode}) or ([2] if self.composite else [1])
        self.spaces = spaces
        descriptor = d
        self.widths: dict[int, float] = {}
        self.default = 0.5
        if self.composite:
            kids = doc.get(d.get("DescendantFonts"))
            kid = doc.get(kids[0]) if isinstance(kids, list) and kids else {}
            self.default = (kid.get("DW", 1000) if isinstance(kid, dict) else 1000) / 1000
            self._cid_widths(doc, doc.get(kid.get("W")) if isinstance(kid, dict) else None)
            descriptor = kid if isinstance(kid, dict) else {}
        else:
            first, widths = doc.get(d.get("FirstChar")), doc.get(d.get("Widths"))
            if isinstance(widths, list) and isinstance(first, int):
                matrix = doc.get(d.get("FontMatrix")) if d.get("Subtype") == "Type3" else None
                scale = matrix[0] if isinstance(matrix, list) and matrix else 0.001
                self.widths = {first + i: doc.get(w) * scale for i, w in enumerate(widths) if isinstance(doc.get(w), int | float)}
                self.default = 0.0
            else:
                self.widths = {32: 0.25}
        descriptor = doc.get(descriptor.get("FontDescriptor"))
        number = lambda key, other: descriptor.get(key) / 1000 if isinstance(descriptor, dict) and isinstance(descriptor.get(key), int | float) else other
        self.ascent, self.descent = number("Ascent", 0.75), number("Descent", -0.25)
        if isinstance(descriptor, dict) and "MissingWidth" in descriptor:
            self.default = number("MissingWidth", self.default)
        self.simple = {} if self.composite else self._encoding(doc, doc.get(d.get("Encoding")))
        space = next((code for (code, _), t in self.unicode.items() if t == " "), None)
        space = next((code for code, t in self.simple.items() if t == " "), 32) if space is None else space
        #: Whether each byte is a code.
        self.bytewise = not self.composite and self.sizes == [1]
        self._bytes: dict[int, tuple[str, float]] = {}
        self._placed: dict[tuple, _Placed] = {}
        #: Width of the space in em; None if the font has none.
        self.space = self.widths.get(space, self.default) or None

    def _cid_widths(self, doc: Document, w) -> None:
        items, i = (w if isinstance(w, list) else []), 0
        while i + 1 < len(items):
            second = doc.get(items[i + 1])
            if isinstance(second, list):
                self.widths |= {items[i] + k: doc.get(x) / 1000 for k, x in enumerate(second)}
                i += 2
            elif i + 2 < len(items) and isinstance(second, int) and second - items[i] <= 0xFFFF:
                self.widths |= dict.fromkeys(range(items[i], second + 1), doc.get(items[i + 2]) / 1000)
                i += 3
            else:
                break

    def _encoding(self, doc: Document, encoding) -> dict[int, str]:
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        kind = _BASES.get(str(base), "ascii")
        out = dict(_base(kind))
        code = 0
        for item in (doc.get(encoding.get("Differences")) or []) if isinstance(encoding, dict) else []:
            if isinstance(item, Name):
                out[code] = glyph_text(item)
                code += 1
            elif isinstance(item, int):
                code = item
        return {c: t for c, t in out.items() if t}

    def placed(self, raw: bytes, size: float, char: float, word: float, reach) -> tuple[str | tuple[str, ...], np.ndarray, np.ndarray]:
        """Text, advance and its length on the page of each code; the texts are one string if each is one character.

        ``reach`` has the parts of the matrix that lengths go by.
        """

        def measured(t: str, w: float) -> tuple[float, float]:
            a = w * size + char + (word if t == " " else 0.0)
            return a, ((a * reach[0]) ** 2 + (a * reach[1]) ** 2) ** 0.5

        if not self.bytewise:
            scanned = self.scan(raw)
            numbers = np.array([measured(t, w) for t, w in scanned], np.float64).reshape(-1, 2)
            return tuple(t for t, _ in scanned), numbers[:, 0], numbers[:, 1]
        key = (size, char, word, *reach)
        if key not in self._placed:
            if len(self._placed) >= 64:
                self._placed.clear()
            self._placed[key] = _Placed()
        p = self._placed[key]
        if fresh := bytes(set(raw.translate(None, p.known))):
            for code in fresh:
                t, w = self.scan(bytes([code]))[0]
                p.texts[code], (p.advances[code], p.lengths[code]) = t, measured(t, w)
            p.known += fresh
            p.odd += bytes(c for c in fresh if len(p.texts[c]) != 1)
            p.same = p.same and all(p.texts[c] == chr(c) for c in fresh)
        codes = np.frombuffer(raw, np.uint8)
        if p.odd and len(raw.translate(None, p.odd)) < len(raw):
            texts = tuple(p.texts[code] for code in raw)
        else:
            texts = raw.decode("latin-1")
            texts = texts if p.same else texts.translate(p.texts)
        return texts, p.advances[codes], p.lengths[codes]

    def scan(self, raw: bytes) -> list[tuple[str, float]]:
        """(text, width in em) of each code of a string, shortest codes first."""
        if self.bytewise:
            for code in set(raw) - self._bytes.keys():
                self._bytes[code] = self.unicode.get((code, 1), self.simple.get(code, "")), self.widths.get(code, self.default)
            return [self._bytes[code] for code in raw]
        out, at = [], 0
        while at < len(raw):
            for n in self.sizes:
                code = int.from_bytes(raw[at : at + n])
                if (code, n) in self.unicode or any(s[0] == n and s[1] <= code <= s[2] for s in self.spaces):
                    break
            else:
                n = self.sizes[-1] if self.composite else 1
                code = int.from_bytes(raw[at : at + n])
            text = self.unicode.get((code, n), self.simple.get(code, "") if n == 1 else "")
            out.append((text, self.widths.get(code, self.default)))
            at += n
        return out


def write_cmap(codes: dict[tuple[int, int], str]) -> bytes:
    """A ToUnicode map of single codes, in sections of a hundred at most."""
    sizes = sorted({n for _, n in codes})
    spaces = b"".join(b"<%s> <%s>\n" % (b"00" * n, b"FF" * n) for n in sizes)
    items, out = sorted(codes.items(), key=lambda x: (x[0][1], x[0][0])), [b"begincmap\n%d begincodespacerange\n" % len(sizes) + spaces + b"endcodespacerange\n"]
    for at in range(0, len(items), 100):
        part = items[at : at + 100]
        lines = b"".join(b"<%s> <%s>\n" % (code.to_bytes(n).hex().upper().encode(), text.encode("utf-16-be").hex().upper().encode()) for (code, n), text in part)
        out.append(b"%d beginbfchar\n" % len(part) + lines + b"endbfchar\n")
    return b"".join(out) + b"endcmap\n"


def differences(codes: dict[int, str]) -> list:
    """Codes and glyph names as an encoding's array: consecutive codes share their first number."""
    out: list = []
    for code in sorted(codes):
        if code - 1 not in codes:
            out.append(code)
        out.append(Name(codes[code]))
    return out
