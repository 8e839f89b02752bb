"""Tokens and values of PDF syntax.

Values: None, bool, int, float, Name, Text (bytes of a string), Ref, list, dict with str keys. Numbers have no
exponent; ``n g R`` is a reference; comments are white space.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Fixed values of the syntax.
WHITE = b"\0\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(_BLANK := rb"[\0\t\n\x0c\r ]*(?:%[^\r\n]*[\0\t\n\x0c\r ]*)*")
_WORD = rb"([^\0\t\n\x0c\r ()<>\[\]{}/%]+)"
#: White space and after it, if they are there, a reference or a word.
_NEXT = {True: re.compile(_BLANK + rb"(?:(?:(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%]))|" + _WORD + rb")?"), False: re.compile(_BLANK + rb"()()" + _WORD + rb"?")}
_INT, _REAL = re.compile(rb"[+-]?\d+\Z"), re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)[\d-]*\Z")
_PLAIN, _OCTAL = re.compile(rb"[^()\\\r]*"), re.compile(rb"[0-7]{1,3}")
_SAFE, _UNPRINTED = re.compile(r"(?:(?![()<>\[\]{}/%#])[!-~])+"), re.compile(rb"[^ -~]")
_REF = re.compile(rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
_LITERALS = {b"null": None, b"true": True, b"false": False}
MOST_DEPTH = 256


class PdfError(ValueError):
    """What is wrong with a file; ``code`` names the kind."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


class Name(str):
    __slots__ = ()

    def __repr__(self):
        return f"/{str(self)}"


class Text(bytes):
    """Bytes of a string; ``hex`` strings are only written differently."""

    __slots__ = ()


class Ref(NamedTuple):
    obj: int
    gen: int


class Keyword(bytes):
    __slots__ = ()


END = Keyword(b"")


def unescape_name(raw: bytes) -> Name:
    data = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw
    try:
        return Name(data.decode())
    except UnicodeDecodeError:
        return Name(data.decode("latin-1"))


def escape_name(name: str) -> bytes:
    if _SAFE.fullmatch(name):
        return name.encode()
    return b"".join(bytes([c]) if 33 <= c <= 126 and c not in DELIMITERS and c != 35 else b"#%02X" % c for c in name.encode())


def text_of(raw: bytes) -> str:
    """By its byte order mark, else as PDFDocEncoding, of which what isn't Latin-1 has a table of its own."""
    for mark, kind in ((b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(kind, "replace")
    return "".join(PDF_DOC.get(b, chr(b)) for b in raw)


#: Codes of PDFDocEncoding that aren't those of Latin-1.
PDF_DOC = {code: char for start, chars in ((0x18, "˘ˇˆ˙˝˛˚˜"), (0x80, "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"), (0xA0, "€")) for code, char in enumerate(chars, start)}
_TO_DOC = {char: code for code, char in PDF_DOC.items()} | {chr(c): c for c in range(256) if c not in PDF_DOC and c not in (0x7F, 0x9F, 0xAD)}


def bytes_of(text: str) -> Text:
    """As PDFDocEncoding where it can be said so, else UTF-16 with a mark."""
    if all(c in _TO_DOC for c in text):
        return Text(_TO_DOC[c] for c in text)
    return Text(b"\xfe\xff" + text.encode("utf-16-be"))


class Reader:
    """Reads values from bytes, from a place on."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references, self._next = data, at, references, _NEXT[references].match

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        """The next value, a Keyword, or END."""
        if depth > MOST_DEPTH:
            raise PdfError("InvalidNesting", "values are nested too deep")
        data, m = self.data, self._next(self.data, self.at)
        at = self.at = m.end()
        obj, gen, word = m.groups()
        if word is None:
            if obj:
                return Ref(int(obj), int(gen))
            c = data[at : at + 1]
            if not c:
                return END
        else:
            if word.isdigit():
                return int(word)
            if word in _LITERALS:
                return _LITERALS[word]
            if _INT.match(word):
                if self.references and (r := _REF.match(data, self.at)):
                    self.at = r.end()
                    return Ref(int(word), int(r[1]))
                return int(word)
            if _REAL.match(word):
                return _real(word)
            return Keyword(word)
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return unescape_name(m[0] if m else b"")
        if c == b"(":
            return self._string()
        if data[at : at + 2] == b"<<":
            self.at += 2
            return self._dictionary(depth)
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise PdfError("UnexpectedEOF", "a hex string has no end")
            self.at = end + 1
            return hex_bytes(data[at + 1 : end])
        if c == b"[":
            self.at += 1
            out = []
            while (v := self.value(depth + 1)) != b"]" or not isinstance(v, Keyword):
                if v is END:
                    raise PdfError("UnexpectedEOF", "an array has no end")
                if isinstance(v, Keyword):
                    raise PdfError("InvalidDataType", f"{bytes(v)!r} in an array")
                out.append(v)
            return out
        if data[at : at + 2] == b">>":
            self.at += 2
            return Keyword(b">>")
        self.at += 1
        return Keyword(c)

    def _dictionary(self, depth: int) -> dict:
        out: dict = {}
        while True:
            key = self.value(depth + 1)
            if isinstance(key, Keyword) and key == b">>":
                return out
            if not isinstance(key, Name):
                raise PdfError("UnexpectedEOF" if key is END else "InvalidDataType", "a dictionary's key is no name")
            value = self.value(depth + 1)
            if isinstance(value, Keyword):
                if value == b">>":  # a key without a value
                    out[str(key)] = None
                    return out
                raise PdfError("UnexpectedEOF" if value is END else "InvalidDataType", f"{bytes(value)!r} as a dictionary's value")
            out[str(key)] = value  # of keys that repeat, the last counts

    def _string(self) -> Text:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while True:
            plain = _PLAIN.match(data, at)
            at = plain.end()
            if depth == 1 and not out and data[at : at + 1] == b")":
                self.at = at + 1
                return Text(plain[0])
            out += plain[0]
            if at >= len(data):
                raise PdfError("UnexpectedEOF", "a string has no end")
            c = data[at]
            at += 1
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = at
                    return Text(out)
            elif c == 0x5C:
                if at >= len(data):
                    continue
                c = data[at]
                at += 1
                if c in _ESCAPES:
                    out += _ESCAPES[c]
                elif 0x30 <= c <= 0x37:
                    m = _OCTAL.match(data, at - 1)
                    at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif c in b"\r\n":  # a line that goes on
                    at += c == 13 and data[at : at + 1] == b"\n"
                else:
                    out.append(c)
                continue
            elif c == 13:  # any end of line is a line feed
                at += data[at : at + 1] == b"\n"
                c = 10
            out.append(c)


def _real(word: bytes) -> float:
    text = word.decode()
    sign = -1.0 if text.startswith("-") else 1.0
    text = text.lstrip("+-")
    return sign * float(text.split("-")[0] or 0)


def hex_bytes(raw: bytes) -> Text:
    """What isn't a hex digit is skipped; an odd digit is followed by 0."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return Text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))


def write_value(v) -> bytes:
    """A value in PDF syntax, keys in order of their names."""
    if v is None:
        return b"null"
    if v is True or v is False:
        return b"true" if v else b"false"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        text = f"{v:.6f}".rstrip("0").rstrip(".")
        return (text if text not in ("-0", "") else "0").encode()
    if isinstance(v, Name):
        return b"/" + escape_name(v)
    if isinstance(v, bytes):
        if _UNPRINTED.search(v):
            return b"<" + v.hex().upper().encode() + b">"
        return b"(" + re.sub(rb"([()\\])", rb"\\\1", v) + b")"
    if isinstance(v, list | tuple):
        return b"[" + b" ".join(map(write_value, v)) + b"]"
    return b"<<" + b"".join(b"/" + escape_name(k) + b" " + write_value(x) for k, x in sorted(v.items())) + b">>"


def kind_of(v) -> str:
    """The name of a value's type."""
    kinds = ((type(None), "Null"), (bool, "Bool"), (Ref, "Reference"), (int, "Number"), (float, "Real"), (Name, "Name"), (bytes, "String"), (list, "Array"), (dict, "Dictionary"))
    return next(name for kind, name in kinds if isinstance(v, kind))
