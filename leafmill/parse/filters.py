"""Stream codecs: hex, ASCII 85, run lengths, LZW and Flate, with predictors; chains of them."""

from __future__ import annotations

import re
import zlib

import numpy as np

from leafmill.parse.tokens import PdfError

#: Short names of filters in inline images.
SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}

_NO_DIGIT_85 = re.compile(rb"[^!-u]")

#: Images and encrypted data go on as they are.
OPAQUE = {"DCTDecode", "CCITTFaxDecode", "JPXDecode", "JBIG2Decode", "Crypt"}


def hex_encode(data: bytes) -> bytes:
    return data.hex().upper().encode() + b">"


def hex_decode(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85_encode(data: bytes) -> bytes:
    numbers = np.frombuffer(data, ">u4", len(data) // 4)
    if numbers.all():  # no group of zeros, which has a short form
        powers = np.array([85**k for k in (4, 3, 2, 1, 0)], np.uint32)
        out = bytearray((numbers.astype(np.uint32)[:, None] // powers % 85 + 33).astype(np.uint8).tobytes())
        rest = len(numbers) * 4
    else:
        out, rest = bytearray(), 0
    for at in range(rest, len(data), 4):
        part = data[at : at + 4]
        number = int.from_bytes(part.ljust(4, b"\0"))
        if number == 0 and len(part) == 4:
            out += b"z"
            continue
        digits = [number // 85**k % 85 + 33 for k in (4, 3, 2, 1, 0)]
        out += bytes(digits[: len(part) + 1])
    return bytes(out) + b"~>"


def ascii85_decode(data: bytes) -> bytes:
    out, group, data = bytearray(), [], data.partition(b"~")[0]
    digits = data.translate(None, b"\0\t\n\x0c\r ")
    whole = len(digits) // 5 * 5
    if not _NO_DIGIT_85.search(digits):
        numbers = np.frombuffer(digits, np.uint8, whole).reshape(-1, 5).astype(np.uint64) - np.uint64(33)
        numbers = numbers @ np.array([85**k for k in (4, 3, 2, 1, 0)], np.uint64)
        if (numbers >> np.uint64(32)).any():
            raise PdfError("ValueOutOfRange", "ASCII 85 group")
        out += numbers.astype(">u4").tobytes()
        data = digits[whole:]
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                number = 0
                for d in group:
                    number = number * 85 + d
                if number >> 32:
                    raise PdfError("ValueOutOfRange", "ASCII 85 group")
                out += number.to_bytes(4)
                group = []
        elif c not in b"\0\t\n\x0c\r ":
            raise PdfError("ValueOutOfRange", "no ASCII 85 digit")
    if len(group) == 1:
        raise PdfError("ValueOutOfRange", "ASCII 85 ends in a single digit")
    if group:
        number = 0
        for d in group + [84] * (5 - len(group)):
            number = number * 85 + d
        out += (number & 0xFFFFFFFF).to_bytes(4)[: len(group) - 1]
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out) + b"\x80"


def run_length_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits; 256 clears the table, 257 ends. ``early``: widths grow one code before they must."""
    out, table, width, bits, held, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & (1 << bits) - 1
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if code == 257:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise PdfError("ValueOutOfRange", "LZW code")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    held, bits, width = 0, 0, 9
    out = bytearray()

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    following, word = 258, b""
    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = following
        following += 1
        # the reader learns an entry one code later
        width = min(12, max(9, (following - 1 + early).bit_length()))
        word = data[i : i + 1]
        if following == 4094:
            put(table[word])
            put(256)
            table, following, width, word = {bytes([k]): k for k in range(256)}, 258, 9, b""
    if word:
        put(table[word])
        following += 1
        width = min(12, max(9, (following - 1 + early).bit_length()))
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def flate_decode(data: bytes) -> bytes:
    z = zlib.decompressobj()
    try:
        return z.decompress(data) + z.flush()
    except zlib.error as e:
        raise PdfError("Flate", str(e)) from None


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undoes TIFF (2) or PNG (10 and over) prediction."""
    if predictor == 1:
        return data
    pixel, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, above = bytearray(), bytes(row)
    if predictor == 2:
        if bits != 8:
            raise PdfError("InvalidPredictor", "TIFF prediction of other than 8 bits")
        for at in range(0, len(data), row):
            line = bytearray(data[at : at + row])
            for i in range(pixel, len(line)):
                line[i] = line[i] + line[i - pixel] & 255
            out += line
        return bytes(out)
    if not 10 <= predictor <= 15:
        raise PdfError("InvalidPredictor", str(predictor))
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            left = line[i - pixel] if i >= pixel else 0
            up, corner = above[i], above[i - pixel] if i >= pixel else 0
            if kind == 1:
                guess = left
            elif kind == 2:
                guess = up
            elif kind == 3:
                guess = (left + up) // 2
            elif kind == 4:
                far = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
                guess = (left, up, corner)[far.index(min(far))]
            elif kind == 0:
                guess = 0
            else:
                raise PdfError("InvalidPredictor", f"row of kind {kind}")
            line[i] = line[i] + guess & 255
        out += line
        above = bytes(line).ljust(row, b"\0")
    return bytes(out)


ENCODERS = {"ASCIIHexDecode": hex_encode, "ASCII85Decode": ascii85_encode, "RunLengthDecode": run_length_encode, "LZWDecode": lzw_encode, "FlateDecode": zlib.compress}
_PLAIN = {"ASCIIHexDecode": hex_decode, "ASCII85Decode": ascii85_decode, "RunLengthDecode": run_length_decode}


def decode(data: bytes, filters: list[str], parms: list[dict | None] | None = None) -> tuple[bytes, list[str]]:
    """Decodes through a chain of filters; returns what is left of it when an image's codec is met."""
    for i, name in enumerate(filters):
        name = SHORT.get(name, name)
        p = (parms[i] if parms and i < len(parms) else None) or {}
        if name in OPAQUE:
            return data, filters[i:]
        if name in _PLAIN:
            data = _PLAIN[name](data)
        elif name in ("FlateDecode", "LZWDecode"):
            data = flate_decode(data) if name == "FlateDecode" else lzw_decode(data, p.get("EarlyChange", 1))
            data = unpredict(data, p.get("Predictor", 1), p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1))
        else:
            raise PdfError("UnsupportedFilter", name)
    return data, []


def encode(data: bytes, filters: list[str]) -> bytes:
    """The reverse: the chain's last filter is applied first."""
    for name in reversed(filters):
        data = ENCODERS[SHORT.get(name, name)](data)
    return data
