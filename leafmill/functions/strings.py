"""String, name and encoding functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.parse.tokens import PDF_DOC

#: ASCII marks that end a word, as a regex class, and white space inside ASCII.
DELIMITER = r"^[ \t-\r!-/:-@\[-`{-~]$"
BLANKS = r"[ \t\n\r\f]+"

#: The code points that count as white space when entries are trimmed or dropped.
UNICODE_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_blank(c: Column) -> Column:
    return c.rlike(rf"^{UNICODE_SPACE}*$")


def trim_blank(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"^{UNICODE_SPACE}+", ""), rf"{UNICODE_SPACE}+$", "")


def trim_line(c: Column) -> Column:
    """Without white space of ASCII, line feeds aside, at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"^[ \t\r\f]+", ""), r"[ \t\r\f]+$", "")


def position(c: Column, pattern: str) -> Column:
    """From 1, in code points; 0 if the pattern isn't there."""
    return F.locate(pattern, c).cast("long")


def whole_word_first(c: Column, pattern: str) -> Column:
    """Whether the first occurrence, and only that is looked at, stands between delimiters or ends of the text."""
    at = F.locate(pattern, c)
    after = at + len(pattern)
    starts = (at == 1) | F.substring(c, at - 1, F.lit(1)).rlike(DELIMITER)
    ends = (after > F.char_length(c)) | F.substring(c, after, F.lit(1)).rlike(DELIMITER)
    return (at > 0) & starts & ends


def words(c: Column) -> Column:
    return F.filter(F.split(c, BLANKS), lambda w: w != "")


def unescape_name(c: Column) -> Column:
    """``#xx`` becomes the byte xx; anything else stays. Other percent signs and pluses are shielded from the decoder."""
    shielded = F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_replace(shielded, "#([0-9A-Fa-f]{2})", "%$1"))


def escape_name(c: Column) -> Column:
    """Bytes outside ``!`` to ``~``, and delimiters, as ``#XX``."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"))
    plain = r"^(2[12]|2[46]|27|2[A-E]|3[0-9]|3[A]|3B|3D|3F|4.|5[0-9A]|5C|5E|5F|6.|7[0-9A]|7C|7E)$"
    return F.array_join(F.transform(pairs, lambda p: F.when(p.rlike(plain), F.decode(F.unhex(p), "UTF-8")).otherwise(F.concat(F.lit("#"), p))), "")


def hex_encode(c: Column) -> Column:
    return F.hex(F.encode(c, "UTF-8"))


def hex_decode(c: Column) -> Column:
    """Characters that aren't hexadecimal are skipped, and an odd digit is followed by 0."""
    clean = F.regexp_replace(c, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.char_length(clean) % 2 == 1, F.concat(clean, F.lit("0"))).otherwise(clean))


def text_of(raw: Column) -> Column:
    """Text of a string's bytes: by its byte order mark, else as PDFDocEncoding."""
    starts = lambda mark: F.hex(F.substring(raw, 1, len(mark) // 2)) == mark
    rest = lambda n: F.substring(raw, n + 1, 1 << 30)
    return F.when(starts("FEFF"), F.decode(rest(2), "UTF-16BE")).when(starts("FFFE"), F.decode(rest(2), "UTF-16LE")).when(starts("EFBBBF"), F.decode(rest(3), "UTF-8")).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, PDF_DOC)), "".join(PDF_DOC.values())))


def is_doc_text(c: Column) -> Column:
    """Whether the text can be said in PDFDocEncoding."""
    said = "".join(rf"\x{{{ord(x):X}}}" for x in PDF_DOC.values())
    return c.rlike(rf"^[\x00-\x17\x20-\x7E\xA1-\xAC\xAE-\xFF{said}]*$")


def is_valid_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def base_font_name(c: Column) -> Column:
    """struct(name, italic, bold) of a font's name: without a subset's prefix, style suffixes and spaces."""
    own = F.regexp_replace(c, r"^[A-Z]{6}\+", "")
    has = lambda *styles: own.rlike(f"[,-]({'|'.join(styles)})")
    name = F.regexp_replace(F.regexp_replace(own, "[,-](BoldItalic|BoldOblique|Bold|Italic|Oblique|Regular)", ""), " ", "")
    return F.struct(name.alias("name"), has("Italic", "Oblique", "BoldItalic", "BoldOblique").alias("italic"), has("Bold").alias("bold"))


def is_plain_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def keywords(c: Column) -> Column:
    """Keywords of a list: it is cut after each carriage return or line feed, which stays at its keyword's end."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"([^\r\n]*[\r\n]|[^\r\n]+$)")), lambda k: k != "")
