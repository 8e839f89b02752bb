"""Dates, flags, colours and geometry as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: D:YYYYMMDDHHmmSSOHH'mm'; what follows the year may be missing, and the last number may have one digit.
_DATE = r"^(?:D:)?(\d{4,14})(?:([Zz])(?:\d{1,2}(?:'(?:\d{1,2}'?)?)?)?|([+-])(\d{1,2})(?:'(?:(\d{1,2})'?)?)?)?$"


def format_date(ts: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"))


def parse_date(c: Column) -> Column:
    """struct(ts, offset_min) in UTC, null for what isn't a date; offset_min is null where none is written."""
    part = lambda i: F.regexp_extract(c, _DATE, i)
    digits = part(1)

    def number(at: int, least: int) -> Column:
        two = F.substring(digits, at, 2)
        found = two.try_cast("int")
        return F.when(two == "", F.lit(least)).when(F.char_length(two) == 1, F.greatest(found, F.lit(least))).otherwise(found)

    local = F.try_make_timestamp(F.substring(digits, 1, 4).try_cast("int"), number(5, 1), number(7, 1), number(9, 0), number(11, 0), number(13, 0).cast("decimal(8,6)"))
    valid = c.rlike(_DATE)
    sign = F.when(part(3) == "-", -1).otherwise(1)
    minutes = F.when(part(2) != "", 0).when(part(3) != "", sign * (part(4).try_cast("int") * 60 + F.coalesce(part(5).try_cast("int"), F.lit(0))))
    utc = local - F.make_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.when(valid & utc.isNotNull(), F.struct(utc.alias("ts"), minutes.cast("int").alias("offset_min")))


def has_flag(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask)) != 0


def button_type(flags: Column, push: int = 1 << 16, radio: int = 1 << 15) -> Column:
    return F.when(has_flag(flags, push), "PushButton").when(has_flag(flags, radio), "RadioButton").otherwise("CheckBox")


def choice_type(flags: Column, combo: int = 1 << 17) -> Column:
    return F.when(has_flag(flags, combo), "ComboBox").otherwise("ListBox")


def field_type(ft: Column, flags: Column) -> Column:
    """Kind of a form field from its inherited type and flags."""
    flags = F.coalesce(flags, F.lit(0))
    return F.when(ft == "Tx", "TextBox").when(ft == "Sig", "Signature").when(ft == "Btn", button_type(flags)).when(ft == "Ch", choice_type(flags)).otherwise("Unknown")


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def rgb_to_cmyk(r: Column, g: Column, b: Column) -> Column:
    """struct(c, m, y, k): what all three inks share goes to black."""
    k = F.least(1 - r, 1 - g, 1 - b)
    ink = lambda x: F.when(k < 1, (1 - x - k) / (1 - k)).otherwise(F.lit(0.0))
    return F.struct(ink(r).alias("c"), ink(g).alias("m"), ink(b).alias("y"), k.alias("k"))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    light = lambda x: x * (k - 1) - k + 1
    return F.struct(light(c).alias("r"), light(m).alias("g"), light(y).alias("b"))


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """A row vector times the matrix a b c d e f."""
    a, b, c, d, e, f = m
    return x * a + y * c + e, x * b + y * d + f


def frame_rotation(box: Column, degrees: Column) -> tuple[Column, ...]:
    """The matrix a b c d e f that turns a frame (array of left, bottom, right, top) and moves its lower left corner back to where it was."""
    r = F.radians(degrees.cast("double"))
    a, b, c, d = F.cos(r), F.sin(r), -F.sin(r), F.cos(r)
    at = lambda i: F.get(box, F.lit(i))
    left, bottom = F.least(at(0), at(2)), F.least(at(1), at(3))
    right, top = F.greatest(at(0), at(2)), F.greatest(at(1), at(3))
    # two opposite corners, turned by a multiple of 90 degrees, are the turned frame's
    e = left - F.least(left * a + bottom * c, right * a + top * c)
    f = bottom - F.least(left * b + bottom * d, right * b + top * d)
    return a, b, c, d, e, f


def frame_rotation_inverse(box: Column, degrees: Column) -> tuple[Column, ...]:
    """The matrix that takes back ``frame_rotation``."""
    a, b, c, d, e, f = frame_rotation(box, degrees)
    return d, -b, -c, a, -(e * d - f * c), -(f * a - e * b)


def vector_sum(x1: Column, y1: Column, x2: Column, y2: Column, sign: int = 1) -> tuple[Column, Column]:
    return x1 + sign * x2, y1 + sign * y2


def vector_length(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def utc_now() -> Column:
    """The time of the query, to the second."""
    return F.date_trunc("second", F.current_timestamp())


def overflows(a: Column, b: Column) -> Column:
    """Whether a product of 64-bit numbers is out of their range; null if either is null.

    ``try_multiply`` raises and catches an exception for each product that is; here a rounded product tells, and the exact
    one only near the limits.
    """
    a, b = a.cast("long"), b.cast("long")
    about = F.abs(a.cast("double") * b.cast("double"))
    exact = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    return F.when(about < 9e18, False).when(about > 9.5e18, True).otherwise((exact > F.lit(Decimal((1 << 63) - 1))) | (exact < F.lit(Decimal(-(1 << 63)))))


def uint_to_bytes(n: Column, size: int = 4) -> Column:
    """Big-endian bytes of an unsigned number."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * size, "0"))


def uint_from_bytes(raw: Column) -> Column:
    """The unsigned number of up to seven big-endian bytes."""
    return F.conv(F.hex(raw), 16, 10).cast("long")


def parse_color(c: Column) -> Column:
    """struct(space, c) of a colour as text: ``#RRGGBB``, ``#CCMMYYKK``, a gray number, or an array; null for anything else."""
    octet = lambda i: F.conv(F.substring(c, 2 * i + 2, 2), 16, 10).cast("double") / 255
    built = lambda space, parts: F.struct(F.lit(space).alias("space"), F.array(*parts).alias("c"))
    gray_ = c.try_cast("double")
    return (
        F.when(c.rlike("^#[0-9A-Fa-f]{6}$"), built("DeviceRGB", [octet(i) for i in range(3)]))
        .when(c.rlike("^#[0-9A-Fa-f]{8}$"), built("DeviceCMYK", [octet(i) for i in range(4)]))
        .when(c.rlike(r"^[0-9.][0-9.]*$") & gray_.between(0, 1), built("DeviceGray", [gray_]))
        .when(c.rlike(r"^\["), color_components(c))
    )


def within(x: Column, y: Column, left: float, bottom: float, width: float, height: float) -> Column:
    """Inside a rectangle, its edges included."""
    return x.between(left, left + width) & y.between(bottom, bottom + height)


def normalize_rect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    left, bottom = F.least(x1, x2), F.least(y1, y2)
    return F.struct(left.alias("l"), bottom.alias("b"), (F.greatest(x1, x2) - left).alias("w"), (F.greatest(y1, y2) - bottom).alias("h"))


def intersect_rect(a: Column, b: Column) -> Column:
    """The common part of two rectangles (l, b, w, h), null if they have none."""
    left, bottom = F.greatest(a.l, b.l), F.greatest(a.b, b.b)
    right, top = F.least(a.l + a.w, b.l + b.w), F.least(a.b + a.h, b.b + b.h)
    return F.when((right >= left) & (top >= bottom), F.struct(left.alias("l"), bottom.alias("b"), (right - left).alias("w"), (top - bottom).alias("h")))


def rotation(c: Column) -> Column:
    """Degrees from 0 to 359."""
    return F.pmod(F.coalesce(c, F.lit(0)), F.lit(360))


def parse_w3c_date(c: Column) -> Column:
    """struct(ts, offset_min) of YYYY[-MM[-DD[Thh:mm[:ss]TZD]]], null for anything else."""
    shape = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:(Z)|([+-])(\d{2}):(\d{2}))?)?)?)?$"
    part = lambda i: F.regexp_extract(c, shape, i)
    number = lambda i, least: F.when(part(i) == "", F.lit(least)).otherwise(part(i).try_cast("int"))
    local = F.try_make_timestamp(number(1, 0), number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0).cast("decimal(8,6)"))
    minutes = F.when(part(7) != "", 0).when(part(8) != "", F.when(part(8) == "-", -1).otherwise(1) * (number(9, 0) * 60 + number(10, 0)))
    utc = local - F.make_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.when(c.rlike(shape) & utc.isNotNull(), F.struct(utc.alias("ts"), minutes.cast("int").alias("offset_min")))


def _offset(minutes: Column, between: str, after: str) -> Column:
    sign = F.when(minutes < 0, "-").otherwise("+")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.coalesce(F.concat(sign, two(F.floor(F.abs(minutes) / 60)), F.lit(between), two(F.abs(minutes) % 60), F.lit(after)), F.lit(""))


def format_date_at(ts: Column, minutes: Column) -> Column:
    """A UTC time and its offset as D:YYYYMMDDHHmmSS+HH'mm'."""
    return F.concat(format_date(ts + F.make_interval(mins=F.coalesce(minutes, F.lit(0)))), _offset(minutes, "'", "'"))


def format_w3c_date(ts: Column, minutes: Column) -> Column:
    local = ts + F.make_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), _offset(minutes, ":", ""))


#: Permission bits of the security handler.
PERMISSIONS = {"print": 1 << 2, "edit": 1 << 3, "copy": 1 << 4, "edit_notes": 1 << 5, "fill_and_sign": 1 << 8, "accessible": 1 << 9, "assemble": 1 << 10, "high_print": 1 << 11}

#: Page sizes in points, upright.
PAGE_SIZES = {"A0": (2384, 3370), "A1": (1684, 2384), "A2": (1191, 1684), "A3": (842, 1190), "A4": (595, 842), "A5": (420, 595), "A6": (297, 420), "Letter": (612, 792), "Legal": (612, 1008), "Tabloid": (792, 1224)}


def permissions(p: Column) -> Column:
    """struct of what a document allows."""
    return F.struct(*(has_flag(p, mask).alias(name) for name, mask in PERMISSIONS.items()))


def page_size(name: Column, landscape: bool = False) -> Column:
    """struct(l, b, w, h) of a standard size, null for an unknown name."""
    pairs = [x for n, (w, h) in PAGE_SIZES.items() for x in (F.lit(n), F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), F.lit(float(h if landscape else w)).alias("w"), F.lit(float(w if landscape else h)).alias("h")))]
    return F.try_element_at(F.create_map(*pairs), name)


def format_number(c: Column) -> Column:
    """A number without trailing zeros, six digits after the point at most."""
    text = F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def matrix_product(m: Column, n: Column) -> Column:
    """struct(a, b, c, d, e, f) of first m, then n."""
    return F.struct(
        (m.a * n.a + m.b * n.c).alias("a"),
        (m.a * n.b + m.b * n.d).alias("b"),
        (m.c * n.a + m.d * n.c).alias("c"),
        (m.c * n.b + m.d * n.d).alias("d"),
        (m.e * n.a + m.f * n.c + n.e).alias("e"),
        (m.e * n.b + m.f * n.d + n.f).alias("f"),
    )


def gray_to_rgb(g: Column) -> Column:
    return F.struct(g.alias("r"), g.alias("g"), g.alias("b"))


def color_components(value: Column) -> Column:
    """struct(space, c) of a colour written as a JSON array: gray, RGB or CMYK by its length, null for anything else."""
    parts = F.from_json(value, "array<double>")
    space = F.when(F.size(parts) == 1, "DeviceGray").when(F.size(parts) == 3, "DeviceRGB").when(F.size(parts) == 4, "DeviceCMYK")
    return F.when(space.isNotNull() & ~F.exists(parts, lambda x: x.isNull()), F.struct(space.alias("space"), parts.alias("c")))
