"""Writing content streams: paths, text, state and objects as operators, with states balanced."""

from __future__ import annotations

from leafmill.parse.tokens import Name, PdfError, Text, write_value

#: How far control points of a quarter's curve lie from its ends, for a unit circle.
KAPPA = 4 * (2**0.5 - 1) / 3


class Canvas:
    """Gathers operators; ``bytes`` ends it, and raises if states or text objects are left open."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.saved, self.text = 0, False

    def op(self, name: str, *operands) -> Canvas:
        self.parts.append(b" ".join([*(write_value(float(o) if isinstance(o, float) else o) for o in operands), name.encode()]))
        return self

    def save(self) -> Canvas:
        self.saved += 1
        return self.op("q")

    def restore(self) -> Canvas:
        if not self.saved:
            raise PdfError("InvalidContent", "no state is saved")
        self.saved -= 1
        return self.op("Q")

    def rectangle(self, x: float, y: float, w: float, h: float, paint: str = "S") -> Canvas:
        return self.op("re", x, y, w, h).op(paint)

    def line(self, x1: float, y1: float, x2: float, y2: float) -> Canvas:
        return self.op("m", x1, y1).op("l", x2, y2).op("S")

    def ellipse(self, x: float, y: float, w: float, h: float, paint: str = "S") -> Canvas:
        """Four curves inside a rectangle."""
        rx, ry = w / 2, h / 2
        cx, cy, kx, ky = x + rx, y + ry, rx * KAPPA, ry * KAPPA
        self.op("m", cx + rx, cy)
        for a, b, c, d, e, f in ((rx, ky, kx, ry, 0, ry), (-kx, ry, -rx, ky, -rx, 0), (-rx, -ky, -kx, -ry, 0, -ry), (kx, -ry, rx, -ky, rx, 0)):
            self.op("c", cx + a, cy + b, cx + c, cy + d, cx + e, cy + f)
        return self.op("h").op(paint)

    def color(self, *components: float, stroke: bool = False) -> Canvas:
        names = {1: "g", 3: "rg", 4: "k"}
        if len(components) not in names or not all(0 <= c <= 1 for c in components):
            raise PdfError("ValueOutOfRange", "a colour has one, three or four parts of 0 to 1")
        name = names[len(components)]
        return self.op(name.upper() if stroke else name, *map(float, components))

    def begin_text(self, font: str, size: float) -> Canvas:
        if self.text:
            raise PdfError("InvalidContent", "a text object is open")
        self.text = True
        return self.op("BT").op("Tf", Name(font), size)

    def show(self, text: str | bytes, x: float | None = None, y: float | None = None) -> Canvas:
        if not self.text:
            raise PdfError("InvalidContent", "no text object is open")
        if x is not None and y is not None:
            self.op("Td", x, y)
        return self.op("Tj", Text(text.encode("cp1252", "replace") if isinstance(text, str) else text))

    def end_text(self) -> Canvas:
        self.text = False
        return self.op("ET")

    def draw(self, name: str, x: float, y: float, w: float = 1.0, h: float = 1.0) -> Canvas:
        """An image or form in its place, state kept."""
        return self.save().op("cm", w, 0, 0, h, x, y).op("Do", Name(name)).restore()

    def bytes(self) -> bytes:
        if self.saved or self.text:
            raise PdfError("InvalidContent", "states or text objects are open")
        return b"\n".join(self.parts) + b"\n" if self.parts else b""
