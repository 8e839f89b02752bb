"""The ordered fold over a page's events that only a loop can say: text state to positioned glyph runs.

Everything after it (lines, gaps, words, matches) is done with windows over the runs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np

from leafmill.parse.content import INVALID_OPERATOR, events, resource
from leafmill.parse.document import Document
from leafmill.parse.fonts import Font
from leafmill.parse.tokens import PdfError, Ref

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Run(NamedTuple):
    """A shown string: its place, where it ends, the width of a space there, and each glyph's text and advance."""

    seq: int
    text: str
    x: float
    y: float
    length: float
    space: float
    texts: str | tuple[str, ...]  # a string if each is one character
    advances: np.ndarray
    chunk: int
    ascent: float
    descent: float


def times(m: Matrix, n: Matrix) -> Matrix:
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def reach(m: Matrix, dx: float) -> float:
    """Length of a step along the writing direction."""
    return ((dx * m[0]) ** 2 + (dx * m[1]) ** 2) ** 0.5


@dataclass
class State:
    ctm: Matrix = UNIT
    tm: Matrix = UNIT
    tlm: Matrix = UNIT
    leading: float = 0.0
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0


def page_runs(doc: Document, page: dict, errors: list[str] | None = None) -> list[Run]:
    """Glyph runs of a page in order. Operators with too few operands are skipped; ``errors`` gets what could not be read."""
    stack, out, chunk = [State()], [], 0
    fonts: dict[object, Font | None] = {}
    saved: list[int] = []

    def show(raw: bytes) -> None:
        s = stack[-1]
        if s.font is None:
            return
        place = times(s.tm, s.ctm)
        texts, advances, reached = s.font.placed(raw, s.size, s.char, s.word, place[:2])
        space, whole = s.size * (s.font.space or 1.0), float(advances.sum())
        out.append(Run(len(out), "".join(texts), place[4], place[5], reach(place, whole), reach(s.tm, space), texts, reached, chunk, s.font.ascent * s.size, s.font.descent * s.size))
        s.tm = times((1, 0, 0, 1, whole, 0), s.tm)

    def line(tx: float, ty: float) -> None:
        s = stack[-1]
        s.tlm = s.tm = times((1, 0, 0, 1, tx, ty), s.tlm)

    for e in events(doc, page):
        s, v = stack[-1], e.operands
        if e.kind == "form":
            saved.append(len(stack))
            stack.append(replace(s))
            continue
        if e.kind == "form_end":
            del stack[saved.pop() :]
            continue
        if e.error is not None and errors is not None:
            errors.append(e.error)
        if e.kind != "operator" or e.warnings & INVALID_OPERATOR:
            continue
        try:
            if e.op == "q":
                stack.append(replace(s))
            elif e.op == "Q":
                if len(stack) == 1 + bool(saved) * (saved[-1] if saved else 0):
                    raise PdfError("InvalidContent", "more states restored than saved")
                stack.pop()
            elif e.op == "cm":
                s.ctm = times(tuple(map(float, v)), s.ctm)
            elif e.op == "Tm":
                s.tm = s.tlm = tuple(map(float, v))
            elif e.op in ("Td", "TD"):
                line(float(v[0]), float(v[1]))
                if e.op == "TD":
                    s.leading = -float(v[1])
            elif e.op == "T*":
                line(0.0, -s.leading)
            elif e.op == "TL":
                s.leading = float(v[0])
            elif e.op == "Tc":
                s.char = float(v[0])
            elif e.op == "Tw":
                s.word = float(v[0])
            elif e.op in ("BT", "ET"):
                s.tm = s.tlm = UNIT
            elif e.op == "Tf":
                ref = resource(doc, e.canvas, "Font", v[0])
                known = doc.fonts if isinstance(ref, Ref) else fonts
                key = ref if isinstance(ref, Ref) else id(ref)
                if key not in known:
                    d = doc.get(ref)
                    known[key] = Font(doc, d) if isinstance(d, dict) else None
                s.font, s.size = known[key], float(v[1])
            elif e.op == "Tj":
                show(bytes(v[0]))
                chunk += 1
            elif e.op == "'":
                line(0.0, -s.leading)
                show(bytes(v[0]))
                chunk += 1
            elif e.op == '"':
                s.word, s.char = float(v[0]), float(v[1])
                line(0.0, -s.leading)
                show(bytes(v[2]))
                chunk += 1
            elif e.op == "TJ":
                for part in v[0]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, int | float):
                        s.tm = times((1, 0, 0, 1, -part / 1000 * s.size, 0), s.tm)
                chunk += 1
        except (TypeError, ValueError, IndexError) as error:
            if isinstance(error, PdfError):
                raise
    return out
