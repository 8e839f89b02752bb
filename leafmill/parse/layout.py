"""Text entries of a page from its runs: lines, gaps, spaces between, words, trimming.

Fixed values, as extraction defines them: strings on one line differ by under 0.01 in height; gaps of a space's width
(less 1e-7) are spaces, and those of over six are ends of an entry.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np

from leafmill.parse.runs import Run

SAME_LINE, SLACK, HARD = 0.01, 1e-7, 6

#: The code points that count as white space when entries are trimmed or dropped.
SPACES = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WHITE, _INK, _SEPARATORS = re.compile(f"[{SPACES}]"), re.compile(f"[^{SPACES}]+"), re.compile("[\x1c-\x1f]")
_ASCII_INK = np.array([chr(c) not in SPACES for c in range(128)], np.int8)


COLUMNS = ("seq", "pos", "text", "x", "y", "length", "ascent", "descent", "first_x", "xs", "advances")


def entries(runs: Iterable[Run], tokenize: bool = False, keep_white: bool = False, pieces: bool = False) -> dict[str, list]:
    """Columns of a page's entries in their order: text, x, y, length, ascent, descent; seq and pos of the first glyph;
    first_x, where the first run stands; and if asked xs and advances, of the glyph of each character."""
    out: dict[str, list] = {name: [] for name in COLUMNS}
    before, held = None, []
    for r in runs:
        space = None
        if before is not None:
            end = before.x + before.length
            gap = abs(r.x - end) + SLACK
            spaced = gap >= r.space
            if abs(r.y - before.y) >= SAME_LINE or spaced and (tokenize or gap > HARD * r.space):
                _inside(out, held, tokenize, keep_white, pieces)
                held = []
            elif spaced and not (before.text and before.text[-1] in SPACES or _WHITE.search(r.text)):
                space = end, gap - SLACK
        held.append((r, space))
        before = r
    if held:
        _inside(out, held, tokenize, keep_white, pieces)
    return out


def _spans(texts: list[str] | str, text: str, tokenize: bool, keep_white: bool) -> list[tuple[int, int]]:
    """Where entries begin and end among the glyphs of a line's part; a string has a glyph for each character."""
    if keep_white and not tokenize:
        return [(0, len(texts))] if text.strip(SPACES) else []
    if isinstance(texts, str) and not tokenize:
        begin = len(text) - len(text.lstrip(SPACES))
        return [(begin, len(text.rstrip(SPACES)))] if begin < len(text) else []
    if isinstance(texts, str):
        return [m.span() for m in _INK.finditer(text)]
    found = []  # glyphs of no or several characters
    for i in (i for i, g in enumerate(texts) if g.strip(SPACES)):
        if found and found[-1][1] == i:
            found[-1] = found[-1][0], i + 1
        else:
            found.append((i, i + 1))
    return found if tokenize else [(found[0][0], found[-1][1])] if found else []


def _words(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Begins and ends of an ASCII text's words, and the words."""
    ink = np.zeros(len(text) + 2, np.int8)
    ink[1:-1] = _ASCII_INK[np.frombuffer(text.encode(), np.uint8)]
    edges = np.flatnonzero(np.diff(ink))
    begins, ends = edges[::2], edges[1::2]
    # the separators that only Python takes for white space
    return begins, ends, _INK.findall(text) if _SEPARATORS.search(text) else text.split()


def _inside(out: dict[str, list], held: list[tuple[Run, tuple[float, float] | None]], tokenize: bool, keep_white: bool, pieces: bool) -> None:
    firsts, parts, n = [], [], 0
    for run, space in held:
        texts, advances, start = run.texts, run.advances, run.x
        if space:
            start, advances = space[0], np.concatenate(([space[1]], advances))
            texts = " " + texts if isinstance(texts, str) else (" ", *texts)
        if texts:
            firsts.append(n)
            offsets = np.zeros(len(advances) + 1)
            np.cumsum(advances, out=offsets[1:])
            parts.append((run, start, advances, offsets, texts))
            n += len(texts)
    if not parts:
        return
    if all(isinstance(p[4], str) for p in parts):
        glyphs = text = "".join(p[4] for p in parts)
    else:
        glyphs = [g for p in parts for g in p[4]]
        text = "".join(glyphs)
        if len(text) == len(glyphs) and "" not in glyphs:  # each of one character
            glyphs = text
    if tokenize and len(parts) == 1 and isinstance(glyphs, str) and text.isascii():
        begins, ends, said = _words(text)
    else:
        spans = _spans(glyphs, text, tokenize, keep_white)
        begins, ends = [a for a, _ in spans], [b for _, b in spans]
        said = [glyphs[a:b] if isinstance(glyphs, str) else "".join(glyphs[a:b]) for a, b in spans]
    n = len(said)
    if not n:
        return
    if len(parts) == 1:
        run, start, advances, offsets, _ = parts[0]
        if n == 1:
            a, last = int(begins[0]), int(ends[0]) - 1
            x = [start + float(offsets[a])]
            lengths, places = [abs(start + float(offsets[last]) + float(advances[last]) - x[0])], [a]
        else:
            a, last = np.asarray(begins), np.asarray(ends) - 1
            x = start + offsets[a]
            lengths, x, places = np.abs(start + offsets[last] + advances[last] - x).tolist(), x.tolist(), a.tolist()
        of = [run] * n
    else:
        x, lengths, places, of = [], [], [], []
        for a, b in zip(begins, ends):
            i, k = bisect_right(firsts, a) - 1, bisect_right(firsts, b - 1) - 1
            run, start, _, offsets, _ = parts[i]
            of.append(run)
            places.append(a - firsts[i])
            x.append(start + float(offsets[a - firsts[i]]))
            _, start, advances, offsets, _ = parts[k]
            lengths.append(abs(start + float(offsets[b - 1 - firsts[k]]) + float(advances[b - 1 - firsts[k]]) - x[-1]))
    out["text"] += said
    out["x"] += x
    out["length"] += lengths
    out["pos"] += places
    for name in ("seq", "y", "ascent", "descent"):
        out[name] += [getattr(of[0], name)] * n if len(parts) == 1 else [getattr(r, name) for r in of]
    out["first_x"] += [held[0][0].x] * n
    if pieces:
        xs, each = np.concatenate([p[1] + p[3][:-1] for p in parts]), np.concatenate([p[2] for p in parts])
        for a, b in zip(begins, ends):
            times = 1 if isinstance(glyphs, str) else [len(g) for g in glyphs[a:b]]
            out["xs"].append(np.repeat(xs[a:b], times))
            out["advances"].append(np.repeat(each[a:b], times))
    else:
        out["xs"] += [None] * n
        out["advances"] += [None] * n
