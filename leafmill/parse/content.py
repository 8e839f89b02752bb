"""Content streams as events: operators with their operands, inline images, and forms read in place."""

from __future__ import annotations

import re
from typing import NamedTuple

from leafmill.parse.document import Document, Obj
from leafmill.parse.tokens import END, Keyword, Name, PdfError, Reader, Ref

#: Operators of content streams and how many operands each takes; -1: any number.
OPERATORS = {
    0: "b B b* B* BI BT BX EI EMC ET EX f F f* h ID n q Q s S T* W W*",
    1: "BMC CS cs Do G g gs i J j M MP ri sh TL Tc Tj Tr Ts Tw Tz ' w",
    2: "BDC d d0 DP l m TD Td Tf",
    3: 'RG rg "',
    4: "K k re v y",
    6: "c cm d1 Tm",
    -1: "SC SCN sc scn",
}
ARITY = {name.encode(): n for n, names in OPERATORS.items() for name in names.split()} | {b"TJ": 1}

#: Bits of a warning.
INVALID_OPERATOR, SPURIOUS_OPERANDS, INVALID_XOBJECT, RECURSIVE_XOBJECT, INVALID_IMAGE, MISSING_END, MALFORMED = 1, 2, 4, 8, 16, 32, 64


class Event(NamedTuple):
    kind: str  # operator, image_dictionary, image_data, form, form_end, unexpected
    op: str
    operands: list
    warnings: int
    depth: int
    canvas: dict
    data: bytes = b""
    error: str | None = None  # of kind unexpected: what could not be read


def contents(doc: Document, canvas: dict) -> bytes:
    """A page's streams one after another, line feeds between; empty ones are skipped."""
    value = canvas.get("Contents")
    refs = doc.get(value) if isinstance(doc.get(value), list) else [value]
    return b"\n".join(part for part in (doc.stream(r) for r in refs) if part)


def inherited(doc: Document, node: dict, key: str, most: int = 1000):
    """The value of a key here or at the nearest ancestor that has it."""
    for _ in range(most):
        if key in node:
            return doc.get(node[key])
        node = doc.get(node.get("Parent"))
        if not isinstance(node, dict):
            return None
    raise PdfError("InvalidXRef", "parents form a loop")


def resource(doc: Document, canvas: dict, kind: str, name: str):
    """(reference or value) of a named resource."""
    resources = inherited(doc, canvas, "Resources")
    kinds = doc.get(resources.get(kind)) if isinstance(resources, dict) else None
    return kinds.get(name) if isinstance(kinds, dict) else None


def events(doc: Document, canvas: dict, data: bytes | None = None, path: tuple[int, ...] = ()):
    """Events of a page or form; ``path`` has the forms that are open.

    What can't be read is an event with its error, and reading goes on after it; only a string without an end takes all
    that follows. Of a strict document the error is raised.
    """
    r = Reader(contents(doc, canvas) if data is None else data, references=False)
    operands: list = []
    while True:
        r.skip()
        begin = r.at
        try:
            v = r.value()
        except PdfError as error:
            if doc.strict:
                raise
            yield Event("unexpected", "", operands, MALFORMED, len(path), canvas, error=str(error))
            if r.at == begin:
                return
            operands = []
            continue
        if v is END:
            return
        if not isinstance(v, Keyword):
            operands.append(v)
            continue
        op = bytes(v)
        if op not in ARITY:
            yield Event("unexpected", op.decode("latin-1"), operands, INVALID_OPERATOR, len(path), canvas)
            operands = []
            continue
        n = ARITY[op]
        warnings = 0 if n < 0 or len(operands) == n else INVALID_OPERATOR if len(operands) < n else SPURIOUS_OPERANDS
        if op == b"BI":
            yield from _inline_image(r, len(path), canvas)
            operands = []
            continue
        if op == b"Do" and operands and isinstance(operands[-1], Name):
            yield from _xobject(doc, canvas, operands, warnings, path)
        else:
            yield Event("operator", op.decode(), operands[-n:] if 0 < n < len(operands) else operands, warnings, len(path), canvas)
        operands = []


def _inline_image(r: Reader, depth: int, canvas: dict):
    d, key, warnings = {}, None, 0
    while True:
        v = r.value()
        if isinstance(v, Keyword):
            break
        if key is None:
            key = v
        else:
            d[str(key)] = v
            key = None
    if v != b"ID" or key is not None:
        warnings = INVALID_IMAGE
    yield Event("image_dictionary", "BI", [d], warnings, depth, canvas)
    begin = r.at + 1
    m = re.compile(rb"(?:(?<=[\0\t\n\x0c\r ])|(?=[\0\t\n\x0c\r ]).)EI(?=[\0\t\n\x0c\r ]|\Z)", re.S).search(r.data, begin)
    if not m:
        r.at = len(r.data)
        yield Event("image_data", "ID", [], MISSING_END, depth, canvas, r.data[begin:])
        return
    r.at = m.end()
    end = m.start() if m[0] != b"EI" else m.start() - 1
    yield Event("image_data", "ID", [], 0, depth, canvas, r.data[begin : max(begin, end)])


def _xobject(doc: Document, canvas: dict, operands: list, warnings: int, path: tuple[int, ...]):
    ref = resource(doc, canvas, "XObject", operands[-1])
    found: Obj | None = doc.objects.get(ref.obj) if isinstance(ref, Ref) else None
    d = found.value if found and isinstance(found.value, dict) else None
    if d is None or found.stream is None:
        yield Event("operator", "Do", operands[-1:], warnings | INVALID_XOBJECT, len(path), canvas)
        return
    if d.get("Subtype") != "Form":
        yield Event("operator", "Do", operands[-1:], warnings, len(path), canvas)
        return
    if ref.obj in path:
        yield Event("operator", "Do", operands[-1:], warnings | RECURSIVE_XOBJECT, len(path), canvas)
        return
    form = d if "Resources" in d else d | {"Resources": inherited(doc, canvas, "Resources")}
    yield Event("form", "Do", operands[-1:], warnings, len(path) + 1, canvas)
    yield from events(doc, form, found.decoded(), (*path, ref.obj))
    yield Event("form_end", "Do", [], 0, len(path), canvas)


def pages(doc: Document):
    """(index, reference, dictionary) of the pages in order; nodes met again, and what is no page, end the walk with an error."""
    root = doc.get(doc.trailer.get("Root"))
    top = root.get("Pages") if isinstance(root, dict) else None
    index, stack, met = 0, [top], set()
    while stack:
        ref = stack.pop()
        node = doc.get(ref)
        if not isinstance(ref, Ref) or not isinstance(node, dict):
            raise PdfError("PageNotFound", f"page {index}")
        if ref in met:
            raise PdfError("PageNotFound", "page tree with a loop")
        met.add(ref)
        if node.get("Type") == "Page" or "Kids" not in node and node.get("Type") != "Pages":
            yield index, ref, node
            index += 1
        else:
            kids = doc.get(node.get("Kids"))
            stack += reversed(kids if isinstance(kids, list) else [])
