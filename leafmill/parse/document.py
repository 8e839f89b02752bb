"""Files: cross-reference chains, objects, object streams, encryption; and writing them anew or as an increment.

Newest wins: sections are read from the newest on, and an entry that is there is never overwritten. ``strict`` raises
on what is broken; otherwise a broken object is kept with its error, and a file without a usable table is scanned for
objects.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from leafmill.parse import filters
from leafmill.parse.crypto import Security
from leafmill.parse.tokens import END, Keyword, Name, PdfError, Reader, Ref, Text, write_value

MOST_OBJECTS, MOST_GENERATION, MOST_SECTIONS = (1 << 23) - 1, 65535, 512


@dataclass
class Entry:
    """Where an object is: kind ``free``, ``used`` (offset, gen) or ``compressed`` (container, index)."""

    obj: int
    kind: str
    offset: int = 0
    gen: int = 0
    container: int | None = None
    index: int | None = None
    revision: int = 0


@dataclass
class Obj:
    obj: int
    gen: int
    value: object = None
    stream: bytes | None = None
    error: str | None = None
    container: int | None = None

    def filters(self) -> tuple[list[str], list[dict | None]]:
        d = self.value if isinstance(self.value, dict) else {}
        names, parms = d.get("Filter"), d.get("DecodeParms", d.get("DP"))
        names = names if isinstance(names, list) else [] if names is None else [names]
        parms = parms if isinstance(parms, list) else [] if parms is None else [parms]
        return [str(n) for n in names], [p if isinstance(p, dict) else None for p in parms]

    def decoded(self) -> bytes:
        names, parms = self.filters()
        data, rest = filters.decode(self.stream or b"", names, parms)
        if rest:
            raise PdfError("UnsupportedFilter", rest[0])
        return data


@dataclass
class Document:
    data: bytes
    strict: bool = False
    password: str = ""
    most_objects: int = MOST_OBJECTS
    version: str | None = None
    entries: dict[int, Entry] = field(default_factory=dict)
    history: list[Entry] = field(default_factory=list)
    trailer: dict = field(default_factory=dict)
    objects: dict[int, Obj] = field(default_factory=dict)
    security: Security | None = None
    start: int = 0
    rebuilt: bool = False
    fonts: dict = field(default_factory=dict)

    @classmethod
    def load(cls, data: bytes, password: str = "", strict: bool = False, most_objects: int = MOST_OBJECTS) -> Document:
        doc = cls(bytes(data), strict, password, most_objects)
        m = re.search(rb"%PDF-(\d\.\d)", doc.data[: 1024 if not strict else 16])
        if not m:
            raise PdfError("NoPdfFile", "no %PDF header")
        doc.version = m[1].decode()
        if m.start():  # offsets count from the header
            doc.data = doc.data[m.start() :]
        try:
            doc._read_chain()
            if "Root" not in doc.trailer:
                raise PdfError("NoTrailer", "no Root")
        except PdfError:
            if strict:
                raise
            doc._rebuild()
        doc._unlock()
        unlisted = doc._list_members() if doc.rebuilt else {}
        doc._read_objects()
        for obj, error in unlisted.items():
            if obj in doc.objects:
                doc.objects[obj].error = error
        root = doc.get(doc.trailer.get("Root"))
        if isinstance(root, dict) and isinstance(root.get("Version"), Name) and root["Version"] > doc.version:
            doc.version = str(root["Version"])
        return doc

    # structure

    def _read_chain(self) -> None:
        end = self.data.rfind(b"%%EOF")
        if self.strict and self.data.rstrip(b"\r\n\0 ")[-5:] != b"%%EOF" or end < 0:
            raise PdfError("NoEOFToken")
        at = self.data.rfind(b"startxref", 0, end)
        m = re.compile(rb"startxref\s+(\d+)").match(self.data, at) if at >= 0 else None
        if not m:
            raise PdfError("NoXRef")
        self.start = int(m[1])
        met: set[int] = set()
        todo: list[int] = [self.start]
        while todo:
            offset = todo.pop(0)
            if offset in met:
                if offset == self.start or self.strict:
                    raise PdfError("InvalidXRef", "sections form a loop")
                continue
            met.add(offset)
            if len(met) > MOST_SECTIONS:
                raise PdfError("InvalidXRef", "too many sections")
            trailer = self._read_section(offset, len(met) - 1)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            for key in ("XRefStm", "Prev"):
                if isinstance(trailer.get(key), int):
                    todo.append(trailer[key])

    def _read_section(self, offset: int, revision: int) -> dict:
        if not 0 <= offset < len(self.data):
            raise PdfError("InvalidXRef", f"section at {offset}")
        r = Reader(self.data, offset)
        r.skip()
        if self.data[r.at : r.at + 4] != b"xref":
            return self._read_stream_section(r.at, revision)
        r.at += 4
        entry = re.compile(rb"\s*(\d{1,10}) +(\d{1,5}) +([nf])")
        while True:
            first = r.value()
            if isinstance(first, Keyword) and first == b"trailer":
                trailer = r.value()
                if not isinstance(trailer, dict):
                    raise PdfError("NoTrailer")
                return trailer
            count = r.value()
            if not isinstance(first, int) or not isinstance(count, int) or first < 0 or count < 0:
                raise PdfError("InvalidXRef", "no subsection")
            if first + count > self.most_objects + 1:
                raise PdfError("ValueOutOfRange", f"{first + count} objects")
            for i in range(count):
                m = entry.match(self.data, r.at)
                if not m:
                    raise PdfError("InvalidXRef", f"entry {first + i}")
                r.at = m.end()
                kind = "used" if m[3] == b"n" else "free"
                if kind == "used" and int(m[1]) == 0:
                    if self.strict:
                        raise PdfError("InvalidXRef", f"object {first + i} at offset 0")
                    kind = "free"
                self._note(Entry(first + i, kind, int(m[1]), int(m[2]), revision=revision))

    def _read_stream_section(self, at: int, revision: int) -> dict:
        found = self._parse_at(at, None)
        d = found.value
        if not isinstance(d, dict) or d.get("Type") != "XRef" or found.stream is None:
            raise PdfError("NoXRef", f"nothing at {at}")
        widths = d.get("W")
        if not isinstance(widths, list) or len(widths) != 3 or not all(isinstance(w, int) and 0 <= w <= 8 for w in widths):
            raise PdfError("NoXRef", "W")
        size = d.get("Size", 0)
        index = d.get("Index", [0, size])
        if not isinstance(index, list) or len(index) % 2 or not all(isinstance(i, int) and i >= 0 for i in index):
            raise PdfError("NoXRef", "Index")
        data, place, row = found.decoded(), 0, sum(widths)
        for first, count in zip(index[::2], index[1::2]):
            if first + count > self.most_objects + 1:
                raise PdfError("ValueOutOfRange", f"{first + count} objects")
            if row == 0 or place + count * row > len(data):
                raise PdfError("NoXRef", "too little data")
            for obj in range(first, first + count):
                fields, p = [], place
                for w in widths:
                    fields.append(int.from_bytes(data[p : p + w]) if w else None)
                    p += w
                place += row
                kind, a, b = 1 if fields[0] is None else fields[0], fields[1] or 0, fields[2] or 0
                if kind == 0:
                    self._note(Entry(obj, "free", a, b, revision=revision))
                elif kind == 1:
                    self._note(Entry(obj, "used", a, b, revision=revision))
                elif kind == 2:
                    self._note(Entry(obj, "compressed", container=a, index=b, revision=revision))
                elif self.strict:
                    raise PdfError("InvalidXRefType", str(kind))
        return d

    def _note(self, e: Entry) -> None:
        self.history.append(e)
        self.entries.setdefault(e.obj, e)

    def _rebuild(self) -> None:
        """Finds objects by their headers, the last of a number counting, and trailers."""
        self.rebuilt, self.entries, self.history, self.trailer = True, {}, [], {}
        for m in re.finditer(rb"(?:^|[\r\n\0 ])(\d{1,10})[ \t]+(\d{1,5})[ \t]+obj\b", self.data):
            e = Entry(int(m[1]), "used", m.start(1), int(m[2]))
            if e.obj <= self.most_objects:
                self.entries[e.obj] = e
        self.history = list(self.entries.values())
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                found = Reader(self.data, m.end()).value()
            except PdfError:
                continue
            if isinstance(found, dict):
                self.trailer |= found
        if "Root" not in self.trailer:
            for e in self.entries.values():
                try:
                    value = self._parse_at(e.offset, None).value
                except PdfError:
                    continue
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(e.obj, e.gen)
                elif isinstance(value, dict) and value.get("Type") == "XRef":
                    self.trailer |= {k: v for k, v in value.items() if k in ("Root", "Info", "Encrypt", "ID")}
        if "Root" not in self.trailer and "Encrypt" not in self.trailer:
            self._list_members()
            for container in sorted({e.container for e in self.entries.values() if e.kind == "compressed"}, key=lambda c: self.entries[c].offset):
                try:
                    found = self._parse_at(self.entries[container].offset, None)
                    data = found.decoded()
                    for obj, offset in _pairs(found):
                        value = Reader(data, found.value.get("First", 0) + offset).value()
                        if isinstance(value, dict) and value.get("Type") == "Catalog" and obj in self.entries and self.entries[obj].container == container:
                            self.trailer["Root"] = Ref(obj, 0)
                except PdfError:
                    continue  # objects with their errors
        if "Root" not in self.trailer:
            raise PdfError("NoTrailer", "no Root")

    def _list_members(self) -> dict[int, str]:
        """Enters what the object streams of a rebuilt file hold, the last of a number counting; errors of those that can't be read."""
        errors: dict[int, str] = {}
        if b"ObjStm" not in self.data:
            return errors
        for e in sorted((e for e in self.entries.values() if e.kind == "used"), key=lambda e: e.offset):
            try:
                found = self._parse_at(e.offset, self.security)
            except PdfError:
                continue  # an object with its error
            if not isinstance(found.value, dict) or found.value.get("Type") != "ObjStm" or found.stream is None or found.obj != e.obj:
                continue
            try:
                for i, (obj, _) in enumerate(_pairs(found)):
                    before = self.entries.get(obj)
                    if obj <= self.most_objects and obj != e.obj and (before is None or before.kind != "used" or before.offset < e.offset):
                        self.entries[obj] = Entry(obj, "compressed", container=e.obj, index=i)
            except PdfError as error:
                errors[e.obj] = str(error)
        self.history = list(self.entries.values())
        return errors

    # objects

    def _unlock(self) -> None:
        encrypt = self.trailer.get("Encrypt")
        if encrypt is None:
            return
        if isinstance(encrypt, Ref) and encrypt.obj in self.entries:
            encrypt = self._parse_at(self.entries[encrypt.obj].offset, None).value
        ids = self.trailer.get("ID")
        if not isinstance(encrypt, dict):
            raise PdfError("InvalidEncryptionDict")
        security = Security(encrypt, bytes(ids[0]) if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"")
        if security.authenticate(self.password) is None:
            raise PdfError("InvalidPassword")
        self.security = security

    def _parse_at(self, at: int, security: Security | None) -> Obj:
        r = Reader(self.data, at)
        obj, gen, word = r.value(), r.value(), r.value()
        if not isinstance(obj, int) or not isinstance(gen, int) or word != b"obj":
            raise PdfError("NoObject", f"nothing at {at}")
        value = r.value()
        if isinstance(value, Keyword):
            if value != b"endobj":
                raise PdfError("NoObject", f"{bytes(value)!r}")
            return Obj(obj, gen)
        found, word = Obj(obj, gen, value), r.value()
        if isinstance(value, dict) and isinstance(word, Keyword) and word == b"stream":
            begin = r.at + (2 if self.data[r.at : r.at + 2] == b"\r\n" else self.data[r.at : r.at + 1] in (b"\n", b"\r"))
            length = value.get("Length")
            if isinstance(length, Ref):
                e = self.entries.get(length.obj)
                length = self._parse_at(e.offset, None).value if e and e.kind == "used" and e.offset != at else None
            if not isinstance(length, int) or length < 0 or not re.compile(rb"\s*endstream").match(self.data, begin + length):
                if self.strict:
                    raise PdfError("InvalidStreamLength", str(length))
                end = self.data.find(b"endstream", begin)
                if end < 0:
                    raise PdfError("InvalidStreamLength", "no end")
                length = len(self.data[begin:end].removesuffix(b"\n").removesuffix(b"\r"))
            found.stream = self.data[begin : begin + length]
        if security and not (isinstance(value, dict) and value.get("Type") == "XRef"):
            sig = isinstance(value, dict) and value.get("Type") == "Sig"
            found.value = _decrypted(value, security, obj, gen, sig)
            if found.stream is not None and not (isinstance(value, dict) and value.get("Type") == "Metadata" and security.plain_metadata):
                found.stream = security.decrypt(found.stream, obj, gen)
        return found

    def _read_objects(self) -> None:
        encrypt = self.trailer.get("Encrypt")
        members: dict[int, set[int]] = {}
        for e in self.entries.values():
            if e.kind == "compressed":
                members.setdefault(e.container, set()).add(e.obj)
            elif e.kind == "used":
                plain = isinstance(encrypt, Ref) and encrypt.obj == e.obj
                try:
                    found = self._parse_at(e.offset, None if plain else self.security)
                    if found.obj != e.obj:
                        raise PdfError("NoObject", f"object {found.obj} where {e.obj} should be")
                except PdfError as error:
                    if self.strict:
                        raise
                    found = Obj(e.obj, e.gen, error=str(error))
                self.objects[e.obj] = found
        for container, wanted in sorted(members.items()):
            try:
                self._read_members(container, wanted)
            except PdfError as error:
                if self.strict:
                    raise
                for obj in wanted:
                    self.objects.setdefault(obj, Obj(obj, 0, error=str(error), container=container))

    def _read_members(self, container: int, wanted: set[int]) -> None:
        found = self.objects.get(container)
        if found is None or found.stream is None or not isinstance(found.value, dict):
            raise PdfError("NoObject", f"object stream {container}")
        data, n, first = found.decoded(), found.value.get("N", 0), found.value.get("First", 0)
        head = Reader(data, references=False)
        pairs = [(head.value(), head.value()) for _ in range(n)]
        for obj, offset in pairs:
            if not isinstance(obj, int) or not isinstance(offset, int) or offset < 0:
                raise PdfError("InvalidObjectStream", "no pair of numbers")
            if obj in wanted:
                value = Reader(data, first + offset).value()
                if isinstance(value, Keyword):
                    raise PdfError("InvalidObjectStream", "no value" if value is END else repr(value))
                self.objects[obj] = Obj(obj, 0, value, container=container)

    def get(self, value, depth: int = 0):
        """A value, references followed."""
        while isinstance(value, Ref):
            found = self.objects.get(value.obj)
            value, depth = found.value if found and found.gen == value.gen else None, depth + 1
            if depth > 256:
                raise PdfError("InvalidXRef", "references form a loop")
        return value

    def stream(self, ref) -> bytes:
        found = self.objects.get(ref.obj) if isinstance(ref, Ref) else None
        return found.decoded() if found and found.stream is not None else b""


def _pairs(found: Obj):
    """(number, offset) of an object stream's members."""
    n, head = found.value.get("N", 0), Reader(found.decoded(), references=False)
    for _ in range(n if isinstance(n, int) else 0):
        obj, offset = head.value(), head.value()
        if not isinstance(obj, int) or not isinstance(offset, int) or offset < 0:
            raise PdfError("InvalidObjectStream", "no pair of numbers")
        yield obj, offset


def _decrypted(v, security: Security, obj: int, gen: int, sig: bool = False):
    if isinstance(v, Text):
        return Text(security.decrypt(v, obj, gen))
    if isinstance(v, list):
        return [_decrypted(x, security, obj, gen) for x in v]
    if isinstance(v, dict):
        return {k: x if sig and k == "Contents" else _decrypted(x, security, obj, gen) for k, x in v.items()}
    return v


def references(v, path: str = "$"):
    """(path, Ref) of every reference inside a value."""
    if isinstance(v, Ref):
        yield path, v
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from references(x, f"{path}[{i}]")
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from references(x, f"{path}.{k}")


# writing


def object_bytes(o: Obj) -> bytes:
    value = o.value
    if o.stream is not None:
        value = (value if isinstance(value, dict) else {}) | {"Length": len(o.stream)}
        return b"%d %d obj\n" % (o.obj, o.gen) + write_value(value) + b"\nstream\n" + o.stream + b"\nendstream\nendobj\n"
    return b"%d %d obj\n" % (o.obj, o.gen) + write_value(value) + b"\nendobj\n"


def identifier(trailer: dict, objects: dict[int, Obj]) -> bytes:
    """A digest of what the information dictionary says and of the number of objects."""
    info = trailer.get("Info")
    info = objects[info.obj].value if isinstance(info, Ref) and info.obj in objects else info
    return hashlib.md5(write_value(info) + b"%d" % len(objects)).digest()


def xref_blocks(used: dict[int, tuple[int, int]], free: list[int]) -> bytes:
    """Subsections of consecutive numbers; free ones are linked, the first being object 0."""
    chain = sorted({0, *free} - used.keys())
    follow = dict(zip(chain, [*chain[1:], 0]))
    numbers, out = sorted(used.keys() | follow.keys()), [b"xref\n"]
    at = 0
    while at < len(numbers):
        end = at
        while end + 1 < len(numbers) and numbers[end + 1] == numbers[end] + 1:
            end += 1
        out.append(b"%d %d\n" % (numbers[at], end - at + 1))
        for n in numbers[at : end + 1]:
            out.append(b"%010d %05d n \n" % used[n] if n in used else b"%010d %05d f \n" % (follow[n], MOST_GENERATION if n == 0 else 1))
        at = end + 1
    return b"".join(out)


def write_document(objects: list[Obj], trailer: dict, version: str = "1.7") -> bytes:
    """A whole file: header, objects in order, table, trailer."""
    by = {o.obj: o for o in objects if o.error is None and not _is_structure(o)}
    out, used = bytearray(b"%%PDF-%s\n%%\xe2\xe3\xcf\xd3\n" % version.encode()), {}
    for n in sorted(by):
        used[n] = (len(out), by[n].gen)
        out += object_bytes(by[n])
    start = len(out)
    size = max(used, default=0) + 1
    out += xref_blocks(used, [n for n in range(1, size) if n not in used])
    kept = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID")}
    mark = Text(identifier(trailer, by))
    first = kept.get("ID", [mark])[0]
    out += b"trailer\n" + write_value(kept | {"Size": size, "ID": [first, mark]}) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def write_update(original: bytes, changed: list[Obj], trailer: dict, start: int) -> bytes:
    """The original and after it only changed objects, with a table that points to the one before."""
    out, used = bytearray(original), {}
    if not out.endswith(b"\n"):
        out += b"\n"
    for o in sorted(changed, key=lambda o: o.obj):
        used[o.obj] = (len(out), o.gen)
        out += object_bytes(o)
    begin = len(out)
    kept = {k: v for k, v in trailer.items() if k in ("Root", "Info", "ID", "Size")}
    kept["Size"] = max(kept.get("Size", 0), max(used, default=0) + 1)
    out += xref_blocks(used, []) + b"trailer\n" + write_value(kept | {"Prev": start}) + b"\nstartxref\n%d\n%%%%EOF\n" % begin
    return bytes(out)


def _is_structure(o: Obj) -> bool:
    """Tables and object streams of a file, which a new one has none of."""
    return isinstance(o.value, dict) and o.stream is not None and o.value.get("Type") in ("XRef", "ObjStm")
