"""Documents written: whole files, increments, merged files and slices, one document a row.

The unit of work is a document: its bytes are in one row, and a merge brings together the bytes of the files that one
result is made of.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.arrow import Out, bounded_batches, over_groups
from leafmill.parse import content
from leafmill.parse.document import Document, Obj, object_bytes, references, write_document, write_update
from leafmill.parse.tokens import Name, Ref

INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


def rebase(v, by: int):
    """A value whose references are moved."""
    if isinstance(v, Ref):
        return Ref(v.obj + by, v.gen)
    if isinstance(v, list):
        return [rebase(x, by) for x in v]
    if isinstance(v, dict):
        return {k: rebase(x, by) for k, x in v.items()}
    return v


def collect_garbage(objects: list[Obj], trailer: dict) -> list[Obj]:
    by, seen = {o.obj: o for o in objects}, set()
    todo = [r.obj for _, r in references({k: v for k, v in trailer.items() if k in ("Root", "Info")})]
    while todo:
        n = todo.pop()
        if n in by and n not in seen:
            seen.add(n)
            todo += [r.obj for _, r in references(by[n].value)]
    return [by[n] for n in sorted(seen)]


def _top_items(doc: Document) -> tuple[list[int], int]:
    """Numbers of the outline's items of the first level in order, nodes met again left out, and how many items show."""
    root = doc.get(doc.trailer.get("Root"))
    top = doc.get(root.get("Outlines")) if isinstance(root, dict) else None
    found: dict[int, None] = {}
    ref = top.get("First") if isinstance(top, dict) else None
    while isinstance(ref, Ref) and ref.obj not in found and isinstance(item := doc.get(ref), dict):
        found[ref.obj] = None
        ref = item.get("Next")
    count = top.get("Count") if found else 0
    return list(found), count if isinstance(count, int) and count >= len(found) else len(found)


def merge_documents(parts: list[bytes], ranges: list[tuple[int, int] | None] | None = None) -> bytes:
    """Pages of all parts in order; ``ranges`` (first, count) take a slice of a part. Inherited attributes go into the pages.

    Outlines of whole parts follow one another under one root; name trees aren't merged.
    """
    objects, kids, following = [], [], 3
    items, shown = [], 0
    for k, data in enumerate(parts):
        doc = Document.load(data)
        offset = following - 1
        span = ranges[k] if ranges else None
        listed = list(content.pages(doc))
        taken = listed if span is None else listed[span[0] : span[0] + span[1]]
        for o in doc.objects.values():
            if o.error is None and not (isinstance(o.value, dict) and o.value.get("Type") in ("XRef", "ObjStm")):
                objects.append(Obj(o.obj + offset, 0, rebase(o.value, offset), o.stream))
        by = {o.obj: o for o in objects}
        for _, ref, node in taken:
            page = {key: v for key, v in node.items() if key != "Parent"}
            for key in INHERITED:
                if key not in page and (v := content.inherited(doc, node, key)) is not None:
                    page[key] = v
            by[ref.obj + offset].value = rebase(page, offset) | {"Parent": Ref(2, 0)}
            kids.append(Ref(ref.obj + offset, 0))
        if span is None:
            top, count = _top_items(doc)
            items += [by[n + offset] for n in top if n + offset in by]
            shown += count
        following = max((o.obj for o in objects), default=2) + 1
    catalog = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}
    if items:
        refs = [Ref(o.obj, 0) for o in items]
        for o, before, after in zip(items, [None, *refs], [*refs[1:], None]):
            near = {"Parent": Ref(following, 0), "Prev": before, "Next": after}
            o.value = {k: v for k, v in o.value.items() if k not in near} | {k: v for k, v in near.items() if v is not None}
        objects.append(Obj(following, 0, {"Type": Name("Outlines"), "First": refs[0], "Last": refs[-1], "Count": shown}))
        catalog["Outlines"] = Ref(following, 0)
    objects += [Obj(1, 0, catalog), Obj(2, 0, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})]
    trailer = {"Root": Ref(1, 0)}
    return write_document(collect_garbage(objects, trailer), trailer)


def changed_objects(old: Document, new: list[Obj]) -> list[Obj]:
    """Objects whose bytes differ from the ones before."""
    return [o for o in new if o is not (before := old.objects.get(o.obj)) and (before is None or object_bytes(o) != object_bytes(before))]


def save_update(original: bytes, new: list[Obj], doc: Document | None = None) -> bytes:
    """``doc`` is the original if it is read already, and not changed since."""
    doc = doc or Document.load(original)
    return write_update(original, changed_objects(doc, new), doc.trailer, doc.start)


def byte_range_digest(data: bytes) -> str | None:
    """SHA-256 of what a signature's ByteRange covers: all but its Contents."""
    m = re.search(rb"/ByteRange\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*\]", data)
    if not m:
        return None
    a, n, b, k = map(int, m.groups())
    return hashlib.sha256(data[a : a + n] + data[b : b + k]).hexdigest()


def merge(files: DataFrame, into: str = "into", order: str = "ord") -> DataFrame:
    """into, content: the files of each result one after another. A result's files are as large as the result."""

    def made(group: list[dict]) -> Iterator[dict]:
        yield {into: group[0][into], "content": merge_documents([r["content"] for r in group])}

    return over_groups(files.select(into, order, "content"), [into], [order], made, f"{into} {dict(files.dtypes)[into]}, content binary")


def slice_pages(files: DataFrame, first: int, count: int) -> DataFrame:
    """doc_id, content: a range of each document's pages as a document of its own."""

    bounded_batches(files.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(kinds)
        for batch in batches:
            for doc_id, c in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                if out.add({"doc_id": doc_id, "content": merge_documents([c.as_py()], [(first, count)])}):
                    yield out.batch()
        yield out.batch()

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id bigint, content binary")
