"""PDF files as tables: each document is parsed where it is read, in Arrow batches, into typed rows.

``mode`` says what becomes of what is broken: ``PERMISSIVE`` keeps a row with its error, ``DROPMALFORMED`` leaves it out,
``FAILFAST`` ends the query. Values are JSON: names as ``"/Name"``, strings as ``"(text"``, references as ``{"R":[obj,gen]}``, so that
``get_json_object``, ``parse_json`` and ``variant_get`` reach into them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.arrow import OUT_ROWS, Out, arrow_schema, bounded_batches
from leafmill.parse import content, layout
from leafmill.parse.document import Document, references
from leafmill.parse.runs import page_runs
from leafmill.parse.tokens import Name, PdfError, Ref, kind_of, text_of

OBJECTS = "doc_id bigint, obj int, gen int, type string, value string, stream_raw binary, filters array<string>, refs array<struct<path: string, obj: int, gen: int>>, container int, error string"
XREF = "doc_id bigint, revision int, obj int, kind string, offset bigint, gen int, container int, idx int, error string"
PAGES = "doc_id bigint, page_index int, obj int, media_box array<double>, crop_box array<double>, rotate int, value string, error string"
CONTENT = "doc_id bigint, page_index int, seq bigint, depth int, type string, op string, operands string, warnings int, data binary, error string"
RUNS = "doc_id bigint, page_index int, seq bigint, text string, x double, y double, length double, space_len double, ascent double, descent double, chunk int, glyphs array<struct<text: string, advance: double>>, rotate int, box array<double>, error string"
ENTRIES = "doc_id bigint, page_index int, seq bigint, pos int, text string, x double, y double, length double, ascent double, descent double, first_x double, rotate int, box array<double>, xs array<double>, advances array<double>"
DOCUMENTS = "doc_id bigint, version string, trailer string, n_objects int, n_bytes bigint, encrypted boolean, rebuilt boolean, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, content of the PDF files under a path, at any depth and in any case of the ending.

    As with all of Spark's readers, names that begin with a dot or underscore are passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def plain(v):
    """A value as JSON has it."""
    if isinstance(v, Ref):
        return {"R": [v.obj, v.gen]}
    if isinstance(v, Name):
        return f"/{v!s}"
    if isinstance(v, bytes):
        return "(" + text_of(v)
    if isinstance(v, list):
        return [plain(i) for i in v]
    if isinstance(v, dict):
        return {k: plain(i) for k, i in v.items()}
    return v


def as_json(v) -> str:
    return json.dumps(plain(v), ensure_ascii=False, separators=(",", ":"))


def table(files: DataFrame, schema: str, rows: Callable[[int, Document], Iterator[dict]], mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1, columns: list[str] | None = None, errors: bool = True, blocks: str | None = None) -> DataFrame:
    """Rows of each file, of which only the named columns leave the worker; or ``blocks`` of rows, given as columns of which
    that one is always there. Without ``errors`` files that can't be read have
    no row, and a column of that name is the rows' own."""
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"no such mode: {mode}")
    spark = files.sparkSession
    bounded_batches(spark)
    kinds = arrow_schema(spark, schema)
    if columns:
        kinds = pa.schema([f for f in kinds if f.name in columns])
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema if f.name in columns)
    drops = errors and mode == "DROPMALFORMED"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(kinds)
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                try:
                    doc = Document.load(data.as_py() or b"", password, mode == "FAILFAST", most_objects)
                    for row in rows(doc_id, doc):
                        if blocks:
                            n = len(row[blocks])
                            for at in range(0, n, OUT_ROWS):
                                if out.extend(min(n - at, OUT_ROWS), {name: column[at : at + OUT_ROWS] for name, column in row.items()}):
                                    yield out.batch()
                        elif not (drops and row.get("error")) and out.add(row):
                            yield out.batch()
                except (PdfError, RecursionError) as error:
                    if mode == "FAILFAST":
                        raise
                    if errors and not drops and out.add({"doc_id": doc_id, "error": str(error)}):
                        yield out.batch()
        yield out.batch()

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(parse, schema)


def documents(files: DataFrame, mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1) -> DataFrame:
    """A row for each file: version, trailer, counts."""

    def rows(doc_id: int, doc: Document) -> Iterator[dict]:
        yield {"doc_id": doc_id, "version": doc.version, "trailer": as_json(doc.trailer), "n_objects": len(doc.objects), "n_bytes": len(doc.data), "encrypted": doc.security is not None, "rebuilt": doc.rebuilt}

    return table(files, DOCUMENTS, rows, mode, password, most_objects)


def objects(files: DataFrame, mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1, streams: bool = True, columns: list[str] | None = None) -> DataFrame:
    """A row for each indirect object; object 0 has the trailer. Streams are as they are in the file, decrypted."""
    said, linked = (columns is None or c in columns for c in ("value", "refs"))
    refs = lambda v: _refs(v) if linked else None

    def rows(doc_id: int, doc: Document) -> Iterator[dict]:
        yield {"doc_id": doc_id, "obj": 0, "gen": 65535, "type": "Trailer", "value": as_json(doc.trailer) if said else None, "refs": refs(doc.trailer), "filters": []}
        for o in doc.objects.values():
            kind = o.value.get("Type") if isinstance(o.value, dict) else None
            yield {
                "doc_id": doc_id,
                "obj": o.obj,
                "gen": o.gen,
                "type": str(kind) if isinstance(kind, Name) else kind_of(o.value),
                "value": as_json(o.value) if said and not o.error else None,
                "stream_raw": o.stream if streams else None,
                "filters": o.filters()[0],
                "refs": refs(o.value),
                "container": o.container,
                "error": o.error,
            }

    return table(files, OBJECTS, rows, mode, password, most_objects, columns)


def xref(files: DataFrame, mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1, columns: list[str] | None = None) -> DataFrame:
    """Every entry of every section, revision 0 being the newest."""

    def rows(doc_id: int, doc: Document) -> Iterator[dict]:
        for e in doc.history:
            yield {"doc_id": doc_id, "revision": e.revision, "obj": e.obj, "kind": e.kind, "offset": e.offset, "gen": e.gen, "container": e.container, "idx": e.index}

    return table(files, XREF, rows, mode, password, most_objects, columns)


def edges(objects_: DataFrame) -> DataFrame:
    """doc_id, src_obj, dst_obj, dst_gen, path of every reference."""
    return objects_.select("doc_id", F.col("obj").alias("src_obj"), F.explode("refs").alias("r")).select("doc_id", "src_obj", F.col("r.obj").alias("dst_obj"), F.col("r.gen").alias("dst_gen"), F.col("r.path").alias("path"))


def _refs(v) -> tuple[list, list, list]:
    found = list(references(v))
    return [p for p, _ in found], [r.obj for _, r in found], [r.gen for _, r in found]


def _box(v) -> list[float] | None:
    return [float(x) for x in v] if isinstance(v, list) and len(v) == 4 and all(isinstance(x, int | float) for x in v) else None


def pages(files: DataFrame, mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1, columns: list[str] | None = None) -> DataFrame:
    """Pages in order, with what they inherit."""
    said = columns is None or "value" in columns

    def rows(doc_id: int, doc: Document) -> Iterator[dict]:
        for index, ref, node in content.pages(doc):
            get = lambda key, node=node: content.inherited(doc, node, key)
            rotate = get("Rotate")
            media = _box(get("MediaBox"))
            yield {"doc_id": doc_id, "page_index": index, "obj": ref.obj, "media_box": media, "crop_box": _box(get("CropBox")) or media, "rotate": int(rotate) % 360 if isinstance(rotate, int | float) else 0, "value": as_json(node) if said else None}

    return table(files, PAGES, rows, mode, password, most_objects, columns)


def content_ops(files: DataFrame, mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1, columns: list[str] | None = None) -> DataFrame:
    """Operators of each page in order, forms read in place; what can't be read is a row with its error among them."""
    said = columns is None or "operands" in columns

    def rows(doc_id: int, doc: Document) -> Iterator[dict]:
        for index, _, node in content.pages(doc):
            for seq, e in enumerate(content.events(doc, node)):
                yield {"doc_id": doc_id, "page_index": index, "seq": seq, "depth": e.depth, "type": e.kind, "op": e.op, "operands": as_json(e.operands) if said else None, "warnings": e.warnings, "data": e.data or None, "error": e.error}

    return table(files, CONTENT, rows, mode, password, most_objects, columns)


def glyph_runs(files: DataFrame, mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1, columns: list[str] | None = None) -> DataFrame:
    """Shown strings of each page, placed; after them a row for each error of the page's content."""
    placed = columns is None or "glyphs" in columns

    def rows(doc_id: int, doc: Document) -> Iterator[dict]:
        for index, _, node in content.pages(doc):
            rotate, box = content.inherited(doc, node, "Rotate"), _box(content.inherited(doc, node, "MediaBox"))
            errors: list[str] = []
            for r in page_runs(doc, node, errors):
                yield {
                    "doc_id": doc_id,
                    "page_index": index,
                    "seq": r.seq,
                    "text": r.text,
                    "x": r.x,
                    "y": r.y,
                    "length": r.length,
                    "space_len": r.space,
                    "ascent": r.ascent,
                    "descent": r.descent,
                    "chunk": r.chunk,
                    "glyphs": (r.texts, r.advances.tolist()) if placed else None,
                    "rotate": int(rotate) % 360 if isinstance(rotate, int | float) else 0,
                    "box": box,
                }
            yield from ({"doc_id": doc_id, "page_index": index, "error": e} for e in errors)

    return table(files, RUNS, rows, mode, password, most_objects, columns)


def entries(files: DataFrame, tokenize: bool = False, keep_white: bool = False, pieces: bool = False, mode: str = "PERMISSIVE", password: str = "", most_objects: int = (1 << 23) - 1, columns: list[str] | None = None) -> DataFrame:
    """Text entries of each page in order, laid out where the page is read; with ``pieces`` also the glyph of each character."""

    def rows(doc_id: int, doc: Document) -> Iterator[dict]:
        for index, _, node in content.pages(doc):
            rotate, box = content.inherited(doc, node, "Rotate"), _box(content.inherited(doc, node, "MediaBox"))
            same = {"doc_id": doc_id, "page_index": index, "rotate": int(rotate) % 360 if isinstance(rotate, int | float) else 0, "box": box}
            found = layout.entries(page_runs(doc, node), tokenize, keep_white, pieces)
            yield found | {name: [value] * len(found["text"]) for name, value in same.items()}

    return table(files, ENTRIES, rows, mode, password, most_objects, columns, errors=False, blocks="text")
