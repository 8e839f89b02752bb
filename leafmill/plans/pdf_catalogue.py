"""Queries over PDF files that are made from the documents table and read back; DuckDB says what must come out.

Each document becomes one file: its lines, ASCII as it is and all else as ``?``, 50 to a page; an information dictionary, an
outline with an item a page, a form of nested fields, named destinations, a link a page, and an object that nothing
refers to. Whole texts are written; a null one is a file of one empty page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.arrow import Out, bounded_batches
from leafmill.functions import values
from leafmill.operators import extract, structure
from leafmill.operators.text import Match
from leafmill.parse import filters
from leafmill.parse.document import Document, Obj, write_document
from leafmill.parse.tokens import Name, Ref, Text
from leafmill.sources import pdf, write

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Lines of a page, the first one's height, and the distance of lines.
LINES, TOP, STEP = 50, 780, 14

#: Objects of every file besides three for each page: catalog, page tree, font, outline, form's root and two fields, names, information, and one that is lost.
FIXED = 10

_FONT = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "FirstChar": 32, "Widths": [500] * 95, "Encoding": Name("WinAnsiEncoding")}


def _literal(line: str) -> bytes:
    return b"(" + line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode() + b")"


def paper(doc_id: int | None, text: str, lang: str | None, source: str | None) -> bytes:
    """The file of one document; ``text`` has ASCII and line feeds only."""
    lines = text.split("\n")
    pages = [lines[at : at + LINES] for at in range(0, len(lines), LINES)]
    ref = lambda k: Ref(FIXED + 1 + k, 0)
    of = [(ref(3 * i), ref(3 * i + 1), ref(3 * i + 2)) for i in range(len(pages))]  # page, contents, outline item
    filter_ = ["FlateDecode"], ["ASCII85Decode", "FlateDecode"], ["ASCIIHexDecode"], []
    objects = [
        Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Outlines": Ref(4, 0), "AcroForm": {"Fields": [Ref(5, 0)]}, "Names": {"Dests": Ref(8, 0)}}),
        Obj(2, 0, {"Type": Name("Pages"), "Kids": [p for p, _, _ in of], "Count": len(of), "MediaBox": [0, 0, 600, 800], "Resources": {"Font": {"F": Ref(3, 0)}}}),
        Obj(3, 0, _FONT),
        Obj(4, 0, {"Type": Name("Outlines"), "First": of[0][2], "Last": of[-1][2], "Count": len(of)}),
        Obj(5, 0, {"T": Text((lang or "none").encode()), "FT": Name("Tx"), "Ff": 1 << 12, "Kids": [Ref(6, 0), Ref(7, 0)]}),
        Obj(6, 0, {"T": Text(b"id"), "Parent": Ref(5, 0), "V": Text(str(doc_id).encode())}),
        Obj(7, 0, {"T": Text(b"lines"), "Parent": Ref(5, 0), "FT": Name("Btn"), "Ff": 1 << 16, "V": Text(str(len(lines)).encode())}),
        Obj(8, 0, {"Names": [x for i, (p, _, _) in enumerate(of) for x in (Text(b"page%06d" % i), [p, Name("Fit")])]}),
        Obj(9, 0, {"Title": Text((lang or "").encode()), "Author": Text((source or "").encode("utf-8")), "CreationDate": Text(b"D:20200102030405Z")}),
        Obj(10, 0, {"Lost": len(lines)}),
    ]
    for i, (page, (p, c, o)) in enumerate(zip(pages, of)):
        drawn = b"BT /F 10 Tf\n" + b"".join(b"1 0 0 1 50 %d Tm %s Tj\n" % (TOP - STEP * k, _literal(line)) for k, line in enumerate(page)) + b"ET"
        link = {"Type": Name("Annot"), "Subtype": Name("Link"), "F": 4, "Rect": [10, 20, 30 + i, 40], "A": {"S": Name("URI"), "URI": Text(b"http://x/%d" % i)}}
        chain = filter_[i % 4]
        own = {"Filter": [Name(f) for f in chain]} if chain else {}
        turned = {"Rotate": 90 * (i % 4)} if i % 4 else {}
        crop = {"CropBox": [0, 0, 300, 400 + i]} if i % 2 else {}
        objects += [
            Obj(p.obj, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": c, "Annots": [link]} | turned | crop),
            Obj(c.obj, 0, own, filters.encode(drawn, chain) if chain else drawn),
            Obj(o.obj, 0, {"Title": Text(b"Page %d" % (i + 1)), "Parent": Ref(4, 0), "Dest": [p, Name("Fit")]} | ({"Next": of[i + 1][2]} if i + 1 < len(of) else {})),
        ]
    return write_document(objects, {"Root": Ref(1, 0), "Info": Ref(9, 0)})


def _rows(make: Callable[[dict], bytes], files: DataFrame) -> DataFrame:
    """doc_id, content: a file for each row."""

    bounded_batches(files.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(kinds)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                for r in batch.slice(at, 100).to_pylist():
                    if out.add({"doc_id": r["doc_id"], "content": make(r)}):
                        yield out.batch()
        yield out.batch()

    return files.mapInArrow(run, "doc_id bigint, content binary")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content of a file for each document."""
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\n -~]", "?")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), ascii_.alias("text"), "lang", "source")
    return _rows(lambda r: paper(r["doc_id"], r["text"], r["lang"], r["source"]), d)


def _query(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(papers(spark, sf_dir))
    return f


@_query
def pdf_documents(files):
    d = pdf.documents(files)
    return d.select("doc_id", "version", F.col("n_objects").cast("long").alias("n_objects"), "encrypted", "rebuilt", structure.ref_of("Root", "trailer").cast("long").alias("root"), "error")


@_query
def pdf_pages(files):
    p = pdf.pages(files, columns=["doc_id", "page_index", "media_box", "crop_box", "rotate"])
    box = lambda c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("int").cast("string")))
    return p.select("doc_id", F.col("page_index").cast("long").alias("page_index"), box("media_box").alias("media_box"), box("crop_box").alias("crop_box"), F.col("rotate").cast("long").alias("rotate"))


@_query
def pdf_page_count(files):
    return pdf.pages(files, columns=["doc_id", "page_index"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


@_query
def pdf_xref_entries(files):
    x = pdf.xref(files, columns=["doc_id", "kind"])
    return x.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@_query
def pdf_objects(files):
    o = pdf.objects(files, streams=False, columns=["doc_id", "obj", "type"]).where("obj > 0")
    return o.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


@_query
def pdf_edges(files):
    """References by where they stand."""
    e = pdf.edges(pdf.objects(files, streams=False, columns=["doc_id", "obj", "refs"]))
    return e.groupBy("doc_id", F.regexp_replace("path", r"\[\d+\]", "[]").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@_query
def pdf_operators(files):
    c = pdf.content_ops(files, columns=["doc_id", "page_index", "op", "warnings"]).where("op IS NOT NULL AND op <> ''")
    return c.groupBy("doc_id", "page_index", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("warnings").cast("long").alias("warnings")).withColumn("page_index", F.col("page_index").cast("long"))


@_query
def pdf_shown_strings(files):
    """Strings as they are shown, blanks and all, from all four codecs."""
    r = pdf.glyph_runs(files, columns=["doc_id", "page_index", "text", "y", "length"])
    return r.select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.round("y").cast("long").alias("y"), "text", F.round("length").cast("long").alias("length")).where("text <> ''")


def _entries(files: DataFrame, raw: bool = True, **how) -> DataFrame:
    found = extract.file_entries(files, Match(**how), raw_coordinates=raw)
    whole = lambda c: F.round(c).cast("long").alias(c)
    return found.select("doc_id", F.col("page_index").cast("long").alias("page_index"), whole("x"), whole("y"), "text", whole("length"))


@_query
def pdf_text_entries(files):
    return _entries(files)


@_query
def pdf_text_words(files):
    return _entries(files, tokenize=True)


@_query
def pdf_text_keep_white(files):
    return _entries(files, keep_white=True)


@_query
def pdf_text_search(files):
    return _entries(files, pattern="the")


@_query
def pdf_text_search_icase(files):
    return _entries(files, pattern="THE", ignore_case=True)


@_query
def pdf_text_search_regex(files):
    return _entries(files, pattern="[0-9]{3}", regex=True)


@_query
def pdf_text_search_whole(files):
    return _entries(files, tokenize=True, pattern="the", whole_word=True)


@_query
def pdf_text_substring(files):
    """The pattern's own place: x and length are of the glyphs that match."""
    return _entries(files, pattern="and", extract=True)


@_query
def pdf_text_clip(files):
    return _entries(files, clip=(0.0, 500.0, 600.0, 200.0))


@_query
def pdf_metadata(files):
    m = structure.metadata(files)
    return m.select("doc_id", F.col("title"), F.col("author"))


@_query
def pdf_creation_date(files):
    o = pdf.objects(files, streams=False, columns=["doc_id", "value"]).where("value LIKE '%CreationDate%'")
    return o.select("doc_id", values.parse_date(structure.text_of("CreationDate")).ts.cast("string").alias("created"))


@_query
def pdf_outlines(files):
    o = structure.outlines(files)
    return o.select("doc_id", F.col("level").cast("long").alias("level"), F.col("pos").cast("long").alias("pos"), "title")


@_query
def pdf_fields(files):
    f = structure.fields(files)
    return f.select("doc_id", "full_name", "type", F.col("flags").cast("long").alias("flags"), F.substring("value", 2, 1 << 30).alias("value"))


@_query
def pdf_destinations(files):
    d = structure.destinations(files)
    return d.select("doc_id", "key", F.col("page_index").cast("long").alias("page_index"))


@_query
def pdf_annotations(files):
    a = structure.annotations(files)
    return a.select("doc_id", F.col("page_index").cast("long").alias("page_index"), "subtype", F.col("flags").cast("long").alias("flags"), F.get("rect", F.lit(2)).cast("long").alias("right"), "uri")


@_query
def pdf_inherited_box(files):
    """The page tree's box and resources as pages inherit them."""
    found = structure.inherit_key(files, "MediaBox").withColumnRenamed("found", "box")
    return found.where("type = 'Page'").groupBy("doc_id", "box").agg(F.count(F.lit(1)).alias("n"))


@_query
def pdf_garbage(files):
    return structure.garbage(files).select("doc_id", F.col("obj").cast("long").alias("obj"))


@_query
def pdf_reachable(files):
    return structure.reachable(files).where("obj > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def pdf_slice(files):
    """The second page of each file as a file of its own, and what it says."""
    return _entries(write.slice_pages(files, 1, 1))


@_query
def pdf_merge(files):
    """Files of two neighbouring ids in one: its pages and outline."""
    merged = write.merge(files.select(F.floor(F.col("doc_id") / 2).cast("long").alias("into"), F.col("doc_id").alias("ord"), "content").where("ord IS NOT NULL"))
    return structure.sizes(merged.withColumnRenamed("into", "doc_id"))


@_query
def pdf_incremental(files):
    """A changed title saved behind the file: the newest revision's table has one object, and the title is read back."""

    def changed(row: dict) -> bytes:
        doc = Document.load(row["content"])
        info = doc.objects[9]
        return write.save_update(row["content"], [*(o for n, o in doc.objects.items() if n != 9), Obj(9, 0, info.value | {"Title": Text(b"changed %d" % len(doc.objects))})], doc)

    newest = lambda doc: {"n_changed": sum(e.revision == 0 and e.obj > 0 for e in doc.history)}
    return structure.metadata(_rows(changed, files), "n_changed bigint", newest).select("doc_id", "n_changed", "title")


_LINES = r"""t AS (SELECT doc_id, lang, source, string_split(regexp_replace(coalesce(text, ''), '[^\n -~]', '?', 'g'), chr(10)) AS ls FROM documents),
    d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(lang, '') AS title, coalesce(source, '') AS author, len(ls) AS n, CAST(ceil(len(ls) / 50.0) AS BIGINT) AS p FROM t),
    pg AS (SELECT doc_id, unnest(range(0, p)) AS page_index FROM d),
    l AS (SELECT doc_id, unnest(ls) AS ln, unnest(range(0, len(ls))) AS i FROM t),
    r AS (SELECT doc_id, CAST(i // 50 AS BIGINT) AS page_index, CAST(780 - 14 * (i % 50) AS BIGINT) AS y, ln FROM l),
    e AS (SELECT doc_id, page_index, CAST(50 + 5 * (length(ln) - length(ltrim(ln, ' '))) AS BIGINT) AS x, y, trim(ln, ' ') AS text, CAST(5 * length(trim(ln, ' ')) AS BIGINT) AS length FROM r WHERE trim(ln, ' ') <> ''),
    wi AS (SELECT doc_id, page_index, y, w, sum(length(w) + 1) OVER (PARTITION BY doc_id, page_index, y ORDER BY k) - length(w) - 1 AS off
        FROM (SELECT doc_id, page_index, y, unnest(string_split(ln, ' ')) AS w, unnest(range(0, len(string_split(ln, ' ')))) AS k FROM r)),
    w AS (SELECT doc_id, page_index, CAST(50 + 5 * off AS BIGINT) AS x, y, w AS text, CAST(5 * length(w) AS BIGINT) AS length FROM wi WHERE w <> '')"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SELECT = {
    "pdf_documents": "SELECT doc_id, '1.7' AS version, 10 + 3 * p AS n_objects, false AS encrypted, false AS rebuilt, CAST(1 AS BIGINT) AS root, CAST(NULL AS VARCHAR) AS error FROM d",
    "pdf_pages": "SELECT doc_id, page_index, '0 0 600 800' AS media_box, CASE WHEN page_index % 2 = 1 THEN '0 0 300 ' || (400 + page_index) ELSE '0 0 600 800' END AS crop_box, 90 * (page_index % 4) AS rotate FROM pg",
    "pdf_page_count": "SELECT doc_id, p AS n_pages FROM d",
    "pdf_xref_entries": "SELECT doc_id, 'free' AS kind, CAST(1 AS BIGINT) AS n FROM d UNION ALL SELECT doc_id, 'used', 10 + 3 * p FROM d",
    "pdf_objects": """SELECT doc_id, type, x.n FROM d, LATERAL (SELECT unnest(['Catalog', 'Pages', 'Font', 'Outlines', 'Page', 'Dictionary']) AS type, unnest([1, 1, 1, 1, p, 6 + 2 * p]) AS n) AS x""",
    "pdf_edges": """SELECT doc_id, path, x.n FROM d, LATERAL (SELECT unnest(['$.Root', '$.Info', '$.Pages', '$.Outlines', '$.AcroForm.Fields[]', '$.Names.Dests', '$.Kids[]', '$.Resources.Font.F', '$.First', '$.Last', '$.Parent',
        '$.Names[][]', '$.Contents', '$.Dest[]', '$.Next']) AS path, unnest([1, 1, 1, 1, 1, 1, p + 2, 1, 1, 1, 2 * p + 2, p, p, p, p - 1]) AS n) AS x WHERE x.n > 0""",
    "pdf_fields": """SELECT doc_id, lang || suffix AS full_name, type, flags, value FROM d, LATERAL (SELECT unnest(['', '.id', '.lines']) AS suffix, unnest(['TextBox', 'TextBox', 'PushButton']) AS type,
        unnest([4096, 4096, 65536]) AS flags, unnest([NULL, CAST(doc_id AS VARCHAR), CAST(n AS VARCHAR)]) AS value)""",
    "pdf_operators": """SELECT doc_id, page_index, op, n, CAST(0 AS BIGINT) AS warnings FROM (SELECT doc_id, page_index, count(*) AS c FROM r GROUP BY ALL),
        LATERAL (SELECT unnest(['BT', 'Tf', 'Tm', 'Tj', 'ET']) AS op, unnest([1, 1, c, c, 1]) AS n)""",
    "pdf_shown_strings": "SELECT doc_id, page_index, y, ln AS text, CAST(5 * length(ln) AS BIGINT) AS length FROM r WHERE ln <> ''",
    "pdf_text_entries": "SELECT * FROM e",
    "pdf_text_words": "SELECT * FROM w",
    "pdf_text_keep_white": "SELECT doc_id, page_index, CAST(50 AS BIGINT) AS x, y, ln AS text, CAST(5 * length(ln) AS BIGINT) AS length FROM r WHERE trim(ln, ' ') <> ''",
    "pdf_text_search": "SELECT * FROM e WHERE contains(text, 'the')",
    "pdf_text_search_icase": f"SELECT * FROM e WHERE contains({_LOWER}, 'the')",
    "pdf_text_search_regex": "SELECT * FROM e WHERE regexp_matches(text, '[0-9]{3}')",
    "pdf_text_search_whole": "SELECT * FROM w WHERE text = 'the'",
    "pdf_text_substring": "SELECT doc_id, page_index, CAST(x + 5 * (strpos(text, 'and') - 1) AS BIGINT) AS x, y, 'and' AS text, CAST(15 AS BIGINT) AS length FROM e WHERE contains(text, 'and')",
    "pdf_text_clip": "SELECT * FROM e WHERE y BETWEEN 500 AND 700",
    "pdf_metadata": "SELECT doc_id, title, author FROM d",
    "pdf_creation_date": "SELECT doc_id, '2020-01-02 03:04:05' AS created FROM d",
    "pdf_outlines": "SELECT doc_id, CAST(1 AS BIGINT) AS level, page_index AS pos, 'Page ' || (page_index + 1) AS title FROM pg",
    "pdf_destinations": "SELECT doc_id, 'page' || lpad(CAST(page_index AS VARCHAR), 6, '0') AS key, page_index FROM pg",
    "pdf_annotations": """SELECT doc_id, page_index, 'Link' AS subtype, CAST(4 AS BIGINT) AS flags, 30 + page_index AS "right", 'http://x/' || page_index AS uri FROM pg""",
    "pdf_inherited_box": "SELECT doc_id, '[0,0,600,800]' AS box, p AS n FROM d",
    "pdf_garbage": "SELECT doc_id, CAST(10 AS BIGINT) AS obj FROM d",
    "pdf_reachable": "SELECT doc_id, 9 + 3 * p AS n FROM d",
    "pdf_slice": "SELECT doc_id, CAST(0 AS BIGINT) AS page_index, x, y, text, length FROM e WHERE page_index = 1",
    "pdf_merge": "SELECT CAST(doc_id // 2 AS BIGINT) AS doc_id, CAST(sum(p) AS BIGINT) AS n_pages, CAST(sum(p) AS BIGINT) AS n_items FROM d GROUP BY 1",
    "pdf_incremental": "SELECT doc_id, CAST(1 AS BIGINT) AS n_changed, 'changed ' || (10 + 3 * p) AS title FROM d",
}

ORACLE_SQL = {name: f"WITH {_LINES}\n    {sql}" for name, sql in _SELECT.items()}
