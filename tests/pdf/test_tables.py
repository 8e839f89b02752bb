"""PDF files as tables: structure, text entries, writing."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.arrow import Out
from leafmill.operators import extract, graph, structure
from leafmill.operators.text import Match
from leafmill.parse import filters
from leafmill.parse.document import Document, Obj, write_document
from leafmill.parse.fonts import write_cmap
from leafmill.parse.tokens import Name, Ref, Text
from leafmill.plans import pdf_catalogue
from leafmill.sources import pdf, write

WIDTHS = [500] * 95
FONT = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "FirstChar": 32, "Widths": [250, *WIDTHS[1:]], "Encoding": Name("WinAnsiEncoding")}
PAGE_ONE = b"""BT /F 10 Tf 1 0 0 1 100 700 Tm (Hello) Tj 1 0 0 1 130 700 Tm (world) Tj
1 0 0 1 400 700 Tm (far) Tj 1 0 0 1 100 650 Tm [(The ) -1000 (the)] TJ 0 -20 Td (  padded  ) Tj ET"""


def sample() -> bytes:
    objects = [
        Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0), "AcroForm": {"Fields": [Ref(20, 0)]}, "Outlines": Ref(30, 0), "Names": {"Dests": Ref(40, 0)}, "Metadata": Ref(50, 0)}),
        Obj(2, 0, {"Type": Name("Pages"), "Kids": [Ref(3, 0), Ref(4, 0)], "Count": 2, "MediaBox": [0, 0, 600, 800], "Resources": {"Font": {"F": Ref(9, 0)}}}),
        Obj(3, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": [Ref(5, 0)], "Annots": [Ref(10, 0), Ref(21, 0)]}),
        Obj(4, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(6, 0), "Rotate": 450, "CropBox": [1, 2, 3, 4]}),
        Obj(5, 0, {"Filter": [Name("ASCIIHexDecode"), Name("FlateDecode")]}, filters.encode(PAGE_ONE, ["ASCIIHexDecode", "FlateDecode"])),
        Obj(6, 0, {}, b"BT /F 10 Tf 50 60 Td (turned) Tj ET"),
        Obj(9, 0, FONT),
        Obj(10, 0, {"Subtype": Name("Link"), "F": 4, "Rect": [1, 2, 3, 4], "A": {"S": Name("URI"), "URI": Text(b"http://x/")}, "Contents": Text(b"note")}),
        Obj(20, 0, {"T": Text(b"a.b"), "FT": Name("Btn"), "Ff": 1 << 16, "Kids": [Ref(21, 0), Ref(22, 0)]}),
        Obj(21, 0, {"T": Text(b"c"), "Parent": Ref(20, 0), "Subtype": Name("Widget")}),
        Obj(22, 0, {"T": Text(b"d"), "Parent": Ref(20, 0), "FT": Name("Tx"), "V": Text(b"value")}),
        Obj(30, 0, {"First": Ref(31, 0), "Last": Ref(32, 0)}),
        Obj(31, 0, {"Title": Text(b"One"), "Parent": Ref(30, 0), "Next": Ref(32, 0), "First": Ref(33, 0)}),
        Obj(32, 0, {"Title": Text(b"Two"), "Parent": Ref(30, 0), "Next": Ref(31, 0)}),
        Obj(33, 0, {"Title": Text(b"Inner"), "Parent": Ref(31, 0)}),
        Obj(40, 0, {"Kids": [Ref(41, 0)]}),
        Obj(41, 0, {"Limits": [Text(b"p1"), Text(b"p2")], "Names": [Text(b"p1"), [Ref(3, 0), Name("Fit")], Text(b"p2"), {"D": [Ref(4, 0), Name("Fit")]}]}),
        Obj(50, 0, {"Type": Name("Metadata")}, b'<x:xmpmeta><dc:title><rdf:Alt><rdf:li>From XMP</rdf:li></rdf:Alt></dc:title><pdf:Producer>Maker</pdf:Producer><d pdfaid:part="1" pdfaid:conformance="B"/></x:xmpmeta>'),
        Obj(60, 0, {"Title": Text(b"From info"), "CreationDate": Text(b"D:20120205132456+01'00'")}),
        Obj(70, 0, {"Orphan": Ref(71, 0)}),
        Obj(71, 0, {"X": 1}),
    ]
    return write_document(objects, {"Root": Ref(1, 0), "Info": Ref(60, 0)})


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdfs")
    (folder / "a.pdf").write_bytes(sample())
    (folder / "broken.pdf").write_bytes(b"no file at all")
    return pdf.read_files(spark, str(folder))


@pytest.fixture(scope="module")
def objects(files):
    return pdf.objects(files).where("error IS NULL").cache()


def test_modes(files):
    assert pdf.documents(files).where("error LIKE 'NoPdfFile%'").count() == 1
    assert pdf.documents(files, "DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="NoPdfFile"):
        pdf.documents(files, "FAILFAST").collect()


def test_pages_and_content(files):
    rows = pdf.pages(files, "DROPMALFORMED").orderBy("page_index").collect()
    assert [(r.obj, r.rotate, r.media_box[2], r.crop_box) for r in rows] == [(3, 0, 600.0, [0, 0, 600, 800]), (4, 90, 600.0, [1, 2, 3, 4])]
    ops = pdf.content_ops(files, "DROPMALFORMED").where("page_index = 0").orderBy("seq").collect()
    assert [r.op for r in ops][:4] == ["BT", "Tf", "Tm", "Tj"] and ops[1].operands == '["/F",10]' and not any(r.warnings for r in ops)


def entries(files, **how):
    flags = {k: how.pop(k) for k in ("bounding_box", "raw_coordinates") if k in how}
    found = extract.text_entries(pdf.glyph_runs(files, "DROPMALFORMED"), Match(**how), **flags)
    return [(r.page_index, r.text, round(r.x, 3), round(r.y, 3), round(r.length, 3)) for r in found.orderBy("page_index", "seq").collect()]


def test_text_entries(files):
    assert entries(files, raw_coordinates=True) == [
        (0, "Hello world", 100.0, 700.0, 55.0),
        (0, "far", 400.0, 700.0, 15.0),
        (0, "The the", 100.0, 650.0, 42.5),
        (0, "padded", 105.0, 630.0, 30.0),
        (1, "turned", 50.0, 60.0, 30.0),
    ]
    words = entries(files, tokenize=True, raw_coordinates=True)
    assert [w[1] for w in words] == ["Hello", "world", "far", "The", "the", "padded", "turned"] and words[1][2] == 130.0
    assert [e[1] for e in entries(files, pattern="the")] == ["The the"]
    assert [e[1] for e in entries(files, pattern="HELLO WORLD", ignore_case=True, whole_word=True)] == ["Hello world"]
    assert [e[1] for e in entries(files, pattern="^[fp]a", regex=True)] == ["far", "padded"]
    assert [e[1] for e in entries(files, clip=(0, 640, 300, 20))] == ["The the"]
    sub = entries(files, pattern="world", whole_word=True, extract=True, raw_coordinates=True)
    assert [e[1] for e in sub] == ["world"] and sub[0][2] == pytest.approx(130, abs=1)
    assert entries(files, pattern="turned")[0][2:4] == (60.0, 550.0)
    box = extract.text_entries(pdf.glyph_runs(files, "DROPMALFORMED"), bounding_box=True).where("text = 'far'").first().bbox
    assert (box.l, box.w, box.h) == (400.0, 15.0, 10.0)
    with pytest.raises(ValueError):
        Match("a", regex=True, whole_word=True)


def test_structure(files, objects):
    pages = pdf.pages(files, "DROPMALFORMED")
    got = {r.full_name: (r.type, r.value, r.parent) for r in structure.fields(objects).collect()}
    assert got == {"a..b": ("PushButton", None, None), "a..b.c": ("PushButton", None, 20), "a..b.d": ("TextBox", "(value", 20)}
    notes = structure.annotations(objects, pages).orderBy("idx").collect()
    assert [(r.page_index, r.subtype, r.flags, r.contents, r.uri) for r in notes] == [(0, "Link", 4, "note", "http://x/"), (0, "Widget", 0, None, None)]
    assert {(r.title, r.level, r.pos) for r in structure.outlines(objects).collect()} == {("One", 1, 0), ("Two", 1, 1), ("Inner", 2, 0)}
    assert {(r.key, r.page_index) for r in structure.destinations(objects, pages).collect()} == {("p1", 0), ("p2", 1)}
    m = structure.metadata(objects).first()
    assert (m.title, m.producer, m.pdfa_level, m.created_offset_min, m.created.isoformat()) == ("From info", "Maker", "1B", 60, "2012-02-05T12:24:56")
    assert {r.obj for r in structure.garbage(objects).collect()} == {70, 71}
    box = {r.obj: r.found for r in structure.inherit_key(objects, "MediaBox").collect()}
    assert box[3] == box[2] == "[0,0,600,800]" and box[9] is None
    assert '"Count":2' in {r.obj: r.found for r in structure.find_key(objects, "Pages").collect()}[1]


def test_edges_and_xref(files, objects):
    assert pdf.edges(objects).where("src_obj = 3").select("dst_obj").distinct().count() == 4
    table = pdf.xref(files, "DROPMALFORMED")
    assert table.where("kind = 'used'").count() == 21 and table.where("kind = 'free'").count() > 0


def test_writing(spark, files):
    two = files.where("path LIKE '%a.pdf'").select("content").withColumn("into", F.lit(1)).withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1))))
    merged = bytes(write.merge(two).first().content)
    doc = Document.load(merged, strict=True)
    from leafmill.parse import content

    assert [p.get("Rotate") for _, _, p in content.pages(doc)] == [None, 450, None, 450]
    assert all(p["MediaBox"] == [0, 0, 600, 800] for _, _, p in content.pages(doc)) and not any("Orphan" in o.value for o in doc.objects.values() if isinstance(o.value, dict))
    part = write.slice_pages(files.where("path LIKE '%a.pdf'"), 1, 1).first()
    assert [p["Rotate"] for _, _, p in content.pages(Document.load(bytes(part.content), strict=True))] == [450]
    data = sample()
    doc = Document.load(data)
    doc.objects[4].value["Rotate"] = 0
    later = write.save_update(data, list(doc.objects.values()))
    assert later.startswith(data) and Document.load(later, strict=True).get(Ref(4, 0))["Rotate"] == 0
    signed = b"xx/ByteRange [0 4 8 4] 1234567"
    assert write.byte_range_digest(signed) == __import__("hashlib").sha256(signed[:4] + signed[8:12]).hexdigest() and write.byte_range_digest(b"") is None


def test_hierarchies_of_any_size(spark):
    """More rows than a recursive query may make, and chains longer than its levels."""
    n = 300
    objects = [Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Outlines": Ref(3, 0), "AcroForm": {"Fields": [Ref(2000, 0)]}, "Names": {"Dests": Ref(3000, 0)}}), Obj(2, 0, {"Type": Name("Pages"), "Kids": [], "Count": 0})]
    objects += [Obj(3, 0, {"First": Ref(1000, 0)}), Obj(4, 0, {"Parent": Ref(5, 0)}), Obj(5, 0, {"Parent": Ref(4, 0)})]
    objects += [Obj(1000 + i, 0, {"Title": Text(b"%d" % i)} | ({"Next": Ref(1001 + i, 0)} if i < n - 1 else {})) for i in range(n)]
    objects += [Obj(2000 + i, 0, {"T": Text(b"t")} | ({"Kids": [Ref(2001 + i, 0)]} if i < n - 1 else {"Kids": [Ref(2000, 0)]}) | ({"Parent": Ref(1999 + i, 0)} if i else {"Found": 7})) for i in range(n)]
    objects += [Obj(3000 + i, 0, {"Kids": [Ref(3001 + i, 0)]} if i < n - 1 else {"Names": [Text(b"k"), [Ref(2, 0)]]}) for i in range(n)]
    table = pdf.objects(spark.createDataFrame([(1, write_document(objects, {"Root": Ref(1, 0)}))], "doc_id long, content binary")).cache()
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "3")
    try:
        assert [(r.obj, r.pos, r.title) for r in structure.outlines(table).orderBy("pos").collect()] == [(1000 + i, i, str(i)) for i in range(n)]
        found = {r.obj: r.found for r in structure.inherit_key(table, "Found").collect()}
        assert len(found) == len(objects) and all((found[o.obj] == "7") == (2000 <= o.obj < 3000) for o in objects)
        assert {r.obj: len(r.full_name) for r in structure.fields(table).collect()} == {2000 + i: 2 * i + 1 for i in range(n)}
        assert [(r.key, r.value) for r in structure.names(table, "Dests").collect()] == [("k", '[{"R":[2,0]}]')]
        nodes = spark.createDataFrame([(i, 0 if i else None, i) for i in range(9)], "node int, parent int, pos int").withColumn("name", F.col("pos").cast("string"))
        assert sorted((r.node, *r.path) for r in graph.tree_paths(nodes, spark).collect()) == [(0, 0), *((i, 0, i) for i in range(1, 9))]
    finally:
        spark.conf.set(limit, before)


def test_malformed_content_is_marked_and_read_on(spark):
    deep = b"[" * 300 + b"]" * 300
    bad = [b"/P << 1 2 >> BDC", b"[(x) foo] TJ", deep + b" TJ"]
    pages = [b"BT /F 10 Tf 1 0 0 1 10 700 Tm (before) Tj " + b + b" 1 0 0 1 10 600 Tm (after) Tj ET" for b in bad] + [b"BT /F 10 Tf (shown) Tj (no end", b"BT /F 10 Tf (last) Tj ET"]
    n = len(pages)
    objects = [Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0)}), Obj(2, 0, {"Type": Name("Pages"), "Kids": [Ref(10 + i, 0) for i in range(n)], "Count": n, "Resources": {"Font": {"F": Ref(9, 0)}}}), Obj(9, 0, FONT)]
    objects += [Obj(10 + i, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(20 + i, 0)}) for i in range(n)] + [Obj(20 + i, 0, {}, p) for i, p in enumerate(pages)]
    one = spark.createDataFrame([(1, write_document(objects, {"Root": Ref(1, 0)}))], "doc_id long, content binary")
    ops = pdf.content_ops(one).collect()
    assert {r.page_index for r in ops if r.error} == {0, 1, 2, 3} and all(r.type == "unexpected" for r in ops if r.error)
    runs = pdf.glyph_runs(one).collect()
    assert {r.page_index for r in runs if r.error} == {0, 1, 2, 3}
    assert [[r.text for r in runs if r.page_index == i and not r.error] for i in range(n)] == [["before", "after"]] * 3 + [["shown"], ["last"]]
    assert [r.text for r in extract.text_entries(pdf.glyph_runs(one)).orderBy("page_index", "seq").collect()] == ["before", "after"] * 3 + ["shown", "last"]
    assert not any(r.error for r in pdf.content_ops(one, "DROPMALFORMED").collect())
    for table in (pdf.content_ops, pdf.glyph_runs):
        with pytest.raises(Exception, match="InvalidDataType"):
            table(one, "FAILFAST").collect()


def test_metadata_of_filtered_streams(spark):
    xmp = b'<x:xmpmeta><dc:title><rdf:Alt><rdf:li>Packed</rdf:li></rdf:Alt></dc:title><d pdfaid:part="2" pdfaid:conformance="U"/></x:xmpmeta>'
    sub = lambda data: b"".join(b"\x01" + bytes((c - (row[i - 1] if i else 0)) & 255 for i, c in enumerate(row)) for row in (data[k : k + 10] for k in range(0, len(data), 10)))
    padded = xmp + b" " * (-len(xmp) % 10)
    flate = lambda data: filters.encode(data, ["FlateDecode"])
    predicted = {"Predictor": 15, "Columns": 10}
    kinds = [
        ({}, xmp),
        ({"Filter": Name("FlateDecode")}, flate(xmp)),
        ({"Filter": [Name("ASCIIHexDecode"), Name("FlateDecode")]}, filters.encode(xmp, ["ASCIIHexDecode", "FlateDecode"])),
        ({"Filter": Name("FlateDecode"), "DecodeParms": predicted}, flate(sub(padded))),
        ({"Filter": Name("FlateDecode"), "DecodeParms": Ref(4, 0)}, flate(sub(padded))),
        ({"Filter": Name("Odd")}, xmp),
    ]
    rows = []
    for i, (d, stream) in enumerate(kinds):
        objects = [Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0), "Metadata": Ref(3, 0)}), Obj(2, 0, {"Type": Name("Pages"), "Kids": [], "Count": 0}), Obj(3, 0, {"Type": Name("Metadata")} | d, stream), Obj(4, 0, predicted)]
        rows.append((i, write_document(objects, {"Root": Ref(1, 0)})))
    got = structure.metadata(pdf.objects(spark.createDataFrame(rows, "doc_id long, content binary"))).orderBy("doc_id").collect()
    assert [(r.title, r.pdfa_level) for r in got] == [("Packed", "2U")] * 5 + [(None, None)]
    assert [r.error is None for r in got] == [True] * 5 + [False] and "Odd" in got[5].error


def test_merged_outlines(spark, files):
    def part(title: bytes, count: int) -> bytes:
        objects = [Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0)} | ({"Outlines": Ref(5, 0)} if count else {})), Obj(2, 0, {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}), Obj(3, 0, {"Type": Name("Page"), "Parent": Ref(2, 0)})]
        objects += [Obj(5, 0, {"First": Ref(10, 0), "Last": Ref(9 + count, 0), "Count": count})] if count else []
        objects += [Obj(10 + i, 0, {"Title": Text(title + b"%d" % i), "Parent": Ref(5, 0), "Dest": [Ref(3, 0), Name("Fit")]} | ({"Next": Ref(11 + i, 0)} if i < count - 1 else {})) for i in range(count)]
        return write_document(objects, {"Root": Ref(1, 0)})

    parts = [part(b"a", 2), part(b"none", 0), bytes(files.where("path LIKE '%a.pdf'").first().content), part(b"b", 1)]
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "into int, ord int, content binary")
    merged = bytes(write.merge(rows).first().content)
    table = pdf.objects(spark.createDataFrame([(1, merged)], "doc_id long, content binary"), "FAILFAST").cache()
    got = structure.outlines(table).orderBy("level", "pos").collect()
    assert [(r.title, r.level, r.pos) for r in got] == [("a0", 1, 0), ("a1", 1, 1), ("One", 1, 2), ("Two", 1, 3), ("b0", 1, 4), ("Inner", 2, 0)]
    doc = Document.load(merged, strict=True)
    top = doc.get(doc.get(doc.trailer["Root"])["Outlines"])
    assert (doc.get(top["First"])["Title"], doc.get(top["Last"])["Title"], top["Count"]) == (b"a0", b"b0", 5)
    from leafmill.parse import content

    at = {ref: i for i, ref, _ in content.pages(doc)}
    by = {o.value["Title"]: o.value for o in doc.objects.values() if isinstance(o.value, dict) and "Title" in o.value}
    assert [at[by[t]["Dest"][0]] for t in (b"a0", b"a1", b"b0")] == [0, 0, 4]
    assert "Prev" not in by[b"a0"] and doc.get(by[b"b0"]["Prev"])["Title"] == b"Two" and doc.get(by[b"Inner"]["Parent"])["Title"] == b"One"
    assert len({by[t]["Parent"] for t in (b"a0", b"a1", b"One", b"Two", b"b0")}) == 1


def test_annotations_in_place(spark):
    note = lambda text, **more: {"Subtype": Name("Text"), "Contents": Text(text), "F": 2, "Rect": [1, 2, 3, 4]} | more
    objects = [Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0)}), Obj(2, 0, {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1})]
    objects += [Obj(3, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Annots": [note(b"in place", P=Ref(3, 0)), Ref(4, 0), None, Ref(99, 0), note(b"last")]}), Obj(4, 0, note(b"by reference"))]
    one = spark.createDataFrame([(1, write_document(objects, {"Root": Ref(1, 0)}))], "doc_id long, content binary")
    got = structure.annotations(pdf.objects(one), pdf.pages(one)).orderBy("idx").collect()
    assert [(r.idx, r.obj, r.subtype, r.flags, r.contents, r.rect) for r in got] == [(i, obj, "Text", 2, text, [1, 2, 3, 4]) for i, obj, text in ((0, None, "in place"), (1, 4, "by reference"), (4, None, "last"))]


def test_files_of_subfolders_and_any_case(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "one/c.Pdf", "one/two/d.pdf", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(sample())
    got = pdf.read_files(spark, str(tmp_path))
    assert got.columns == ["doc_id", "path", "content"] and sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["B.PDF", "a.pdf", "c.Pdf", "d.pdf"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in pdf_catalogue.QUERIES if n != "pdf_merge"])
def test_queries_read_files_once(spark, name):
    """Files are made once and parsed once, and no page's or document's rows are brought together."""
    found = plan(pdf_catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert found.count("MapInArrow") == 2 + (name in ("pdf_slice", "pdf_incremental")) and "Window" not in found and "Join" not in found
    assert found.count("Exchange") <= 1 and ("Exchange" not in found or "HashAggregate" in found)


def test_merge_reads_files_once(spark):
    found = plan(pdf_catalogue.QUERIES["pdf_merge"](spark, "/root/testdata/sf0.001"))
    assert (found.count("MapInArrow"), found.count("Exchange")) == (3, 1) and "Join" not in found


def test_structure_reads_objects_once(spark, files):
    """From the objects table, which is read once, as from the files."""
    table, pages, one = pdf.objects(files), pdf.pages(files), files.where("path LIKE '%a.pdf'")
    for made in (structure.outlines, structure.fields, structure.garbage, structure.reachable, lambda s: structure.inherit_key(s, "MediaBox"), lambda s: structure.names(s, "Dests")):
        assert plan(made(table)).count("MapInArrow") == 2
        assert sorted(map(str, made(table).collect())) == sorted(map(str, made(files).collect()))
    for made in (structure.annotations, structure.destinations, structure.sizes):
        assert plan(made(table, pages)).count("MapInArrow") == 3
        assert sorted(map(str, made(table, pages).collect())) == sorted(map(str, made(files).collect()))
    assert structure.metadata(table).collect() == structure.metadata(files).collect() == structure.metadata(one).collect()


def test_files_of_the_same_or_no_id(spark):
    """Each file is a document of its own."""
    rows = spark.createDataFrame([(None, sample()), (7, sample()), (7, sample())], "doc_id long, content binary")
    for made in (structure.outlines, structure.fields, structure.annotations, structure.destinations, structure.garbage):
        assert {r.doc_id: r["count"] for r in made(rows).groupBy("doc_id").count().collect()} == {None: (n := made(rows.limit(1)).count()), 7: 2 * n} and n
    words = extract.file_entries(rows, Match(tokenize=True)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in words} == {None: 7, 7: 14}


def test_entries_of_runs_and_of_files(spark, files):
    """Glyphs of several and of no characters, spaces between runs, and both ways to entries."""
    codes = {(65, 1): "ffi", (66, 1): "", (67, 1): " x", (32, 1): " "} | {(c, 1): chr(c) for c in range(97, 123)}
    objects = [
        Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0)}),
        Obj(2, 0, {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "Resources": {"Font": {"F": Ref(4, 0)}}}),
        Obj(3, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(5, 0)}),
        Obj(4, 0, FONT | {"ToUnicode": Ref(6, 0), "Widths": [500] * 95}),
        Obj(5, 0, {}, b"BT /F 10 Tf 1 0 0 1 10 700 Tm (  oAce  aBb ) Tj 1 0 0 1 90 700 Tm (cd) Tj 1 0 0 1 10 600 Tm (aCb) Tj () Tj ( ) Tj 0 -20 Td ( ) Tj ET"),
        Obj(6, 0, {}, write_cmap(codes)),
    ]
    one = spark.createDataFrame([(1, write_document(objects, {"Root": Ref(1, 0)}))], "doc_id long, content binary")
    said = lambda found: [(r.text, round(r.x, 3), round(r.length, 3), r.seq.seq, r.seq.pos) for r in found.orderBy("page_index", "seq").collect()]
    runs = pdf.glyph_runs(one)
    want = {
        Match(): [("officeX".replace("X", "  ab cd"), 20.0, 80.0, 0, 2), ("a xb", 10.0, 15.0, 2, 0)],
        Match(tokenize=True): [("office", 20.0, 20.0, 0, 2), ("a", 50.0, 5.0, 0, 8), ("b", 60.0, 5.0, 0, 10), ("cd", 90.0, 10.0, 1, 0), ("a xb", 10.0, 15.0, 2, 0)],
        Match(keep_white=True): [("  office  ab cd", 10.0, 90.0, 0, 0), ("a xb ", 10.0, 20.0, 2, 0)],
        Match("fic", extract=True): [("fic", 25.0, 10.0, 0, 2)],
    }
    for how, rows in want.items():
        assert said(extract.file_entries(one, how, raw_coordinates=True)) == said(extract.text_entries(runs, how, raw_coordinates=True)) == rows
    for how in (Match(), Match(tokenize=True), Match("the", extract=True), Match(keep_white=True), Match(clip=(0, 640, 300, 20))):
        both = [made(source, how, bounding_box=True).drop("doc_id").orderBy("page_index", "seq").collect() for made, source in ((extract.file_entries, files), (extract.text_entries, pdf.glyph_runs(files, "DROPMALFORMED")))]
        assert both[0] == both[1] and both[0]


def test_batches_are_bounded_by_bytes():
    """Rows of large texts leave a worker a few at a time, however many files a batch has."""
    out = Out(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    asked = [out.add({"doc_id": i, "text": "x" * 100_000}) for i in range(12)]
    assert asked == [False] * 10 + [True] * 2 and out.batch().num_rows == 12 and not out.add({"doc_id": 1}) and out.batch().to_pylist() == [{"doc_id": 1, "text": None}]
