"""Drawing, XMP, maps and differences written and read back."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import values
from leafmill.parse.content import ARITY
from leafmill.parse.draw import Canvas
from leafmill.parse.fonts import differences, read_cmap, write_cmap
from leafmill.parse.tokens import END, Keyword, PdfError, Reader
from leafmill.parse.xmp import normalize_xmp, read_xmp, write_xmp


def test_what_is_drawn_has_its_operands():
    c = Canvas().save().color(1, 0.5, 0).rectangle(1, 2, 3.5, 4).ellipse(0, 0, 10, 6, "f").line(0, 0, 1, 1).begin_text("F1", 12).show("(x)", 5, 6).end_text().draw("Im", 1, 2, 3, 4).restore()
    r, operands, seen = Reader(c.bytes(), references=False), [], []
    while (v := r.value()) is not END:
        if isinstance(v, Keyword):
            assert len(operands) == ARITY[bytes(v)]
            seen.append(v.decode())
            operands = []
        else:
            operands.append(v)
    assert seen == "q rg re S m c c c c h f m l S BT Tf Td Tj ET q cm Do Q Q".split()
    assert Canvas().bytes() == b"" and b"BT\n/F1 12 Tf\n(Hello) Tj\nET" in Canvas().begin_text("F1", 12).show("Hello").end_text().bytes()
    for bad in (lambda: Canvas().save().bytes(), lambda: Canvas().restore(), lambda: Canvas().show("x"), lambda: Canvas().color(2)):
        with pytest.raises(PdfError):
            bad()


def test_xmp():
    fields = {"title": "A <b> & c", "author": "é", "keywords": "k1, k2", "pdfa_part": "1", "created": "2020-01-02T03:04:05Z"}
    assert read_xmp(write_xmp(fields)) == fields
    flat = '<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:RDF><rdf:Description rdf:about="" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" pdf:Producer="P"/><rdf:Description rdf:about="" xmlns:pdf="http://ns.adobe.com/pdf/1.3/"><pdf:Keywords> k </pdf:Keywords></rdf:Description></rdf:RDF></x:xmpmeta>'
    assert read_xmp(flat) == {"producer": "P", "keywords": "k"}
    assert normalize_xmp(flat) == normalize_xmp(normalize_xmp(flat))


def test_maps_and_differences():
    codes = {(i, 2): chr(0x4E00 + i) for i in range(250)} | {(65, 1): "ﬁ", (66, 1): "\U0001f600"}
    assert read_cmap(write_cmap(codes))[0] == codes
    assert differences({1: "A", 2: "B", 9: "C"}) == [1, "A", "B", 9, "C"]


def test_more_values(spark):
    row = spark.range(1).select(
        values.parse_w3c_date(F.lit("2012-02-05T14:24:56+01:00")).alias("w"),
        values.parse_w3c_date(F.lit("2012-13")).alias("bad"),
        values.permissions(F.lit(-44)).alias("p"),
        values.page_size(F.lit("A4"), landscape=True).alias("size"),
        values.page_size(F.lit("B9")).alias("none"),
        F.array(*(values.format_number(F.lit(x)) for x in (1.5, 2.0, -0.0, 100.0, 0.1234567))).alias("n"),
        values.color_components(F.lit("[0.1,0.2,0.3]")).alias("rgb"),
        values.color_components(F.lit("[1,2]")).alias("no"),
        values.matrix_product(*[F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("abcdef", m))) for m in ((2, 0, 0, 2, 1, 1), (0, 1, -1, 0, 5, 0))]).alias("m"),
    ).first()
    assert (row.w.ts.isoformat(), row.w.offset_min, row.bad) == ("2012-02-05T13:24:56", 60, None)
    assert row.p.print and row.p.copy and not row.p.edit and not row.p.edit_notes
    assert (row.size.w, row.size.h, row.none) == (842, 595, None)
    assert row.n == ["1.5", "2", "0", "100", "0.123457"]
    assert (row.rgb.space, row.no) == ("DeviceRGB", None) and tuple(row.m) == (0, 2, -2, 0, 4, 1)
    dates = spark.sql("SELECT timestamp'2012-02-05 13:24:56' AS t, 60 AS m, CAST(NULL AS INT) AS n").select(values.format_date_at(F.col("t"), F.col("m")).alias("a"), values.format_date_at(F.col("t"), F.col("n")).alias("b"), values.format_w3c_date(F.col("t"), -F.col("m")).alias("c")).first()
    assert tuple(dates) == ("D:20120205142456+01'00'", "D:20120205132456", "2012-02-05T12:24:56-01:00")
