"""PDF syntax, codecs, keys and files on small inputs built here."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.parse import content, crypto, filters
from leafmill.parse.document import Document, Obj, write_document, write_update, xref_blocks
from leafmill.parse.fonts import glyph_text, read_cmap
from leafmill.parse.tokens import Name, PdfError, Reader, Ref, Text, bytes_of, escape_name, kind_of, text_of, unescape_name, write_value


@pytest.mark.parametrize(
    "raw, value",
    [
        (b"613", 613),
        (b"-5", -5),
        (b"0.0", 0.0),
        (b"-.5", -0.5),
        (b"true", True),
        (b"null", None),
        (b"(Hallo\\040(du)\\)\\n)", b"Hallo (du))\n"),
        (b"(a\\\nb)", b"ab"),
        (b"<486 56c6C6>", b"Hell`"),
        (b"/A#20B", "A B"),
        (b"[1 2 R (x) 3 0 R]", None),
        (b"% comment\n17", 17),
        (b"<</K [1 0 R] /L<</M null>>>>", {"K": [Ref(1, 0)], "L": {"M": None}}),
        (b"<</A 1/A 2>>", {"A": 2}),
    ],
)
def test_values(raw, value):
    if raw.startswith(b"[1 2 R"):
        assert Reader(raw).value() == [Ref(1, 2), b"x", Ref(3, 0)]
    else:
        assert Reader(raw).value() == value


@pytest.mark.parametrize("raw", [b"[1 2", b"<</A", b"(abc", b"<12", b"[" * 400])
def test_broken_values_raise(raw):
    with pytest.raises(PdfError):
        Reader(raw).value()


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.binary(max_size=9).map(Text) | st.text(st.characters(codec="utf-8", exclude_characters="\0"), min_size=1, max_size=5).map(Name) | st.builds(Ref, st.integers(1, 99), st.integers(0, 9)),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text("abc /#(", min_size=1, max_size=4), v, max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(values)
def test_written_values_read_back(v):
    assert Reader(write_value(v)).value() == v
    assert kind_of(v) == kind_of(Reader(write_value(v)).value())


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=20))
def test_names_and_texts_round_trip(text):
    assert unescape_name(escape_name(text)) == text
    assert text_of(bytes_of(text)) == text or "﻿" in text or text[:1] in "þÿï"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.lists(st.sampled_from(sorted(filters.ENCODERS)), min_size=1, max_size=3))
def test_codecs_round_trip(data, chain):
    assert filters.decode(filters.encode(data, chain), chain) == (data, [])


@pytest.mark.parametrize("name", sorted(filters.ENCODERS))
def test_codecs_on_long_data(name):
    for data in (bytes(range(255)) * 40, b"\0" * 9000, os.urandom(20000), b"abcabcabd" * 3000):
        assert filters.decode(filters.encode(data, [name]), [name])[0] == data


def test_predictors():
    rows = bytes([0, 1, 2, 3, 1, 1, 1, 1, 2, 1, 1, 1, 3, 2, 2, 2, 4, 1, 1, 1])
    assert filters.unpredict(rows, 15, columns=3) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 6, 7])
    assert filters.unpredict(bytes([1, 1, 1, 5, 1, 1]), 2, columns=3) == bytes([1, 2, 3, 5, 6, 7])


def test_published_vectors():
    block = 0x00112233445566778899AABBCCDDEEFF
    for n, out in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(n))
        assert crypto._encrypt_word(crypto._words(key), block).to_bytes(16).hex() == out
        assert bytes(crypto._decrypt_block(crypto._schedule(key), list(bytes.fromhex(out)))) == block.to_bytes(16)
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("method", ["RC4-40", "RC4-128", "AES-128"])
def test_passwords(method):
    d, mine = crypto.new_security(method, "userpass", "ownerpass", -44, b"id" * 8)
    for password, who in (("userpass", "user"), ("ownerpass", "owner"), ("wrong", None)):
        s = crypto.Security(d, b"id" * 8)
        assert s.authenticate(password) == who
        if who:
            assert s.decrypt(mine.encrypt(b"some data" * 5, 7, 0), 7, 0) == b"some data" * 5


def small(extra=(), page=None, contents=b"BT (Hello) Tj ET"):
    objects = [
        Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0)}),
        Obj(2, 0, {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "MediaBox": [0, 0, 200, 300]}),
        Obj(3, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(5, 0)} | (page or {})),
        Obj(5, 0, {"Filter": Name("FlateDecode")}, filters.encode(contents, ["FlateDecode"])),
        *extra,
    ]
    return write_document(objects, {"Root": Ref(1, 0)})


def test_files_and_increments():
    data = small()
    doc = Document.load(data, strict=True)
    assert doc.stream(Ref(5, 0)) == b"BT (Hello) Tj ET" and [i for i, _, _ in content.pages(doc)] == [0]
    later = write_update(data, [Obj(3, 0, {"Type": Name("Page"), "Parent": Ref(2, 0), "Rotate": 90})], doc.trailer, doc.start)
    again = Document.load(later, strict=True)
    assert later.startswith(data) and again.get(Ref(3, 0))["Rotate"] == 90 and len(again.history) > len(again.entries)
    assert Document.load(b"junk\n" + data).get(Ref(3, 0))["Type"] == "Page"
    rebuilt = Document.load(data.replace(b"startxref", b"startxxxx"))
    assert rebuilt.rebuilt and rebuilt.stream(Ref(5, 0)) == b"BT (Hello) Tj ET"
    with pytest.raises(PdfError, match="NoXRef"):
        Document.load(data.replace(b"startxref", b"startxxxx"), strict=True)
    with pytest.raises(PdfError, match="NoPdfFile"):
        Document.load(b"no file")


def test_object_streams_and_stream_tables():
    members = b"3 0 4 28 "
    bodies = b"<</Type/Pages/Kids[]/N 0>>  " + b"<</X 5>>"
    head = b"%PDF-1.5\n"
    one = head + b"1 0 obj\n<</Type/Catalog/Pages 3 0 R>>\nendobj\n"
    at2 = len(one)
    stream = members + bodies
    two = one + b"2 0 obj\n<</Type/ObjStm/N 2/First %d/Length %d>>\nstream\n" % (len(members), len(stream)) + stream + b"\nendstream\nendobj\n"
    at5 = len(two)
    rows = [(0, 0, 255), (1, len(head), 0), (1, at2, 0), (2, 2, 0), (2, 2, 1), (1, at5, 0)]
    table = b"".join(bytes([k]) + a.to_bytes(2) + bytes([b]) for k, a, b in rows)
    data = two + b"5 0 obj\n<</Type/XRef/W[1 2 1]/Size 6/Root 1 0 R/Length %d>>\nstream\n" % len(table) + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at5
    doc = Document.load(data, strict=True)
    assert doc.get(Ref(4, 0)) == {"X": 5} and doc.objects[3].container == 2
    for bad in (data.replace(b"/W[1 2 1]", b"/W[1 9 1]"), data.replace(b"/W[1 2 1]", b"/W[0 0 0]"), data.replace(b"/Size 6", b"/Size 9")):
        with pytest.raises(PdfError):
            Document.load(bad, strict=True)


def test_loops_and_limits_end_in_errors():
    data = small()
    start = Document.load(data).start
    with pytest.raises(PdfError, match="InvalidXRef"):
        Document.load(data.replace(b"/Size 6", b"/Size 6/Prev %d" % start), strict=True)
    with pytest.raises(PdfError, match="ValueOutOfRange"):
        Document.load(data, strict=True, most_objects=2)
    looped = small(page={"Kids": [Ref(2, 0)], "Type": Name("Pages")})
    with pytest.raises(PdfError, match="PageNotFound"):
        list(content.pages(Document.load(looped)))


def test_xref_blocks_link_free_numbers():
    table = xref_blocks({1: (10, 0), 2: (20, 0), 5: (50, 1)}, [3, 4]).decode()
    assert table.splitlines()[1] == "0 6" and "0000000003 65535 f" in table and "0000000004 00001 f" in table


def test_encrypted_file():
    enc, s = crypto.new_security("AES-128", "", "owner", -4, b"0123456789abcdef")
    objects = [Obj(1, 0, {"Type": Name("Catalog"), "Pages": Ref(2, 0)}), Obj(2, 0, {"Type": Name("Pages"), "Kids": [], "T": Text(s.encrypt(b"secret", 2, 0))}), Obj(3, 0, {"A": 1}, s.encrypt(b"stream", 3, 0)), Obj(4, 0, enc)]
    data = write_document(objects, {"Root": Ref(1, 0), "ID": [Text(b"0123456789abcdef")]})
    data = data.replace(b"trailer\n<<", b"trailer\n<</Encrypt 4 0 R")
    doc = Document.load(data, strict=True)
    assert doc.get(Ref(2, 0))["T"] == b"secret" and doc.objects[3].stream == b"stream"
    enc, s = crypto.new_security("RC4-128", "user", "owner", -4, b"0123456789abcdef")
    objects[3] = Obj(4, 0, enc)
    locked = write_document(objects, {"Root": Ref(1, 0), "ID": [Text(b"0123456789abcdef")]}).replace(b"trailer\n<<", b"trailer\n<</Encrypt 4 0 R")
    with pytest.raises(PdfError, match="InvalidPassword"):
        Document.load(locked)


def test_content_events():
    form = Obj(7, 0, {"Type": Name("XObject"), "Subtype": Name("Form"), "Resources": {"XObject": {"F": Ref(7, 0)}}}, b"q /F Do Q")
    data = small([form], {"Resources": {"XObject": {"F": Ref(7, 0)}}}, b"q 1 0 0 cm 5 w 1 2 w /F Do zap BI /W 1 /H 1 ID \x01\x02 EI Q")
    doc = Document.load(data)
    page = next(content.pages(doc))[2]
    got = [(e.kind, e.op, e.warnings, e.depth) for e in content.events(doc, page)]
    assert got == [
        ("operator", "q", 0, 0),
        ("operator", "cm", content.INVALID_OPERATOR, 0),
        ("operator", "w", 0, 0),
        ("operator", "w", content.SPURIOUS_OPERANDS, 0),
        ("form", "Do", 0, 1),
        ("operator", "q", 0, 1),
        ("operator", "Do", content.RECURSIVE_XOBJECT, 1),
        ("operator", "Q", 0, 1),
        ("form_end", "Do", 0, 0),
        ("unexpected", "zap", content.INVALID_OPERATOR, 0),
        ("image_dictionary", "BI", 0, 0),
        ("image_data", "ID", 0, 0),
        ("operator", "Q", 0, 0),
    ]
    assert next(e.data for e in content.events(doc, page) if e.kind == "image_data") == b"\x01\x02"


def test_unicode_maps_and_glyph_names():
    codes, spaces = read_cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0000> <005E> <0020> <005F> <0061> [<00660066> <00660069> <00660066006C>] endbfrange 1 beginbfchar <3A51> <D840DC3E> endbfchar")
    assert codes[0, 2] == " " and codes[0x5E, 2] == "~" and codes[0x60, 2] == "fi" and codes[0x3A51, 2] == "\U0002003e" and spaces == [(2, 0, 0xFFFF)]
    with pytest.raises(PdfError):
        read_cmap(b"1 beginbfrange (a) 2 3 endbfrange")
    assert [glyph_text(n) for n in ("A", "space", "eacute", "uni20AC", "u1F600", "f_i", "alpha", "nosuchglyph", "a.alt")] == ["A", " ", "é", "€", "\U0001f600", "fi", "α", "", "a"]


def test_rebuilt_files_have_what_object_streams_hold():
    def packed(number: int, members: dict[int, bytes], filtered: bool = True, extra: bytes = b"") -> bytes:
        head, bodies = b"", b""
        for n, body in members.items():
            head += b"%d %d " % (n, len(bodies))
            bodies += body + b" "
        stream = filters.encode(head + bodies, ["FlateDecode"]) if filtered else head + bodies
        return b"%d 0 obj\n<</Type/ObjStm/N %d/First %d/Length %d%s>>\nstream\n" % (number, len(members), len(head), len(stream), b"/Filter/FlateDecode" if filtered else extra) + stream + b"\nendstream\nendobj\n"

    plain = lambda n, body: b"%d 0 obj\n%s\nendobj\n" % (n, body)
    kept = plain(5, b"<</Old 1>>") + packed(10, {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R>>", 4: b"<</Old 1>>", 5: b"<</New 1>>", 6: b"<</Old 1>>"})
    data = b"%PDF-1.7\n" + kept + plain(4, b"<</New 1>>") + packed(11, {6: b"<</New 1>>", 7: b"(x)"}) + packed(12, {8: b"1"}, False, b"/Filter/Odd") + b"startxref\n99999\n%%EOF"
    doc = Document.load(data)
    assert doc.rebuilt and [doc.get(Ref(n, 0)) for n in (4, 5, 6)] == [{"New": 1}] * 3 and doc.get(Ref(7, 0)) == b"x"
    assert [ref for _, ref, _ in content.pages(doc)] == [Ref(3, 0)] and doc.objects[3].container == 10
    assert "Odd" in doc.objects[12].error and sorted(e.obj for e in doc.history if e.kind == "compressed") == [1, 2, 3, 5, 6, 7]
