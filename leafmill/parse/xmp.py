"""XMP packets: written from metadata, and brought to one shape for comparison."""

from __future__ import annotations

import xml.etree.ElementTree as ET

#: Namespaces by prefix.
SPACES = {"x": "adobe:ns:meta/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "dc": "http://purl.org/dc/elements/1.1/", "pdf": "http://ns.adobe.com/pdf/1.3/", "xmp": "http://ns.adobe.com/xap/1.0/", "pdfaid": "http://www.aiim.org/pdfa/ns/id/"}

#: Of each field: its element, and the container its values stand in.
FIELDS = {"title": ("dc:title", "Alt"), "author": ("dc:creator", "Seq"), "subject": ("dc:description", "Alt"), "keywords": ("pdf:Keywords", None), "creator": ("xmp:CreatorTool", None), "producer": ("pdf:Producer", None), "created": ("xmp:CreateDate", None), "modified": ("xmp:ModifyDate", None), "pdfa_part": ("pdfaid:part", None), "pdfa_conformance": ("pdfaid:conformance", None)}


def _name(prefixed: str) -> str:
    prefix, _, name = prefixed.partition(":")
    return f"{{{SPACES[prefix]}}}{name}"


def write_xmp(fields: dict[str, str | None]) -> str:
    """A packet with the fields that aren't null."""
    for prefix, uri in SPACES.items():
        ET.register_namespace(prefix, uri)
    root = ET.Element(_name("x:xmpmeta"))
    about = ET.SubElement(ET.SubElement(root, _name("rdf:RDF")), _name("rdf:Description"), {_name("rdf:about"): ""})
    for field, (element, container) in FIELDS.items():
        if fields.get(field) is None:
            continue
        at = ET.SubElement(about, _name(element))
        if container:
            at = ET.SubElement(ET.SubElement(at, _name(f"rdf:{container}")), _name("rdf:li"), {"{http://www.w3.org/XML/1998/namespace}lang": "x-default"} if container == "Alt" else {})
        at.text = fields[field]
    return ET.tostring(root, encoding="unicode")


def read_xmp(packet: str) -> dict[str, str]:
    """The fields of a packet, whether written as elements or as attributes."""
    out: dict[str, str] = {}
    for about in ET.fromstring(packet).iter(_name("rdf:Description")):
        for field, (element, _) in FIELDS.items():
            if (value := about.get(_name(element))) is not None:
                out.setdefault(field, value)
            elif (found := about.find(_name(element))) is not None:
                item = next(found.iter(_name("rdf:li")), found)
                out.setdefault(field, (item.text or "").strip())
    return out


def normalize_xmp(packet: str) -> str:
    """The same fields in one shape: a single description, elements only, in a fixed order."""
    return write_xmp(read_xmp(packet))
