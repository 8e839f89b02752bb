"""Text entries from glyph runs: pages are laid out a page at a time (``parse.layout``); what matches, clips, turns and
cuts out substrings are expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.arrow import over_groups
from leafmill.functions import strings
from leafmill.functions.values import affine, frame_rotation, within
from leafmill.operators import text
from leafmill.operators.text import Match
from leafmill.parse import layout
from leafmill.parse.runs import Run
from leafmill.sources import pdf

#: Columns that every answer needs, and those that only some do.
_ALWAYS = ["doc_id", "page_index", "seq", "pos", "text", "x", "y", "length"]


def _columns(how: Match, bounding_box: bool, raw_coordinates: bool) -> list[str]:
    some = (["first_x"], how.clip), (["xs", "advances"], how.extract), (["ascent", "descent"], bounding_box), (["rotate", "box"], not raw_coordinates)
    return _ALWAYS + [c for names, wanted in some if wanted for c in names]


def text_entries(runs: DataFrame, how: Match = Match(), bounding_box: bool = False, raw_coordinates: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, page_index, seq, text, x, y, length, bbox: entries in the order of the page, from a table of glyph runs.

    A page's runs are brought together and laid out, a page at a time. Of files, ``file_entries`` needs no shuffle.
    """

    def made(group: list[dict]) -> Iterator[dict]:
        page = [Run(r["seq"], r["text"], r["x"], r["y"], r["length"], r["space_len"], *_glyphs(r["glyphs"]), 0, r["ascent"], r["descent"]) for r in group]
        turned = {r["seq"]: r["rotate"] for r in group}
        found = layout.entries(page, how.tokenize, how.keep_white, how.extract)
        for values in zip(*found.values()):
            e = dict(zip(found, values))
            yield {"doc_id": group[0]["doc_id"], "page_index": group[0]["page_index"], "rotate": turned[e["seq"]], "box": group[0]["box"]} | e

    needed = runs.where("error IS NULL").select("doc_id", "page_index", "seq", "text", "x", "y", "length", "space_len", "glyphs", "ascent", "descent", "rotate", "box")
    found = over_groups(needed, ["doc_id", "page_index"], ["seq"], made, pdf.ENTRIES.replace("doc_id bigint", f"doc_id {dict(runs.dtypes)['doc_id']}"))
    return _finished(found.select(*_columns(how, bounding_box, raw_coordinates)), how, bounding_box, raw_coordinates)


def file_entries(files: DataFrame, how: Match = Match(), bounding_box: bool = False, raw_coordinates: bool = False) -> DataFrame:  # noqa: B008
    """The same of files: each page is laid out where it is parsed, so that no glyph leaves the worker unless a substring's
    place is asked for."""
    found = pdf.entries(files, how.tokenize, how.keep_white, how.extract, columns=_columns(how, bounding_box, raw_coordinates))
    return _finished(found, how, bounding_box, raw_coordinates)


def _glyphs(glyphs: list[dict] | None) -> tuple[tuple[str, ...], np.ndarray]:
    return tuple(g["text"] for g in glyphs or ()), np.array([g["advance"] for g in glyphs or ()], np.float64)


def _finished(found: DataFrame, how: Match, bounding_box: bool, raw_coordinates: bool) -> DataFrame:
    """What matches, and what of it."""
    if how.clip:
        found = found.where(within(F.col("first_x"), F.col("y"), *how.clip))
    found = found.where(text.matches(F.col("text"), how))
    if how.extract:
        folded = strings.ascii_lower(F.col("text")) if how.ignore_case else F.col("text")
        at = F.locate(text.folded_pattern(how), folded)
        # the glyph of each character: a match begins where its first glyph does and ends with its last one's advance
        first, end = at - 1, at + (len(how.pattern) - 2)
        begin = F.get("xs", first)
        found = found.withColumns({"x": begin, "length": F.abs(F.get("xs", end) + F.get("advances", end) - begin), "text": F.substring("text", at, F.lit(len(how.pattern)))})
    box = F.struct(F.col("x").alias("l"), (F.col("y") + F.col("descent")).alias("b"), F.col("length").alias("w"), (F.col("ascent") - F.col("descent")).alias("h")) if bounding_box else F.lit(None).cast("struct<l: double, b: double, w: double, h: double>")
    found = found.withColumn("bbox", box)
    if not raw_coordinates:
        found = _rotated(found)
    return found.select("doc_id", "page_index", F.struct("seq", "pos").alias("seq"), "text", "x", "y", "length", "bbox")


def _rotated(entries: DataFrame) -> DataFrame:
    """Turns places of rotated pages with the page's frame, whose lower left corner stays."""
    # a page's turn is clockwise; without a box, about the origin
    x, y = affine(F.col("x"), F.col("y"), frame_rotation(F.coalesce("box", F.array(*(F.lit(0.0),) * 4)), 360 - F.col("rotate")))
    turned = F.col("rotate") % 360 != 0
    return entries.withColumns({"x": F.when(turned, x).otherwise(F.col("x")), "y": F.when(turned, y).otherwise(F.col("y"))})
