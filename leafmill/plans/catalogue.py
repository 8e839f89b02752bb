"""The reference's operators as queries on the driver's tables; ``oracle`` has the DuckDB SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import edit, strings, values
from leafmill.operators import graph, lookup, ordered, text
from leafmill.plans import pdf_catalogue
from leafmill.plans.oracle import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(tables: str):
    """Registers a function of tables as a query of (spark, sf_dir)."""

    def register(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(table(spark, sf_dir, t) for t in tables.split()))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        return run

    return register


# text predicates and tokens


@_query("documents")
def text_contains(d):
    return d.where(text.matches(F.col("text"), text.Match("the"))).select("doc_id", "lang")


@_query("documents")
def text_contains_icase(d):
    return d.where(text.matches(F.col("text"), text.Match("the", ignore_case=True))).select("doc_id")


@_query("documents")
def text_regex(d):
    return d.where(text.matches(F.col("text"), text.Match("[0-9]{3}", regex=True))).select("doc_id")


@_query("documents")
def text_whole_word_first(d):
    how = text.Match("the", whole_word=True, extract=True)
    return d.where(text.matches(F.col("text"), how)).select("doc_id", strings.position(F.col("text"), "the").alias("pos"))


@_query("documents")
def text_extract_substring(d):
    at = strings.position(F.col("text"), "and")
    return d.where(at > 0).select("doc_id", at.alias("pos"), F.substring("text", at.cast("int"), F.lit(3)).alias("hit"))


@_query("documents")
def tokenize_words(d):
    return text.tokens(d.select("doc_id", "text")).select("doc_id", "tok")


@_query("documents")
def token_counts(d):
    return text.tokens(d.select("lang", "text")).groupBy("lang", "tok").agg(F.count(F.lit(1)).alias("n"))


@_query("documents")
def trim_entries(d):
    return text.lines(d.select("doc_id", "text")).select("doc_id", strings.trim_line(F.col("ln")).alias("ln")).where("ln <> ''")


@_query("documents")
def line_numbering(d):
    return text.lines(d.select("doc_id", "text"), number="line_no").select("doc_id", "line_no", "ln")


@_query("documents")
def keywords_split(d):
    k = strings.keywords(F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.size(k).cast("long").alias("n"), F.get(k, F.lit(0)).alias("first"))


# ordered, stateful operators


@_query("events")
def gap_entries(e):
    """Entry number of each event of a user: a gap of over an hour starts a new entry."""
    spec = ordered.over(["user_id"], ["ts", "event_id"])
    gap = F.col("ts") - F.lag("ts").over(spec)
    opens = gap.isNull() | (gap > F.expr("INTERVAL 1 HOUR"))
    return ordered.entry_number(e.select("user_id", "event_id", "ts"), opens, spec).select("user_id", "event_id", "entry")


@_query("events")
def gap_class(e):
    spec = ordered.over(["user_id"], ["ts", "event_id"])
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return e.select("event_id", ordered.gap_class(seconds - F.lag(seconds).over(spec), 3600, 6 * 3600).alias("sep"))


@_query("conversations")
def entry_concat(c):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t.text), " ").alias("txt"))


@_query("documents")
def pen_position(d):
    spec = ordered.over(["source"], ["doc_id"])
    return d.select("doc_id", ordered.pen_position(F.col("n_chars"), spec).alias("x"))


@_query("events")
def state_depth(e):
    spec = ordered.over(["user_id"], ["ts", "event_id"])
    return e.select("event_id", ordered.depth(F.col("value") >= 50, spec).alias("depth"))


@_query("conversations")
def sibling_links(c):
    before, after = ordered.siblings("turn", ordered.over(["conv_id"], ["turn"]))
    return c.select("conv_id", "turn", before.alias("prev_turn"), after.alias("next_turn"))


@_query("orders")
def xref_blocks(o):
    return ordered.blocks(o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k")), "k")


@_query("orders")
def width_runs(o):
    return ordered.runs(o.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@_query("orders")
def xref_latest_wins(o):
    rows = o.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return ordered.latest(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@_query("pages")
def page_ordinal(p):
    return ordered.ordinal(p.select("page_id"), "page_id", "page_index")


@_query("pages")
def page_slice(p):
    return ordered.ordinal(p.select("page_id"), "page_id").where("i >= 10 AND i < 15").select("page_id")


@_query("pages")
def delete_page_renumber(p):
    return ordered.ordinal(p.select("page_id").where("page_id <> 3"), "page_id")


@_query("conversations")
def annotation_enumerate(c):
    spec = ordered.over(["conv_id"], ["turn"])
    return c.select("conv_id", (F.row_number().over(spec) - 1).cast("long").alias("idx"), "role")


# lookups and graphs


@_query("orders customer")
def ref_resolve(o, c):
    return lookup.resolve(o, c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@_query("lineitem part")
def ref_must_resolve(li, p):
    return lookup.resolve(li, p, li.l_partkey == p.p_partkey, must=True).select("l_orderkey", "l_linenumber", "p_name")


@_query("customer nation region")
def inherit_key(c, n, r):
    up = lookup.resolve(lookup.resolve(c, n, c.c_nationkey == n.n_nationkey), r, n.n_regionkey == r.r_regionkey)
    own = F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_mktsegment"))
    return up.select("c_custkey", lookup.inherit(own, F.col("n_name"), F.col("r_name")).alias("v"))


@_query("nation region")
def full_name(n, r):
    both = lookup.resolve(n, r, n.n_regionkey == r.r_regionkey, must=True).select("n_nationkey", F.array("r_name", "n_name").alias("names"))
    return both.select("n_nationkey", graph.full_name("names").alias("full_name"))


@_query("region nation customer")
def reachable_objects(r, n, c):
    key = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    near = n.join(r, n.n_regionkey == r.r_regionkey).select(key("r", "r_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    edges = near.unionByName(c.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")))
    return graph.reachable(edges, r.where("r_regionkey = 0").select(key("r", "r_regionkey").alias("id")))


@_query("part lineitem")
def garbage_objects(p, li):
    used = li.where("l_quantity > 45").select("l_partkey")
    return lookup.unreferenced(p.select("p_partkey"), used, F.col("l_partkey") == F.col("p_partkey"))


@_query("orders lineitem")
def xref_semi(o, li):
    members = li.where("l_returnflag = 'R'").select("l_orderkey")
    return lookup.listed(o.select("o_orderkey"), members, F.col("l_orderkey") == F.col("o_orderkey"))


@_query("orders")
def trailer_merge(o):
    return lookup.merge_first(o.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("prio")), "o_custkey", "prio", "o_orderkey")


@_query("documents labels")
def info_xmp_merge(d, lab):
    both = d.select("doc_id", "source").join(lab.select(F.col("doc_id").alias("l_id"), "quality"), F.col("doc_id") == F.col("l_id"), "full")
    return both.select(F.coalesce("doc_id", "l_id").alias("doc_id"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("source", F.lit("?")).alias("source"))


@_query("nation")
def merge_rebase(n):
    rows = n.select(F.col("n_nationkey").alias("id"), "n_name")
    return lookup.rebased_union(rows, rows, "id")


@_query("part")
def node_limits(p):
    return p.groupBy("p_brand").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))


@_query("customer")
def name_lookup(c):
    return c.where(F.col("c_name").between("Customer#000000010", "Customer#000000020")).select("c_custkey", "c_name")


@_query("nation")
def range_expand(n):
    k = F.col("n_nationkey").cast("long")
    return lookup.expand_ranges(n.select("n_nationkey"), k, k + 2, "code")


@_query("nation")
def sorted_dictionary(n):
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


# scalar functions


@_query("part")
def clip_rect(p):
    return p.where(values.within(F.col("p_size"), F.col("p_retailprice"), 10, 900, 10, 600)).select("p_partkey")


@_query("region")
def hex_encode(r):
    return r.select("r_regionkey", strings.hex_encode(F.col("r_name")).alias("h"))


@_query("documents")
def file_identifier(d):
    return d.select("doc_id", F.md5(F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string"))).alias("ident"))


@_query("orders")
def pdf_date_format(o):
    return o.select("o_orderkey", values.format_date(F.col("o_orderdate")).alias("d"))


@_query("orders")
def pdf_date_parse(o):
    written = F.concat(values.format_date(F.col("o_orderdate")), F.lit("+01'00'"))
    return o.select("o_orderkey", values.parse_date(written).ts.cast("timestamp_ntz").alias("utc"))


@_query("part")
def flag_bits(p):
    return p.select("p_partkey", values.has_flag(F.col("p_size"), 4).alias("can_print"), values.has_flag(F.col("p_size"), 16).alias("can_copy"))


@_query("part")
def field_type(p):
    return p.select("p_partkey", values.button_type(F.col("p_size"), push=16, radio=8).alias("ft"))


@_query("part")
def box_fallback(p):
    size = F.col("p_size")
    return p.select("p_partkey", lookup.inherit(F.when(size > 40, size), F.when(size > 20, size * 2), size * 3).alias("box"))


@_query("lineitem")
def color_gray(li):
    return li.select("l_orderkey", "l_linenumber", values.gray(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50).alias("gray"))


@_query("lineitem")
def rgb_to_cmyk(li):
    return li.select("l_orderkey", "l_linenumber", values.rgb_to_cmyk(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50).k.alias("k"))


@_query("part")
def affine_point(p):
    x, y = values.affine(F.col("p_size"), F.col("p_retailprice"), (2.0, -0.5, 0.5, 2.0, 10.0, 20.0))
    return p.select("p_partkey", x.alias("x"), y.alias("y"))


@_query("events")
def props_get(e):
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"))


@_query("pages")
def html_text(p):
    return p.select("page_id", F.char_length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n"))


@_query("pages")
def html_title(p):
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@_query("pages")
def link_destinations(p):
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("uri"))


# scalar functions of documents


@_query("part")
def frame_rotated(p):
    """A point of a page turned with its frame, and back."""
    box = F.array(F.lit(10.0), F.lit(20.0), F.lit(610.0), F.lit(820.0))
    degrees = F.col("p_size") % 4 * 90
    x, y = values.affine(F.col("p_size").cast("double"), F.col("p_retailprice"), values.frame_rotation(box, degrees))
    back_x, back_y = values.affine(x, y, values.frame_rotation_inverse(box, degrees))
    near = (F.abs(back_x - F.col("p_size")) < 1e-6) & (F.abs(back_y - F.col("p_retailprice")) < 1e-6)
    return p.select("p_partkey", F.round(x * 100).cast("long").alias("x"), F.round(y * 100).cast("long").alias("y"), near.alias("back"))


@_query("part")
def vector_lengths(p):
    x, y = values.vector_sum(F.col("p_size") * 3, F.col("p_size") * 4, F.lit(0), F.lit(0), -1)
    return p.select("p_partkey", F.round(values.vector_length(x, y)).cast("long").alias("length"))


@_query("lineitem")
def products_overflow(li):
    return li.select("l_orderkey", "l_linenumber", values.overflows(F.col("l_orderkey"), F.lit(1 << 50)).alias("over"))


@_query("orders")
def endian_round_trip(o):
    raw = values.uint_to_bytes(F.col("o_orderkey"))
    return o.select("o_orderkey", F.hex(raw).alias("raw"), values.uint_from_bytes(raw).alias("again"))


@_query("part")
def color_hex(p):
    c = values.parse_color(F.concat(F.lit("#"), F.lpad(F.hex((F.col("p_partkey") * 7919 % 16777216).cast("long")), 6, "0")))
    part = lambda i: F.round(F.get(c.c, F.lit(i)) * 255).cast("long")
    return p.select("p_partkey", c.space.alias("space"), part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


@_query("part")
def font_base_names(p):
    style = F.get(F.array(*(F.lit(x) for x in ("", "-Bold", ",Italic", ",BoldItalic", "-Oblique"))), (F.col("p_partkey") % 5).cast("int"))
    name = strings.base_font_name(F.concat(F.when(F.col("p_size") % 2 == 0, "ABCDEF+").otherwise(""), "p_name", style))
    return p.select("p_partkey", name["name"].alias("name"), name.italic.alias("italic"), name.bold.alias("bold"))


@_query("documents")
def doc_encodable(d):
    c = F.coalesce("text", F.lit(""))
    return d.select("doc_id", strings.is_doc_text(c).alias("doc"), strings.is_plain_ascii(c).alias("ascii"), strings.is_valid_utf8(c.cast("binary")).alias("valid"))


@_query("customer")
def dictionary_edits(c):
    """A key set, one removed, and what is read back."""
    value = F.to_json(F.struct(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b")))
    changed = edit.remove_key(edit.set_key(value, "c", F.col("c_custkey").cast("string")), "b")
    return c.select("c_custkey", F.get_json_object(changed, "$.a").alias("a"), F.get_json_object(changed, "$.b").alias("b"), F.get_json_object(changed, "$.c").alias("c"))


@_query("customer")
def array_edits(c):
    value = F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit(',"x",null]'))
    out = edit.remove_at(edit.insert_at(edit.append(edit.set_at(value, 1, F.lit("[1]")), F.lit('"end"')), 0, F.lit("7")), 3)
    return c.select("c_custkey", out.alias("edited"), edit.item_at(out, 1).alias("second"), edit.resize(out, 2).alias("cut"), edit.resize(value, 4).alias("filled"))


QUERIES |= pdf_catalogue.QUERIES
ORACLE_SQL |= pdf_catalogue.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "table"]
