"""Every query of the catalogue against its DuckDB SQL, on the smallest tables; functions and operators on literals."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions import strings, values
from leafmill.operators import graph, lookup, ordered, text
from leafmill.plans import catalogue
from leafmill.streaming import gaps

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(rows):
    return sorted(tuple("null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = plain(df.select(*columns).collect())
    assert got == plain(want.select(*(f'"{c}"' for c in columns)).fetchall()) and got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(
    "written, epoch",
    [
        ("D:20120205132456", 1328448296),
        ("D:20120205142456+01'00'", 1328448296),
        ("D:20120205122456-01'00'", 1328448296),
        ("D:20120205132456Z", 1328448296),
        ("20120205132456Z", 1328448296),
        ("D:2012", 1325376000),
        ("D:20121", 1325376000),
        ("D:20120", 1325376000),
        ("D:20120205175456+04'30'", 1328448296),
        ("D:20120205132456Z00'00", 1328448296),
        ("D:20120205132456+0", 1328448296),
        ("D:20120205132456-00'0", 1328448296),
        ("D:20120132", None),
        ("D:2012010125", None),
        ("D:20121301", None),
        ("D:201202051324560", None),
        ("no date", None),
        ("", None),
    ],
)
def test_dates(spark, written, epoch):
    got = spark.createDataFrame([(written,)], "s string").select(F.unix_timestamp(values.parse_date(F.col("s")).ts).alias("e")).first().e
    assert got == epoch


def test_strings(spark):
    rows = [("a b#c/é",), ("%+ x",), ("",)]
    df = spark.createDataFrame(rows, "s string").select("s", strings.escape_name(F.col("s")).alias("e"))
    got = df.select("s", "e", strings.unescape_name(F.col("e")).alias("u")).collect()
    assert [r.u for r in got] == [r.s for r in got] and got[0].e == "a#20b#23c#2F#C3#A9"
    raw = [(b"\xfe\xff\x00A\x20\xac", "A€"), (b"\xff\xfeA\x00", "A"), (b"\xef\xbb\xbf\xc3\xa9", "é"), (b"plain", "plain")]
    assert [r.t for r in spark.createDataFrame(raw, "b binary, w string").select(strings.text_of(F.col("b")).alias("t")).collect()] == [w for _, w in raw]
    assert bytes(spark.sql("SELECT '4 8x5' AS s").select(strings.hex_decode(F.col("s")).alias("b")).first().b) == b"HP"
    words = spark.createDataFrame([("the end",), ("bathe the",), ("other",), ("(the)",), ("to the",), ("no",)], "s string").select(strings.whole_word_first(F.col("s"), "the").alias("w"))
    assert [r.w for r in words.collect()] == [True, False, False, True, True, False]
    blank = spark.createDataFrame([("  \t",), (" a ",)], "s string").select(strings.is_blank(F.col("s")).alias("b"), strings.trim_blank(F.col("s")).alias("t")).collect()
    assert [(r.b, r.t) for r in blank] == [(True, ""), (False, "a")]


def test_values(spark):
    one = spark.range(1)
    r = one.select(
        values.rgb_to_cmyk(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("cmyk"),
        values.cmyk_to_rgb(F.lit(0.0), F.lit(0.5), F.lit(1.0), F.lit(0.0)).alias("rgb"),
        values.normalize_rect(F.lit(10.0), F.lit(20.0), F.lit(4.0), F.lit(5.0)).alias("rect"),
        values.rotation(F.lit(-90)).alias("rot"),
        values.field_type(F.lit("Btn"), F.lit(1 << 15)).alias("ft"),
        values.field_type(F.lit("Ch"), F.lit(None).cast("int")).alias("ch"),
    ).first()
    assert tuple(r.cmyk) == (0, 0.5, 1, 0) and tuple(r.rgb) == (1, 0.5, 0) and tuple(r.rect) == (4, 5, 6, 15)
    assert (r.rot, r.ft, r.ch) == (270, "RadioButton", "ListBox")
    boxes = one.select(values.normalize_rect(*map(F.lit, (0.0, 0.0, 4.0, 4.0))).alias("a"), values.normalize_rect(*map(F.lit, (2.0, 3.0, 9.0, 9.0))).alias("b"), values.normalize_rect(*map(F.lit, (5.0, 5.0, 6.0, 6.0))).alias("c"))
    cut = boxes.select(values.intersect_rect(F.col("a"), F.col("b")).alias("ab"), values.intersect_rect(F.col("a"), F.col("c")).alias("ac")).first()
    assert tuple(cut.ab) == (2, 3, 2, 1) and cut.ac is None


def test_overflows_at_the_limits(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(high, 1), (high, 2), (low, 1), (low, -1), (low, low), (1 << 31, 1 << 32), (1 << 31, (1 << 32) - 1), (-(1 << 31), 1 << 32), (-(1 << 31), (1 << 32) + 1), (3037000500, 3037000500), (3037000499, 3037000499), (0, low), (None, 1), (1, None)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", values.overflows(F.col("a"), F.col("b")).alias("over"))
    assert [r.over for r in df.collect()] == [None if a is None or b is None else not low <= a * b <= high for a, b in rows]
    assert "try_multiply" not in df._jdf.queryExecution().toString()  # an exception for each product out of range


def test_ordinals_and_graphs(spark):
    ids = [5, 3, 9, 9, None, 100, -4] + list(range(200, 400))
    got = ordered.ordinal(spark.createDataFrame([(i,) for i in ids], "k long").repartition(5), "k").collect()
    assert sorted(r.i for r in got) == list(range(len(ids)))
    assert [r.k for r in sorted(got, key=lambda r: r.i)] == sorted(ids, key=lambda k: (k is not None, k or 0))
    many = ordered.ordinal(spark.createDataFrame([(i,) for i in ids], "k long"), "k", ranges=150).collect()
    assert sorted((r.i, str(r.k)) for r in many) == sorted((r.i, str(r.k)) for r in got)
    assert ordered.ordinal(spark.createDataFrame([], "k long"), "k").count() == 0
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (1, 1)], "src int, dst int")
    assert {r.id for r in graph.reachable(edges, spark.createDataFrame([(1,), (9,)], "id int")).collect()} == {1, 2, 3, 9}
    nodes = spark.createDataFrame([(1, None, 0, "a.b"), (2, 1, 0, None), (3, 2, 1, "c"), (7, 8, 0, "x"), (8, 7, 0, "y")], "node int, parent int, pos int, name string")
    paths = graph.tree_paths(nodes, spark).withColumn("full", graph.full_name("names"))
    assert {(r.node, tuple(r.path), r.full) for r in paths.collect()} == {(1, (0,), "a..b"), (2, (0, 0), "a..b"), (3, (0, 0, 1), "a..b.c")}
    both = lookup.rebased_union(spark.createDataFrame([(0,), (4,)], "id int"), spark.createDataFrame([(0,), (1,)], "id int"), "id")
    assert sorted(r.id for r in both.collect()) == [0, 4, 5, 6]


def test_search(spark):
    entries = spark.createDataFrame([(" The cat ", 1.0, 1.0), ("\t", 1.0, 1.0), ("cathedral", 50.0, 5.0), ("a CAT!", 2.0, 2.0)], "text string, x double, y double")
    run = lambda **k: sorted(r.text for r in text.search(entries, text.Match(**k)).collect())
    assert run() == ["The cat", "a CAT!", "cathedral"]
    assert run(pattern="cat") == ["The cat", "cathedral"] and run(pattern="cat", clip=(0, 0, 9, 9)) == ["The cat"]
    assert run(pattern="cat", whole_word=True, extract=True, ignore_case=True) == ["CAT", "cat"]
    assert run(tokenize=True, pattern="cat") == ["cat", "cathedral"]
    with pytest.raises(NotImplementedError):
        text.Match(extract=True)


def test_stream_gaps(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:30:00", 2), (1, "2024-01-01 02:00:00", 3), (2, "2024-01-01 00:00:00", 4), (9, "2024-01-03 00:00:00", 5)]
    spark.createDataFrame(rows, "user_id long, s string, event_id long").select("user_id", F.to_timestamp("s").alias("ts"), "event_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_id long").parquet(str(tmp_path / "in"))
    query = gaps.gap_entries(stream).writeStream.format("memory").queryName("entries").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("entries").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_imports_without_the_training_data_operators(tmp_path):
    """The rest stands when that folder is taken away."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/leafmill", tmp_path / "leafmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from leafmill.plans import catalogue as c; assert len(e.queries()) == len(e.oracle_sql()) == len(c.QUERIES) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
