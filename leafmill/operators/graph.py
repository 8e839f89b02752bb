"""Reference graphs: reachability, garbage, ancestors' paths and full names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DEPTH = 256


def _written(df: DataFrame) -> DataFrame:
    """A Parquet table in the folder that all executors share: it cuts lineage and outlives executors."""
    sc = df.sparkSession.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="leafmill-"))
        at = sc._jsc.sc().getCheckpointDir()
    path = f"{at.get()}/graph-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id of all nodes that roots (id) reach over edges (src, dst): a frontier that grows by what wasn't met before."""
    seen = frontier = _written(roots.select("id").distinct())
    for _ in range(MOST_DEPTH):
        met = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = _written(met.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = _written(seen.unionByName(frontier))
    raise RuntimeError(f"references are nested deeper than {MOST_DEPTH}")


def garbage(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects (id, …) that no root reaches."""
    return objects.join(reachable(edges, roots), "id", "left_anti")


def tree_paths(nodes: DataFrame, spark: SparkSession) -> DataFrame:
    """node, path (positions of its ancestors and itself, root first), names: every node below the roots.

    ``nodes``: node, parent (null for roots), pos, name. Cycles are cut where a node would be its own ancestor.
    """
    nodes = _written(nodes.select(F.col("node").alias("n"), "parent", "pos", "name"))
    found = frontier = _written(nodes.where("parent IS NULL").select(F.col("n").alias("node"), F.array("pos").alias("path"), F.array("name").alias("names"), F.array("n").alias("above")))
    while not frontier.isEmpty():
        below = frontier.join(nodes, frontier["node"] == nodes["parent"]).where(~F.array_contains("above", F.col("n")))
        frontier = _written(below.select(F.col("n").alias("node"), *(F.array_append(to, F.col(of)).alias(to) for to, of in (("path", "pos"), ("names", "name"), ("above", "n")))))
        found = found.unionByName(frontier)
    return found.select("node", "path", "names")


def full_name(names: str):
    """Partial names from the root, dots inside doubled, joined by dots; nameless levels are skipped."""
    return F.array_join(F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.replace(n, F.lit("."), F.lit(".."))), ".")
