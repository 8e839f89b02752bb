"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the mean number of its copies in the mix. Among all rates that meet a source's token
target, the ones chosen differ least from 1 in relative entropy. Their dual is convex with one unknown lambda for
each source, and the rates are the documents exponentially tilted: ``min(cap, exp(lambda * size / mean size))``. Newton
iterations solve the dual, each a distributed aggregation over the histogram of sizes (which holds all that the dual
asks of the documents), with a bracket that keeps a step from overshooting. Sources may be many, as domains are: their
table, with each lambda and its bracket, stays distributed and is written in each round. The driver sees sums over all
sources and the number of those that aren't solved yet.

Rates become whole copies by error diffusion: in groups of a few thousand documents of one source, largest first,
each document takes the rate's floor or ceiling so that the group's words follow their running target. The last and
smallest documents leave an error of a few words for each group, whatever the hot source's share. Groups are chosen by
a hash of the id, so reruns agree; they are streamed, with one number carried on.

Defined cases: a null text has no words, and such a document is kept once in a mix, at no cost (rate 1).
A null source is a source of its own, after all others. Repeated rows are documents of their own. An empty table, or
one without words, gives targets of 0. Columns named like an output are replaced. Dual steps that don't settle raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._common import WORD, fresh, written

#: Documents of a rounding group, about.
GROUP = 4000

#: Fixed values of the contract: weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(histogram: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """k, source, docs, total, mean, weight of every source; k counts them in code-point order, null last.

    Sources are cut into ranges, and counted before they are ranked inside these, so no task gets all of them.
    """
    per = histogram.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("total"))
    order = F.col("source").asc_nulls_last()
    ranged = written(per.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each shuffle partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("k"), F.lit(len(weights))) + 1).cast("int"))
    mean = F.col("total") / F.greatest(F.col("docs"), F.lit(1))
    return ranged.join(before, "part").withColumn("k", k.cast("long")).select("k", "source", "docs", "total", mean.alias("mean"), weight.alias("weight"))


def with_targets(sources: DataFrame, cap: float) -> DataFrame:
    """Adds ``target``: all sizes shared by weight, none over ``cap`` times its size, the excess dealt anew among the rest.

    A source of weight w gets min(cap x size, w x level); the level is found by rounds that each close the sources over it.
    """
    level, closed = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.lit(float(cap)) * F.col("total")
        left = F.sum(F.when(over, F.col("total") * F.lit(1.0 - cap)).otherwise(F.col("total").cast("double")))
        got = sources.where("total > 0").agg(left, F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if not got[1] or got[2] == closed:
            break
        level, closed = got[0] / got[1], got[2]
    share = F.least(F.lit(float(cap)) * F.col("total"), F.col("weight") * F.lit(level)) if got[1] else F.lit(float(cap)) * F.col("total")
    return sources.withColumn("target", F.when(F.col("total") > 0, share).otherwise(F.lit(0.0)))


def solve_dual(histogram: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-9, most: int = 60) -> DataFrame:
    """Adds ``lam`` to the sources. ``histogram``: k, size, n; ``sources``: k, total, mean, target and more.

    A target of ``cap`` times the total is met by the cap itself: lambda is infinite. Each round is one aggregation
    over the histogram of the sources that aren't solved, and a Newton step within each one's bracket.
    """
    ceiling, inf = F.lit(float(np.log(cap))), F.lit(float("inf"))
    full = F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("total")
    start = F.when(full & (F.col("total") > 0), inf).when(F.col("target") > 0, F.log(F.col("target") / F.col("total"))).otherwise(F.lit(0.0))
    keys = ["k", "mean", "target", "lam", "low", "high"]
    state = sources.select("k", "mean", "target", start.alias("lam"), (-inf).alias("low"), inf.alias("high"), (full | (F.col("total") <= 0)).alias("done"))
    state = written(state, "dual")
    for _ in range(most):
        if state.where("NOT done").isEmpty():
            break
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * F.exp(F.least(tilt, ceiling))
        slope = F.when(tilt < ceiling, words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        asked = histogram.join(state.where("NOT done").select(*keys), "k").groupBy(*keys).agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        short = F.col("target") - F.col("words")
        met = F.abs(short) <= tolerance * F.col("target")
        closer = asked.withColumn("met", met).withColumns({"low": F.when(short > 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(short > 0, F.col("high")).otherwise(F.col("lam"))})
        step = F.when(F.col("slope") > 0, F.col("lam") + short / F.col("slope")).otherwise(inf)
        wide = (
            F.when(F.col("high") == inf, F.when(F.col("lam") > 0, 2 * F.col("lam") + 1).otherwise(F.lit(1.0)))
            .when(F.col("low") == -inf, F.when(F.col("lam") < 0, 2 * F.col("lam") - 1).otherwise(F.lit(-1.0)))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (F.col("low") < step) & (step < F.col("high")) & (F.abs(step - F.col("lam")) <= 4 + F.abs(F.col("lam")))
        moved = closer.withColumn("next", F.when(F.col("met"), F.col("lam")).when(inside, step).otherwise(wide))
        narrow = F.col("high") - F.col("low") <= 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col("next")))
        moved = moved.select("k", "mean", "target", F.col("next").alias("lam"), "low", "high", (F.col("met") | narrow).alias("done"))
        state = written(moved.unionByName(state.where("done")), "dual")
    else:
        if not state.where("NOT done").isEmpty():
            raise RuntimeError(f"the dual did not settle in {most} rounds")
    # sums come in any order: fewer digits than they have make reruns agree
    return sources.join(state.select("k", F.round("lam", 7).alias("lam")), "k")


def round_copies(rate: np.ndarray, size: np.ndarray, error: float = 0.0) -> tuple[np.ndarray, float]:
    """Floor or ceiling of each rate, so that words taken follow the running sum of rate x size; and the words still owed."""
    copies = np.floor(rate + 1e-9).astype(np.int64)
    for i, (r, s, low) in enumerate(zip(rate.tolist(), size.tolist(), copies.tolist())):
        if s == 0:
            continue
        error += (r - low) * s
        if r > low + 1e-9 and 2 * error >= s:
            copies[i] += 1
            error -= s
    return copies, error


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for all documents.

    ``weights`` repeat over the sources in code-point order, null last. No document has more than ceil(rate) copies,
    so none exceeds ``cap`` (whole) times its size.
    """
    if cap < 1 or cap != int(cap):
        raise ValueError("cap must be a whole number of at least 1")
    # ids and sizes are all that mixing reads of a text: a narrow table, written once
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    histogram = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = written(with_targets(written(ranked_sources(histogram, weights), "ranked"), cap), "targets")
    of = sources.select("k", F.col("source").alias("of"))
    keyed = written(histogram.join(of, F.col("source").eqNullSafe(F.col("of"))).select("k", "size", "n"), "keyed")
    solved = written(solve_dual(keyed, sources, cap), "solved")

    s = solved.select("k", F.col("source").alias("of"), "docs", F.col("total").alias("source_size"), "mean", "target", "lam")
    tilt = F.when(F.col("lam") == float("inf"), F.log(F.lit(cap))).otherwise(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(cap))))
    # a few numbers a row on either side: Spark broadcasts the sources if they are few, and else adaptive execution splits a hot one
    rated = sized.join(s, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.exp(tilt), F.lit(float(cap)))))
    groups = F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP))
    rated = rated.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("mix")), groups))

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions sorted by group and falling size: a group may go on in the next batch, with the words it is owed."""
        last, error = None, 0.0
        for batch in batches:
            k, part, rate, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "part", "rate", "size"))
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (part[1:] != part[:-1])][: len(k)])
            out = []
            for a, b in zip(starts, [*starts[1:], len(k)]):
                group = (k[a], part[a])
                taken, error = round_copies(rate[a:b], size[a:b], error if group == last else 0.0)
                out.append(taken)
                last = group
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=[*batch.schema.names, "copies"])

    columns = ["doc_id", "source", "k", "part", "size", "source_size", "target", "rate"]
    ordered = rated.select(*columns).repartition("k", "part").sortWithinPartitions("k", "part", F.desc("size"), "doc_id")
    kinds = dict(ordered.dtypes)
    counted = ordered.mapInArrow(copies, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", copies bigint")
    return counted.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it has copies.

    Rows that repeat an id, with texts of one size and source, are dealt that id's copies in turn, in the order of all
    their columns, so reruns agree.
    """
    names, id_col, source, text = docs.columns, how.get("id_col", "doc_id"), how.get("source", "source"), how.get("text", "text")
    key, size, of, n, rows, nth, copy = (fresh(docs, x) for x in ("key", "size", "of", "n", "rows", "nth", "copy"))
    # null ids and sources have stand-ins, so that one exchange serves the join and the window
    keys = lambda i, s: (F.coalesce(i.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("")))
    mixed = mix(docs, **how)
    i, s = keys(F.col("doc_id"), F.col("source"))
    counted = written(mixed.groupBy(i.alias(key), s.alias(of), F.col("size").alias(size)).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(rows)), "copies")
    i, s = keys(F.col(id_col), F.col(source))
    joined = docs.withColumns({key: i, of: s, size: word_count(F.col(text))}).join(counted.hint("merge"), [key, of, size])
    ordered = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    turn = F.row_number().over(Window.partitionBy(key, of, size).orderBy(*ordered))
    times = F.floor(F.col(n) / F.col(rows)) + (F.col(nth) <= F.col(n) % F.col(rows)).cast("int")
    dealt = joined.withColumn(nth, turn).withColumn(copy, F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return dealt.select(*names)
