"""Distances from many starts in one search.

Starts are numbered, and 64 of them share a bitmap: a row (vertex, word, bits)
says which starts of that word have come to the vertex.  A round of the
search is one join with the steps and a bitwise or, which Spark combines
before the shuffle, so rounds grow with the longest distance and not with the starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lattica.graph import Graph
from lattica.options import NeighborOptions
from lattica.plans.numbering import numbered
from lattica.plans.storage import Scratch

#: Levels that are joined one by one before they are merged into one table of what was seen.
MERGED_FROM = 8


def _merged(levels: list[DataFrame]) -> DataFrame:
    """(b, word, seen): the starts that any of these levels holds."""
    return reduce(DataFrame.union, [level.select("b", "word", "bits") for level in levels]).groupBy("b", "word").agg(F.bit_or("bits").alias("seen"))


def _searched(graph: Graph, keep: Scratch, starts: DataFrame, options: NeighborOptions) -> tuple[DataFrame, list[DataFrame]]:
    """(id, number) of the starts, and levels (b, word, bits) of vertices first reached by these starts after 0, 1, ... steps."""
    steps = keep.stored(graph.oriented(options.direction, options.edge_label).where("a <> b").select("a", "b").distinct(), "steps")
    known = graph.vertices.select("id").join(starts.select(F.col("id").cast("string")), "id", "left_semi").distinct()
    order = keep.stored(numbered(known, [F.col("id")], "number", first=0, keep=keep), "starts")
    first = order.select(F.col("id").alias("b"), F.expr("shiftright(number, 6)").alias("word"), F.expr("shiftleft(1L, cast(number % 64 as int))").alias("bits"))
    levels, seen, since = [keep.stored(first, "level")], None, 0
    for _ in range(options.max_depth):
        ahead = steps.join(levels[-1].withColumnRenamed("b", "a"), "a").groupBy("b", "word").agg(F.bit_or("bits").alias("got"))
        if len(levels) - since > MERGED_FROM:
            old = seen
            seen, since = keep.stored(_merged([*([old.withColumnRenamed("seen", "bits")] if old is not None else []), *levels[since:]]), "seen"), len(levels)
            if old is not None:
                keep.discard(old)
        before = _merged([*([seen.withColumnRenamed("seen", "bits")] if seen is not None else []), *levels[since:]])
        fresh = ahead.join(before, ["b", "word"], "left").select("b", "word", F.expr("got & ~coalesce(seen, 0L)").alias("bits")).where("bits <> 0")
        fresh, facts = keep.stored_seeing(fresh, "level", n=F.count("*"))
        if not facts["n"]:
            break
        levels.append(fresh)
    return order, levels


def distances_from(graph: Graph, starts: DataFrame, options: NeighborOptions | None = None) -> DataFrame:
    """(start, id, distance) of every vertex within max_depth steps of each start (column ``id`` of ``starts``).

    The start itself is there with 0, but for include_start=False.  Repeated starts count once; null ones and those that
    are no vertex have no row.
    """
    options = options or NeighborOptions()
    keep = Scratch()
    order, levels = _searched(graph, keep, starts, options)
    found = reduce(DataFrame.union, [level.withColumn("distance", F.lit(d)) for d, level in enumerate(levels) if d or options.include_start] or [levels[0].where("false").withColumn("distance", F.lit(0))])
    places = F.expr("explode(filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L))")
    found = found.select(F.col("b").alias("id"), "word", "distance", places.alias("place"))
    found = found.select("id", "distance", (F.col("word") * 64 + F.col("place")).alias("number"))
    return keep.result(found.join(order.withColumnRenamed("id", "start"), "number").select("start", "id", "distance"), "reach")


def reached_by(graph: Graph, starts: DataFrame, options: NeighborOptions | None = None) -> DataFrame:
    """(id, distance, starts): how many starts are that many steps from each vertex, counted from the bitmaps without opening them."""
    options = options or NeighborOptions()
    keep = Scratch()
    _, levels = _searched(graph, keep, starts, options)
    counts = [level.groupBy("b").agg(F.sum(F.bit_count("bits")).alias("starts")).select(F.col("b").alias("id"), F.lit(d).alias("distance"), "starts") for d, level in enumerate(levels) if d or options.include_start]
    out = reduce(DataFrame.union, counts) if counts else levels[0].select(F.col("b").alias("id"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("starts")).where("false")
    return keep.result(out, "reached")
