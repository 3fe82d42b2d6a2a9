"""Simple directed cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattica.errors import require_text
from lattica.graph import Graph
from lattica.operators.components import strong_roots
from lattica.options import UNBOUNDED, CycleOptions
from lattica.plans.storage import Scratch, discard

#: Starts that are searched first if only some cycles are wanted; each further turn takes so many times more.
FIRST_STARTS, MORE = 64, 8
#: More steps than this are first cut down to those within strong components; fewer are searched sooner than their components are found.
STRONG_FROM = 100_000


def _path_columns() -> list:
    return ["vertex_ids", "edge_ids"]


def _all_steps(graph: Graph, options: CycleOptions) -> DataFrame:
    """(a, b, edge_id); parallel edges make one step, shown by the smallest edge id."""
    _, edges = graph.restricted(options.vertex_label, options.edge_label)
    return edges.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min("id").alias("edge_id"))


def _steps(graph: Graph, keep: Scratch, options: CycleOptions) -> DataFrame:
    """As :func:`_all_steps`; steps that no cycle can hold are left out, again and again while many go."""
    steps, facts = keep.stored_seeing(_all_steps(graph, options), "steps", n=F.count("*"))
    while facts["n"]:
        n = facts["n"]
        kept = steps.join(steps.select(F.col("b").alias("a")), "a", "left_semi").join(steps.select(F.col("a").alias("b")), "b", "left_semi")
        steps, facts = keep.stored_seeing(kept.select("a", "b", "edge_id"), "steps", n=F.count("*"))
        if facts["n"] > 0.9 * n:
            break
    if facts["n"] > STRONG_FROM:
        ends = steps.select(F.col("a").alias("id")).union(steps.select(F.col("b").alias("id"))).distinct()
        roots = strong_roots(ends, steps.select("a", "b"))
        root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        within = steps.where("a <> b").join(root_of("a"), "a").join(root_of("b"), "b").where("root_a = root_b")
        steps, _ = keep.stored_seeing(within.select("a", "b", "edge_id").union(steps.where("a = b")), "steps", n=F.count("*"))
        discard(roots)
    return steps


def _ways_back(keep: Scratch, steps: DataFrame, max_distance: int, starts) -> DataFrame:
    """(start, last, distance) of vertices larger than a start from which it is 1 to max_distance steps back to it, over such vertices only."""
    near = frontier = steps.select(F.col("b").alias("a"), F.col("a").alias("last")).where(starts & (F.col("last") > F.col("a"))).select(F.col("a").alias("start"), "last")
    near = near.withColumn("distance", F.lit(1))
    for distance in range(2, max_distance + 1):
        behind = steps.join(frontier.select("start", F.col("last").alias("b")), "b").where("a > start").select("start", F.col("a").alias("last")).distinct()
        frontier, facts = keep.stored_seeing(behind.join(near.select("start", "last"), ["start", "last"], "left_anti"), "back", n=F.count("*"))
        if not facts["n"]:
            break
        near = near.union(frontier.withColumn("distance", F.lit(distance)))
    return near


def _from_starts(keep: Scratch, steps: DataFrame, max_depth: int, starts) -> DataFrame:
    """(vertex_ids, edge_ids) of cycles of 1 to max_depth edges whose smallest vertex, where they begin, meets the condition ``starts``.

    A path is only made where the way back to its start is short enough for the edges that it has left.
    """
    first = steps.where(starts).select(F.col("a").alias("start"), F.col("b").alias("last"), F.array("a", "b").alias("vertex_ids"), F.array("edge_id").alias("edge_ids"))
    closed = first.where("last = start").select(*_path_columns())
    held = first.where("last > start")
    if max_depth > 2:
        near = _ways_back(keep, steps, max_depth - 1, starts)
        held = held.join(near, ["start", "last"]).drop("distance")
    closing = steps.select(F.col("a").alias("last"), F.col("b").alias("start"), "edge_id")
    longer = [F.concat("vertex_ids", F.array("b")).alias("vertex_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids")]
    for length in range(2, max_depth + 1):
        if 2 < length < max_depth:
            held, facts = keep.stored_seeing(held, "cycles", n=F.count("*"))
            if not facts["n"]:
                break
        ends = held.join(closing, ["last", "start"])
        closed = closed.union(ends.select(F.concat("vertex_ids", F.array("start")), F.concat("edge_ids", F.array("edge_id"))))
        if length < max_depth:
            # the start stays the smallest vertex, so no rotation of a cycle comes up again
            back = near.where(F.col("distance") <= max_depth - length).select("start", F.col("last").alias("b"))
            ahead = held.join(steps, held["last"] == steps["a"]).where((F.col("b") > F.col("start")) & ~F.array_contains("vertex_ids", F.col("b")))
            held = ahead.join(back, ["start", "b"]).select("start", F.col("b").alias("last"), *longer)
    return closed


def _through(graph: Graph, keep: Scratch, steps: DataFrame, vertex: str, max_depth: int) -> DataFrame:
    """(vertex_ids, edge_ids) of cycles over one vertex: simple paths from it back to it, cut off by the distance back, then turned to begin at the smallest id."""
    near = frontier = graph.spark.createDataFrame([(vertex, 0)], "b string, distance int")
    for depth in range(1, max_depth):
        behind = steps.join(frontier.select("b"), "b", "left_semi").select(F.col("a").alias("b")).distinct().join(near.select("b"), "b", "left_anti")
        frontier, facts = keep.stored_seeing(behind.withColumn("distance", F.lit(depth)), "near", n=F.count("*"))
        if not facts["n"]:
            break
        near = near.union(frontier)
    steps = keep.stored(steps.join(near, "b"), "steps")
    held = graph.spark.createDataFrame([(vertex, [vertex], [])], "last string, vertex_ids array<string>, edge_ids array<string>")
    closed = held.where("false").select(*_path_columns())
    for length in range(1, max_depth + 1):
        ahead = held.join(steps.where(F.col("distance") + length <= max_depth), held["last"] == steps["a"])
        ahead = ahead.where((F.col("b") == vertex) | ~F.array_contains("vertex_ids", F.col("b")))
        ahead = ahead.select(F.col("b").alias("last"), F.concat("vertex_ids", F.array("b")).alias("vertex_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"))
        ahead, facts = keep.stored_seeing(ahead, "cycles", n=F.count("*"))
        if not facts["n"]:
            break
        closed = closed.union(ahead.where(F.col("last") == vertex).select(*_path_columns()))
        held = ahead.where(F.col("last") != vertex)
    ring = F.slice("vertex_ids", F.lit(1), F.size("edge_ids"))
    turned = closed.withColumn("ring", ring).withColumn("at", F.array_position("ring", F.array_min("ring")).cast("int"))
    turn = lambda c: F.concat(F.slice(c, F.col("at"), F.size(c)), F.slice(c, F.lit(1), F.col("at") - 1))
    return turned.select(F.concat(turn("ring"), F.array(F.array_min("ring"))).alias("vertex_ids"), turn("edge_ids").alias("edge_ids"))


def detect_cycles(graph: Graph, options: CycleOptions | None = None, through: str | None = None) -> DataFrame:
    """(vertex_ids, edge_ids, length) of simple cycles of 1 to max_depth edges, each once, from its smallest id.

    Parallel edges make one step, shown by the smallest edge id.  The first
    max_cycles by vertex_ids are returned: starts are searched in ascending
    order, some and then more, until there are so many.  With ``through`` only cycles over that vertex.
    """
    options = options or CycleOptions()
    if through is not None:
        require_text(through, "vertex id")
    keep = Scratch()
    # a search through one vertex meets what is near it only: cutting down the whole graph would be the larger job
    steps = _steps(graph, keep, options) if through is None else keep.stored_seeing(_all_steps(graph, options), "steps", n=F.count("*"))[0]
    bounded = options.max_cycles < UNBOUNDED
    if options.max_depth <= 0:
        closed = _from_starts(keep, steps.where("false"), 1, F.lit(True))
    elif through is not None:
        closed = _through(graph, keep, steps, through, options.max_depth)
    elif not bounded:
        closed = _from_starts(keep, steps, options.max_depth, F.lit(True))
    else:
        closed, n, above, size = None, 0, F.lit(True), FIRST_STARTS
        while True:
            last = steps.where(above & (F.col("b") >= F.col("a"))).select("a").distinct().orderBy("a").limit(size).agg(F.max("a")).first()[0]
            if last is None:
                break
            found, facts = keep.stored_seeing(_from_starts(keep, steps, options.max_depth, above & (F.col("a") <= last)), "closed", n=F.count("*"))
            closed, n = found if closed is None else closed.union(found), n + facts["n"]
            if n >= options.max_cycles:
                break
            above, size = F.col("a") > last, size * MORE
        if closed is None:
            closed = _from_starts(keep, steps.where("false"), 1, F.lit(True))
    out = closed.select("vertex_ids", "edge_ids", F.size("edge_ids").alias("length")).orderBy("vertex_ids")
    return keep.result(out.limit(options.max_cycles) if bounded else out, "cycles").orderBy("vertex_ids")


def cycles_through(graph: Graph, vertex_id: str, options: CycleOptions | None = None) -> DataFrame:
    """Cycles over one vertex: the answer to whether it depends on itself."""
    return detect_cycles(graph, options, through=vertex_id)
