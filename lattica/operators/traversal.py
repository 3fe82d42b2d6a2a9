"""Neighbours, shortest path and all simple paths.

Steps are written once for a search, and each level is one job: what decides
about the next level is taken while the level is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lattica.errors import GraphQueryError, require_text
from lattica.graph import Graph
from lattica.model import Direction
from lattica.options import NeighborOptions, PathOptions
from lattica.plans.storage import Scratch

#: Levels that stay one lazy plan.
LAZY_LEVELS = 2


def neighbors(graph: Graph, start_id: str, options: NeighborOptions | None = None) -> DataFrame:
    """Distinct vertices within max_depth steps of the start; walks may turn back, so the start is one of them if a closed walk exists."""
    options = options or NeighborOptions()
    require_text(start_id, "start id")
    keep, deep = Scratch(), options.max_depth > LAZY_LEVELS
    steps = graph.steps(keep, options.direction, options.edge_label) if deep else graph.oriented(options.direction, options.edge_label)
    steps = steps.select("a", "b")
    reached = frontier = steps.where(F.col("a") == start_id).select("b").distinct()
    if options.max_depth <= 0:
        reached = reached.where("false")
    for depth in range(2, options.max_depth + 1):
        if deep:
            frontier, facts = keep.stored_seeing(frontier, "frontier", n=F.count("*"))
            reached = frontier if depth == 2 else reached.union(frontier)
            if not facts["n"]:
                break
        ahead = steps.join(frontier.select(F.col("b").alias("a")), "a", "left_semi").select("b").distinct()
        frontier = ahead.join(reached, "b", "left_anti")
        if not deep or depth == options.max_depth:
            reached = reached.union(frontier)
    if deep:
        reached = keep.result(reached, "reached")
    if not options.include_start:
        reached = reached.where(F.col("b") != start_id)
    return graph.vertices.join(reached.withColumnRenamed("b", "id"), "id", "left_semi").select(*graph.vertices.columns)


def _no_path(graph: Graph) -> DataFrame:
    return graph.spark.createDataFrame([], "vertex_ids array<string>, edge_ids array<string>, length int")


def _ahead(steps: DataFrame, levels: list[DataFrame], with_edges: bool = False) -> DataFrame:
    """The level after the last: b of each vertex, or (a, b, edge_id) of each step into it.

    As every step also goes back, a step leads one level on, one back or to the
    same level: only two levels are left out of the next.
    """
    ahead = steps.join(levels[-1].select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    ahead = ahead.select("a", "b", "edge_id") if with_edges else ahead.select("b").distinct()
    return ahead.join(reduce(DataFrame.union, [level.select("b") for level in levels[-2:]]), "b", "left_anti")


def _levels(graph: Graph, keep: Scratch, steps: DataFrame, start: str, max_depth: int) -> list[DataFrame]:
    """Level-synchronous search along ``steps``, which go both ways: [vertices (b) of level 0, level 1, ...]."""
    levels = [graph.vertices.where(F.col("id") == start).select(F.col("id").alias("b"))]
    for _ in range(max_depth):
        ahead, seen = keep.stored_seeing(_ahead(steps, levels), "level", n=F.count("*"))
        if not seen["n"]:
            break
        levels.append(ahead)
    return levels


def _meet(graph: Graph, keep: Scratch, steps: DataFrame, ends: tuple[str, str], max_depth: int) -> tuple[list[list[DataFrame]], list[list[int]]] | None:
    """Levels of steps from both ends until the last ones share a vertex, and their sizes; None if they don't within max_depth.

    The side whose last level has fewer steps grows, so a hub on the way is met by one side instead of being opened by both.
    Before a side grows the sides share nothing: the first vertex that they share is on a shortest path.
    """
    sides = [[graph.vertices.where(F.col("id") == end).select(F.col("id").alias("b"))] for end in ends]
    sizes = [[1], [1]]
    for _ in range(max_depth):
        k = int(sizes[1][-1] < sizes[0][-1])
        marks = sides[1 - k][-1].select("b").distinct().withColumn("hit", F.lit(True))
        ahead, facts = keep.stored_seeing(_ahead(steps, sides[k], with_edges=True).join(marks, "b", "left"), "level", n=F.count("*"), met=F.max("hit"))
        if not facts["n"]:
            return None
        sides[k].append(ahead), sizes[k].append(facts["n"])
        if facts["met"]:
            return sides, sizes
    return None


def _distances(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [level.select(F.col("b").alias("id"), F.lit(d).alias("distance")) for d, level in enumerate(levels)])


def shortest_path(graph: Graph, from_id: str, to_id: str, options: PathOptions | None = None) -> DataFrame:
    """The shortest path over edges of either direction: one row (vertex_ids, edge_ids, length) or none.

    The search grows from both ends.  Among paths of least length the lexicographically smallest (vertex_ids,
    edge_ids) is taken.  No path for from = to, nor beyond max_depth.
    """
    options = options or PathOptions()
    require_text(from_id, "from id"), require_text(to_id, "to id")
    if from_id == to_id or options.max_depth <= 0:
        return _no_path(graph)
    keep = Scratch()
    steps = graph.steps(keep, Direction.BOTH, options.edge_label).where("a <> b")
    found = _meet(graph, keep, steps, (from_id, to_id), options.max_depth)
    if found is None:
        keep.discard()
        return _no_path(graph)
    (near, far), _ = found
    # the best rest of a path from each vertex of a level: of the far side's levels outwards, then of the near side's back to the start
    best = graph.spark.createDataFrame([(to_id, [to_id], [])], "v string, vs array<string>, es array<string>")
    for level, last, first in [*((level, "a", "b") for level in far[1:]), *((level, "b", "a") for level in reversed(near[1:]))]:
        back = level.select("a", "b", "edge_id").join(best.withColumnRenamed("v", last), last)
        rest = F.struct(F.concat(F.array(first), "vs").alias("vs"), F.concat(F.array("edge_id"), "es").alias("es"))
        best = back.groupBy(F.col(first).alias("v")).agg(F.min(rest).alias("m")).select("v", "m.vs", "m.es")
    path = best.where(F.col("v") == from_id).select(F.col("vs").alias("vertex_ids"), F.col("es").alias("edge_ids"), F.size("es").alias("length"))
    return keep.result(path, "path")


def shortest_path_lengths(graph: Graph, from_id: str, options: PathOptions | None = None) -> DataFrame:
    """(id, distance) of every vertex within max_depth steps of either direction, the start with 0."""
    options = options or PathOptions()
    require_text(from_id, "from id")
    keep = Scratch()
    steps = graph.steps(keep, Direction.BOTH, options.edge_label)
    levels = _levels(graph, keep, steps.where("a <> b"), from_id, options.max_depth)
    keep.discard(steps)
    return _distances(levels)


#: What a half path carries along with its vertices, in SQL: (name, value without a step, value after one step more).
_EDGES = ("edge_ids", "cast(array() as array<string>)", "concat(edge_ids, array(edge_id))")
_TIMES = ("times", "cast(1 as decimal(38,0))", "cast(times * edges as decimal(38,0))")


def _grown(keep: Scratch, steps: DataFrame, start: DataFrame, carried: tuple, depths: int, within: Callable[[int], Column], banned: str, max_rows: int) -> list[DataFrame]:
    """[simple paths (vertex_ids, carried) of 0, 1, ... edges] from ``start`` along steps that meet ``within`` at their depth; those that get to ``banned`` go no further."""
    name, first, longer = carried
    levels = [start.select(F.array("id").alias("vertex_ids"), F.expr(first).alias(name))]
    last = F.element_at("vertex_ids", -1)
    for depth in range(1, depths + 1):
        ahead = levels[-1].where(last != banned).withColumn("a", last).join(steps.where(within(depth)), "a").where(~F.array_contains("vertex_ids", F.col("b")))
        if depth > 1:
            ahead = ahead.where(F.col("b") != banned)
        level, facts = keep.stored_seeing(ahead.select(F.concat("vertex_ids", F.array("b")).alias("vertex_ids"), F.expr(longer).alias(name)), "half", n=F.count("*"))
        if facts["n"] > max_rows:
            raise GraphQueryError(f"{facts['n']} partial paths of {depth} edges; max_rows is {max_rows}")
        if not facts["n"]:
            break
        levels.append(level)
    return levels


def _halves(graph: Graph, keep: Scratch, ends: tuple[str, str], options: PathOptions, carried: tuple) -> list[tuple[DataFrame, DataFrame, int]]:
    """For each length of a path, the halves (m, vertex_ids, carried) from both ends that may meet in m, and that length.

    The half from the start has the odd edge.  It grows only where the goal is near enough; where it ends, that is
    as far as the other half is looked for.  Neither holds the other's end, but for a first step that is a whole path.
    """
    from_id, to_id = ends
    depth, b = options.max_depth, options.max_depth // 2
    steps = graph.steps(keep, Direction.BOTH, options.edge_label).where("a <> b")
    near = _distances(_levels(graph, keep, steps, to_id, depth - 1))
    steps = keep.stored(steps.join(near.select(F.col("id").alias("b"), "distance"), "b"), "steps")
    if carried is _TIMES:
        # parallel edges are one step that counts as many times
        steps = keep.stored(steps.groupBy("a", "b", "distance").agg(F.count("*").alias("edges")), "steps")
    end = lambda v: graph.vertices.where(F.col("id") == v).select("id")
    out = _grown(keep, steps, end(from_id), carried, depth - b, lambda d: F.col("distance") + d <= depth, to_id, options.max_rows)
    middle = reduce(DataFrame.union, [level.select(F.element_at("vertex_ids", -1).alias("id")) for level in out]).distinct()
    reach = [keep.stored(middle.withColumn("left", F.lit(0)), "middle")]
    for left in range(1, b):
        ahead = steps.join(reach[-1].select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        ahead = ahead.join(reduce(DataFrame.union, reach).select("id"), "id", "left_anti")
        reach.append(keep.stored(ahead.withColumn("left", F.lit(left)), "middle"))
    if b:
        steps = keep.stored(steps.join(reduce(DataFrame.union, reach).withColumnRenamed("id", "b"), "b"), "steps")
    back = _grown(keep, steps, end(to_id), carried, b, lambda d: F.col("left") + d <= b, from_id, options.max_rows)
    meeting = lambda level: level.withColumn("m", F.element_at("vertex_ids", -1))
    lengths = [(n - n // 2, n // 2, n) for n in range(1, depth + 1)]
    return [(meeting(out[i]), meeting(back[j]), n) for i, j, n in lengths if i < len(out) and j < len(back)]


def all_paths(graph: Graph, from_id: str, to_id: str, options: PathOptions | None = None) -> DataFrame:
    """All simple paths of 1 to max_depth edges of either direction; parallel edges make paths of their own.

    A path ends when it first reaches ``to_id``.  Half paths grow from both ends and are joined where they meet, so nothing
    longer than half a path is held before the paths themselves.  More than max_rows half paths
    at once raise GraphQueryError; by default there is no such bound.
    """
    options = options or PathOptions()
    require_text(from_id, "from id"), require_text(to_id, "to id")
    if from_id == to_id or options.max_depth <= 0:
        return _no_path(graph)
    keep, out = Scratch(), _no_path(graph).drop("length")
    for near, far, n in _halves(graph, keep, (from_id, to_id), options, _EDGES):
        far = far.select("m", F.slice("vertex_ids", F.lit(1), F.lit(n // 2)).alias("rest"), F.col("edge_ids").alias("rest_ids"))
        whole = near.join(far, "m").where(~F.arrays_overlap("vertex_ids", "rest"))
        out = out.union(whole.select(F.concat("vertex_ids", F.reverse("rest")), F.concat("edge_ids", F.reverse("rest_ids"))))
    return keep.result(out, "paths").select("vertex_ids", "edge_ids", F.size("edge_ids").alias("length"))


def _by_parts(half: DataFrame, edges: int, most: int) -> DataFrame:
    """(m, part, times): how many halves of so many edges end in m and hold all vertices of ``part`` in between; for parts of up to ``most`` vertices."""
    inner = F.sort_array(F.slice("vertex_ids", F.lit(2), F.lit(max(edges - 1, 0))))
    none = F.array(F.array().cast("array<string>"))
    parts = F.aggregate(inner, none, lambda acc, v: F.concat(acc, F.transform(F.filter(acc, lambda p: F.size(p) < most), lambda p: F.concat(p, F.array(v)))))
    return half.select("m", F.explode(parts).alias("part"), "times").groupBy("m", "part").agg(F.sum("times").cast("decimal(38,0)").alias("times"))


def count_paths(graph: Graph, from_id: str, to_id: str, options: PathOptions | None = None) -> DataFrame:
    """(length, paths): how many rows :func:`all_paths` has of each length, without making them; lengths without a path have no row.

    Half paths are counted by the vertex where they end and by every set of vertices that they hold in between.  Pairs of halves
    that share no vertex are then counted by inclusion and exclusion: all pairs that meet, less those that hold one vertex both, and so
    on.  So the work grows with the half paths, not with the paths.
    """
    options = options or PathOptions()
    require_text(from_id, "from id"), require_text(to_id, "to id")
    out = graph.spark.createDataFrame([], "length int, paths long")
    if from_id == to_id or options.max_depth <= 0:
        return out
    keep = Scratch()
    for near, far, n in _halves(graph, keep, (from_id, to_id), options, _TIMES):
        most = max(n // 2 - 1, 0)
        pairs = _by_parts(near, n - n // 2, most).join(_by_parts(far, n // 2, most).withColumnRenamed("times", "others"), ["m", "part"])
        sign = F.when(F.size("part") % 2 == 0, 1).otherwise(-1)
        count = F.sum(sign * (F.col("times") * F.col("others")).cast("decimal(38,0)")).cast("long").alias("paths")
        out = out.union(pairs.agg(count).where("paths > 0").select(F.lit(n).alias("length"), "paths"))
    return keep.result(out, "counts")
