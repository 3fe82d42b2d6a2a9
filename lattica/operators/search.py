"""Breadth-first traversal with a defined order of visits.

Edges of a vertex are taken in ascending edge id, numbers by value first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lattica.errors import require_text
from lattica.graph import Graph
from lattica.options import UNBOUNDED, BfsDfsOptions
from lattica.plans.numbering import numbered
from lattica.plans.storage import Scratch

#: Rows up to which a level that max_vertices cuts is numbered by one task.
FEW = 100_000

VISIT_DDL = "visit_order long, vertex_id string, depth int, parent_id string"


def edge_order(column: str = "edge_id"):
    return F.struct(F.coalesce(F.expr(f"try_cast({column} as bigint)"), F.lit(2**63 - 1)).alias("n"), F.col(column).alias("s"))


def bfs(graph: Graph, start_id: str, options: BfsDfsOptions | None = None) -> DataFrame:
    """(visit_order, vertex_id, depth, parent_id) in level order; the parent is the first to find a vertex in queue order.

    The start is visited even if the graph lacks it.  At most max_vertices
    rows: each level is cut by a distributed top-k before it is numbered.  A
    level that may have more than FEW rows is numbered by ranges, so no task sees all of it.
    """
    options = options or BfsDfsOptions()
    require_text(start_id, "start id")
    keep = Scratch()
    steps = graph.steps(keep, options.direction, options.edge_label)
    seen = frontier = graph.spark.createDataFrame([(0, start_id, 0, None)], VISIT_DDL)
    n = 1
    for depth in range(1, options.max_depth + 1):
        if n >= options.max_vertices:
            break
        ahead = steps.join(frontier.select(F.col("vertex_id").alias("a"), F.col("visit_order").alias("p")), "a")
        ahead = ahead.join(seen.select(F.col("vertex_id").alias("b")), "b", "left_anti")
        found = ahead.groupBy("b").agg(F.min(F.struct("p", edge_order().alias("e"), "a")).alias("m"))
        if options.max_vertices - n > FEW:
            found = found if options.max_vertices >= UNBOUNDED else found.orderBy("m.p", "m.e").limit(options.max_vertices - n)
            level = numbered(found, [F.col("m.p"), F.col("m.e")], "visit_order", n)
        else:
            level = found.orderBy("m.p", "m.e").limit(options.max_vertices - n)
            level = level.withColumn("visit_order", F.row_number().over(Window.orderBy("m.p", "m.e")).cast("long") + (n - 1))
        level = level.select("visit_order", F.col("b").alias("vertex_id"), F.lit(depth).alias("depth"), F.col("m.a").alias("parent_id"))
        frontier, facts = keep.stored_seeing(level, "frontier", n=F.count("*"))
        if not facts["n"]:
            break
        n += facts["n"]
        seen = seen.union(frontier)
    keep.discard(steps)
    return seen
