"""Degrees of one vertex and of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattica.errors import require_text
from lattica.graph import Graph
from lattica.model import Direction
from lattica.options import DegreeOptions


def _ways(direction: Direction) -> tuple[int, int]:
    return int(direction is not Direction.OUTGOING), int(direction is not Direction.INCOMING)


def degree_centrality(graph: Graph, vertex_id: str, options: DegreeOptions | None = None) -> DataFrame:
    """One row: vertex_id, in_degree, out_degree, total; zeros for an unknown vertex and for the direction not asked for.  A self-loop counts once each way."""
    options = options or DegreeOptions()
    require_text(vertex_id, "vertex id")
    edges = graph.edges if options.edge_label is None else graph.edges.where(F.col("label") == options.edge_label)
    into, out = _ways(options.direction)
    touching = edges.where((F.col("src") == vertex_id) | (F.col("dst") == vertex_id))
    counts = touching.agg((F.count_if(F.col("dst") == vertex_id) * into).cast("int").alias("in_degree"), (F.count_if(F.col("src") == vertex_id) * out).cast("int").alias("out_degree"))
    return counts.select(F.lit(vertex_id).alias("vertex_id"), "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total"))


def degrees(graph: Graph, options: DegreeOptions | None = None) -> DataFrame:
    """The same for every vertex of the graph, in one aggregation of both ends of each edge."""
    options = options or DegreeOptions()
    edges = graph.edges if options.edge_label is None else graph.edges.where(F.col("label") == options.edge_label)
    into, out = _ways(options.direction)
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(into).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(out).alias("o")))).alias("e"))
    counts = ends.groupBy("e.id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    joined = graph.vertices.select("id").join(counts, "id", "left")
    return joined.select(F.col("id").alias("vertex_id"), zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("total"))
