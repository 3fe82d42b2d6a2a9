"""Accessors of path columns (vertex_ids and edge_ids arrays)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def path_length(edge_ids: Column | str = "edge_ids") -> Column:
    return F.size(edge_ids)


def path_is_empty(vertex_ids: Column | str = "vertex_ids") -> Column:
    return F.size(vertex_ids) == 0


def path_text(vertex_ids: Column | str = "vertex_ids") -> Column:
    return F.array_join(vertex_ids, ">")


def path_steps(vertex_ids: str = "vertex_ids", edge_ids: str = "edge_ids") -> Column:
    """Array of struct(kind, id), vertices and edges in turn."""
    step = lambda kind, i: F.struct(F.lit(kind).alias("kind"), i.alias("id"))
    pairs = F.transform(F.col(vertex_ids), lambda v, i: F.when(i < F.size(edge_ids), F.array(step("vertex", v), step("edge", F.get(F.col(edge_ids), i)))).otherwise(F.array(step("vertex", v))))
    return F.flatten(pairs)
