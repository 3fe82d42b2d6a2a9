"""Weakly and strongly connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lattica.graph import Graph
from lattica.options import ComponentOptions
from lattica.plans.components import contract
from lattica.plans.storage import Scratch


def connected_components(graph: Graph, options: ComponentOptions | None = None) -> DataFrame:
    """(component_id, vertex_id, size): component_id is the smallest id of the component; those below min_size are left out.

    Isolated vertices are components of their own.  With weakly=False two
    vertices are together if each can be reached from the other.
    """
    options = options or ComponentOptions()
    if options.weakly:
        return _weak(graph, options)
    ids, edges = graph.restricted(options.vertex_label, options.edge_label)
    roots = strong_roots(ids, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    out = ids.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(F.coalesce("root", "id").alias("component_id"), F.col("id").alias("vertex_id"))
    sizes = out.groupBy("component_id").agg(F.count("*").alias("size")).where(F.col("size") >= options.min_size)
    return out.join(sizes, "component_id")


def _weak(graph: Graph, options: ComponentOptions) -> DataFrame:
    nodes, links, _ = graph.by_number(Scratch(), options.vertex_label, options.edge_label)
    roots = contract(links)
    out = nodes.where("id is not null").join(roots.select(F.col("node").alias("n"), "root"), "n", "left").select(F.coalesce("root", "n").alias("root"), F.col("id").alias("vertex_id"), "times")
    sizes = out.groupBy("root").agg(F.min("vertex_id").alias("component_id"), F.sum("times").alias("size")).where(F.col("size") >= options.min_size)
    every = F.explode(F.array_repeat("vertex_id", F.col("times").cast("int"))).alias("vertex_id")
    return out.join(sizes, "root").select("component_id", every, "size")


def _least_reaching(keep: Scratch, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest id that reaches each node along ``pairs``.

    A round goes one step along the pairs, and then from each root to the root that
    it had itself: what reaches the root reaches the node.  So rounds grow with the logarithm of a chain's length.
    """
    table, _ = keep.stored_seeing(nodes.select("node", F.col("node").alias("root")), "labels", n=F.count("*"))
    labels = table
    while True:
        sent = pairs.join(labels.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("got"))
        near = labels.join(sent, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "got").alias("root"))
        far = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = near.join(far, "root").select("node", "old", F.least("root", "far").alias("root"))
        fresh, facts = keep.stored_seeing(jumped, "labels", n=F.count("*"), changed=F.count_if(F.col("root") != F.col("old")))
        keep.discard(table)
        table, labels = fresh, fresh.select("node", "root")
        if not facts["changed"]:
            return labels


def _trimmed(keep: Scratch, left: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with a pair into them and one out of them, pairs among these, how many nodes), again and again while many go."""
    n = None
    while True:
        for end, other in (("a", "b"), ("b", "a")):
            left = left.join(pairs.select(F.col(end).alias("node")), "node", "left_semi")
        left, facts = keep.stored_seeing(left, "left", n=F.count("*"))
        for end in ("a", "b"):
            pairs = pairs.join(left.withColumnRenamed("node", end), end, "left_semi")
        pairs, _ = keep.stored_seeing(pairs.select("a", "b"), "pairs", n=F.count("*"))
        if not facts["n"] or n is not None and facts["n"] > 0.9 * n:
            return left, pairs, facts["n"]
        n = facts["n"]


def strong_roots(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) of strong components of two nodes and more; all others are left out.

    Nodes that no cycle can hold go first.  Then every node gets the smallest
    id that reaches it; those of a colour that reach that id are its component.  The rest is
    done again.
    """
    keep, done = Scratch(), []
    left, pairs, n = _trimmed(keep, ids.select(F.col("id").alias("node")), keep.stored_seeing(pairs.where("a <> b").distinct(), "pairs", n=F.count("*"))[0])
    while n:
        colors = _least_reaching(keep, left, pairs).withColumnRenamed("root", "color")
        own = pairs.join(colors.select(F.col("node").alias("a"), F.col("color").alias("ca")), "a").join(colors.select(F.col("node").alias("b"), F.col("color").alias("cb")), "b")
        back, _ = keep.stored_seeing(own.where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b")), "back", n=F.count("*"))
        # within a colour no id is smaller than the colour's own
        reach = _least_reaching(keep, left, back).join(colors, "node").where("root = color").select("node", "root")
        done.append(keep.stored_seeing(reach, "strong", n=F.count("*"))[0])
        left = left.join(done[-1], "node", "left_anti")
        for end in ("a", "b"):
            pairs = pairs.join(left.withColumnRenamed("node", end), end, "left_semi")
        left, pairs, n = _trimmed(keep, *(keep.stored_seeing(t, name, n=F.count("*"))[0] for t, name in ((left, "left"), (pairs.select("a", "b"), "pairs"))))
    found = reduce(DataFrame.union, done) if done else ids.where("false").select(F.col("id").alias("node"), F.col("id").alias("root"))
    return keep.result(found, "strong")
