"""Connected components by contraction to stars.

Each round every vertex goes over to the one of least hash among itself and its
neighbours, under a hash of the round's own, and edges between vertices that went to the same one are gone.
A quarter of the vertices at least is expected to go in a round, most in a dense graph, so the rounds together
move some multiple of the input, not the input once a round.  Then roots are handed back round by round.
The only grouped quantity is a minimum over numbers, which Spark combines before the shuffle, so a hub with
very many neighbours is never gathered into one task.  A set of edges that is
counted to be small is left to one task with union-find instead: there the
rounds would only be waiting.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.plans.storage import Scratch, discard


#: Edges that one task may contract: some megabytes.
SMALL = 50_000


def _union_find(batches):
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            root.setdefault(a, a), root.setdefault(b, b)
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def contract(pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every number of ``pairs(a, b)``; root is some member of the component, the same for all.

    Self loops and null ends are ignored; isolated vertices don't appear.
    """
    keep, rounds = Scratch(), []
    edges, facts = keep.stored_seeing(pairs.where("a <> b").select("a", "b"), "cc", n=F.count("*"))
    while facts["n"] > SMALL:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        hashed = lambda c: F.xxhash64(F.lit(len(rounds)), F.col(c))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("h", hashed("b"))
        # of equal hashes any may be taken: it is a neighbour all the same
        least = both.groupBy("a").agg(F.min("h").alias("h"), F.min_by("b", "h").alias("b"))
        moved = keep.stored(least.select(F.col("a").alias("node"), F.when(F.col("h") < hashed("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "moved")
        rounds.append(moved)
        left = edges
        for end in ("a", "b"):
            left = left.join(moved.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")), end)
        left = left.where("to_a <> to_b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct()
        fresh, facts = keep.stored_seeing(left, "cc", n=F.count("*"))
        keep.discard(edges)
        edges = fresh
    roots = edges.coalesce(1).mapInArrow(_union_find, "node bigint, root bigint")
    for moved in reversed(rounds):
        roots = moved.join(roots.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return keep.result(roots, "roots")


def star_contract(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every vertex of ``edges(a, b)``; root is the smallest id of the component.

    Self loops and null ends are ignored; isolated vertices don't appear.
    """
    keep = Scratch()
    edges, facts = keep.stored_seeing(edges.where("a <> b").select("a", "b"), "pairs", n=F.count("*"))
    if facts["n"] <= SMALL:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_union_find, f"node {kind}, root {kind}")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    nodes = keep.stored(ends.select("node", F.monotonically_increasing_id().alias("n")), "nodes")
    pairs = edges
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), end)
    roots = contract(pairs.select(F.col("n_a").alias("a"), F.col("n_b").alias("b")), max_rounds)
    of = nodes.join(roots.select(F.col("node").alias("n"), F.col("root").alias("at")), "n").select("node", "at")
    out = keep.result(of.join(of.groupBy("at").agg(F.min("node").alias("root")), "at").select("node", "root"), "roots")
    discard(roots)
    return out
