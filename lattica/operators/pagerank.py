"""PageRank by iterated join and aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lattica.graph import Graph
from lattica.options import UNBOUNDED, PageRankOptions
from lattica.plans.numbering import numbered
from lattica.plans.storage import Scratch

#: Edges of one source in one partition; a source with more is a hub, whose edges are spread over several.
HUB = 1_000_000
#: Edges of one partition that is kept on the executors: a small graph isn't dealt to as many tasks as a large one in every round.
SPREAD = 500_000


def page_rank(graph: Graph, options: PageRankOptions | None = None) -> DataFrame:
    """(vertex_id, score, rank) by descending score, ties by id.

    Edges count if both ends pass the label filters, parallel ones each.  A
    vertex without out-edges gives its rank to all.  Iteration ends when the
    ranks' total change is below the tolerance (the new ranks count), or after
    ``iterations``.  ``rank`` counts from 1; without a top_k it is numbered by ranges,
    so that no task has to hold all vertices.  With ``tie_digits`` scores that
    agree when rounded to so many decimals are ties: the last bits depend on the order in which shares are added.
    """
    options = options or PageRankOptions()
    d = options.damping_factor
    keep = Scratch()
    nodes, links, n = graph.by_number(keep, options.vertex_label, options.edge_label)
    if not n:
        return graph.spark.createDataFrame([], "vertex_id string, score double, rank long")
    edges, seen = keep.stored_seeing(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "edges", n=F.count("*"))
    parts = max(graph.spark.sparkContext.defaultParallelism, -(-seen["n"] // SPREAD))
    out_degree = edges.groupBy(F.col("src").alias("n")).agg(F.count("*").alias("degree"))
    # a vertex that is there more than once counts as often
    ranks = nodes.select("n", "times").join(out_degree, "n", "left").select("n", "times", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(1.0 / n).alias("r"))
    ranks, facts = keep.stored_seeing(ranks, "ranks", free=F.sum(F.when(F.col("degree") == 0, F.col("times")).otherwise(0)), most=F.max("degree"))
    dangling, salts = facts["free"] / n, F.ceil(F.col("degree") / HUB).cast("int")
    # kept by source on the executors: each round moves ranks to the edges, not edges.  A hub's are dealt to
    # as many partitions as they need; hubs are at most edges / HUB, so their table may be broadcast
    salt = F.lit(0)
    if facts["most"] > HUB:
        hubs = F.broadcast(ranks.where(F.col("degree") > HUB).select(F.col("n").alias("src"), salts.alias("salts")))
        edges, salt = edges.join(hubs, "src", "left"), F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")
    edges = edges.select("src", "dst", salt.alias("salt")).repartition(parts, "src", "salt").persist()
    for _ in range(options.iterations):
        shares = ranks.where("degree > 0").select(F.col("n").alias("src"), (d * F.col("r") * F.col("times") / F.col("degree")).alias("share"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        got = edges.join(shares, ["src", "salt"]).groupBy(F.col("dst").alias("n")).agg(F.sum("share").alias("got"))
        base = (1 - d) / n + d * dangling / n
        new = ranks.join(got, "n", "left").select("n", "times", "degree", F.col("r").alias("old"), (F.lit(base) + F.coalesce("got", F.lit(0.0))).alias("r"))
        # the round's change and the next round's dangling rank are taken while the ranks are written
        change, free = F.abs(F.col("r") - F.col("old")) * F.col("times"), F.when(F.col("degree") == 0, F.col("r") * F.col("times")).otherwise(0.0)
        fresh, facts = keep.stored_seeing(new.select("n", "times", "degree", "r", "old"), "ranks", delta=F.sum(change), dangling=F.sum(free))
        keep.discard(ranks)
        ranks, dangling = fresh, facts["dangling"]
        if facts["delta"] < options.tolerance:
            break
    edges.unpersist()
    every = F.explode(F.array_repeat("id", F.col("times").cast("int"))).alias("vertex_id")
    out = ranks.select("n", F.col("r").alias("score")).join(nodes, "n").select(every, "score")
    order = [F.desc("score" if options.tie_digits is None else F.round("score", options.tie_digits)), F.asc("vertex_id")]
    if options.top_k < UNBOUNDED:
        out = out.orderBy(*order).limit(options.top_k)
        return keep.result(out.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")), "ranked").orderBy("rank")
    ranked = numbered(out, order, "rank")
    keep.discard()
    return ranked
