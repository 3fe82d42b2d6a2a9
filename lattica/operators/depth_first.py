"""Depth-first traversal: vertices in pre-order, the first edge first.

The order is found in the way that what lies within reach allows:

* **A shallow tree.**  A breadth-first search ends after a few levels and no step
  leads to a vertex twice: sorted by the path of edges that leads to them, vertices are in pre-order.
* **A deep forest.**  No vertex has two ways in (steps into the start don't count): an Euler tour, in which every vertex is entered and
  left once, is a linked list, and pointer doubling ranks it in as many rounds as its length's logarithm.
* **Anything else** is sequential by nature.  Up to GATHERED steps are walked in one task.  Beyond that the walk runs on the driver over pages of steps:
  vertices are numbered, steps lie in the order in which a vertex takes them, and each
  one knows where its end's own steps lie.  The driver holds one bit a vertex, one
  frame for each vertex on the current path, and some pages; visits are written in pieces.
"""

from __future__ import annotations

from array import array
from collections import OrderedDict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lattica.errors import require_text
from lattica.graph import Graph
from lattica.options import UNBOUNDED, BfsDfsOptions
from lattica.operators.search import VISIT_DDL, edge_order
from lattica.plans.numbering import numbered
from lattica.plans.storage import Scratch

#: Levels searched before a whole graph is looked at for a deep forest (SOME_LEVELS while no more than FEW steps were met), and before a search by levels is given up.
FEW_LEVELS, SOME_LEVELS, MANY_LEVELS, FEW = 8, 16, 64, 10_000
#: Steps that one task may walk; steps of a page; pages that are fetched at once and held; visits of a piece.
GATHERED, PAGE, PAGES_AT_ONCE, PAGES_HELD, PIECE = 5_000_000, 200_000, 8, 100, 1_000_000
#: Frames from the top of the stack, and steps of each, that are asked for the pages they need next.
_LOOK_BACK, _LOOK_ON = 64, 16


def dfs(graph: Graph, start_id: str, options: BfsDfsOptions | None = None) -> DataFrame:
    """(visit_order, vertex_id, depth, parent_id) in pre-order, the first edge first.

    The start is visited even if the graph lacks it.  A vertex is marked when it is visited, so with a depth limit some that
    breadth-first finds may be missed.  At most max_vertices rows.
    """
    require_text(start_id, "start id")
    options, keep = options or BfsDfsOptions(), Scratch()
    steps = _ahead(graph, keep, options)
    found = _Levels(keep, steps, start_id)
    found.search(options.max_depth, FEW_LEVELS)
    # what lies within reach may be little of a large graph: a level reads its steps once, a tour moves them round after round
    found.search(options.max_depth, SOME_LEVELS, FEW)
    if not found.closed and _one_way_in(steps, start_id):
        return keep.result(_deep_forest(keep, steps, start_id, options), "visits")
    found.search(options.max_depth, MANY_LEVELS)
    if found.closed and found.tree:
        return keep.result(found.in_order(options.max_vertices), "visits")
    if found.closed and found.n <= GATHERED:
        return keep.result(_walked(found.steps(), options), "visits").drop("start")
    return keep.result(_paged_walk(keep, steps, start_id, options), "visits")


def _ahead(graph: Graph, keep: Scratch, options: BfsDfsOptions) -> DataFrame:
    """(a, b, e, edge_id): the first step from each vertex to each end; of a vertex's ends no more than a walk can look at."""
    steps = graph.steps(keep, options.direction, options.edge_label)
    firsts = steps.groupBy("a", "b").agg(F.min(edge_order()).alias("e")).select("a", "b", F.struct("e.n", "e.s", "b").alias("e"), F.col("e.s").alias("edge_id"))
    if options.max_vertices < UNBOUNDED:
        # those visited already, and as many as visits are left
        place = F.row_number().over(Window.partitionBy("a").orderBy("e"))
        firsts = firsts.withColumn("place", place).where(F.col("place") <= 2 * options.max_vertices)
    return keep.stored(firsts.select("a", "b", "e", "edge_id"), "steps")


class _Levels:
    """A search by levels that sees whether what it meets is a tree, and as long as it is notes the path to each vertex."""

    def __init__(self, keep: Scratch, steps: DataFrame, start: str):
        self.keep, self.all, self.start = keep, steps, start
        path = F.array().cast("array<struct<n: bigint, s: string, b: string>>").alias("path")
        one = steps.sparkSession.range(1)
        self.levels = [one.select(F.lit(start).alias("vertex_id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_id"), path)]
        self.taken: list[DataFrame] = []
        self.n, self.closed, self.tree = 0, False, True

    def search(self, max_depth: int, levels: int, few: int | None = None) -> None:
        while not self.closed:
            depth = len(self.levels)
            if depth > max_depth:
                self.closed = True
            elif depth > levels or self.n > GATHERED and not self.tree or few is not None and self.n > few:
                return
            else:
                self._next(depth)

    def _next(self, depth: int) -> None:
        before = self.levels[-1].select(F.col("vertex_id").alias("a"), F.col("parent_id").alias("p"), "path")
        on = self.all.join(before, "a").select("a", "b", "e", "edge_id", "p", "path")
        # the way back to the parent or to the start is never taken
        useful = (F.col("b") != self.start) & ~F.col("b").eqNullSafe(F.col("p"))
        on, facts = self.keep.stored_seeing(on, "level", n=F.count("*"), useful=F.count_if(useful))
        self.taken.append(on)
        self.n += facts["n"]
        seen = reduce(DataFrame.union, [level.select(F.col("vertex_id").alias("b")) for level in self.levels])
        path = F.concat("path", F.array("e")) if self.tree else F.col("path")
        fresh = on.join(seen, "b", "left_anti").groupBy("b").agg(F.min(F.struct("e", "a", path.alias("path"))).alias("m"))
        fresh = fresh.select(F.col("b").alias("vertex_id"), F.lit(depth).alias("depth"), F.col("m.a").alias("parent_id"), F.col("m.path").alias("path"))
        fresh, found = self.keep.stored_seeing(fresh, "frontier", n=F.count("*"))
        self.tree = self.tree and facts["useful"] == found["n"]
        if found["n"]:
            self.levels.append(fresh)
        else:
            self.closed = True

    def in_order(self, most: int) -> DataFrame:
        """Visits of a tree."""
        every = reduce(DataFrame.union, self.levels)
        return numbered(every, [F.col("path")], "visit_order", 0, self.keep).where(F.col("visit_order") < most).select("visit_order", "vertex_id", "depth", "parent_id")

    def steps(self) -> DataFrame:
        """(start, a, b, e) of all steps within reach; one row for the start without b."""
        own = [on.select("a", "b", "e") for on in self.taken]
        alone = self.levels[0].select(F.col("vertex_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast(self.all.schema["e"].dataType).alias("e"))
        return reduce(DataFrame.union, [alone, *own]).select(F.lit(self.start).alias("start"), "a", "b", "e")


# a deep forest -------------------------------------------------------------------------------------------------------


def _one_way_in(steps: DataFrame, start: str) -> bool:
    return steps.where(F.col("b") != start).groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _deep_forest(keep: Scratch, steps: DataFrame, start: str, options: BfsDfsOptions) -> DataFrame:
    """Visits where each vertex but the start has one way in at most.

    Vertices get dense numbers r in the order (parent, edge), those without a parent first, so a vertex's next
    sibling is r + 1 if that one has the same parent.  The tour enters r at 2r and leaves it at 2r + 1.
    """
    children = steps.where(F.col("b") != start).select(F.col("b").alias("v"), F.col("a").alias("p"), "e")
    parents = children.select(F.col("p").alias("v")).union(steps.sparkSession.range(1).select(F.lit(start).alias("v"))).distinct()
    roots = parents.join(children.select("v"), "v", "left_anti").select("v", F.lit(None).cast("string").alias("p"), F.lit(None).cast(children.schema["e"].dataType).alias("e"))
    known = keep.stored(numbered(roots.union(children), [F.col("p").asc_nulls_first(), F.col("e"), F.col("v")], "r", 0, keep).select("r", "v", "p"), "numbered")
    first = known.where("p is not null").groupBy("p").agg(F.min("r").alias("first")).withColumnRenamed("p", "v")
    linked = known.join(first, "v", "left").join(known.select(F.col("v").alias("p"), F.col("r").alias("pr")), "p", "left")
    sibling = known.select((F.col("r") - 1).alias("r"), F.col("p").alias("next_p"), F.lit(True).alias("sibling")).where("next_p is not null")
    linked = linked.join(sibling, "r", "left").withColumn("sibling", F.coalesce(F.col("sibling") & (F.col("next_p") == F.col("p")), F.lit(False)))
    node = lambda at, next, enters, up: F.struct(at.alias("node"), next.alias("next"), F.lit(enters).cast("long").alias("enters"), up.cast("long").alias("up"))
    r, leave = F.col("r"), 2 * F.col("r") + 1
    enter = node(2 * r, F.coalesce(2 * F.col("first"), leave), 1, F.lit(1))
    after = F.when(F.col("sibling"), 2 * (r + 1)).otherwise(F.coalesce(2 * F.col("pr") + 1, leave))
    left = node(leave, after, 0, F.when(F.col("pr").isNull(), 0).otherwise(-1))
    end = 2 * known.where(F.col("v") == start).first()["r"] + 1
    reached = F.count_if(F.col("next") == end)
    tour, facts = keep.stored_seeing(linked.select(F.explode(F.array(enter, left)).alias("x")).select("x.*"), "tour", n=reached)
    while True:
        on = tour.select(F.col("node").alias("next"), F.col("next").alias("to"), F.col("enters").alias("more"), F.col("up").alias("higher"))
        longer = tour.join(on, "next").select("node", F.col("to").alias("next"), (F.col("enters") + F.col("more")).alias("enters"), (F.col("up") + F.col("higher")).alias("up"))
        fresh, now = keep.stored_seeing(longer, "tour", n=reached)
        keep.discard(tour)
        tour = fresh
        # distances to the end have no gap: without a new one there is none beyond
        if now["n"] == facts["n"]:
            break
        facts = now
    inside = tour.where((F.col("next") == end) & (F.col("node") % 2 == 0)).select(F.shiftright("node", 1).alias("r"), "enters", (1 - F.col("up")).cast("int").alias("depth"))
    inside, facts = keep.stored_seeing(inside, "ranked", n=F.count("*"), deepest=F.max("depth"))
    placed = inside.withColumn("visit_order", facts["n"] - F.col("enters"))
    if facts["deepest"] > options.max_depth:
        placed = numbered(placed.where(F.col("depth") <= options.max_depth).drop("visit_order"), [F.col("enters").desc()], "visit_order", 0, keep)
    out = placed.where(F.col("visit_order") < options.max_vertices).join(known, "r")
    return out.select("visit_order", F.col("v").alias("vertex_id"), "depth", F.col("p").alias("parent_id"))


# one task ------------------------------------------------------------------------------------------------------------


def _walk(max_depth: int, max_vertices: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["start"].iloc[0]
        ahead: dict[str, list[str]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            if b is not None:
                ahead.setdefault(a, []).append(b)
        seen, rows, stack = set(), [], [(start, 0, None)]
        while stack and len(rows) < max_vertices:
            vertex, depth, parent = stack.pop()
            if vertex in seen:
                continue
            seen.add(vertex)
            rows.append((start, len(rows), vertex, depth, parent))
            if depth < max_depth:
                stack += [(b, depth + 1, vertex) for b in reversed(ahead.get(vertex, [])) if b not in seen]
        return pd.DataFrame(rows, columns=["start", "visit_order", "vertex_id", "depth", "parent_id"])

    return run


def _walked(steps: DataFrame, options: BfsDfsOptions) -> DataFrame:
    ordered = steps.select("start", "a", "b", F.col("e.n").alias("n"), F.col("e.s").alias("s"))
    walk = _walk(options.max_depth, options.max_vertices)
    return ordered.groupBy("start").applyInPandas(lambda pdf: walk(pdf.sort_values(["n", "s", "b"], na_position="first")), f"start string, {VISIT_DDL}")


def dfs_many(graph: Graph, starts: DataFrame, options: BfsDfsOptions | None = None) -> DataFrame:
    """Depth-first from each of ``starts`` at once, each in a task of its own: (start, visit_order, vertex_id, depth, parent_id).

    What a walk can reach within max_depth is found by joins first; only those edges meet in its task.
    """
    options, keep = options or BfsDfsOptions(), Scratch()
    steps = _ahead(graph, keep, options)
    frontier = starts.select("start", F.col("start").alias("a")).distinct()
    taken = frontier.select("start", "a", F.lit(None).cast("string").alias("b"), F.lit(None).cast(steps.schema["e"].dataType).alias("e"))
    seen = frontier
    for _ in range(options.max_depth):
        level, facts = keep.stored_seeing(steps.join(frontier, "a").select("start", "a", "b", "e"), "level", n=F.count("*"))
        if not facts["n"]:
            break
        taken = taken.union(level)
        fresh = level.select("start", F.col("b").alias("a")).distinct().join(seen, ["start", "a"], "left_anti")
        frontier = keep.stored(fresh, "frontier")
        seen = seen.union(frontier)
    return keep.result(_walked(taken, options), "visits")


# pages ---------------------------------------------------------------------------------------------------------------


class _Pages:
    """Steps in order of place, PAGE to a page: (end, first place of the end's own steps, place behind its last) of each."""

    def __init__(self, steps: DataFrame):
        self.steps, self.held, self.fetches = steps, OrderedDict(), 0

    def __contains__(self, page: int) -> bool:
        return page in self.held

    def fetch(self, wanted: list[int]) -> None:
        self.fetches += 1
        pages = F.floor(F.col("place") / PAGE)
        ranges = reduce(lambda a, b: a | b, [F.col("place").between(p * PAGE, (p + 1) * PAGE - 1) for p in wanted])
        got = self.steps.where(ranges).select(pages.alias("page"), "place", "b", "low", "high").toPandas().sort_values("place")
        for page, own in got.groupby("page"):
            self.held[int(page)] = tuple(array("q", own[c].to_numpy(np.int64).tobytes()) for c in ("b", "low", "high"))
        while len(self.held) > PAGES_HELD:
            self.held.popitem(last=False)

    def page(self, page: int) -> tuple[array, array, array]:
        self.held.move_to_end(page)
        return self.held[page]


def _paged_walk(keep: Scratch, steps: DataFrame, start: str, options: BfsDfsOptions) -> DataFrame:
    spark = steps.sparkSession
    alone = spark.range(1).select(F.lit(start).alias("v"))
    ids = steps.select(F.explode(F.array("a", "b")).alias("v")).union(alone).distinct()
    ids, facts = keep.stored_seeing(numbered(ids, [F.col("v")], "n", 0, keep), "numbered", n=F.count("*"))
    of = lambda c: ids.select(F.col("v").alias(c), F.col("n").alias(f"{c}n"))
    placed = keep.stored(numbered(steps.join(of("a"), "a").join(of("b"), "b").select("an", "bn", "e"), [F.col("an"), F.col("e")], "place", 0, keep).select("place", "an", "bn"), "placed")
    own = placed.groupBy("an").agg(F.min("place").alias("low"), (F.max("place") + 1).alias("high"))
    none = F.lit(0).cast("long")
    linked = placed.drop("an").join(own.withColumnRenamed("an", "bn"), "bn", "left").select("place", F.col("bn").alias("b"), F.coalesce("low", none).alias("low"), F.coalesce("high", none).alias("high"))
    parts = max(1, -(-placed.count() // PAGE))
    pages = _Pages(keep.stored(linked.repartitionByRange(min(parts, 10_000), "place").sortWithinPartitions("place"), "pages"))
    first = ids.where(F.col("v") == start).first()["n"]
    mine = own.where(F.col("an") == first).first()
    pieces: list[DataFrame] = []
    for visits in _visits(pages, facts["n"], first, (mine["low"], mine["high"]) if mine else (0, 0), options):
        rows = spark.createDataFrame(pd.DataFrame(visits, columns=["visit_order", "n", "depth", "pn"]), "visit_order long, n long, depth int, pn long")
        pieces.append(keep.stored(rows, "piece"))
    out = reduce(DataFrame.union, pieces).join(ids.withColumnRenamed("v", "vertex_id"), "n").join(ids.select(F.col("v").alias("parent_id"), F.col("n").alias("pn")), "pn", "left")
    return out.select("visit_order", "vertex_id", "depth", "parent_id")


def _visits(pages: _Pages, n: int, first: int, own: tuple[int, int], options: BfsDfsOptions):
    """Visits (order, vertex, depth, parent; -1 for none) in lists of PIECE."""
    seen = bytearray(n // 8 + 1)
    vertices, places, ends = array("q", [first]), array("q", [own[0]]), array("q", [own[1] if options.max_depth else own[0]])
    seen[first >> 3] |= 1 << (first & 7)
    out, order = [(0, first, 0, -1)], 1
    while vertices and order < options.max_vertices:
        place = places[-1]
        if place >= ends[-1]:
            vertices.pop(), places.pop(), ends.pop()
            continue
        page, at = divmod(place, PAGE)
        if page not in pages:
            pages.fetch(_wanted(pages, seen, places, ends))
        b, low, high = pages.page(page)
        last = min(ends[-1] - page * PAGE, PAGE)
        while at < last and seen[b[at] >> 3] >> (b[at] & 7) & 1:
            at += 1
        if at == last:
            places[-1] = page * PAGE + at
            continue
        places[-1] = page * PAGE + at + 1
        v = b[at]
        seen[v >> 3] |= 1 << (v & 7)
        depth = len(vertices)
        out.append((order, v, depth, vertices[-1]))
        order += 1
        vertices.append(v), places.append(low[at]), ends.append(high[at] if depth < options.max_depth else low[at])
        if len(out) == PIECE:
            yield out
            out = []
    if out:
        yield out


def _wanted(pages: _Pages, seen: bytearray, places: array, ends: array) -> list[int]:
    """The page that the top of the stack needs, and those that it and the frames below will need next."""
    wanted = {places[-1] // PAGE: None}
    for i in range(len(places) - 1, max(-1, len(places) - 1 - _LOOK_BACK), -1):
        if places[i] >= ends[i]:
            continue
        page, at = divmod(places[i], PAGE)
        if page not in pages:
            wanted[page] = None
        else:
            b, low, high = pages.held[page]
            for j in range(at, min(at + _LOOK_ON, ends[i] - page * PAGE, len(b))):
                v, ahead = b[j], low[j] // PAGE
                if not seen[v >> 3] >> (v & 7) & 1 and low[j] < high[j] and ahead not in pages:
                    wanted[ahead] = None
        if len(wanted) >= PAGES_AT_ONCE:
            break
    return list(wanted)[:PAGES_AT_ONCE]
