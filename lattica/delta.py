"""Single mutations of a graph, kept beside it and merged when it is read.

A log has the rows that were added and tombstones of those that are gone.  A
read joins the graph to both, whose plan is the same however many mutations there
were; a log with too many entries is folded into new tables in the shared folder.
Looking something up in the log, and adding to it, takes no Spark job.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, functions as F

from lattica.errors import GraphQueryError, require
from lattica.graph import Graph, to_json
from lattica.model import Edge, Vertex
from lattica.plans.storage import discard

#: Entries of a log before it is folded into the graph; ids of the graph that are remembered to be there.
LOG_ROWS, KNOWN_IDS = 10_000, 100_000


class DeltaLog:
    def __init__(self, base: Graph):
        self.base, self.known = base, set()
        self._folded: list[Graph] = []
        self._clear()

    def _clear(self) -> None:
        self.vertices: dict[str, tuple[str, dict]] = {}
        self.edges: dict[tuple[str, str], tuple[str, str, dict]] = {}
        #: Ids of the base's vertices that are another row now, of those that are gone with their edges; (label, id) of its edges that are gone.
        self.replaced: set[str] = set()
        self.detached: set[str] = set()
        self.dead: set[tuple[str, str]] = set()
        self._merged: Graph | None = self.base

    def __len__(self) -> int:
        return sum(map(len, (self.vertices, self.edges, self.replaced, self.detached, self.dead)))

    def graph(self) -> Graph:
        """The base with the log's changes."""
        if self._merged is None:
            v, e = self.base.vertices, self.base.edges
            v = self._without(v, "id", [(i,) for i in self.replaced | self.detached])
            for end in ("src", "dst"):
                e = self._without(e, end, [(i,) for i in self.detached])
            e = self._without(e, "label, id", self.dead)
            rows = self.base._rows
            if self.vertices:
                v = v.unionByName(rows("vertices", [(i, label, p) for i, (label, p) in self.vertices.items()]), allowMissingColumns=True)
            if self.edges:
                e = e.unionByName(rows("edges", [(i, label, a, b, p) for (label, i), (a, b, p) in self.edges.items()]), allowMissingColumns=True)
            self._merged = Graph(v, e)
        return self._merged

    def _without(self, frame: DataFrame, columns: str, keys: Iterable[tuple]) -> DataFrame:
        keys = sorted(keys)
        if not keys:
            return frame
        names = columns.split(", ")
        gone = frame.sparkSession.createDataFrame(keys, ", ".join(f"{c} string" for c in names))
        return frame.join(F.broadcast(gone), names, "left_anti").select(*frame.columns)

    def _changed(self) -> None:
        self._merged = None
        if len(self) >= LOG_ROWS:
            self.fold()

    def fold(self) -> None:
        """Write the graph as it is now to new tables, and begin an empty log; snapshots that were handed out stay readable."""
        self.base = self.graph().stored()
        self._folded.append(self.base)
        self._clear()

    def close(self) -> None:
        """Delete the tables of earlier folds."""
        for graph in self._folded[:-1]:
            discard(graph.vertices, graph.edges)
        del self._folded[:-1]

    def plain(self, which: str, properties: Mapping[str, Any] | None) -> dict:
        """Properties as reading them back gives them."""
        frame = self.base.vertices if which == "vertices" else self.base.edges
        own = {k: v for k, v in (properties or {}).items() if v is not None}
        if "properties" in frame.columns or not own:
            return json.loads(to_json(own))
        require(set(own) <= set(frame.columns), f"no such property column: {sorted(set(own) - set(frame.columns))}")
        return own

    # vertices -----------------------------------------------------------------------------------------------------

    def create_vertex(self, vertex: Vertex) -> None:
        self.vertices[vertex.id] = (vertex.label, self.plain("vertices", vertex.properties))
        self._changed()

    def find_vertex(self, label: str, vertex_id: str) -> Vertex | None:
        if vertex_id in self.vertices:
            own, properties = self.vertices[vertex_id]
            return Vertex(vertex_id, own, dict(properties)) if own == label else None
        if vertex_id in self.detached:
            return None
        return next(iter(Graph.vertices_of(self.base.find_vertex_by_id(label, vertex_id))), None)

    def update_vertex(self, label: str, vertex_id: str, changes: Mapping[str, Any]) -> Vertex | None:
        own = self.find_vertex(label, vertex_id)
        if own is None or not changes:
            return own
        merged = {k: v for k, v in own.properties.items() if k not in changes} | self.plain("vertices", changes)
        if vertex_id not in self.vertices:
            self.replaced.add(vertex_id)
        self.vertices[vertex_id] = (label, merged)
        self._changed()
        return self.find_vertex(label, vertex_id)

    def delete_vertex(self, label: str, vertex_id: str) -> bool:
        if self.find_vertex(label, vertex_id) is None:
            return False
        self.vertices.pop(vertex_id, None)
        self.edges = {k: e for k, e in self.edges.items() if vertex_id not in e[:2]}
        self.detached.add(vertex_id)
        self.replaced.discard(vertex_id)
        self.known.discard(vertex_id)
        self._changed()
        return True

    # edges --------------------------------------------------------------------------------------------------------

    def create_edge(self, edge: Edge) -> None:
        unsure = {edge.src, edge.dst} - self.vertices.keys() - self.known
        asked = unsure - self.detached
        found = {r["id"] for r in self.base.vertices.where(F.col("id").isin(*asked)).select("id").collect()} if asked else set()
        if unsure - found:
            raise GraphQueryError(f"edge {edge.src}->{edge.dst}: no such vertex: {', '.join(sorted(unsure - found))}")
        if len(self.known) + len(found) > KNOWN_IDS:
            self.known.clear()
        self.known |= found
        self.edges[edge.label, edge.id] = (edge.src, edge.dst, self.plain("edges", edge.properties))
        self._changed()

    def delete_edge(self, label: str, edge_id: str) -> bool:
        if self.edges.pop((label, edge_id), None) is None:
            own = self.base.edges.where((F.col("label") == label) & (F.col("id") == edge_id)).select("src", "dst").collect()
            if (label, edge_id) in self.dead or all(r["src"] in self.detached or r["dst"] in self.detached for r in own):
                return False
            self.dead.add((label, edge_id))
        self._changed()
        return True
