"""Named graphs, and a session that applies mutations to one of them.

With a root folder a graph is a pair of Parquet tables
below ``<root>/<name>/<version>``; a version is complete once its marker
file exists, so readers never see half a graph.  Without a root graphs live in memory.
"""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from lattica.delta import DeltaLog
from lattica.errors import GraphAlreadyExistsError, GraphNotFoundError, require_text
from lattica.graph import Graph
from lattica.model import Component, Cycle, DegreeResult, Edge, PageRankScore, Path, TraversalVisit, Vertex
from lattica.options import EngineConfig


def _laid_out(frame: DataFrame, by: list[str], looked_up: list[str]) -> DataFrameWriter:
    """A writer of sorted ranges with bloom filters: a look-up by label and id, or of a vertex's edges, reads few row groups."""
    writer = frame.repartitionByRange(*by).sortWithinPartitions(*by).write
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


class GraphCatalog:
    def __init__(self, spark: SparkSession, config: EngineConfig = EngineConfig()):
        self.spark, self.root = spark, config.root and config.root.rstrip("/")
        self._graphs: dict[str, Graph] = {}

    def create_graph(self, name: str, exist_ok: bool = True) -> Graph:
        require_text(name, "name")
        if self.graph_exists(name):
            if not exist_ok:
                raise GraphAlreadyExistsError(f"graph {name} exists")
            return self.graph(name)
        return self.save(name, Graph.empty(self.spark))

    def drop_graph(self, name: str) -> None:
        require_text(name, "name")
        graph = self._graphs.pop(name, None)
        if graph is not None:
            graph.vertices.unpersist(), graph.edges.unpersist()
        if self.root:
            fs, path = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)

    def graph_exists(self, name: str) -> bool:
        require_text(name, "name")
        return name in self._graphs or bool(self.root) and self._version(name) is not None

    def graph(self, name: str) -> Graph:
        if not self.graph_exists(name):
            raise GraphNotFoundError(f"no graph {name}")
        if name not in self._graphs:
            at = f"{self.root}/{name}/{self._version(name)}"
            self._graphs[name] = Graph(self.spark.read.parquet(f"{at}/vertices"), self.spark.read.parquet(f"{at}/edges"), at_rest=True)
        return self._graphs[name]

    def save(self, name: str, graph: Graph) -> Graph:
        """Make ``graph`` the current one under that name."""
        if not self.root:
            self._graphs[name] = graph
            return graph
        old = self._version(name)
        version = f"v{int(old[1:].split('-')[0]) + 1 if old else 1:06d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/{name}/{version}"
        _laid_out(graph.vertices, ["label", "id"], ["id"]).parquet(f"{at}/vertices")
        _laid_out(graph.edges, ["label", "src", "id"], ["id", "dst"]).parquet(f"{at}/edges")
        fs, path = self._fs(f"{at}/complete")
        fs.create(path, True).close()
        self._graphs.pop(name, None)
        return self.graph(name)

    def names(self) -> list[str]:
        """Names of all graphs, sorted."""
        found = set(self._graphs)
        if self.root:
            fs, path = self._fs(self.root)
            found |= {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
        return sorted(n for n in found if self.graph_exists(n))

    def health(self) -> dict[str, Any]:
        """A probe: ``status`` is UP if the session can run a job and the folder can be read, else DOWN with the ``error``."""
        try:
            self.spark.range(1).count()
            return {"status": "UP", "root": self.root, "graphs": len(self.names())}
        except Exception as e:  # whatever the cluster or the store says
            return {"status": "DOWN", "root": self.root, "error": str(e)}

    def close(self) -> None:
        """Forget frames; the session that was handed in stays open."""
        for graph in self._graphs.values():
            graph.vertices.unpersist(), graph.edges.unpersist()
        if self.root:
            self._graphs.clear()

    def _fs(self, path: str):
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm_path

    def _version(self, name: str) -> str | None:
        fs, path = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return next((n for n in reversed(names) if fs.exists(self._fs(f"{self.root}/{name}/{n}/complete")[1])), None)


class GraphSession:
    """Blocking calls on one graph.

    Single mutations go into a log (:class:`lattica.delta.DeltaLog`) that ``graph`` is merged
    with when it is read; bulk changes belong in frames (:meth:`Graph.add_vertices` and its like), by setting ``graph``.
    """

    def __init__(self, spark: SparkSession, graph: Graph | None = None, name: str = "g"):
        self.spark, self.name = spark, name
        self._log, self._turn = DeltaLog(graph or Graph.empty(spark)), threading.RLock()
        self._ids = itertools.count(1)
        self._taken: int | None = None if graph is not None else 0

    @property
    def graph(self) -> Graph:
        with self._turn:
            return self._log.graph()

    @graph.setter
    def graph(self, graph: Graph) -> None:
        with self._turn:
            self._log = DeltaLog(graph)

    def _next_id(self) -> str:
        if self._taken is None:
            ids = self.graph.vertices.select("id").union(self.graph.edges.select("id"))
            self._taken = ids.agg(F.max(F.expr("try_cast(id as bigint)"))).first()[0] or 0
        return str(self._taken + next(self._ids))

    def create_vertex(self, label: str, properties: Mapping[str, Any] | None = None) -> Vertex:
        require_text(label, "label")
        with self._turn:
            vertex = Vertex(self._next_id(), label, {k: v for k, v in (properties or {}).items() if v is not None})
            self._log.create_vertex(vertex)
        return vertex

    def find_vertex_by_id(self, label: str, vertex_id: str) -> Vertex | None:
        require_text(label, "label"), require_text(vertex_id, "id")
        return self._log.find_vertex(label, vertex_id)

    def find_vertices_by_label(self, label: str, filter: Mapping[str, Any] | None = None) -> list[Vertex]:
        return Graph.vertices_of(self.graph.find_vertices_by_label(label, filter))

    def update_vertex(self, label: str, vertex_id: str, properties: Mapping[str, Any]) -> Vertex | None:
        require_text(label, "label"), require_text(vertex_id, "id")
        with self._turn:
            return self._log.update_vertex(label, vertex_id, properties)

    def delete_vertex(self, label: str, vertex_id: str) -> bool:
        require_text(label, "label"), require_text(vertex_id, "id")
        with self._turn:
            return self._log.delete_vertex(label, vertex_id)

    def count_vertices(self, label: str) -> int:
        return self.graph.count_vertices(label)

    def create_edge(self, from_id: str, to_id: str, label: str, properties: Mapping[str, Any] | None = None) -> Edge:
        require_text(label, "label"), require_text(from_id, "from id"), require_text(to_id, "to id")
        with self._turn:
            edge = Edge(self._next_id(), label, from_id, to_id, {k: v for k, v in (properties or {}).items() if v is not None})
            self._log.create_edge(edge)
        return edge

    def find_edges_by_label(self, label: str, filter: Mapping[str, Any] | None = None) -> list[Edge]:
        return Graph.edges_of(self.graph.find_edges_by_label(label, filter))

    def delete_edge(self, label: str, edge_id: str) -> bool:
        with self._turn:
            return self._log.delete_edge(label, edge_id)

    # reads: the operators of lattica.operators ---------------------------------------------------------------------

    def _elements(self, ids, edge_ids=()) -> tuple[dict[str, Vertex], dict[str, Edge]]:
        """Whole vertices and edges of a collected result, by id; an id that the graph lacks is a vertex without label."""
        known = lambda frame, own: frame.join(F.broadcast(self.spark.createDataFrame([(i,) for i in sorted(own)], "id string")), "id", "left_semi") if own else None
        ids, edge_ids = set(ids), set(edge_ids)
        vertices, edges = known(self.graph.vertices, ids), known(self.graph.edges, edge_ids)
        found = {i: Vertex(i, "") for i in ids} | {v.id: v for v in (Graph.vertices_of(vertices) if vertices is not None else [])}
        return found, {e.id: e for e in (Graph.edges_of(edges) if edges is not None else [])}

    def _paths(self, frame: DataFrame) -> list[Path]:
        rows = frame.collect()
        vertices, edges = self._elements((i for r in rows for i in r["vertex_ids"]), (i for r in rows for i in r["edge_ids"]))
        return [Path.from_row(r, vertices, edges) for r in rows]

    def neighbors(self, start_id, options=None) -> list[Vertex]:
        from lattica.operators.traversal import neighbors

        return Graph.vertices_of(neighbors(self.graph, start_id, options))

    def shortest_path(self, from_id, to_id, options=None) -> Path | None:
        from lattica.operators.traversal import shortest_path

        return next(iter(self._paths(shortest_path(self.graph, from_id, to_id, options))), None)

    def all_paths(self, from_id, to_id, options=None) -> list[Path]:
        from lattica.operators.traversal import all_paths

        return self._paths(all_paths(self.graph, from_id, to_id, options))

    def page_rank(self, options=None) -> list[PageRankScore]:
        from lattica.operators.pagerank import page_rank

        rows = page_rank(self.graph, options).orderBy("rank").collect()
        vertices, _ = self._elements(r["vertex_id"] for r in rows)
        return [PageRankScore(vertices[r["vertex_id"]], r["score"]) for r in rows]

    def degree_centrality(self, vertex_id, options=None) -> DegreeResult:
        from lattica.operators.degree import degree_centrality

        r = degree_centrality(self.graph, vertex_id, options).first()
        return DegreeResult(vertex_id, r["in_degree"], r["out_degree"])

    def connected_components(self, options=None) -> list[Component]:
        from lattica.operators.components import connected_components

        rows = connected_components(self.graph, options).orderBy("component_id", "vertex_id").collect()
        vertices, _ = self._elements(r["vertex_id"] for r in rows)
        return [Component(c, tuple(vertices[r["vertex_id"]] for r in own)) for c, own in itertools.groupby(rows, lambda r: r["component_id"])]

    def _visits(self, frame) -> list[TraversalVisit]:
        rows = frame.orderBy("visit_order").collect()
        vertices, _ = self._elements(r["vertex_id"] for r in rows)
        return [TraversalVisit(vertices[r["vertex_id"]], r["depth"], r["parent_id"]) for r in rows]

    def bfs(self, start_id, options=None) -> list[TraversalVisit]:
        from lattica.operators.search import bfs

        return self._visits(bfs(self.graph, start_id, options))

    def dfs(self, start_id, options=None) -> list[TraversalVisit]:
        from lattica.operators.depth_first import dfs

        return self._visits(dfs(self.graph, start_id, options))

    def detect_cycles(self, options=None) -> list[Cycle]:
        from lattica.operators.cycles import detect_cycles

        return [Cycle(p) for p in self._paths(detect_cycles(self.graph, options))]

    def cycles_through(self, vertex_id, options=None) -> list[Cycle]:
        from lattica.operators.cycles import cycles_through

        return [Cycle(p) for p in self._paths(cycles_through(self.graph, vertex_id, options))]

    def sql(self, text: str) -> DataFrame:
        return self.graph.sql(text)

    def close(self) -> None:
        """Nothing of the caller's is closed; snapshots of a log that has been folded since go."""
        self._log.close()
        self.graph.vertices.unpersist(), self.graph.edges.unpersist()


