"""Modules, classes and functions, and what depends on what."""

from __future__ import annotations

from lattica.catalog import GraphSession
from lattica.model import Cycle, Direction, Edge, Path, Vertex
from lattica.options import CycleOptions, NeighborOptions, PathOptions
from lattica.schema import EdgeLabel, VertexLabel

MODULE, CLASS, FUNCTION = VertexLabel("Module"), VertexLabel("Class"), VertexLabel("Function")
for _label, _names in ((MODULE, "name path version language"), (CLASS, "name qualifiedName module"), (FUNCTION, "name signature className module")):
    for _name in _names.split():
        _label.string(_name)
CLASS.boolean("isAbstract"), CLASS.boolean("isInterface"), FUNCTION.integer("lineCount")
DEPENDS_ON = EdgeLabel("DEPENDS_ON", MODULE, MODULE)
DEPENDS_ON.string("dependencyType"), DEPENDS_ON.string("version")
IMPORTS, EXTENDS, IMPLEMENTS = (EdgeLabel(n, CLASS, CLASS) for n in ("IMPORTS", "EXTENDS", "IMPLEMENTS"))
CALLS = EdgeLabel("CALLS", FUNCTION, FUNCTION)
CALLS.integer("callCount"), CALLS.boolean("isRecursive")
BELONGS_TO = EdgeLabel("BELONGS_TO", CLASS, MODULE)


class CodeGraph:
    def __init__(self, session: GraphSession):
        self.session = session

    def add_module(self, name: str, **properties) -> Vertex:
        return self.session.create_vertex(MODULE.label, {"name": name} | properties)

    def add_class(self, name: str, **properties) -> Vertex:
        return self.session.create_vertex(CLASS.label, {"name": name} | properties)

    def add_function(self, name: str, **properties) -> Vertex:
        return self.session.create_vertex(FUNCTION.label, {"name": name} | properties)

    def _link(self, label: EdgeLabel, src: Vertex, dst: Vertex, **properties) -> Edge:
        return self.session.create_edge(src.id, dst.id, label.label, properties)

    def add_dependency(self, src: Vertex, dst: Vertex, **properties) -> Edge:
        return self._link(DEPENDS_ON, src, dst, **properties)

    def add_import(self, src: Vertex, dst: Vertex) -> Edge:
        return self._link(IMPORTS, src, dst)

    def add_extends(self, src: Vertex, dst: Vertex) -> Edge:
        return self._link(EXTENDS, src, dst)

    def add_implements(self, src: Vertex, dst: Vertex) -> Edge:
        return self._link(IMPLEMENTS, src, dst)

    def add_call(self, src: Vertex, dst: Vertex, **properties) -> Edge:
        return self._link(CALLS, src, dst, **properties)

    def add_belongs_to(self, src: Vertex, dst: Vertex) -> Edge:
        return self._link(BELONGS_TO, src, dst)

    def _reach(self, label: EdgeLabel, start: Vertex, direction: Direction, depth: int) -> list[Vertex]:
        return self.session.neighbors(start.id, NeighborOptions(label.label, direction, depth))

    def dependencies(self, module: Vertex) -> list[Vertex]:
        return self._reach(DEPENDS_ON, module, Direction.OUTGOING, 1)

    def dependents(self, module: Vertex) -> list[Vertex]:
        return self._reach(DEPENDS_ON, module, Direction.INCOMING, 1)

    def transitive_dependencies(self, module: Vertex, max_depth: int = 5) -> list[Vertex]:
        return self._reach(DEPENDS_ON, module, Direction.OUTGOING, max_depth)

    def impacted_modules(self, module: Vertex, depth: int = 3) -> list[Vertex]:
        return self._reach(DEPENDS_ON, module, Direction.INCOMING, depth)

    def dependency_path(self, src: Vertex, dst: Vertex) -> Path | None:
        return self.session.shortest_path(src.id, dst.id, PathOptions(DEPENDS_ON.label, 10))

    def circular_dependencies(self, module: Vertex, max_depth: int = 5) -> list[Cycle]:
        return self.session.cycles_through(module.id, CycleOptions(MODULE.label, DEPENDS_ON.label, max_depth))

    def inheritance_chain(self, cls: Vertex, depth: int = 5) -> list[Vertex]:
        return self._reach(EXTENDS, cls, Direction.OUTGOING, depth)

    def call_chain(self, function: Vertex, max_depth: int = 5) -> list[Vertex]:
        return self._reach(CALLS, function, Direction.OUTGOING, max_depth)

    def find_module(self, name: str) -> list[Vertex]:
        return self.session.find_vertices_by_label(MODULE.label, {"name": name})

    def find_class(self, name: str) -> list[Vertex]:
        return self.session.find_vertices_by_label(CLASS.label, {"name": name})
