"""Elements as Python values, for results that were collected, and the frames' schemas."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from enum import Enum
from typing import Any

from pyspark.sql import Row

VERTEX_DDL = "id string, label string, properties variant"
EDGE_DDL = "id string, label string, src string, dst string, properties variant"


class Direction(Enum):
    OUTGOING = "outgoing"
    INCOMING = "incoming"
    BOTH = "both"


@dataclass(frozen=True)
class Vertex:
    id: str
    label: str
    properties: dict[str, Any] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Edge:
    id: str
    label: str
    src: str
    dst: str
    properties: dict[str, Any] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Path:
    """Vertices and edges in turn; a path of vertices only is legal."""

    steps: tuple[Vertex | Edge, ...] = ()

    @classmethod
    def of(cls, *vertices: Vertex) -> Path:
        return cls(vertices)

    @classmethod
    def from_row(cls, row: Row, vertices: Mapping[str, Vertex], edges: Mapping[str, Edge]) -> Path:
        """From parallel arrays vertex_ids and edge_ids, with the elements by their ids."""
        ids = row["vertex_ids"]
        steps: list[Vertex | Edge] = [vertices[ids[0]]] if ids else []
        for e, b in zip(row["edge_ids"], ids[1:]):
            steps += [edges[e], vertices[b]]
        return cls(tuple(steps))

    @property
    def vertices(self) -> list[Vertex]:
        return [s for s in self.steps if isinstance(s, Vertex)]

    @property
    def edges(self) -> list[Edge]:
        return [s for s in self.steps if isinstance(s, Edge)]

    @property
    def length(self) -> int:
        return len(self.edges)

    @property
    def is_empty(self) -> bool:
        return not self.steps


EMPTY_PATH = Path()


@dataclass(frozen=True)
class Cycle:
    path: Path

    @property
    def length(self) -> int:
        return self.path.length


@dataclass(frozen=True)
class DegreeResult:
    vertex_id: str
    in_degree: int
    out_degree: int

    @property
    def total(self) -> int:
        return self.in_degree + self.out_degree


@dataclass(frozen=True)
class TraversalVisit:
    vertex: Vertex
    depth: int
    parent_id: str | None


@dataclass(frozen=True)
class PageRankScore:
    vertex: Vertex
    score: float


@dataclass(frozen=True)
class Component:
    component_id: str
    vertices: tuple[Vertex, ...]

    @property
    def size(self) -> int:
        return len(self.vertices)


def _plain(value: Any) -> Any:
    """Decimals of a VARIANT as floats: JSON's numbers are doubles here."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def properties_of(row: Row) -> dict[str, Any]:
    """Of an element row: its variant, or its own columns beyond the element's; nulls are absent."""
    fixed = {"id", "label", "src", "dst", "properties"}
    out = {k: v for k, v in row.asDict().items() if k not in fixed and v is not None}
    packed = row.asDict().get("properties")
    if packed is not None:
        out |= {k: _plain(v) for k, v in packed.toPython().items() if v is not None}
    return out


def vertex_of(row: Row) -> Vertex:
    return Vertex(row["id"], row["label"], properties_of(row))


def edge_of(row: Row) -> Edge:
    return Edge(row["id"], row["label"], row["src"], row["dst"], properties_of(row))
