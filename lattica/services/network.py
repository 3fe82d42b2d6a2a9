"""Persons, companies and how they know each other."""

from __future__ import annotations

from lattica.catalog import GraphSession
from lattica.model import Direction, Edge, Path, Vertex
from lattica.options import NeighborOptions, PathOptions
from lattica.schema import EdgeLabel, VertexLabel

PERSON, COMPANY, SKILL = VertexLabel("Person"), VertexLabel("Company"), VertexLabel("Skill")
for _label, _names in ((PERSON, "name title company location"), (COMPANY, "name industry size location"), (SKILL, "name category")):
    for _name in _names.split():
        _label.string(_name)
PERSON.string_list("skills"), PERSON.integer("connectionCount")
KNOWS, FOLLOWS, ENDORSES = (EdgeLabel(n, PERSON, PERSON) for n in ("KNOWS", "FOLLOWS", "ENDORSES"))
KNOWS.string("since"), KNOWS.integer("strength"), ENDORSES.string("skillName")
WORKS_AT, HAS_SKILL = EdgeLabel("WORKS_AT", PERSON, COMPANY), EdgeLabel("HAS_SKILL", PERSON, SKILL)
WORKS_AT.string("role"), WORKS_AT.string("startDate"), WORKS_AT.boolean("isCurrent"), HAS_SKILL.string("level")


class Network:
    def __init__(self, session: GraphSession):
        self.session = session

    def add_person(self, name: str, **properties) -> Vertex:
        return self.session.create_vertex(PERSON.label, {"name": name} | properties)

    def add_company(self, name: str, **properties) -> Vertex:
        return self.session.create_vertex(COMPANY.label, {"name": name} | properties)

    def connect(self, a: Vertex, b: Vertex, **properties) -> tuple[Edge, Edge]:
        """Two edges, one each way."""
        return self.session.create_edge(a.id, b.id, KNOWS.label, properties), self.session.create_edge(b.id, a.id, KNOWS.label, properties)

    def add_work_experience(self, person: Vertex, company: Vertex, **properties) -> Edge:
        return self.session.create_edge(person.id, company.id, WORKS_AT.label, properties)

    def follow(self, follower: Vertex, followed: Vertex) -> Edge:
        return self.session.create_edge(follower.id, followed.id, FOLLOWS.label)

    def direct_connections(self, person: Vertex) -> list[Vertex]:
        return self.connections_within(person, 1)

    def connections_within(self, person: Vertex, degree: int) -> list[Vertex]:
        return self.session.neighbors(person.id, NeighborOptions(KNOWS.label, Direction.OUTGOING, degree))

    def connection_path(self, a: Vertex, b: Vertex) -> Path | None:
        return self.session.shortest_path(a.id, b.id, PathOptions(KNOWS.label, 6))

    def all_connection_paths(self, a: Vertex, b: Vertex) -> list[Path]:
        return self.session.all_paths(a.id, b.id, PathOptions(KNOWS.label, 3))

    def employees(self, company: Vertex) -> list[Vertex]:
        return self.session.neighbors(company.id, NeighborOptions(WORKS_AT.label, Direction.INCOMING))

    def followers(self, person: Vertex) -> list[Vertex]:
        return self.session.neighbors(person.id, NeighborOptions(FOLLOWS.label, Direction.INCOMING))

    def find_person(self, name: str) -> list[Vertex]:
        return self.session.find_vertices_by_label(PERSON.label, {"name": name})
