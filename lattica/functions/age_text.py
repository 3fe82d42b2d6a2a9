"""Text of the statements that a Cypher-in-SQL back-end takes, for use outside of Spark.

Spark itself runs none of it: the same operators are methods of
:class:`lattica.graph.Graph`.  Labels are checked, values are literals.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from lattica.errors import checked_label, require
from lattica.functions.literals import cypher_props, cypher_value
from lattica.model import Direction

SESSION = ("CREATE EXTENSION IF NOT EXISTS age", "LOAD 'age'", 'SET search_path = ag_catalog, "$user", public')


def _quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def create_graph(name: str) -> str:
    return f"SELECT ag_catalog.create_graph({_quoted(name)})"


def drop_graph(name: str) -> str:
    return f"SELECT ag_catalog.drop_graph({_quoted(name)}, true)"


def graph_exists(name: str) -> str:
    return f"SELECT count(*) FROM ag_catalog.ag_graph WHERE name = {_quoted(name)}"


def cypher(graph: str, query: str, *columns: str) -> str:
    """The wrapping SELECT; each column is an agtype."""
    require("$$" not in query, "a query can't hold $$")
    return f"SELECT * FROM ag_catalog.cypher({_quoted(graph)}, $$ {query} $$) AS ({', '.join(f'{c} agtype' for c in columns)})"


def _node(name: str, label: str | None = None, properties: Mapping[str, Any] | None = None) -> str:
    kind = f":{checked_label(label)}" if label else ""
    return f"({name}{kind}{' ' + cypher_props(properties) if properties else ''})"


def _by_id(name: str, element_id: str | int) -> str:
    return f"id({name}) = {int(element_id)}"


def create_vertex(graph: str, label: str, properties: Mapping[str, Any] | None = None) -> str:
    return cypher(graph, f"CREATE {_node('v', label, properties)} RETURN v", "v")


def match_vertices(graph: str, label: str | None = None, filter: Mapping[str, Any] | None = None) -> str:
    return cypher(graph, f"MATCH {_node('v', label, filter)} RETURN v", "v")


def match_vertex_by_id(graph: str, label: str, vertex_id: str) -> str:
    return cypher(graph, f"MATCH {_node('v', label)} WHERE {_by_id('v', vertex_id)} RETURN v", "v")


def update_vertex(graph: str, label: str, vertex_id: str, properties: Mapping[str, Any]) -> str:
    require(bool(properties), "nothing to set")
    changes = ", ".join(f"v.{checked_label(k)} = {cypher_value(v)}" for k, v in properties.items())
    return cypher(graph, f"MATCH {_node('v', label)} WHERE {_by_id('v', vertex_id)} SET {changes} RETURN v", "v")


def delete_vertex(graph: str, label: str, vertex_id: str) -> str:
    return cypher(graph, f"MATCH {_node('v', label)} WHERE {_by_id('v', vertex_id)} DETACH DELETE v RETURN id(v)", "id")


def count_vertices(graph: str, label: str) -> str:
    return cypher(graph, f"MATCH {_node('v', label)} RETURN count(v)", "count")


def create_edge(graph: str, src: str, dst: str, label: str, properties: Mapping[str, Any] | None = None) -> str:
    edge = f"[e:{checked_label(label)}{' ' + cypher_props(properties) if properties else ''}]"
    return cypher(graph, f"MATCH (a), (b) WHERE {_by_id('a', src)} AND {_by_id('b', dst)} CREATE (a)-{edge}->(b) RETURN e", "e")


def match_edges(graph: str, label: str | None = None, filter: Mapping[str, Any] | None = None) -> str:
    return cypher(graph, f"MATCH ()-[e{':' + checked_label(label) if label else ''}{' ' + cypher_props(filter) if filter else ''}]->() RETURN e", "e")


def delete_edge(graph: str, label: str, edge_id: str) -> str:
    return cypher(graph, f"MATCH ()-[e:{checked_label(label)}]->() WHERE {_by_id('e', edge_id)} DELETE e RETURN id(e)", "id")


def _hops(label: str | None, most: int) -> str:
    return f"[{':' + checked_label(label) if label else ''}*1..{int(most)}]"


def neighbors(graph: str, start: str, label: str | None, direction: Direction, most: int = 1) -> str:
    left, right = {Direction.OUTGOING: ("-", "->"), Direction.INCOMING: ("<-", "-"), Direction.BOTH: ("-", "-")}[direction]
    return cypher(graph, f"MATCH (s){left}{_hops(label, most)}{right}(n) WHERE {_by_id('s', start)} RETURN DISTINCT n", "n")


def paths(graph: str, src: str, dst: str, label: str | None, most: int, shortest: bool = False) -> str:
    """All paths, or with ``shortest`` one of least length."""
    end = " ORDER BY length(p) LIMIT 1" if shortest else ""
    return cypher(graph, f"MATCH p = (a)-{_hops(label, most)}-(b) WHERE {_by_id('a', src)} AND {_by_id('b', dst)} RETURN p{end}", "p")


def degree(graph: str, vertex: str, label: str | None = None) -> str:
    kind = f":{checked_label(label)}" if label else ""
    return cypher(graph, f"MATCH (v) WHERE {_by_id('v', vertex)} OPTIONAL MATCH (v)<-[i{kind}]-() WITH v, count(i) AS ins OPTIONAL MATCH (v)-[o{kind}]->() RETURN ins, count(o)", "in_degree", "out_degree")
