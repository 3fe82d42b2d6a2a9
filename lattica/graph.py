"""A property graph: a frame of vertices and a frame of edges.

``vertices`` has id and label, ``edges`` id, label, src and dst; properties are
either native columns beside these (best over tables: they are pruned and pushed
down) or one VARIANT column ``properties``.  A Graph never changes; mutators
return a new one whose plan is the old plan and the change.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lattica.errors import GraphQueryError, require, require_text
from lattica.model import EDGE_DDL, VERTEX_DDL, Direction, Edge, Vertex, edge_of, vertex_of
from lattica.plans.storage import Scratch, stored

_VERTEX, _EDGE = ("id", "label"), ("id", "label", "src", "dst")


def to_json(properties: Mapping[str, Any] | None) -> str:
    """JSON of a property map without its nulls; dates become ISO text."""

    def plain(v):
        if isinstance(v, date | datetime):
            return v.isoformat()
        if isinstance(v, Decimal):
            return float(v)
        return str(v)

    return json.dumps({k: v for k, v in (properties or {}).items() if v is not None}, default=plain, ensure_ascii=False)


def _equals(frame: DataFrame, key: str, value: Any) -> Column:
    """Typed equality: numbers compare with numbers only, text with text only; null matches nothing."""
    if value is None:
        return F.lit(False)
    if key in frame.columns:
        return F.col(f"`{key}`") == F.lit(value)
    if "properties" not in frame.columns:
        return F.lit(False)
    own = F.variant_get("properties", "$['" + key.replace("'", "\\'") + "']", "variant")
    kind = F.schema_of_variant(own)
    text = F.to_json(own)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (text == json.dumps(value))
    if isinstance(value, int | float):
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return number & (F.when(number, text.try_cast("double")) == float(value))
    if isinstance(value, list | tuple | Mapping):
        return text == F.to_json(F.parse_json(F.lit(json.dumps(value))))
    shown = value.isoformat() if isinstance(value, date | datetime) else str(value)
    return (kind == "STRING") & (F.try_variant_get("properties", "$['" + key.replace("'", "\\'") + "']", "string") == shown)


class Graph:
    """``at_rest``: the frames are plain tables, so that reading them again and again costs no more than a scan."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, at_rest: bool = False):
        require(set(_VERTEX) <= set(vertices.columns), f"vertices need columns {_VERTEX}")
        require(set(_EDGE) <= set(edges.columns), f"edges need columns {_EDGE}")
        self.vertices, self.edges, self.spark, self.at_rest = vertices, edges, vertices.sparkSession, at_rest

    def stored(self) -> Graph:
        """The same graph with its frames written once: for several operators on a view that joins have to make."""
        return self if self.at_rest else Graph(stored(self.vertices, "vertices"), stored(self.edges, "edges"), at_rest=True)

    def bare(self) -> Graph:
        """The same graph without properties, for operators that don't look at them: a view need not make them."""
        return Graph(self.vertices.select(*_VERTEX), self.edges.select(*_EDGE), self.at_rest)

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], VERTEX_DDL), spark.createDataFrame([], EDGE_DDL))

    @classmethod
    def from_rows(cls, spark: SparkSession, vertices: Iterable[tuple], edges: Iterable[tuple] = ()) -> Graph:
        """From (id, label[, properties]) and (id, label, src, dst[, properties])."""
        return cls(_frame(spark, vertices, _VERTEX), _frame(spark, edges, _EDGE))

    # scans --------------------------------------------------------------------------------------------------------

    def find_vertex_by_id(self, label: str, vertex_id: str) -> DataFrame:
        require_text(label, "label"), require_text(vertex_id, "id")
        return self.vertices.where((F.col("id") == vertex_id) & (F.col("label") == label)).limit(1)

    def find_vertices_by_label(self, label: str, filter: Mapping[str, Any] | None = None, where: Column | None = None) -> DataFrame:
        return self._labelled(self.vertices, label, filter, where)

    def count_vertices(self, label: str) -> int:
        return self.find_vertices_by_label(label).count()

    def counts_by_label(self) -> DataFrame:
        return self.vertices.groupBy("label").agg(F.count("*").alias("vertices"))

    def find_edges_by_label(self, label: str, filter: Mapping[str, Any] | None = None, where: Column | None = None) -> DataFrame:
        return self._labelled(self.edges, label, filter, where)

    def edge_counts_by_label(self) -> DataFrame:
        return self.edges.groupBy("label").agg(F.count("*").alias("edges"))

    def _labelled(self, frame, label, filter, where):
        require_text(label, "label")
        out = frame.where(F.col("label") == label)
        for key, value in (filter or {}).items():
            out = out.where(_equals(frame, key, value))
        return out if where is None else out.where(where)

    # copy-on-write mutations --------------------------------------------------------------------------------------

    def add_vertices(self, rows: DataFrame) -> Graph:
        return Graph(self.vertices.unionByName(rows, allowMissingColumns=True), self.edges)

    def add_edges(self, rows: DataFrame) -> Graph:
        """Append edges whose ends both exist; others are dropped (see :meth:`missing_endpoints`)."""
        ids = self.vertices.select("id")
        good = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.vertices, self.edges.unionByName(good.select(*rows.columns), allowMissingColumns=True))

    def missing_endpoints(self, rows: DataFrame) -> DataFrame:
        """Edges of ``rows`` that lack an end in this graph."""
        ids = self.vertices.select("id")
        ends = rows.select("id", F.explode(F.array("src", "dst")).alias("end"))
        lost = ends.join(ids.withColumnRenamed("id", "end"), "end", "left_anti").select("id").distinct()
        return rows.join(lost, "id", "left_semi")

    def with_vertex(self, vertex_id: str, label: str, properties: Mapping[str, Any] | None = None) -> Graph:
        require_text(label, "label")
        return self.add_vertices(self._rows("vertices", [(vertex_id, label, properties)]))

    def with_edge(self, edge_id: str, src: str, dst: str, label: str, properties: Mapping[str, Any] | None = None) -> Graph:
        require_text(label, "label"), require_text(src, "from id"), require_text(dst, "to id")
        ends = {r["id"] for r in self.vertices.where(F.col("id").isin(src, dst)).select("id").collect()}
        if not {src, dst} <= ends:
            raise GraphQueryError(f"edge {src}->{dst}: no such vertex: {', '.join(sorted({src, dst} - ends))}")
        return Graph(self.vertices, self.edges.unionByName(self._rows("edges", [(edge_id, label, src, dst, properties)]), allowMissingColumns=True))

    def _rows(self, which: str, rows: list[tuple]) -> DataFrame:
        frame, fixed = (self.vertices, _VERTEX) if which == "vertices" else (self.edges, _EDGE)
        if "properties" in frame.columns or len(frame.columns) == len(fixed) and not any(r[-1] for r in rows):
            out = _frame(self.spark, rows, fixed)
            return out if "properties" in frame.columns else out.drop("properties")
        types = {f.name: f.dataType for f in frame.schema}
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField(c, types[c]) for c in frame.columns])
        full = [dict(zip(fixed, r)) | {k: v for k, v in (r[-1] or {}).items() if v is not None} for r in rows]
        for r in full:
            require(set(r) <= set(types), f"no such property column: {sorted(set(r) - set(types))}")
        return self.spark.createDataFrame([[r.get(c) for c in frame.columns] for r in full], schema)

    def update_vertices(self, label: str, changes: Mapping[str, Any], where: Column | None = None, vertex_id: str | None = None) -> Graph:
        """Merge ``changes`` into the properties of matching vertices; a None value deletes its key."""
        require_text(label, "label")
        hit = F.col("label") == label
        if vertex_id is not None:
            hit = hit & (F.col("id") == vertex_id)
        if where is not None:
            hit = hit & where
        out = self.vertices
        if not changes:
            return self
        native = {k: v for k, v in changes.items() if k in out.columns and k not in (*_VERTEX, "properties")}
        for key, value in native.items():
            kind = dict(self.vertices.dtypes)[key]
            out = out.withColumn(key, F.when(hit, F.lit(value).cast(kind)).otherwise(F.col(key)))
        packed = {k: v for k, v in changes.items() if k not in native}
        if packed:
            require("properties" in out.columns, f"no such property column: {sorted(packed)}")
            gone = F.array(*map(F.lit, packed))
            old = F.from_json(F.to_json("properties"), "map<string,variant>")
            kept = F.map_filter(old, lambda k, _: ~F.array_contains(gone, k))
            new = F.from_json(F.lit(to_json(packed)), "map<string,variant>")
            merged = F.parse_json(F.to_json(F.map_concat(F.coalesce(kept, F.from_json(F.lit("{}"), "map<string,variant>")), new)))
            out = out.withColumn("properties", F.when(hit, merged).otherwise(F.col("properties")))
        return Graph(out, self.edges)

    def delete_vertices(self, doomed: DataFrame) -> Graph:
        """Without the vertices whose id is in ``doomed``, and without their edges."""
        ids = doomed.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.vertices.join(ids, "id", "left_anti").select(*self.vertices.columns), edges.select(*self.edges.columns))

    def delete_edges(self, doomed: DataFrame) -> Graph:
        """Without the edges whose (label, id) is in ``doomed``."""
        return Graph(self.vertices, self.edges.join(doomed.select("label", "id").distinct(), ["label", "id"], "left_anti").select(*self.edges.columns))

    # views --------------------------------------------------------------------------------------------------------

    def oriented(self, direction: Direction = Direction.OUTGOING, edge_label: str | None = None) -> DataFrame:
        """(a, b, edge_id): steps from a to b that follow ``direction``."""
        edges = self.edges if edge_label is None else self.edges.where(F.col("label") == edge_label)
        out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("id").alias("edge_id"))
        back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("id").alias("edge_id"))
        return {Direction.OUTGOING: out, Direction.INCOMING: back}.get(direction) or out.union(back)

    def steps(self, keep: Scratch, direction: Direction = Direction.OUTGOING, edge_label: str | None = None) -> DataFrame:
        """:meth:`oriented` for operators that read it in every round: written once, unless it is at rest anyway."""
        steps = self.oriented(direction, edge_label)
        return steps if self.at_rest else keep.stored(steps, "steps")

    def restricted(self, vertex_label: str | None, edge_label: str | None) -> tuple[DataFrame, DataFrame]:
        """(ids, (src, dst, id) of edges with both ends among them) after label filters."""
        ids = (self.vertices if vertex_label is None else self.vertices.where(F.col("label") == vertex_label)).select("id")
        edges = (self.edges if edge_label is None else self.edges.where(F.col("label") == edge_label)).select("src", "dst", "id")
        for end in ("src", "dst"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return ids, edges.select("src", "dst", "id")

    def by_number(self, keep: Scratch, vertex_label: str | None, edge_label: str | None) -> tuple[DataFrame, DataFrame, int]:
        """:meth:`restricted` with numbers for ids: ((n, id, times) of distinct ids, (a, b) of edges, rows of vertices).

        Numbers are in no order.  The joins that find them leave out edges without an end; what follows moves 16 bytes an edge.
        """
        ids = (self.vertices if vertex_label is None else self.vertices.where(F.col("label") == vertex_label)).groupBy("id").agg(F.count("*").alias("times"))
        nodes, facts = keep.stored_seeing(ids.select(F.monotonically_increasing_id().alias("n"), "id", "times"), "nodes", n=F.sum("times"))
        edges = (self.edges if edge_label is None else self.edges.where(F.col("label") == edge_label)).select("src", "dst")
        for end, number in (("src", "a"), ("dst", "b")):
            edges = edges.join(nodes.select(F.col("id").alias(end), F.col("n").alias(number)), end)
        return nodes, edges.select("a", "b"), facts["n"] or 0

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the views ``vertices`` and ``edges``: the raw query hatch."""
        self.vertices.createOrReplaceTempView("vertices")
        self.edges.createOrReplaceTempView("edges")
        return self.spark.sql(text)

    # collected forms ----------------------------------------------------------------------------------------------

    @staticmethod
    def vertices_of(frame: DataFrame) -> list[Vertex]:
        return [vertex_of(r) for r in frame.collect()]

    @staticmethod
    def edges_of(frame: DataFrame) -> list[Edge]:
        return [edge_of(r) for r in frame.collect()]


def _frame(spark: SparkSession, rows: Iterable[tuple], fixed: tuple[str, ...]) -> DataFrame:
    n = len(fixed)
    flat = [(*map(str, r[:n]), to_json(r[n] if len(r) > n else None)) for r in rows]
    ddl = ", ".join(f"{c} string" for c in (*fixed, "packed"))
    return spark.createDataFrame(flat, ddl).select(*fixed, F.parse_json("packed").alias("properties"))
