"""The records of files as asynchronous streams: vertices first, then edges, lazily."""

from __future__ import annotations

import json
from collections.abc import AsyncIterator
from typing import BinaryIO

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from lattica.model import Edge, Vertex
from lattica.options import GraphImportOptions
from lattica.sources.csv_io import read_csv_records
from lattica.sources.ndjson_io import read_ndjson_records
from lattica.streaming.surfaces import AsyncSurface


class RecordReader:
    """Streams of what stands in files, before any rule on duplicates or missing ends; ids are the files' own.

    Nothing runs before the first record is asked for, and one partition is held at a time.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self._vertices, self._edges = vertices.orderBy("pos"), edges.orderBy("pos")

    @classmethod
    def of_csv(cls, spark: SparkSession, vertices: str | BinaryIO, edges: str | BinaryIO, options: GraphImportOptions = GraphImportOptions()) -> RecordReader:
        return cls(*read_csv_records(spark, vertices, edges, options))

    @classmethod
    def of_ndjson(cls, spark: SparkSession, path: str | BinaryIO, options: GraphImportOptions = GraphImportOptions()) -> RecordReader:
        records = read_ndjson_records(spark, path).where("ok")
        label = lambda default: F.coalesce("label", F.lit(default)).alias("label")
        vertices = records.where("type = 'vertex'").select("pos", F.col("id").alias("external_id"), label(options.default_vertex_label), "properties")
        edges = records.where("type = 'edge'").select("pos", F.col("id").alias("external_id"), label(options.default_edge_label), F.col("from").alias("from_ext"), F.col("to").alias("to_ext"), "properties")
        return cls(vertices, edges)

    @staticmethod
    def _properties(row: Row) -> dict:
        return {k: v for k, v in json.loads(row["properties"]).items() if v is not None}

    async def vertices(self) -> AsyncIterator[Vertex]:
        async for r in AsyncSurface.stream(self._vertices):
            yield Vertex(r["external_id"], r["label"], self._properties(r))

    async def edges(self) -> AsyncIterator[Edge]:
        async for r in AsyncSurface.stream(self._edges):
            yield Edge(r["external_id"], r["label"], r["from_ext"], r["to_ext"], self._properties(r))

    async def records(self) -> AsyncIterator[Vertex | Edge]:
        """All vertices, then all edges."""
        async for v in self.vertices():
            yield v
        async for e in self.edges():
            yield e
