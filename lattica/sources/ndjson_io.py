"""Newline-delimited JSON: one envelope (type, id, label, from, to, properties) a line."""

from __future__ import annotations

import time
import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from lattica.errors import require
from lattica.graph import Graph
from lattica.options import GraphExportOptions, GraphImportOptions
from lattica.plans.storage import stored_seeing
from lattica.sources.endpoints import Staging, decoded, deliver, encoded, sink, source
from lattica.sources.report import ExportReport, Failure, Format, ImportReport, Phase, Severity
from lattica.sources.staging import apply, as_map, before, position, selected


def export_ndjson(graph: Graph, path: str | BinaryIO, options: GraphExportOptions, append: bool = False, charset: str = "UTF-8") -> ExportReport:
    """Write the named labels, vertices before edges in the order of the files' names; to a folder, or to a stream."""
    began, report, spark, seen = time.time(), ExportReport(Format.NDJSON), graph.spark, Observation()
    vertices, edges = selected(graph, options)
    v = as_map(vertices, ("id", "label"), options.include_empty_properties)
    e = as_map(edges, ("id", "label", "src", "dst"), options.include_empty_properties)
    v = v.select(F.lit(True).alias("is_vertex"), F.to_json(F.struct(F.lit("vertex").alias("type"), "id", "label", F.col("props").alias("properties"))).alias("value"))
    e = e.select(F.lit(False), F.to_json(F.struct(F.lit("edge").alias("type"), "id", "label", F.col("src").alias("from"), F.col("dst").alias("to"), F.col("props").alias("properties"))).alias("value"))
    told = v.union(e).observe(seen, F.count_if("is_vertex").alias("v"), F.count_if(~F.col("is_vertex")).alias("e"))
    at = sink(spark, path)
    with Staging(spark, append) as staged:
        told.select(encoded(F.col("value"), charset).alias("value")).write.text(staged.folder(at))
    report.vertices_written, report.edges_written = seen.get["v"], seen.get["e"]
    deliver(spark, at, path)
    report.elapsed = time.time() - began
    return report


def read_ndjson_records(spark: SparkSession, path: str | BinaryIO, charset: str = "UTF-8") -> DataFrame:
    """Envelopes as they stand in the files: pos, line (its text), ok (whether it is a JSON object), type, id, label, from, to, properties (JSON text)."""
    lines = spark.read.text(source(spark, path)).select(position().alias("pos"), decoded(F.col("value"), charset).alias("line")).where("trim(line) <> ''")
    parsed = lines.withColumn("v", F.try_parse_json("line"))
    ok = F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    return parsed.select("pos", "line", ok.alias("ok"), field("type"), field("id"), field("label"), field("from"), field("to"), F.coalesce(F.to_json(F.try_variant_get("v", "$.properties", "variant")), F.lit("{}")).alias("properties"))


def import_ndjson(spark: SparkSession, path: str | BinaryIO, options: GraphImportOptions = GraphImportOptions(), graph: Graph | None = None, charset: str = "UTF-8") -> tuple[Graph, ImportReport]:
    """Read envelopes; edges may come before vertices, values keep their JSON types.

    A malformed line, and the edge that exceeds max_edge_buffer_size (if one is
    asked for), fail the import there: what came before is kept, edges are not created.  A vertex without id is a
    ValueError, an unknown type a warning.
    """
    began, report = time.time(), ImportReport(Format.NDJSON)
    graph = graph or Graph.empty(spark)
    is_edge, no_id = F.col("type") == "edge", F.col("ok") & (F.col("type") == "vertex") & (F.col("id").isNull() | (F.trim("id") == ""))
    strange = F.col("ok") & (F.col("type").isNull() | ~F.col("type").isin("vertex", "edge"))
    records, facts = stored_seeing(read_ndjson_records(spark, path, charset), "records", bad=F.count_if(~F.col("ok")), edges=F.count_if(is_edge), no_id=F.count_if(no_id), strange=F.count_if(strange))
    n_edges, unsure = facts["edges"], facts["bad"] > 0
    if facts["bad"]:
        every = records
        records, bad = before(records, ~F.col("ok"))
        at = bad.select("pos").first()["pos"]
        line = every.where((F.col("pos.file") == at["file"]) & (F.col("pos") <= F.struct(*[F.lit(x).alias(k) for k, x in at.asDict().items()]))).count()
        report.fail(Failure(Phase.READ_VERTEX, Severity.ERROR, "Malformed JSON line", line=line))
        n_edges = records.where(is_edge).count()
    if options.max_edge_buffer_size is not None and n_edges > options.max_edge_buffer_size:
        over = records.where(is_edge).orderBy("pos").select("pos").limit(options.max_edge_buffer_size + 1).agg(F.max("pos").alias("pos")).first()["pos"]
        records, _ = before(records, F.col("pos") == F.struct(*[F.lit(x).alias(k) for k, x in over.asDict().items()]))
        report.fail(Failure(Phase.READ_EDGE, Severity.ERROR, f"maxEdgeBufferSize {options.max_edge_buffer_size} exceeded"))
        n_edges, unsure = options.max_edge_buffer_size + 1, True
    if facts["strange"]:
        report.reject(Phase.READ_VERTEX, records.where(strange), F.col("id"), F.concat(F.lit("Unknown type "), F.coalesce("type", F.lit("None"))))
    require(not facts["no_id"] or unsure and records.where(no_id).isEmpty(), "a vertex envelope has no id")
    label = lambda default: F.when(F.trim("label") != "", F.col("label")).otherwise(F.lit(default)).alias("label")
    vertices = records.where("type = 'vertex'").select("pos", F.col("id").alias("external_id"), label(options.default_vertex_label), "properties")
    edges = records.where(is_edge).select("pos", F.col("id").alias("external_id"), label(options.default_edge_label), F.col("from").alias("from_ext"), F.col("to").alias("to_ext"), "properties")
    if report.status.value == "failed":
        edges = edges.where("false")
        report.edges_read = n_edges
    graph = apply(graph, vertices, edges, options, report, f"j{uuid.uuid4().hex[:8]}:", warn_duplicates=False, edges_read=lambda: n_edges)
    report.elapsed = time.time() - began
    return graph, report
