"""CSV: a folder of vertices and a folder of edges, with a header."""

from __future__ import annotations

import time
import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from lattica.errors import require
from lattica.graph import Graph
from lattica.options import CsvOptions, CsvPropertyMode, GraphExportOptions, GraphImportOptions
from lattica.plans.storage import stored_seeing
from lattica.sources.endpoints import Staging, deliver, sink, source
from lattica.sources.report import ExportReport, Failure, Format, ImportReport, Phase, Severity
from lattica.sources.staging import apply, as_map, before, keys_of, position, selected, text_of

VERTEX, EDGE = ("id", "label"), ("id", "label", "src", "dst")


def _columns(frame: DataFrame, fixed: tuple[str, ...], csv: CsvOptions) -> DataFrame:
    names = {"src": "from", "dst": "to"}
    base = [F.col(c).alias(names.get(c, c)) for c in fixed]
    if csv.mode is CsvPropertyMode.RAW_JSON:
        return frame.select(*base, F.to_json("props").alias(csv.json_column))
    if csv.mode is CsvPropertyMode.NONE:
        return frame.select(*base)
    keys = keys_of(frame)
    taken = {names.get(c, c) for c in fixed}
    clash = [k for k in keys if csv.prefix + k in taken]
    require(not clash, f"property columns collide with {clash}")
    return frame.select(*base, *[text_of(k).alias(csv.prefix + k) for k in keys])


def export_csv(graph: Graph, vertices_path: str | BinaryIO, edges_path: str | BinaryIO, options: GraphExportOptions, csv: CsvOptions = CsvOptions(), append: bool = False, charset: str = "UTF-8") -> ExportReport:
    """Write the named labels to folders, or to streams; null and absent properties are empty cells, every value is text."""
    began, spark = time.time(), graph.spark
    report = ExportReport(Format.CSV)
    paths = [sink(spark, given) for given in (vertices_path, edges_path)]
    with Staging(spark, append) as staged:
        for frame, fixed, path, count in zip(selected(graph, options), (VERTEX, EDGE), paths, ("vertices_written", "edges_written")):
            own, seen = _columns(as_map(frame, fixed, options.include_empty_properties), fixed, csv), Observation()
            own.observe(seen, F.count("*").alias("n")).write.csv(staged.folder(path), header=True, quote='"', escape='"', emptyValue='""', nullValue="", encoding=charset)
            setattr(report, count, seen.get["n"])
    for path, given in zip(paths, (vertices_path, edges_path)):
        deliver(spark, path, given, header=True)
    report.elapsed = time.time() - began
    return report


def _read(spark: SparkSession, given: str | BinaryIO, fixed: tuple[str, ...], csv: CsvOptions, charset: str) -> DataFrame:
    path = source(spark, given, ".csv")
    # a record that goes on over a line's end leaves an odd number of quotes in that line; without one files can be split
    odd = F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1
    lines = not spark.read.text(path).where(odd).limit(1).isEmpty()
    how = dict(header=True, multiLine=lines, quote='"', escape='"', nullValue="", emptyValue="", encoding=charset)
    names = spark.read.csv(path, **how).columns
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path, **how)
    if csv.mode is CsvPropertyMode.RAW_JSON and csv.json_column in raw.columns:
        props = F.coalesce(F.col(f"`{csv.json_column}`"), F.lit("{}"))
    elif csv.mode is CsvPropertyMode.PREFIXED:
        own = [c for c in raw.columns if c.startswith(csv.prefix)]
        props = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c.removeprefix(csv.prefix)) for c in own])) if own else F.lit("{}")
    else:
        props = F.lit("{}")
    for c in fixed:
        require(c in raw.columns, f"{path} has no column {c}")
    return raw.select(position().alias("pos"), *fixed, props.alias("properties"))


def read_csv_records(spark: SparkSession, vertices_path: str | BinaryIO, edges_path: str | BinaryIO, options: GraphImportOptions = GraphImportOptions(), csv: CsvOptions = CsvOptions(), charset: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) as they stand in the files: pos, external_id, label, for edges from_ext and to_ext, properties (JSON text)."""
    label = lambda default: F.when(F.trim("label") != "", F.col("label")).otherwise(F.lit(default)).alias("label")
    vertices = _read(spark, vertices_path, ("id", "label"), csv, charset).select("pos", F.col("id").alias("external_id"), label(options.default_vertex_label), "properties")
    edges = _read(spark, edges_path, ("id", "label", "from", "to"), csv, charset).select("pos", F.col("id").alias("external_id"), label(options.default_edge_label), F.col("from").alias("from_ext"), F.col("to").alias("to_ext"), "properties")
    return vertices, edges


def import_csv(spark: SparkSession, vertices_path: str | BinaryIO, edges_path: str | BinaryIO, options: GraphImportOptions = GraphImportOptions(), csv: CsvOptions = CsvOptions(), graph: Graph | None = None, charset: str = "UTF-8") -> tuple[Graph, ImportReport]:
    """Read vertices, then edges; properties stay text.  A blank vertex id fails the import where it stands.

    Files are split unless a record goes on over the end of a line.
    """
    began, report = time.time(), ImportReport(Format.CSV)
    graph = graph or Graph.empty(spark)
    vertices, edges = read_csv_records(spark, vertices_path, edges_path, options, csv, charset)
    blank = F.col("external_id").isNull() | (F.trim("external_id") == "")
    vertices, facts = stored_seeing(vertices, "staged-vertices", blank=F.count_if(blank))
    if facts["blank"]:
        vertices, _ = before(vertices, blank)
        report.fail(Failure(Phase.READ_VERTEX, Severity.ERROR, "Vertex id is blank"))
        report.vertices_read += 1
        edges = edges.where("false")
    graph = apply(graph, vertices, edges, options, report, f"c{uuid.uuid4().hex[:8]}:")
    report.elapsed = time.time() - began
    return graph, report
