"""GraphML: XML documents of keys, nodes and edges."""

from __future__ import annotations

import time
import uuid
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from lattica.errors import require
from lattica.graph import Graph
from lattica.options import GraphExportOptions, GraphImportOptions, GraphMlExportOptions, GraphMlImportOptions, UnsupportedElementPolicy
from lattica.plans.storage import Scratch, stored
from lattica.sources.endpoints import Staging, deliver, encoded, sink, source
from lattica.sources.graphml_events import read_events
from lattica.sources.report import ExportReport, Failure, Format, ImportReport, Phase, Severity
from lattica.sources.staging import apply, as_map, keys_of, kinds_of, selected, text_of

# Characters that XML text and attributes must escape; those it can't hold.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")]
ILLEGAL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"
#: attr.type of uniformly typed properties.
TYPES = {"BIGINT": "long", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "STRING": "string"}


def _escaped(column: Column) -> Column:
    column = F.regexp_replace(column, ILLEGAL, "")
    for raw, shown in ESCAPES:
        column = F.replace(column, F.lit(raw), F.lit(shown))
    return column


def _kinds(frame: DataFrame, legacy: bool) -> dict[str, str]:
    if legacy:
        return {}
    if kinds_of(frame) is not None:
        return kinds_of(frame)
    each = frame.select(F.explode(F.map_entries("props")).alias("p")).select("p.key", F.schema_of_variant("p.value").alias("kind")).where("kind <> 'VOID'")
    kind = F.when(F.col("kind").startswith("DECIMAL"), "DOUBLE").otherwise(F.col("kind"))
    rows = each.groupBy("key").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo = hi").collect()
    return {r["key"]: TYPES.get(r["lo"], "string") for r in rows}


def whole_documents(head: str, tail: str, always: bool):
    """Lines of each partition as a document; of one without lines only if ``always``."""

    def run(batches):
        begun = False
        for batch in batches:
            if not begun:
                yield pa.RecordBatch.from_pydict({"value": [head]})
                begun = True
            yield batch
        if always and not begun:
            yield pa.RecordBatch.from_pydict({"value": [head]})
        if always or begun:
            yield pa.RecordBatch.from_pydict({"value": [tail]})

    return run


def export_graphml(graph: Graph, path: str | BinaryIO, options: GraphExportOptions, xml: GraphMlExportOptions = GraphMlExportOptions()) -> ExportReport:
    """Write documents into the folder ``path``, in parallel, each whole and with the same keys; nulls are empty data elements.

    With ``one_file``, and to a stream, it is a single document, which goes through one task.
    """
    began, report, spark, seen = time.time(), ExportReport(Format.GRAPHML), graph.spark, Observation()
    vertices, edges = selected(graph, options)
    # properties of a VARIANT have to be looked at before they are written
    at_rest = lambda frame: frame if kinds_of(frame) is not None else stored(frame, "export")
    v = at_rest(as_map(vertices, ("id", "label"), options.include_empty_properties))
    e = at_rest(as_map(edges, ("id", "label", "src", "dst"), options.include_empty_properties))
    number = iter(range(10**9))
    head = [f'<?xml version="1.0" encoding="{xml.encoding}"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']

    def lines(frame: DataFrame, target: str, opening: list[Column]) -> Column:
        kinds = _kinds(frame, xml.legacy_string_types)
        parts = []
        for i, name in enumerate([xml.label_attr_name, *keys_of(frame)]):
            key, kind = f"d{next(number)}", kinds.get(name, "string") if i else "string"
            shown = name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
            head.append(f'<key id="{key}" for="{target}" attr.name="{shown}" attr.type="{kind}"/>')
            value = _escaped(text_of(name)) if i else _escaped(F.col("label"))
            data = F.concat(F.lit(f'<data key="{key}">'), F.coalesce(value, F.lit("")), F.lit("</data>"))
            has = F.map_contains_key("props", name)
            parts.append(data if not i else F.when(has, data).otherwise(F.lit("")))
        return F.concat(*opening, *parts, F.lit(f"</{target}>"))

    quoted = lambda c: F.concat(F.lit('"'), _escaped(F.col(c)), F.lit('"'))
    nodes = v.select(F.lit(1).alias("part"), lines(v, "node", [F.lit("<node id="), quoted("id"), F.lit(">")]).alias("value"))
    links = e.select(F.lit(2).alias("part"), lines(e, "edge", [F.lit("<edge id="), quoted("id"), F.lit(" source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit(">")]).alias("value"))
    head.append(f'<graph id="{xml.graph_id}" edgedefault="{xml.edge_default}">')
    told = nodes.union(links).observe(seen, F.count_if(F.col("part") == 1).alias("v"), F.count_if(F.col("part") == 2).alias("e"))
    at, one = sink(spark, path), xml.one_file or not isinstance(path, str)
    told = told.coalesce(1).sortWithinPartitions("part") if one else told
    whole = told.select("value").mapInArrow(whole_documents("\n".join(head), "</graph>\n</graphml>", one), "value string")
    with Staging(spark) as staged:
        whole.select(encoded(F.col("value"), xml.encoding).alias("value")).write.text(staged.folder(at))
    report.vertices_written, report.edges_written = seen.get["v"], seen.get["e"]
    deliver(spark, at, path)
    report.elapsed = time.time() - began
    return report


def _coerced(value: Column, kind: Column) -> Column:
    """A value as its key's type, or as text where it doesn't fit."""
    truth = (kind == "boolean") & F.lower(value).isin("true", "false")
    typed = F.when(kind.isin("int", "long"), value.try_cast("bigint").cast("variant")).when(kind.isin("float", "double"), value.try_cast("double").cast("variant")).when(truth, value.try_cast("boolean").cast("variant"))
    return F.coalesce(typed, value.cast("variant"))


def _keys(events: DataFrame) -> dict[str, tuple[str, str]]:
    """Names and types of properties by the ids of their keys."""
    out: dict[str, tuple[str, str]] = {}
    said = lambda name: F.col("attributes")[name]
    told = events.where("kind = 'key'").select(said("id").alias("id"), F.coalesce(said("attr.name"), said("id")).alias("name"), F.coalesce(said("attr.type"), F.lit("string")).alias("kind"))
    for r in told.where("id is not null").distinct().collect():
        own = (r["name"], r["kind"])
        require(out.setdefault(r["id"], own) == own, f"documents that are read together must agree on key {r['id']}")
    return out


def _label_and_properties(keys: dict[str, tuple[str, str]], label_name: str, default: str) -> list[Column]:
    """Label and properties (JSON text) of elements; of data with one name the last counts."""
    look_up = lambda known: lambda key: F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key) if known else F.lit(None).cast("string")
    name_of, kind_of = look_up({k: name for k, (name, _) in keys.items()}), look_up({k: kind for k, (_, kind) in keys.items() if kind != "string"})
    named = F.transform("data", lambda d: F.struct(F.coalesce(name_of(d["key"]), d["key"]).alias("name"), d["value"].alias("value"), kind_of(d["key"]).alias("kind")))
    last = lambda entries, name: F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))
    label = last(named, F.lit(label_name))["value"]
    entries = F.transform(F.array(named), lambda own: F.transform(
        F.array_remove(F.array_distinct(F.transform(own, lambda e: e["name"])), label_name),
        lambda n: F.transform(F.array(last(own, n)), lambda e: F.struct(n.alias("name"), _coerced(e["value"], e["kind"]).alias("typed")))[0],
    ))[0]
    return [F.when(F.trim(label) != "", label).otherwise(F.lit(default)).alias("label"), F.to_json(F.map_from_entries(entries)).alias("properties")]


def import_graphml(spark: SparkSession, path: str | BinaryIO, options: GraphImportOptions = GraphImportOptions(), xml: GraphMlImportOptions = GraphMlImportOptions(), graph: Graph | None = None, charset: str = "UTF-8") -> tuple[Graph, ImportReport]:
    """Read a document, or a folder of documents with the same keys; values take their keys' types where they fit.

    Files are scanned once (:mod:`lattica.sources.graphml_events`).  A node without id and an edge without an end are recorded and
    left out; the status stays.  Hyperedges, ports and graphs within nodes, edges or graphs are unsupported: the import
    fails, or hyperedges and ports are skipped and what inner graphs hold is read as if it stood outside.
    XML that isn't well nested raises MalformedXmlError.
    """
    began, report, keep = time.time(), ImportReport(Format.GRAPHML), Scratch()
    graph = graph or Graph.empty(spark)
    events = read_events(spark, source(spark, path, ".graphml"), charset, keep)
    if xml.unsupported_element_policy is UnsupportedElementPolicy.FAIL:
        bad = events.where("kind = 'unsupported'").orderBy("file", "block", "n").first()
        if bad is not None:
            report.fail(Failure(Phase.READ_VERTEX, Severity.ERROR, f"Unsupported element {bad['attributes']['tag']}"))
            report.elapsed = time.time() - began
            keep.discard()
            return graph, report
    keys, said = _keys(events), lambda name: F.when(F.trim(F.col("attributes")[name]) != "", F.col("attributes")[name])
    pos = F.struct("file", "block", "n").alias("pos")
    nodes = events.where("kind = 'node'").select(pos, said("id").alias("external_id"), *_label_and_properties(keys, xml.label_attr_name, xml.default_vertex_label))
    links = events.where("kind = 'edge'").select(pos, said("id").alias("external_id"), said("source").alias("from_ext"), said("target").alias("to_ext"), *_label_and_properties(keys, xml.label_attr_name, xml.default_edge_label))
    endless = "from_ext is null or to_ext is null"
    faults = events.where(F.col("kind").isin("node", "edge")).agg(F.count_if((F.col("kind") == "node") & said("id").isNull()).alias("nodes"), F.count_if((F.col("kind") == "edge") & (said("source").isNull() | said("target").isNull())).alias("edges")).first()
    if faults["nodes"]:
        report.reject(Phase.READ_VERTEX, nodes.where("external_id is null"), F.col("external_id"), F.lit("Node has no id"), severity=Severity.ERROR)
    if faults["edges"]:
        report.reject(Phase.READ_EDGE, links.where(endless), F.col("external_id"), F.lit("Edge has no source or target"), severity=Severity.ERROR)
    graph = apply(graph, nodes.where("external_id is not null"), links.where(f"not ({endless})"), options, report, f"x{uuid.uuid4().hex[:8]}:", edges_read=lambda: 0)
    if report.rejected is None:
        keep.discard()  # what was imported is stored by itself
    report.elapsed = time.time() - began
    return graph, report
