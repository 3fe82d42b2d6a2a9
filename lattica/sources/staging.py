"""What importers share: staged records with positions, and the rules on duplicates and missing ends.

"Stop at the first failure" is expressed by positions: the least position of a
bad record is found, and only records before it count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lattica.graph import Graph
from lattica.options import DuplicatePolicy, GraphImportOptions, MissingEndpointPolicy
from lattica.plans.storage import stored_seeing
from lattica.sources.report import Failure, ImportReport, Phase, Severity

#: Staged vertices: pos, external_id, label, properties (JSON text). Staged edges: pos, external_id, label, from_ext, to_ext, properties.
POSITION = "struct<file string, block long, n long>"


class DuplicateVertexError(ValueError):
    pass


def position():
    """Order of records over the files of a read: by file, by part of the file, by place in it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def before(frame: DataFrame, bad) -> tuple[DataFrame, DataFrame | None]:
    """(records before the first bad one, the first bad one as a frame of one row or None)."""
    first = frame.where(bad).orderBy("pos").limit(1)
    row = first.select("pos").first()
    if row is None:
        return frame, None
    limit = F.struct(*[F.lit(v).alias(k) for k, v in row["pos"].asDict().items()])
    return frame.where(F.col("pos") < limit.cast(POSITION)), first


def _with_id(properties, external, name: str | None):
    if not name:
        return properties
    entry = F.create_map(F.lit(name), F.to_json(F.to_variant_object(F.struct(external.alias("v")))))
    own = F.from_json(properties, "map<string,variant>")
    extra = F.transform_values(entry, lambda _, v: F.try_variant_get(F.parse_json(v), "$.v", "variant"))
    merged = F.map_concat(F.map_filter(F.coalesce(own, F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, _: k != name), extra)
    return F.when(external.isNotNull() & (F.trim(external) != ""), F.to_json(merged)).otherwise(properties)


def apply(graph: Graph, vertices: DataFrame, edges: DataFrame, options: GraphImportOptions, report: ImportReport, prefix: str, warn_duplicates: bool = True, edges_read: Callable[[], int] | None = None) -> Graph:
    """Create what the rules allow in a new graph on top of ``graph`` and fill in the report.

    Numbers are taken while tables are written: three jobs, if no rule is broken.
    """
    firsts = vertices.groupBy("external_id").agg(F.min("pos").alias("first"), F.count("*").alias("c"))
    facts = firsts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("ids")).first()
    report.vertices_read += facts["n"]
    kept = vertices
    if facts["n"] > facts["ids"]:
        again = vertices.join(firsts.where("c > 1"), "external_id").where("pos > first")
        if options.on_duplicate_vertex_id is DuplicatePolicy.FAIL:
            raise DuplicateVertexError(f"Duplicate vertex externalId={again.orderBy('pos').select('external_id').first()['external_id']}")
        report.skipped_vertices += facts["n"] - facts["ids"]
        report.reject(Phase.CREATE_VERTEX, again, F.col("external_id"), F.concat(F.lit("Duplicate vertex externalId="), "external_id"), warn_duplicates)
        report.partly()
        kept = vertices.join(firsts.select("external_id", F.col("first").alias("pos")), ["external_id", "pos"], "left_semi")
    new_id = lambda c: F.concat(F.lit(prefix), F.col(c))
    keep = options.preserve_external_id_property
    properties = lambda: F.parse_json(_with_id(F.col("properties"), F.col("external_id"), keep)).alias("properties")
    made, facts = stored_seeing(kept.select(new_id("external_id").alias("id"), "label", properties(), "external_id"), "imported", n=F.count("*"))
    report.vertices_created += facts["n"]
    ids = made.select("external_id")
    known = edges.join(ids.select(F.col("external_id").alias("from_ext"), F.lit(True).alias("has_from")), "from_ext", "left").join(ids.select(F.col("external_id").alias("to_ext"), F.lit(True).alias("has_to")), "to_ext", "left")
    lost = (F.col("has_from").isNull() | F.col("has_to").isNull()).alias("lost")
    number = F.concat(F.lit(prefix + "e"), F.sha2(F.to_json("pos"), 256))
    known = known.select("pos", "external_id", "from_ext", "to_ext", lost, number.alias("id"), "label", new_id("from_ext").alias("src"), new_id("to_ext").alias("dst"), properties())
    known, facts = stored_seeing(known, "staged-edges", n=F.count("*"), lost=F.count_if("lost"))
    message = F.concat(F.lit("Missing endpoint: "), F.coalesce("from_ext", F.lit("null")), F.lit(" -> "), F.coalesce("to_ext", F.lit("null")))
    total, created, good = facts["n"], facts["n"] - facts["lost"], known.where("not lost")
    if facts["lost"] and options.on_missing_edge_endpoint is MissingEndpointPolicy.FAIL:
        good, bad = before(known, F.col("lost"))
        r = bad.select("external_id", message.alias("m")).first()
        report.fail(Failure(Phase.CREATE_EDGE, Severity.ERROR, r["m"], r["external_id"]))
        created = good.count()
        if edges_read is None:  # rows are read as they are created, the bad one too
            total = created + 1
    elif facts["lost"]:
        report.skipped_edges += facts["lost"]
        report.reject(Phase.CREATE_EDGE, known.where("lost"), F.col("external_id"), message)
        report.partly()
    report.edges_read += total
    report.edges_created += created
    new = good.select("id", "label", "src", "dst", "properties")
    return Graph(graph.vertices.unionByName(made.drop("external_id"), allowMissingColumns=True), graph.edges.unionByName(new, allowMissingColumns=True))


def selected(graph: Graph, options) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the labels that an export names; an empty set exports nothing."""
    pick = lambda frame, labels: frame.where(F.col("label").isin(*sorted(labels))) if labels else frame.where("false")
    return pick(graph.vertices, options.vertex_labels), pick(graph.edges, options.edge_labels)


def as_map(frame: DataFrame, fixed: tuple[str, ...], include_empty: bool = True) -> DataFrame:
    """Elements with ``props``: map<string, variant> of all their properties, from the VARIANT or from native columns."""
    kinds = None
    if "properties" in frame.columns:
        props = F.coalesce(F.from_json(F.to_json("properties"), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    else:
        own = [c for c in frame.columns if c not in fixed]
        if include_empty:  # every column is a property of every element
            kinds = {c: KINDS.get(t.split("(")[0], "string") for c, t in frame.dtypes if c in own}
        packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"}) if own else F.lit("{}")
        props = F.from_json(packed, "map<string,variant>")
    if not include_empty:
        props = F.map_filter(props, lambda _, v: F.to_json(v) != "null")
    out = frame.select(*fixed, props.alias("props"))
    out._kinds = kinds
    return out


#: GraphML types of native columns; all others are strings.
KINDS = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "float": "double", "decimal": "double", "boolean": "boolean"}


def kinds_of(frame: DataFrame) -> dict[str, str] | None:
    """Names and types of properties where native columns tell them (see :func:`as_map`), else None."""
    return frame.__dict__.get("_kinds")


def keys_of(frame: DataFrame) -> list[str]:
    """Sorted property names.  They become columns or keys of a document, so they have to fit a plan: names that are data belong into CSV's RAW_JSON or NDJSON, which don't ask for them."""
    known = kinds_of(frame)
    return sorted(known) if known is not None else [r[0] for r in frame.select(F.explode(F.map_keys("props")).alias("k")).distinct().orderBy("k").collect()]


def text_of(key: str):
    """A property as text: strings plain, other values as JSON; null and absent are null."""
    value = F.get(F.map_values(F.map_filter("props", lambda k, _: k == key)), 0)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).when(F.to_json(value) != "null", F.to_json(value))


