"""agtype text: JSON with ::vertex, ::edge and ::path marks, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STEP = "struct<kind string, id string, label string, src string, dst string, properties string>"


def _marked(column: Column, mark: str) -> Column:
    return F.rtrim(column).endswith(f"::{mark}")


def is_vertex(column: Column) -> Column:
    return _marked(column, "vertex")


def is_edge(column: Column) -> Column:
    return _marked(column, "edge")


def is_path(column: Column) -> Column:
    return _marked(column, "path")


def _body(column: Column, mark: str) -> Column:
    text = F.rtrim(column)
    return F.when(_marked(column, mark), F.substring(text, F.lit(1), F.length(text) - len(mark) - 2))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _element(value: Column) -> list[Column]:
    return [_field(value, "id").alias("id"), _field(value, "label").alias("label"), _field(value, "start_id").alias("src"), _field(value, "end_id").alias("dst"), F.to_json(F.try_variant_get(value, "$.properties", "variant")).alias("properties")]


def parse_vertex(column: Column) -> Column:
    """struct(id, label, properties as JSON text); null unless the text is a well-formed vertex."""
    i, label, _, _, properties = _element(F.try_parse_json(_body(column, "vertex")))
    return F.when(_field(F.try_parse_json(_body(column, "vertex")), "id").isNotNull(), F.struct(i, label, properties))


def parse_edge(column: Column) -> Column:
    """struct(id, label, src, dst, properties as JSON text); null unless the text is a well-formed edge."""
    value = F.try_parse_json(_body(column, "edge"))
    return F.when(_field(value, "id").isNotNull(), F.struct(*_element(value)))


def parse_path(column: Column) -> Column:
    """Array of steps, in order, with kind ``vertex`` or ``edge``; null unless the text is a well-formed path."""
    plain = F.regexp_replace(_body(column, "path"), r"\}::(?:vertex|edge)", "}")
    value = F.try_variant_get(F.try_parse_json(plain), "$", "array<variant>")
    return F.transform(value, lambda s: F.struct(F.when(_field(s, "start_id").isNotNull(), F.lit("edge")).otherwise(F.lit("vertex")).alias("kind"), *_element(s)))
