"""A DSL that declares labels and their properties; it isn't enforced unless asked for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from lattica.errors import require_text


@dataclass(frozen=True)
class PropertyDef:
    name: str
    type: T.DataType
    allowed: tuple[str, ...] = ()


@dataclass
class _Label:
    label: str
    properties: list[PropertyDef] = field(default_factory=list, kw_only=True)

    def __post_init__(self):
        require_text(self.label, "label")

    def _add(self, name: str, kind: T.DataType, allowed: tuple[str, ...] = ()) -> PropertyDef:
        self.properties.append(PropertyDef(require_text(name, "name"), kind, allowed))
        return self.properties[-1]

    def string(self, name: str) -> PropertyDef:
        return self._add(name, T.StringType())

    def integer(self, name: str) -> PropertyDef:
        return self._add(name, T.IntegerType())

    def long(self, name: str) -> PropertyDef:
        return self._add(name, T.LongType())

    def boolean(self, name: str) -> PropertyDef:
        return self._add(name, T.BooleanType())

    def string_list(self, name: str) -> PropertyDef:
        return self._add(name, T.ArrayType(T.StringType()))

    def json(self, name: str) -> PropertyDef:
        return self._add(name, T.VariantType())

    def local_date(self, name: str) -> PropertyDef:
        return self._add(name, T.DateType())

    def local_datetime(self, name: str) -> PropertyDef:
        return self._add(name, T.TimestampNTZType())

    def enum(self, name: str, values) -> PropertyDef:
        return self._add(name, T.StringType(), tuple(getattr(v, "name", str(v)) for v in values))

    def to_struct(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, p.type, True, {"allowed": list(p.allowed)} if p.allowed else {}) for p in self.properties])

    def typed(self, elements: DataFrame) -> DataFrame:
        """Elements of this label with the declared properties as columns of their types (null where a value doesn't fit)."""
        own = elements.where(F.col("label") == self.label)
        if "properties" not in own.columns:
            return own
        columns = [F.try_variant_get("properties", f"$['{p.name}']", p.type.simpleString()).alias(p.name) for p in self.properties]
        return own.select(*[c for c in own.columns if c != "properties"], *columns)

    def violations(self, elements: DataFrame) -> DataFrame:
        """(id, property) of values that don't fit their declared type or allowed values."""
        own = elements.where(F.col("label") == self.label)
        tests = []
        for p in self.properties:
            raw = F.variant_get("properties", f"$['{p.name}']", "variant")
            value = F.try_variant_get("properties", f"$['{p.name}']", p.type.simpleString())
            wrong = F.to_json(raw).isNotNull() & (F.to_json(raw) != "null") & value.isNull()
            if p.allowed:
                wrong = wrong | ~value.isin(*p.allowed)
            tests.append(F.when(wrong, F.lit(p.name)))
        found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
        return own.select("id", F.explode(found).alias("property"))


@dataclass
class VertexLabel(_Label):
    pass


@dataclass
class EdgeLabel(_Label):
    source: VertexLabel
    target: VertexLabel
