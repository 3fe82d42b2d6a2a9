"""Cypher literals of Python values, and a column form for strings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, functions as F

# What a quoted literal escapes, the backslash first.
ESCAPES = [("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def escape(text: str) -> str:
    for raw, shown in ESCAPES:
        text = text.replace(raw, shown)
    return text


def cypher_name(name: str) -> str:
    """A property's name: as it is if that is safe, else in back quotes."""
    return name if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name) else "`" + name.replace("`", "``") + "`"


def cypher_value(value: Any) -> str:
    """null, bare numbers and booleans, quoted text and ISO dates, lists and maps; anything else as its quoted text."""
    match value:
        case None:
            return "null"
        case bool():
            return "true" if value else "false"
        case int() | float():
            return str(value)
        case datetime() | date():
            return f"'{value.isoformat()}'"
        case Mapping():
            return "{" + ", ".join(f"{cypher_name(str(k))}: {cypher_value(v)}" for k, v in value.items()) + "}"
        case list() | tuple():
            return "[" + ", ".join(map(cypher_value, value)) + "]"
    return f"'{escape(str(value))}'"


def cypher_props(properties: Mapping[str, Any]) -> str:
    return cypher_value(properties) if properties else ""


def cypher_string(column: Column) -> Column:
    """Quoted literal of a string column; null for null."""
    for raw, shown in ESCAPES:
        column = F.replace(column, F.lit(raw), F.lit(shown))
    return F.coalesce(F.concat(F.lit("'"), column, F.lit("'")), F.lit("null"))
