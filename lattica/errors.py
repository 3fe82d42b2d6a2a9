"""Errors of the engine; wrong arguments are plain ``ValueError``s."""

import re


class GraphError(RuntimeError):
    """Base of all engine errors."""


class GraphNotFoundError(GraphError):
    pass


class GraphAlreadyExistsError(GraphError):
    pass


class GraphQueryError(GraphError):
    pass


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def require_text(value: str | None, name: str) -> str:
    require(isinstance(value, str) and bool(value.strip()), f"{name} must not be blank")
    return value


def checked_label(label: str) -> str:
    """Labels that are safe inside generated text: a letter or underscore, then letters, digits and underscores."""
    require(bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", label or "")), f"Invalid label: {label}")
    return label
