"""Options of the operators, with their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import SparkSession

from lattica.errors import require, require_text
from lattica.model import Direction

UNBOUNDED = 2**31 - 1


@dataclass(frozen=True)
class NeighborOptions:
    edge_label: str | None = None
    direction: Direction = Direction.OUTGOING
    max_depth: int = 1
    #: Whether the start may be its own neighbour (it is, if a closed walk leads back).
    include_start: bool = True


@dataclass(frozen=True)
class PathOptions:
    edge_label: str | None = None
    max_depth: int = 10
    #: Half paths of one length held at once before the search gives up with an error; no bound unless asked for.
    max_rows: int = 2**63 - 1


@dataclass(frozen=True)
class BfsDfsOptions:
    edge_label: str | None = None
    direction: Direction = Direction.OUTGOING
    max_depth: int = 5
    max_vertices: int = 10_000

    def __post_init__(self):
        require(self.max_depth >= 0, "max_depth must be 0 or more")
        require(self.max_vertices > 0, "max_vertices must be positive")


@dataclass(frozen=True)
class CycleOptions:
    vertex_label: str | None = None
    edge_label: str | None = None
    max_depth: int = 10
    max_cycles: int = 100

    def __post_init__(self):
        require(self.max_depth >= 0, "max_depth must be 0 or more")
        require(self.max_cycles > 0, "max_cycles must be positive")


@dataclass(frozen=True)
class PageRankOptions:
    vertex_label: str | None = None
    edge_label: str | None = None
    iterations: int = 20
    damping_factor: float = 0.85
    tolerance: float = 1e-4
    top_k: int = UNBOUNDED
    tie_digits: int | None = None

    def __post_init__(self):
        require(self.iterations > 0, "iterations must be positive")
        require(self.top_k > 0, "top_k must be positive")
        require(0 <= self.damping_factor <= 1, "damping_factor must be between 0 and 1")


@dataclass(frozen=True)
class DegreeOptions:
    edge_label: str | None = None
    direction: Direction = Direction.BOTH


@dataclass(frozen=True)
class ComponentOptions:
    vertex_label: str | None = None
    edge_label: str | None = None
    weakly: bool = True
    min_size: int = 1


class DuplicatePolicy(Enum):
    FAIL = "fail"
    SKIP = "skip"


class MissingEndpointPolicy(Enum):
    FAIL = "fail"
    SKIP_EDGE = "skip_edge"


@dataclass(frozen=True)
class GraphExportOptions:
    vertex_labels: frozenset[str] = frozenset()
    edge_labels: frozenset[str] = frozenset()
    #: False leaves out null entries and columns that are null throughout.
    include_empty_properties: bool = True

    def __post_init__(self):
        for label in (*self.vertex_labels, *self.edge_labels):
            require_text(label, "label")


@dataclass(frozen=True)
class GraphImportOptions:
    batch_size: int = 1_000
    #: Edges an import may have.  Nothing is buffered here, so there is no bound unless one is asked for.
    max_edge_buffer_size: int | None = None
    on_duplicate_vertex_id: DuplicatePolicy = DuplicatePolicy.FAIL
    on_missing_edge_endpoint: MissingEndpointPolicy = MissingEndpointPolicy.FAIL
    default_vertex_label: str = "Vertex"
    default_edge_label: str = "Edge"
    preserve_external_id_property: str | None = "_graphIoExternalId"

    def __post_init__(self):
        require(self.batch_size > 0, "batch_size must be positive")
        require(self.max_edge_buffer_size is None or self.max_edge_buffer_size > 0, "max_edge_buffer_size must be positive")
        require_text(self.default_vertex_label, "default_vertex_label")
        require_text(self.default_edge_label, "default_edge_label")


class CsvPropertyMode(Enum):
    PREFIXED = "prefixed"
    RAW_JSON = "raw_json"
    NONE = "none"


@dataclass(frozen=True)
class CsvOptions:
    mode: CsvPropertyMode = CsvPropertyMode.PREFIXED
    prefix: str = "prop."
    json_column: str = "properties"

    def __post_init__(self):
        require_text(self.prefix, "prefix")
        require_text(self.json_column, "json_column")


class UnsupportedElementPolicy(Enum):
    SKIP = "skip"
    FAIL = "fail"


@dataclass(frozen=True)
class GraphMlExportOptions:
    label_attr_name: str = "label"
    edge_default: str = "directed"
    graph_id: str = "G"
    encoding: str = "UTF-8"
    #: Type every key as a string, instead of by what its values are.
    legacy_string_types: bool = False
    #: One document in one file, through one task; else each task writes a document.
    one_file: bool = False


@dataclass(frozen=True)
class GraphMlImportOptions:
    label_attr_name: str = "label"
    unsupported_element_policy: UnsupportedElementPolicy = UnsupportedElementPolicy.SKIP
    default_vertex_label: str = "Vertex"
    default_edge_label: str = "EDGE"


@dataclass(frozen=True)
class EngineConfig:
    """What a session needs: the folder of its graphs (None: in memory only) and threads for futures."""

    root: str | None = None
    workers: int = 8

    @classmethod
    def of(cls, spark: SparkSession) -> EngineConfig:
        """From the session's settings lattica.root and lattica.workers."""
        return cls(spark.conf.get("lattica.root", None), int(spark.conf.get("lattica.workers", str(cls.workers))))
