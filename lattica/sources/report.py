"""Reports of imports and exports."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, functions as F

#: Failures a report lists on the driver; counters are always complete, and ``rejected`` has every record left out.
LISTED = 1_000


class Status(Enum):
    COMPLETED = "completed"
    PARTIAL = "partial"
    FAILED = "failed"


class Phase(Enum):
    READ_VERTEX = "read_vertex"
    READ_EDGE = "read_edge"
    CREATE_VERTEX = "create_vertex"
    CREATE_EDGE = "create_edge"


class Severity(Enum):
    WARN = "warn"
    ERROR = "error"


class Format(Enum):
    CSV = "csv"
    NDJSON = "ndjson"
    GRAPHML = "graphml"


@dataclass(frozen=True)
class Failure:
    phase: Phase
    severity: Severity
    message: str
    record_id: str | None = None
    line: int | None = None


@dataclass
class ImportReport:
    format: Format
    status: Status = Status.COMPLETED
    vertices_read: int = 0
    vertices_created: int = 0
    edges_read: int = 0
    edges_created: int = 0
    skipped_vertices: int = 0
    skipped_edges: int = 0
    elapsed: float = 0.0
    failures: list[Failure] = field(default_factory=list)
    #: (phase, record_id, message) of all records that were left out one by one, however many; None if none was.
    rejected: DataFrame | None = None

    def reject(self, phase: Phase, frame: DataFrame, record_id: Column, message: Column, listed: bool = True, severity: Severity = Severity.WARN) -> None:
        """Records left out: all in ``rejected``, the first by position listed as failures; the status stays as it is."""
        found = frame.select(F.lit(phase.value).alias("phase"), record_id.alias("record_id"), message.alias("message"), "pos")
        if listed:
            self.failures += [Failure(phase, severity, r["message"], r["record_id"]) for r in found.orderBy("pos").limit(LISTED).collect()]
        self.rejected = found.drop("pos") if self.rejected is None else self.rejected.union(found.drop("pos"))

    def fail(self, failure: Failure) -> None:
        self.failures.append(failure)
        self.status = Status.FAILED

    def partly(self) -> None:
        if self.status is Status.COMPLETED:
            self.status = Status.PARTIAL


@dataclass
class ExportReport:
    format: Format
    vertices_written: int = 0
    edges_written: int = 0
    elapsed: float = 0.0
    status: Status = Status.COMPLETED
    failures: list[Failure] = field(default_factory=list)
