"""Where documents come from and go to: paths, or the caller's own streams.

A stream passes through the driver piece by piece and rests in the shared
folder, where the executors read it in parallel.  Streams are flushed, never closed.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyspark.sql import Column, SparkSession, functions as F

from lattica.errors import require
from lattica.plans.storage import fresh_path

_PIECE = 1 << 20


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def source(spark: SparkSession, given: str | BinaryIO, suffix: str = "") -> str:
    """A path as it is; a stream of bytes read to its end and put into a file."""
    if isinstance(given, str):
        return given
    path = fresh_path(spark, "stream") + suffix
    fs, place = _fs(spark, path)
    out = fs.create(place, True)
    try:
        while piece := given.read(_PIECE):
            out.write(bytearray(piece))
    finally:
        out.close()
    return path


def sink(spark: SparkSession, given: str | BinaryIO) -> str:
    """Where to write: the path, or a fresh one for a stream (see :func:`deliver`)."""
    return given if isinstance(given, str) else fresh_path(spark, "stream")


def deliver(spark: SparkSession, path: str, given: str | BinaryIO, header: bool = False) -> None:
    """Copy the files of a folder that was written to the stream, in the order of their names; with ``header`` only the first keeps its first line."""
    if isinstance(given, str):
        return
    fs, place = _fs(spark, path)
    names = sorted(s.getPath().toString() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        data, skipping = fs.open(_fs(spark, name)[1]), header and i > 0
        try:
            while piece := bytes(data.readNBytes(_PIECE)):
                if skipping:
                    _, found, piece = piece.partition(b"\n")
                    skipping = not found
                given.write(piece)
        finally:
            data.close()
    given.flush()
    fs.delete(place, True)


class Staging:
    """Exports are written beside their targets and put in their places together, once all are whole.

    ``with Staging(spark) as staged:`` write to ``staged.folder(target)``.  If anything fails within, the targets are as they were; what has
    been written goes.  With ``append`` files are added to the target instead of taking its place.
    """

    def __init__(self, spark: SparkSession, append: bool = False):
        self.spark, self.append, self.pending = spark, append, []

    def folder(self, target: str) -> str:
        parent, _, name = target.rstrip("/").rpartition("/")
        beside = f"{parent}/_{name}-{uuid.uuid4().hex}" if parent else f"_{name}-{uuid.uuid4().hex}"
        self.pending.append((beside, target.rstrip("/")))
        return beside

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            for beside, target in self.pending:
                self._place(beside, target)
        for beside, _ in self.pending:
            fs, place = _fs(self.spark, beside)
            fs.delete(place, True)

    def _place(self, beside: str, target: str) -> None:
        fs, new = _fs(self.spark, beside)
        there, old = _fs(self.spark, target)[1], _fs(self.spark, f"{beside}-old")[1]
        if self.append and fs.exists(there):
            for status in fs.listStatus(new):
                name = status.getPath().getName()
                if name[0] not in "_.":
                    fs.rename(status.getPath(), _fs(self.spark, f"{target}/{name}")[1])
            return
        if fs.exists(there):
            fs.rename(there, old)
        require(fs.rename(new, there), f"{target} can't be put in its place; it is at {beside}")
        fs.delete(old, True)


def checked_charset(charset: str) -> str:
    """Of text files by lines: one that writes ASCII as ASCII does."""
    require("\n<{,".encode(charset) == b"\n<{,", f"{charset} doesn't hold ASCII as it is")
    return charset


def _utf8(charset: str) -> bool:
    return charset.upper().replace("-", "") == "UTF8"


def encoded(column: Column, charset: str) -> Column:
    """A line as Spark's text writer must get it to write that charset."""
    return column if _utf8(charset) else F.encode(column, checked_charset(charset)).cast("string")


def decoded(column: Column, charset: str) -> Column:
    """A line that Spark's text reader took for UTF-8."""
    return column if _utf8(charset) else F.decode(column.cast("binary"), checked_charset(charset))
