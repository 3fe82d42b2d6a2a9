"""Vector codes: a codebook for each part of the vectors, fitted by Lloyd's rounds with Elkan's bounds.

A vector is cut into parts, and a part is stored as the number of its nearest
codebook entry.  Between rounds every row keeps, for each part, an upper bound of the distance to its
own entry and a lower bound of that to each entry.  When the entries move, bounds are shifted by
as much; an entry is only looked at if neither its lower bound nor half its distance from
the row's entry is *strictly* above the upper bound.  What is looked at is
decided by exact integers, so ties go to the lower index whatever bounds are rounded to.  Bounds are half floats,
upper ones rounded up and lower ones down.

A round is one pass that reads the rows' state and writes the next one to the shared folder.  Each Arrow batch's
change of the entries' sums rides on its first row; Spark adds those up, and what
reaches the driver is one number a component of the codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from lattica.llm.workers import map_batches
from lattica.plans.storage import Scratch

#: What bounds are multiplied by before they are rounded, against the error of square roots and sums.
_MORE, _LESS = 1 + 2.0**-48, 1 - 2.0**-48
_FAR = np.iinfo(np.int64).max


@dataclass
class Codes:
    """rows: id, label, code (bytes, a part each) and error of every kept vector.  codebooks[part][entry]: its components.

    distances: how many were computed in each pass; vectors x parts x entries of them are there.
    """

    rows: DataFrame
    codebooks: list[list[list[int]]]
    distances: list[int] = field(default_factory=list)


def _up(x: np.ndarray) -> np.ndarray:
    """Half floats that aren't below x."""
    x = x * _MORE
    with np.errstate(over="ignore"):
        out = x.astype(np.float16)
        return np.where(out < x, np.nextafter(out, np.float16(np.inf)), out)


def _down(x: np.ndarray) -> np.ndarray:
    """Half floats that aren't above x, from 0."""
    x = np.maximum(x, 0) * _LESS
    with np.errstate(over="ignore"):
        out = x.astype(np.float16)
        return np.where(out > x, np.nextafter(out, np.float16(-np.inf)), out)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("...i,...i->...", gap, gap)


def first_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries, upper and lower bounds by computing every distance, and how many were."""
    d = np.stack([_squared(x, entry) for entry in book], axis=1)
    own = d.argmin(axis=1)
    root = np.sqrt(d.astype(np.float64))
    return own, _up(root[np.arange(len(x)), own]), _down(root), d.size


def next_entries(x: np.ndarray, book: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As :func:`first_entries`, from entries and bounds that hold for this ``book``."""
    half = 0.5 * _LESS * np.sqrt(_squared(book[:, None], book[None]).astype(np.float64))
    upper, lower, own = upper.astype(np.float64), lower.copy(), own.copy()

    def open_(rows):
        u = upper[rows, None]
        out = (u >= lower[rows]) & (u >= half[own[rows]])
        out[np.arange(len(rows)), own[rows]] = False
        return out

    every = np.arange(len(x))
    rows = every[open_(every).any(axis=1)]
    exact = _squared(x[rows], book[own[rows]])
    root = np.sqrt(exact.astype(np.float64))
    upper[rows], lower[rows, own[rows]] = _up(root), _down(root)
    i, j = np.nonzero(open_(rows))
    d = _squared(x[rows[i]], book[j])
    lower[rows[i], j] = _down(np.sqrt(d.astype(np.float64)))
    table = np.full((len(rows), len(book)), _FAR)
    table[i, j] = d
    at = np.arange(len(rows))
    table[at, own[rows]] = exact
    own[rows] = table.argmin(axis=1)
    upper[rows] = _up(np.sqrt(table[at, own[rows]].astype(np.float64)))
    return own, upper.astype(np.float16), lower, len(rows) + len(i)


def _ints(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _bytes(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _fixed(x: np.ndarray) -> pa.Array:
    """A row of bytes for each row."""
    width = x[0].nbytes
    data = np.ascontiguousarray(x).tobytes()
    return pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())


def _pass(books: np.ndarray, moved: np.ndarray | None, last: bool):
    """One assignment. books: parts x entries x components; moved: how far each entry has moved since the state was written (None: there is no state)."""
    parts, entries, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            x = _ints(batch.column("x"), parts * width).reshape(n, parts, width)
            own, upper, lower = np.empty((n, parts), np.uint8), np.empty((n, parts), np.float16), np.empty((n, parts, entries), np.float16)
            sums, counts, computed = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
            if moved is not None:
                old = _bytes(batch.column("code"), np.uint8, parts)
                old_upper, old_lower = _bytes(batch.column("upper"), np.float16, parts), _bytes(batch.column("lower"), np.float16, parts, entries)
            for p in range(parts):
                if moved is None:
                    own[:, p], upper[:, p], lower[:, p], done = first_entries(x[:, p], books[p])
                    changed = np.arange(n)
                else:
                    was = old[:, p].astype(np.int64)
                    own[:, p], upper[:, p], lower[:, p], done = next_entries(
                        x[:, p], books[p], was, _up(old_upper[:, p].astype(np.float64) + moved[p, was]), _down(old_lower[:, p].astype(np.float64) - moved[p])
                    )
                    changed = np.flatnonzero(own[:, p] != was)
                    np.subtract.at(sums[p], was[changed], x[changed, p])
                    np.subtract.at(counts[p], was[changed], 1)
                np.add.at(sums[p], own[changed, p], x[changed, p])
                np.add.at(counts[p], own[changed, p], 1)
                computed += done
            delta = pa.array([np.concatenate([sums.ravel(), counts.ravel(), [computed]]).tolist(), *[None] * (n - 1)], pa.list_(pa.int64()))
            same = [batch.column("vec_id"), batch.column("label")]
            if last:
                error = sum(_squared(x[:, p], books[p][own[:, p]]) for p in range(parts))
                yield pa.RecordBatch.from_arrays([*same, _fixed(own), pa.array(error), delta], names=["vec_id", "label", "code", "error", "delta"])
            else:
                yield pa.RecordBatch.from_arrays([*same, batch.column("x"), _fixed(own), _fixed(upper), _fixed(lower), delta], names=["vec_id", "label", "x", "code", "upper", "lower", "delta"])

    return run


def _total(state: DataFrame, n: int) -> list[int]:
    """Sum of all changes: n numbers."""
    out = [0] * n
    changes = state.where("delta is not null").select(F.posexplode("delta").alias("at", "by"))
    for at, total in changes.groupBy("at").agg(F.sum(F.col("by").cast("decimal(38,0)")).alias("total")).collect():
        out[at] = int(total)
    return out


def kept_vectors(vectors: DataFrame, parts: int = 8, scale: int = 4096) -> DataFrame:
    """vec_id, label and x, the components as integers floor(scale * component), of the vectors that count.

    Left out are null and empty vectors, those with a null or non-finite component or one so large that a squared
    distance wouldn't fit a long (46,340 for 64 components at scale 4,096), and those that can't be cut into equal parts.
    """
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).where("x is not null and size(x) > 0").where(F.size("x") % parts == 0)
    bound = F.sqrt(F.lit(2.0**63) / F.size("x")) / (2 * scale)
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < bound))
    return kept.where(good).withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("long")))


def fit_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of all kept vectors (:func:`kept_vectors`), and the codebooks after ``rounds`` rounds.

    A part's codebook begins as that part of the ``entries`` vectors of smallest vec_id (null ids last; vectors of one id
    by their components); with fewer vectors it has fewer entries.  A round
    gives every part to the nearest entry (squared distance, ties to the lower index) and makes each entry the floor of its parts' mean; an unused
    entry stays.  Vectors that haven't as many components as the first of those are left out.

    Repeated rows count each; null labels and ids stay as they are; other columns are ignored; without a kept
    vector there are no rows and no entries.  A lost executor costs its tasks of one pass.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, parts, scale)
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    kind = StructType([StructField("vec_id", kept.schema["vec_id"].dataType), StructField("label", kept.schema["label"].dataType)])
    seeds = [r.x for r in kept.orderBy(*order).limit(entries).collect()]
    if not seeds:
        out = StructType([*kind, *StructType.fromDDL("code binary, error long")])
        return Codes(spark.createDataFrame([], out), [[] for _ in range(parts)])
    dims = len(seeds[0])
    kept = kept.where(F.size("x") == dims)
    if any(len(s) != dims for s in seeds):
        seeds = [r.x for r in kept.orderBy(*order).limit(entries).collect()]
    width, many = dims // parts, len(seeds)
    books = np.array(seeds, np.int64).reshape(many, parts, width).transpose(1, 0, 2).copy()
    n = parts * many * width
    size = n + parts * many + 1
    totals, moved, scratch, distances = [0] * size, None, Scratch(), []
    state, before = kept, None
    for at in range(rounds + 1):
        last = at == rounds
        rest = "code binary, error long" if last else "x array<long>, code binary, upper binary, lower binary"
        state = scratch.stored(map_batches(state, _pass(books, moved, last), StructType([*kind, *StructType.fromDDL(f"{rest}, delta array<long>")])), "codes")
        if before is not None:
            scratch.discard(before)
        before = state
        change = _total(state, size)
        totals = [a + b for a, b in zip(totals, change)]
        distances.append(change[-1])
        if not last:
            sums, counts = np.array(totals[:n], object).reshape(parts, many, width), np.array(totals[n:-1], object).reshape(parts, many, 1)
            fresh = np.where(counts > 0, sums // np.maximum(counts, 1), books).astype(np.int64)
            moved = np.sqrt(_squared(fresh, books).astype(np.float64)) * _MORE
            books = fresh
    return Codes(state.drop("delta"), books.tolist(), distances)


def code_report(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error (the errors of all vectors of the label, nulls together) and a digest of the codebooks.

    Odd rows as in :func:`fit_codes`.
    """
    codes = fit_codes(vectors, parts, entries, rounds, scale)
    listed = ",".join(str(v) for book in codes.codebooks for entry in book for v in entry)
    by_label = codes.rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return codes.rows.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256")
    )
