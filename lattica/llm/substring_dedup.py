"""Removal of repeated passages, with a count-min prefilter.

Texts are gathered into blocks of bounded size.  Each window of words has an
anchor: the least hash of its 8-word runs, the same wherever the window stands,
so a window never stands more often than its anchor.

1. Count-min: SKETCH rows of counters, as many in a row as the input's size
   asks for.  Every anchor adds the places it has to one counter of each row.  The sketch of
   a partition is the map side of an aggregation by counter, which merges sketches by addition.
   An anchor's least counter overestimates its places, and so its windows' places.
2. Only windows are grouped whose anchor's counters all say two or more: exactly, by
   the anchor's 64 bits and 64 bits of another hash of the whole window.  No
   repeated window is lost: its two places have the same anchor.

All of this is ordinary aggregation, joins and sorts by key, which spill.  What a block
sends are its distinct anchors and distinct windows, so a passage that a third of all documents hold is one
entry of each block.  It gets back one bit for each window.  Blocks
carry their texts through one shuffle, which all steps read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.llm.words import BLOCK_BYTES, U, Words, blocks, shingle
from lattica.llm.workers import map_batches, pieces, small_batches

#: Words of an anchor's run, bytes of text in a block.
RUN, BLOCK_TEXT = 8, 8_000_000
#: Rows of the sketch, bytes of input for each counter of a row, and bounds of the logarithm of a row's size.
SKETCH, COUNTER_BYTES, LEAST_BITS, MOST_BITS = 2, 8, 16, 44

_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.list_(pa.binary())), ("anchors", pa.list_(pa.int64())), ("places", pa.list_(pa.int8()))])
_BLOCK_DDL = "block long, doc_ids array<long>, sizes array<int>, texts array<binary>, anchors array<long>, places array<byte>"
_ANCHORS = pa.schema([("block", pa.int64()), ("anchor", pa.int64()), ("places", pa.int64())])
_HOT = pa.schema([("block", pa.int64()), ("anchor", pa.int64()), ("windows", pa.list_(pa.int64()))])
_LOST = "the input isn't the same when read again"


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of all runs of n, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Chunk:
    """Windows and anchors of some texts at once; windows over the end of a text don't count."""

    def __init__(self, texts: list[bytes], k: int):
        self.words, self.k = Words(texts, "plain"), k
        hashes, self.counts = self.words.half(0), self.words.counts
        n, ends = len(hashes), np.cumsum(self.counts)
        end_of = np.repeat(ends, self.counts)
        run = min(RUN, k)
        self.starts, self.anchors, self.runs = np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
        if n < k:
            return
        runs = shingle(hashes, run)
        self.starts = np.flatnonzero(np.arange(n - k + 1) + k <= end_of[: n - k + 1])
        self.anchors = _least(runs, k - run + 1)[self.starts]
        self.runs = runs[np.arange(len(runs)) + run <= end_of[: len(runs)]]

    def places(self) -> np.ndarray:
        """The anchors of all windows, each as often as its run of words stands in the texts, so that repeats within a text count."""
        if not len(self.starts):
            return np.empty(0, U)
        chosen = np.unique(self.anchors)
        at = np.minimum(np.searchsorted(chosen, self.runs), len(chosen) - 1)
        return self.runs[chosen[at] == self.runs]

    def hot(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, anchor, hash) of windows whose anchor is one of the sorted ``anchors``."""
        if not len(anchors) or not len(self.starts):
            return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
        at = np.minimum(np.searchsorted(anchors, self.anchors), len(anchors) - 1)
        own = anchors[at] == self.anchors
        return self.starts[own], self.anchors[own], shingle(self.words.half(1), self.k, 1)[self.starts[own]]


def _chunks(texts: list[bytes], k: int):
    for chunk in blocks([(t,) for t in texts]):
        yield len(chunk), _Chunk([t for t, in chunk], k)


def _gather(k: int):
    def flush(rows: list[tuple], number: int) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        anchors, places = np.unique(np.concatenate([c.places() for _, c in _chunks(texts, k)]), return_counts=True)
        squeeze = zstandard.ZstdCompressor(1)
        # a few texts at a time, so that no value grows with the block
        packed = [squeeze.compress(b"".join(t for t, in c)) for c in blocks([(t,) for t in texts], 1_000_000)]
        ids, sizes = [i for i, _ in rows], [len(t) for t in texts]
        # of its place and its content, so that a block made anew in another way isn't taken for the first
        digest = xxhash.xxh3_64(repr((TaskContext.get().partitionId(), number, ids, sizes)).encode())
        for x in packed:
            digest.update(x)
        row = (digest.intdigest() - (1 << 63), ids, sizes, packed, anchors.view(np.int64), np.minimum(places, 2).astype(np.int8))
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _BLOCK)], schema=_BLOCK)

    def run(batches):
        rows = ((i, t or b"") for p in pieces(batches, BLOCK_BYTES) for i, t in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist()))
        for number, block in enumerate(blocks(rows, BLOCK_TEXT)):
            yield flush(block, number)

    return run


def _anchors(batches):
    for batch in batches:
        for block, anchors, places in zip(batch.column("block").to_pylist(), batch.column("anchors"), batch.column("places")):
            anchors, places = anchors.values, places.values.cast(pa.int64())
            if len(anchors):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchors), block)), anchors, places], schema=_ANCHORS)


class _Block:
    def __init__(self, left: pa.Table, k: int):
        if left.num_rows != 1:
            raise ValueError(f"an answer for a block that isn't there: {_LOST}")
        self.k, self.name = k, left["block"][0].as_py()
        self.ids = left["doc_ids"][0].as_py()
        joined = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in left["texts"][0].as_py())
        cuts = np.cumsum([0, *left["sizes"][0].as_py()]).tolist()
        self.texts = [joined[a:b] for a, b in zip(cuts, cuts[1:])]

    def windows(self, anchors: np.ndarray):
        """Sorted distinct (anchor, window) of the windows with such anchors; their anchors, windows, number within the anchor
        and places (at most 2); and, chunk by chunk, (texts, words per text, starts of windows, their places among the distinct)."""
        chunks, found = [], []
        for size, chunk in _chunks(self.texts, self.k):
            starts, *keys = chunk.hot(anchors)
            chunks.append((size, chunk.counts, starts))
            found.append(keys)
        anchor, window = (np.concatenate([np.empty(0, U), *x]) for x in zip(*found))
        order = np.lexsort((window, anchor))
        anchor, window = anchor[order], window[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])
        at = np.flatnonzero(new)
        number = np.empty(len(anchor), np.int64)
        number[order] = np.cumsum(new) - 1
        anchor, window, twice = anchor[at], window[at], np.diff(at, append=len(new)) > 1
        first = np.flatnonzero(np.diff(anchor, prepend=~anchor[:1]) != 0)
        within = np.arange(len(anchor)) - np.repeat(first, np.diff(first, append=len(anchor)))
        cuts = np.cumsum([len(s) for *_, s in chunks])[:-1]
        return anchor, window, first, within, twice, [(*c, n) for c, n in zip(chunks, np.split(number, cuts))]


def _second(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return _HOT.empty_table()
        block = _Block(left, k)
        anchor, window, first, _, twice, _ = block.windows(np.sort(right["anchor"].to_numpy().view(U)))
        rows = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(anchor)]):
            # windows that stand twice in this block alone are there a second time, behind the others
            rows.append(np.concatenate([window[a:b], window[a:b][twice[a:b]]]).view(np.int64))
        return pa.Table.from_arrays([pa.array(np.full(len(rows), block.name)), pa.array(anchor[first].view(np.int64)), pa.array(rows, pa.list_(pa.int64()))], schema=_HOT)

    return run


def _finish(k: int, whole: bool):
    columns = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if whole else [])]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, k)
        own, part, bits = (right[c].to_numpy() for c in ("anchor", "part", "bits"))
        own = own.view(U)
        anchor, _, _, within, _, chunks = block.windows(np.unique(own))
        # one bit for each distinct window, 64 of an anchor in a row
        answered = {(a, p): b for a, p, b in zip(own.tolist(), part.tolist(), bits.view(U).tolist())}
        masks = np.array([answered.get(x, 0) for x in zip(anchor.tolist(), (within >> 6).tolist())], U)
        repeated = (masks >> (within & 63).astype(U) & U(1)).astype(bool)
        rows, seen = [], 0
        for size, counts, starts, number in chunks:
            starts = starts[repeated[number]]
            cover = np.zeros(int(counts.sum()) + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + k, -1)
            keep = np.cumsum(cover)[:-1] == 0
            ends = np.cumsum(counts)
            removed = counts - np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])])
            for i, text in enumerate(block.texts[seen : seen + size]):
                words = text.split()
                if removed[i]:
                    words = compress(words, keep[ends[i] - counts[i] : ends[i]].tolist())
                kept = b" ".join(words)
                row = (block.ids[seen + i], int(counts[i]), int(removed[i]), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if whole else row)
            seen += size
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], schema=pa.schema(columns))

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * whole


def _row_bits(docs: DataFrame) -> int:
    """Logarithm of a sketch row's counters, from Spark's estimate of the input's size; how good that is decides about the time only."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, (size // COUNTER_BYTES).bit_length()))


def _counter(row: int, bits: int) -> Column:
    """The counter of an anchor in a row of the sketch."""
    return F.shiftrightunsigned(F.xxhash64("anchor", F.lit(row)), 64 - bits) + (row << bits)


def dedup_substrings(docs: DataFrame, window: int = 35, whole: bool = False) -> DataFrame:
    """Remove words covered by windows of ``window`` words that also start elsewhere, in any document or the same one.

    Words are runs of characters other than ASCII white space, unchanged;
    windows are judged on the input.  Returns a row for each row of ``docs``:
    doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one
    space); with ``whole`` also kept, that text.  Null and empty texts have no words.  Repeated
    rows are documents of their own, so their windows are repeated.  Null ids and other columns do
    no harm; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bits = _row_bits(source)
    dealt = map_batches(source, _gather(window), _BLOCK_DDL).repartition(parts, "block")
    anchors = map_batches(dealt, _anchors, "block long, anchor long, places long")
    counters = [_counter(row, bits) for row in range(SKETCH)]
    sketch = anchors.select(F.explode(F.array(*counters)).alias("counter"), "places").groupBy("counter").agg(F.sum("places").alias("places")).where("places > 1").select("counter")
    asked = anchors
    for counter in counters:
        asked = asked.withColumn("counter", counter).join(sketch, "counter", "left_semi").drop("counter")
    hot = dealt.groupBy("block").cogroup(asked.select("block", "anchor").groupBy("block")).applyInArrow(_second(window), "block long, anchor long, windows array<long>")
    # dealt by the anchor alone, which is enough to group by anchor and window
    each = hot.repartition(parts, "anchor").select("block", "anchor", F.posexplode("windows").alias("at", "window"))
    often = F.count("*").over(Window.partitionBy("anchor", "window"))
    repeated = each.withColumn("often", often).where("often > 1")
    bit = F.expr("shiftleft(1L, at % 64)")
    masks = repeated.groupBy("block", "anchor", F.expr("cast(at div 64 as int)").alias("part")).agg(F.bit_or(bit).alias("bits"))
    run, schema = _finish(window, whole)
    return dealt.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(run, schema)
