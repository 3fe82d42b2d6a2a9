"""Maximal runs of repeated words, by the runs theorem.

A run is a stretch of words with a period that no neighbouring word extends.
Every run holds, as one of its roots, the longest Lyndon word that starts somewhere under
one of two orders: a suffix order and its reverse.  Where such a word ends is the
next smaller (or next greater) value of the inverse suffix array, so there are
at most two candidates a word, and no pair of words is ever compared outside of them:

1. suffix array of a block of texts by prefix doubling; only suffixes not yet
   told apart are sorted again, and the LCP of neighbours falls out of the levels;
2. next smaller and next greater values, by a pyramid of minima;
3. each candidate is extended to the right by the LCP of its two ends (a sparse
   table answers it), and to the left by the same over reversed texts, of which only those are built that
   have a candidate left.

Words are compared whole, not by hashes.  A task holds one block at a time.
"""

from __future__ import annotations

from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lattica.llm.workers import map_batches, pieces

#: Bytes of text whose suffixes are sorted together.
_AT_ONCE = 2_000_000
#: The white space that ends a word.
_WHITE = r"[\x20\x09-\x0D]+"
_RUN = "struct<start: long, length: long, period: long>"
_SCHEMA = f"doc_id long, n_words long, runs array<{_RUN}>, collapsed string"


class _RangeMinimum:
    """Least value of any range: minima from either end of short blocks, and a sparse table over whole blocks."""

    BITS = 5

    def __init__(self, values: np.ndarray):
        self.values = values
        size = 1 << self.BITS
        most = np.iinfo(values.dtype).max
        blocks = np.append(values, np.full(-len(values) % size, most, values.dtype)).reshape(-1, size)
        self.ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(axis=1)]
        step = 1
        while 2 * step <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values[first..last], both included."""
        a, b = first >> self.BITS, last >> self.BITS
        out = np.minimum(self.behind[first], self.ahead[last])
        wide = np.flatnonzero(b - a > 1)
        low, n = a[wide] + 1, (b - a)[wide] - 1
        level = np.frexp(n.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            of = level == k
            at = low[of]
            out[wide[of]] = np.minimum(out[wide[of]], np.minimum(self.table[k][at], self.table[k][at + n[of] - (1 << k)]))
        short = np.flatnonzero(a == b)
        at, end = first[short], last[short]
        least = self.values[at]
        while len(short):
            out[short] = least
            on = at < end
            short, at, end = short[on], at[on] + 1, end[on]
            least = np.minimum(least[on], self.values[at])
        return out


class Suffixes:
    """Suffixes of some sequences of words, in order; each sequence ends with a separator of its own, smaller than all words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        """words: numbers of all words, sequence after sequence; counts: how many each sequence has."""
        self.counts = counts
        self.bases = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]).astype(np.int64)
        n, many = len(words) + len(counts), len(counts)
        ends = self.bases + counts
        self.is_word = np.ones(n, bool)
        self.is_word[ends] = False
        places = np.flatnonzero(self.is_word).astype(np.int32)
        rank = np.empty(n, np.int32)
        rank[ends] = np.arange(many, dtype=np.int32)
        by = np.argsort(words, kind="stable")
        suffix = np.concatenate([ends.astype(np.int32), places[by]])
        words = words[by]
        fresh = np.ones(n, bool)
        fresh[many + 1 :] = words[1:] != words[:-1]
        at = np.arange(n, dtype=np.int32)
        rank[suffix] = np.maximum.accumulate(np.where(fresh, at, 0))
        #: levels[k]: rank by the first 2**k words.
        self.levels = [rank]
        self.lcp = np.zeros(n, np.int32)
        open_ = at[~fresh | np.append(~fresh[1:], False)]
        h = 1
        while len(open_):
            pos = suffix[open_]
            key = (rank[pos].astype(np.int64) << 32) | rank[pos + h]
            by = np.argsort(key)
            key, pos = key[by], pos[by]
            suffix[open_] = pos
            fresh = np.append(True, key[1:] != key[:-1])
            split = np.flatnonzero(fresh[1:] & (key[1:] >> 32 == key[:-1] >> 32)) + 1
            self.lcp[open_[split]] = h + self._common(pos[split - 1] + h, pos[split] + h)
            rank = rank.copy()
            rank[pos] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
            self.levels.append(rank)
            open_ = open_[~fresh | np.append(~fresh[1:], False)]
            h *= 2
        self.place = rank
        self._ranges: _RangeMinimum | None = None

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes that the last level tells apart."""
        out = np.zeros(len(a), np.int32)
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a + out] == self.levels[k][b + out]
            out += same.astype(np.int32) << k
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of different suffixes."""
        if self._ranges is None:
            self._ranges = _RangeMinimum(self.lcp)
        a, b = self.place[a], self.place[b]
        return self._ranges.least(np.minimum(a, b) + 1, np.maximum(a, b))

    def lyndon_ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and (exclusive) ends of the longest Lyndon words that start at each word, under both orders."""
        starts = np.flatnonzero(self.is_word)
        up = next_smaller(self.place, starts)
        down = next_smaller(np.where(self.is_word, -self.place, np.int32(-len(self.place) - 1)), starts)
        # under the reverse order a sequence's end is greater than all words: what runs into it is no Lyndon word
        inner = self.is_word[down]
        return np.concatenate([starts, starts[inner]]), np.concatenate([up, down[inner]])


def next_smaller(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start the next place with a smaller value, which must be there."""
    most = np.iinfo(values.dtype).max
    tree = [values]
    while len(tree[-1]) > 1:
        low = np.append(tree[-1], most) if len(tree[-1]) % 2 else tree[-1]
        tree.append(np.minimum(low[::2], low[1::2]))
    found = []
    of, node, own = np.arange(len(starts)), starts + 1, values[starts]
    while len(of):
        hit = tree[len(found)][node] < own
        found.append((of[hit], node[hit], own[hit]))
        on = ~hit
        of, node, own = of[on], (node[on] + 1) >> 1, own[on]
    of, node, own = (np.empty(0, x.dtype) for x in (of, node, own))
    for level in range(len(found) - 1, -1, -1):
        of, node, own = (np.concatenate(x) for x in zip((of, node, own), found[level]))
        if level:
            node = 2 * node
            node += tree[level - 1][node] >= own
    out = np.empty(len(starts), np.int64)
    out[of] = node
    return out


def find_runs(words: np.ndarray, counts: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """(sequence, start, length, period) of all runs, in this order of sorting (start and period first)."""
    counts = np.asarray(counts, np.int64)
    none = (np.empty(0, np.int64),) * 4
    if not len(words):
        return none
    suffixes = Suffixes(words, counts)
    a, b = suffixes.lyndon_ends()
    first = suffixes.levels[0]
    likely = first[a] == first[b]
    a, b = a[likely], b[likely]
    period, right = b - a, suffixes.common(a, b).astype(np.int64)
    # the first root in a run starts less than a period from the run's start
    enough = right > (min_exponent - 2) * period
    a, b, period, right = a[enough], b[enough], period[enough], right[enough]
    if not len(a):
        return none
    of = np.searchsorted(suffixes.bases, a, "right") - 1
    some, inverse = np.unique(of, return_inverse=True)
    backwards = Suffixes(np.concatenate([first[suffixes.bases[s] : suffixes.bases[s] + counts[s]][::-1] for s in some.tolist()]), counts[some])
    at = a - suffixes.bases[of]
    left = np.zeros(len(a), np.int64)
    more = np.flatnonzero(at)
    mirrored = (backwards.bases[inverse] + counts[of] - at)[more]
    left[more] = backwards.common(mirrored, mirrored - period[more])
    start, length = at - left, left + period + right
    keep = length >= np.maximum(min_length, min_exponent * period)
    found = np.unique(np.stack([of, start, period, length])[:, keep], axis=1)
    return found[0], found[1], found[3], found[2]


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:-1] > 0


def _search(min_length: int, min_exponent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def run(batches):
        for piece in pieces(batches, _AT_ONCE):
            texts = [(t or b"").split() for t in piece.column("text").cast(pa.binary()).to_pylist()]
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            n = int(counts.sum())
            known: dict[bytes, int] = {}
            words = np.fromiter(map(known.setdefault, chain.from_iterable(texts), count()), np.int32, n)
            del known
            of, start, length, period = find_runs(words, counts, min_length, min_exponent)
            offsets = np.searchsorted(of, np.arange(len(texts) + 1))
            for i in np.unique(of).tolist():
                own = slice(offsets[i], offsets[i + 1])
                gone = _covered(len(texts[i]), start[own] + period[own], start[own] + length[own])
                texts[i] = list(compress(texts[i], ~gone))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"]))
            collapsed = pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts), runs, collapsed], schema=schema)

    return run, _SCHEMA


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every text, a row for each row of ``docs``.

    Words are what stands between white space (``\\x20\\x09-\\x0D``), numbered from 0.  A run is a
    longest stretch of words in which words ``period`` apart are alike, its
    smallest period, of ``min_length`` words and ``min_exponent`` (2 or more) periods at least.  The collapsed text has of each
    run the first period only, its words joined by one space.

    Null and empty texts and those of white space have no word, no run and the empty text; rows are looked at one by one, so
    repeated rows come out alike, null ids do no harm and other columns are ignored; an empty table
    gives none.  A text longer than 2 MB is a block of its own: memory grows as its words times the logarithm of their number.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run has two periods at least")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _search(min_length, min_exponent)
    return map_batches(source, run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a run made in a tenth of the texts: with h the crc32 of the id in decimal and g = floor(h / 10), where
    h is divisible by ten and there are n > 0 words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).

    Texts without an id, null and empty ones stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def altered(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.transform(F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p"))), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0), F.size(x["w"]) - 1), lambda i: F.get(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "
        ))[0]

    words = F.filter(F.split("text", _WHITE), lambda w: w != "")
    # bound once, so that the text is split once
    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, altered(w)).otherwise(F.col("text")))[0]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """The longest run of each text with a planted run, and digests of all runs and of the collapsed text.

    Of runs of one length the first counts, then that of the smallest period; texts without a run have nulls there.  Odd
    rows as in :func:`periodic_runs` and :func:`planted`.
    """
    found = periodic_runs(planted(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", "n_words", "runs", "collapsed", longest.alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
