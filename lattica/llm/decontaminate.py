"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Scores are BM25 contributions divided by the score an item gives itself, so
one threshold holds for items of every length.  Postings are cut into blocks
of neighbouring items that also keep only their greatest contribution (block-max).

All passages above a fixed threshold are wanted, so WAND's threshold never
moves, and the passages of a batch are served together.  For each passage
* the lists of its terms are put in order of their maxima; up to the pivot the
  maxima add up to less than a share of the threshold, so a block that only these lists
  are in is never visited, and a passage without a pivot is done;
* the cursors from the pivot on walk their blocks; a block counts with their block
  maxima and the list maxima up to the pivot;
* where that reaches the threshold, the other cursors are moved to the
  block and their block maxima take the place of list maxima;
* only the blocks that still reach it are scored, from their postings.

Passages are pairs of neighbouring tiles.  How long the tiles are depends on the item alone: TILE words, doubled until the
item fits.  A retrieved pair counts only if enough of the item's question and of its
answer (its last sentence, or the last third of a single one) is in the
passage, in runs of three words.  An item of fewer than five words must be
there as a whole, in one run.

The index is broadcast in shards of bounded size, of items with tiles of one length; passages meet every shard, as many shards
in one pass over the documents as GROUP_BYTES allow.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm.words import BLOCK_BYTES, U, distinct, hash_words, shingle
from lattica.llm.workers import map_batches, pieces
from lattica.plans.storage import discard, stored

K1, B = 1.2, 0.75
#: Items of a block, words of a tile at least, items and bytes of a shard, bytes of the shards of one pass.
BLOCK, TILE = 4, 64
SHARD_ITEMS, SHARD_BYTES, GROUP_BYTES = 16_384, 16 << 20, 64 << 20
#: Words of a run that must be found; items of fewer words than SHORT must be found whole.
_RUN, SHORT = 3, 5
#: Share of the threshold that the lists up to the pivot stay below (up to 1): less means more walking and less seeking.
PIVOT = 0.25
#: Sums held at once for blocks that cursors walk.
_TOGETHER = 500_000
_SLACK = 1e-9
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer; of a single sentence the last third of the words."""
    parts = [p for p in _SENTENCE.split(text.strip()) if re.search(r"[^\W_]", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _item_words(batches):
    schema = pa.schema([("item_id", pa.int64()), ("question", pa.list_(pa.int64())), ("answer", pa.list_(pa.int64()))])
    for batch in batches:
        parts = [split_item(t or "") for t in batch.column("text").to_pylist()]
        flat = [p.encode() for pair in parts for p in pair]
        if not flat:
            continue
        hashes, counts = hash_words(flat, "bare")
        lists = [h.view(np.int64) for h in np.split(hashes, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists[::2], pa.list_(pa.int64())), pa.array(lists[1::2], pa.list_(pa.int64()))], schema=schema)


def _runs(hashes: np.ndarray, run: int) -> np.ndarray:
    return distinct(shingle(hashes, min(run, len(hashes)))) if len(hashes) else np.empty(0, U)


class BlockMaxIndex:
    """One shard of the index; plain arrays, so that it pickles well.

    ``items``: (key, hashes of the question's words, of the answer's).  Terms are
    numbered by the maxima of their lists, so that a passage's sorted terms are in the pivot's order.
    """

    def __init__(self, items: list[tuple[object, np.ndarray, np.ndarray]], df: dict[int, int], n_items: int, mean_length: float, tile: int):
        self.tile = tile
        self.keys = [i for i, _, _ in items]
        self.parts, self.runs = [], []
        for _, q, a in items:
            if len(q) + len(a) < SHORT:
                q, a = np.concatenate([q, a]), np.empty(0, U)
            run = _RUN if len(q) + len(a) >= SHORT else len(q)
            self.parts.append((_runs(q, run), _runs(a, run)))
            self.runs.append((min(run, len(q)), min(run, len(a))))
        terms, of, weights = [], [], []
        for k, (_, q, a) in enumerate(items):
            word, tf = np.unique(np.concatenate([q, a]), return_counts=True)
            n = np.array([df[int(w)] for w in word.view(np.int64)], float)
            w = np.log1p((n_items - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(q) + len(a)) / mean_length))
            terms.append(word)
            of.append(np.full(len(word), k))
            weights.append(w / w.sum())
        terms = np.concatenate(terms) if terms else np.empty(0, U)
        of = np.concatenate(of) if of else np.empty(0, int)
        weights = np.concatenate(weights) if weights else np.empty(0)
        self.words, at = np.unique(terms, return_inverse=True)
        most = np.zeros(len(self.words))
        np.maximum.at(most, at, weights)
        by_most = np.argsort(most, kind="stable")
        self.number = np.empty(len(by_most), np.int64)
        self.number[by_most] = np.arange(len(by_most))
        self.most = most[by_most]
        term = self.number[at]
        order = np.lexsort((of, term))
        self.item, self.weight = of[order], weights[order]
        self.n_blocks = max(1, -(-len(items) // BLOCK))
        #: Postings in order of (term, block); blocks of a term with the place of their first posting and their maxima.
        key = term[order] * self.n_blocks + self.item // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, self.first = key[first], np.append(first, len(key))
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.list_at = np.searchsorted(self.key, np.arange(len(self.words) + 1) * self.n_blocks)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers; -1 for words of no item."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.number[at], -1)

    def _seek(self, term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cursors moved to a block each: their places, and which of them are in that block."""
        key = term * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, self.key[at] == key

    def search(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs that reach the threshold, from the sorted distinct (passage, term) of n passages."""
        least = threshold - _SLACK
        most = self.most[term]
        starts = np.searchsorted(passage, np.arange(n + 1))
        summed = np.concatenate([[0.0], np.cumsum(most)])
        upto = summed[1:] - summed[starts[passage]]
        behind = upto >= PIVOT * least  # from the pivot on
        rest = np.bincount(passage[~behind], most[~behind], n)
        walking = np.flatnonzero(np.bincount(passage[behind], minlength=n))
        out = []
        group = max(1, _TOGETHER // self.n_blocks)
        for some in np.split(walking, range(group, len(walking), group)):
            number = np.full(n, -1)
            number[some] = np.arange(len(some))
            own = np.flatnonzero(behind & (number[passage] >= 0))
            at, of = _spread(self.list_at, term[own])
            sums = np.bincount(number[passage[own[of]]] * self.n_blocks + self.key[at] % self.n_blocks, self.top[at], len(some) * self.n_blocks)
            # a block that no walking cursor is in has no sum and can't reach the threshold
            found = np.flatnonzero((sums > 0) & (sums + np.repeat(rest[some], self.n_blocks) >= least))
            if len(found):
                out.append(self._scored(some[found // self.n_blocks], found % self.n_blocks, sums[found], starts, term, behind, threshold))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))

    def _scored(self, passage, block, bound, starts, term, behind, threshold):
        at, of = _spread(starts, passage)
        lagging = ~behind[at]
        where, there = self._seek(term[at[lagging]], block[of[lagging]])
        bound = bound + np.bincount(of[lagging][there], self.top[where[there]], len(block))
        pick = np.flatnonzero(bound >= threshold - _SLACK)
        passage, block = passage[pick], block[pick]
        at, of = _spread(starts, passage)
        where, there = self._seek(term[at], block[of])
        posting, cursor = _spread(self.first, where[there])
        of = of[there][cursor]
        scores = np.bincount(of * BLOCK + self.item[posting] % BLOCK, self.weight[posting], len(pick) * BLOCK)
        hit = np.flatnonzero(scores >= threshold)
        return passage[hit // BLOCK], block[hit // BLOCK] * BLOCK + hit % BLOCK, scores[hit]


def _spread(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the given rows of a compressed table, and which of the given rows each belongs to."""
    width = starts[rows + 1] - starts[rows]
    of = np.repeat(np.arange(len(rows)), width)
    return np.arange(len(of)) + (starts[rows] - np.cumsum(width) + width)[of], of


def _searcher(threshold: float, question: float, answer: float):
    """block_hits(words, index): (text's number, item, score, question overlap, answer overlap, first word) of each hit; words: hashes, and how many each text has."""

    def block_hits(words, ix):
        hashes, counts = words
        tile_words, texts = ix.tile, counts
        tiles_of = np.maximum(1, -(-counts // tile_words))
        first_tile = np.cumsum(tiles_of) - tiles_of
        first_word = np.cumsum(counts) - counts
        doc = np.repeat(np.arange(len(texts)), counts)
        tile = first_tile[doc] + (np.arange(len(hashes)) - first_word[doc]) // tile_words
        term = ix.lookup(hashes)
        known = term >= 0
        tile, term, size = tile[known], term[known], len(ix.words)
        if not len(term):
            return []
        # a tile's terms count for its own passage and for that of the tile before, if that is of the same text
        n = int(tiles_of.sum())
        opens = np.zeros(n, bool)
        opens[first_tile] = True
        shared = ~opens[tile]
        pairs = distinct(np.concatenate([tile * size + term, (tile[shared] - 1) * size + term[shared]]))
        tile_doc = np.repeat(np.arange(len(texts)), tiles_of)
        best: dict[tuple[int, int], tuple] = {}
        for p, k, score in zip(*ix.search(pairs // size, pairs % size, n, threshold)):
            d = int(tile_doc[p])
            start = (p - first_tile[d]) * tile_words
            own = hashes[first_word[d] : first_word[d] + counts[d]][start : start + 2 * tile_words]
            q, a = (np.isin(part, shingle(own, run)).mean() if len(part) else 1.0 for part, run in zip(ix.parts[k], ix.runs[k]))
            if q >= question and a >= answer:
                row = (float(score), float(q), float(a), int(start))
                best[d, k] = max(best.get((d, k), row), row, key=lambda r: (r[0], -r[3]))
        return [(d, k, *row) for (d, k), row in sorted(best.items())]

    return block_hits


def _query(group, search):
    columns = [("doc_id", pa.int64()), ("key", pa.string()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]
    schema = pa.schema(columns)

    def run(batches):
        for piece in pieces(batches, BLOCK_BYTES):
            ids = piece.column("doc_id").to_pylist()
            words = hash_words([t or b"" for t in piece.column("text").to_pylist()], "bare")
            rows = [(ids[d], index.value.keys[k], *row) for index in group for d, k, *row in search(words, index.value)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], schema=schema)

    return run, "doc_id long, key string, score double, question_overlap double, answer_overlap double, first_word long"


def _index(benchmark: DataFrame):
    """(item_id, key) of all items with words, and broadcast shards of the index of the different ones among them, in groups that are made one by one.

    Repeated items are one entry, so a shard's size is bounded by SHARD_ITEMS and
    SHARD_BYTES (or by one item, if that is longer): entries of a tile's length are dealt evenly by a hash of their key.
    """
    spark = benchmark.sparkSession
    parts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = map_batches(parts, _item_words, "item_id long, question array<long>, answer array<long>").withColumn("n", F.size("question") + F.size("answer")).where("n > 0")
    tile = F.when(F.col("n") <= TILE, TILE).otherwise(F.pow(F.lit(2.0), F.length(F.bin(F.col("n") - 1))).cast("int"))
    items = stored(items.withColumn("key", F.sha2(F.concat_ws(" ", F.concat_ws(" ", "question"), F.lit("|"), F.concat_ws(" ", "answer")), 256)).withColumn("tile", tile), "items")

    def groups():
        entries = items.dropDuplicates(["key"]).select("key", "question", "answer", "n", "tile")
        sizes = sorted(entries.groupBy("tile").agg(F.count("*").alias("items"), F.sum("n").alias("words")).collect())
        total, words = sum(r["items"] for r in sizes), sum(r["words"] for r in sizes)
        shards = {r["tile"]: max(1, -(-r["items"] // (SHARD_ITEMS // 2)), -(-32 * r["words"] // (SHARD_BYTES // 2))) for r in sizes}
        count = F.coalesce(*[F.when(F.col("tile") == t, n) for t, n in shards.items()], F.lit(1))
        dealt = entries.withColumn("shard", F.pmod(F.xxhash64("key"), count))
        said = dealt.select("tile", "shard", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("word"))
        df = stored(said.groupBy("word").agg(F.count("*").alias("df")), "df") if sum(shards.values()) > 1 else said.groupBy("word").agg(F.count("*").alias("df"))
        group, held = [], 0
        for length, shard in [(t, i) for t, n in shards.items() for i in range(n)]:
            mine = (F.col("tile") == length) & (F.col("shard") == shard)
            own = dealt.where(mine).orderBy("n", "key").collect()
            seen = {r["word"]: r["df"] for r in df.join(said.where(mine).select("word").distinct(), "word", "left_semi").toLocalIterator()}
            as_hashes = lambda xs: np.array(xs, np.int64).view(U)
            index = BlockMaxIndex([(r["key"], as_hashes(r["question"]), as_hashes(r["answer"])) for r in own], seen, total, words / total, length)
            size = 32 * sum(r["n"] for r in own)
            if group and held + size > GROUP_BYTES:
                yield group
                group, held = [], 0
            group.append(spark.sparkContext.broadcast(index))
            held += size
        if group:
            yield group
        discard(df)

    return items.select("item_id", "key"), groups()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """Pairs (doc_id, item_id) of training documents with a passage that holds a test item.

    Further columns: score (share of the item's own BM25 score), the shares of
    question and answer found, and the passage's first word; the best passage
    of each pair counts.  Words are runs of ASCII letters and digits and of
    characters beyond ASCII, A-Z lower-cased; each character from U+3000 to U+DFFF is a word.  Items without
    words (null and empty ones too) are no evidence and are left out.  Null and empty
    documents match nothing.  Repeated rows of either table give a pair each
    time; other columns are ignored; if a table is empty so is the result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items, groups = _index(benchmark)
    out = None
    for group in [*groups, []]:
        run, schema = _query(group, _searcher(threshold, question, answer))
        if group or out is None:
            hits = map_batches(source, run, schema)
            out = hits if out is None else out.union(hits)
    return out.join(items, "key").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that :func:`contaminated` finds nothing in, as they are; nothing is shuffled.

    Null and empty texts stay, repeated rows stay or go alike, further columns
    come along whatever their names; an empty table gives none, an empty benchmark all rows.
    """
    search = _searcher(threshold, question, answer)

    def without(group):
        def run(batches):
            for piece in pieces(batches, BLOCK_BYTES):
                words = hash_words([(t or "").encode() for t in piece.column("text").to_pylist()], "bare")
                hit = {d for index in group for d, *_ in search(words, index.value)}
                yield piece.filter(pa.array([i not in hit for i in range(piece.num_rows)], pa.bool_()))

        return run

    for group in _index(benchmark)[1]:
        docs = map_batches(docs, without(group), docs.schema)
    return docs
