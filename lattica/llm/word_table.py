"""BPE encoding and decoding through a distinct-word table.

1. Texts are split into words.  A block of documents (a bounded amount of text
   of one task) becomes a small dictionary of its distinct words and, for each
   document, the words' numbers in that dictionary: its words by position.
2. The blocks' dictionaries are dealt out by a hash of the word, so that every
   occurrence of a word in any dictionary meets in one group, where the word is
   encoded once.
3. The ids in use are joined with the table of all ids and their pieces, which
   decode the words; ids and decoded words go back to the blocks.
4. Each block joins them to positions.

Dictionaries and documents share one shuffle by block.  What is dealt out are
distinct words of blocks, not occurrences, in compressed runs: a word that
makes up a third of all text is one entry of each block.  A block is named by
a hash of its content, so a block made anew after a loss in another way can't be
joined to ids meant for the first.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm.bpe import WordBpe
from lattica.llm.packing import pack, unpack
from lattica.llm.workers import map_batches, pieces, small_batches

#: Characters of text in a block (one longer text makes a block of its own).
BLOCK_CHARS = 8_000_000
#: Bytes of texts that are split at once.
_AT_ONCE = 2_000_000

_BLOCK = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
_BLOCK_DDL = "block long, part int, words binary, doc_ids array<long>, counts array<long>, codes binary"
_PART = pa.schema([("part", pa.int32()), ("widths", pa.binary()), ("ids", pa.binary()), ("used", pa.list_(pa.int32()))])
_PART_DDL = "part int, widths binary, ids binary, used array<int>"
_REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("widths", pa.binary()), ("ids", pa.binary()), ("decoded", pa.binary())])
_REPLY_DDL = "block long, part int, widths binary, ids binary, decoded binary"


class _Numerals(dict):
    def __missing__(self, number: int) -> str:
        self[number] = text = str(number)
        return text


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split(path: str, parts: int):
    def flush(ids: list, docs: list[np.ndarray], numbers: _Numbers):
        codes = np.concatenate(docs) if docs else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(codes, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        known = list(numbers)
        words = [known[i] for i in order]
        part_of = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.uint32, len(words))
        packed, belongs = pack(rank[codes]), pack(part_of)
        name = xxhash.xxh3_64_intdigest(packed + "\n".join(words).encode() + repr(ids).encode()) - (1 << 63)
        rows = [(name, -1, belongs, ids, [len(d) for d in docs], packed)]
        squeeze = zstandard.ZstdCompressor(3)
        by_part = np.argsort(part_of, kind="stable")
        cuts = np.searchsorted(part_of[by_part], np.arange(parts + 1))
        for p in np.unique(part_of).tolist():
            own = [words[i] for i in by_part[cuts[p] : cuts[p + 1]]]
            rows.append((name, p, squeeze.compress("\n".join(own).encode()), None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK)], schema=_BLOCK)

    def run(batches):
        bpe = WordBpe.of(path)
        ids, docs, numbers, size = [], [], _Numbers(), 0
        for piece in pieces(batches, _AT_ONCE):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                text = text or ""
                if ids and size + len(text) > BLOCK_CHARS:
                    yield flush(ids, docs, numbers)
                    ids, docs, numbers, size = [], [], _Numbers(), 0
                words = bpe.words(text)
                ids.append(doc_id)
                docs.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(text)
        if ids:
            yield flush(ids, docs, numbers)

    return run


def _dictionaries(batches):
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("part"), 0)).select(["block", "part", "words"])


def _unpacked(table: pa.Table) -> list[list[str]]:
    return [zstandard.ZstdDecompressor().decompress(x).decode().split("\n") for x in table["words"].to_pylist()]


def _encode(path: str):
    def run(table: pa.Table) -> pa.Table:
        """Of one part, from all blocks: each word encoded once, in the words' order, and the ids that are in use."""
        encode = WordBpe.of(path).encode
        ids = [encode(w) for w in sorted(set().union(*_unpacked(table)))]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        row = (table["part"][0].as_py(), pack(np.fromiter(map(len, ids), np.uint32, len(ids))), pack(flat), np.unique(flat).astype(np.int32))
        return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(row, _PART)], schema=_PART)

    return run


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each block the ids and decoded texts of its words of one part."""
    unpacked = _unpacked(left)
    piece_of = dict(zip(right["id"].to_pylist(), right["piece"].to_pylist()))
    row = right.filter(right["ids"].is_valid())
    ids, ends = unpack(row["ids"][0].as_py()).tolist(), np.cumsum(unpack(row["widths"][0].as_py())).tolist()
    words = sorted(set().union(*unpacked))
    if len(words) != len(ends):
        raise ValueError("other words than those encoded: the input isn't the same when read again")
    known = {w: (a, b, " ".join([piece_of[i] for i in ids[a:b]])) for w, a, b in zip(words, [0, *ends], ends)}
    rows, squeeze = [], zstandard.ZstdCompressor(3)
    for block, part, own in zip(left["block"].to_pylist(), left["part"].to_pylist(), unpacked):
        found = [known[w] for w in own]
        flat = np.fromiter(chain.from_iterable(ids[a:b] for a, b, _ in found), np.uint32)
        widths = np.fromiter((b - a for a, b, _ in found), np.uint32, len(found))
        rows.append((block, part, pack(widths), pack(flat), squeeze.compress("\n".join([d for *_, d in found]).encode())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REPLY)], schema=_REPLY)


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """The table of all ids and their pieces."""
    tokenizer = WordBpe.of(path).tokenizer
    return spark.createDataFrame([(i, tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())], "id int, piece string")


def _rebuild(whole: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if whole else [])])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(pc.less(left["part"], 0))
        if not left.num_rows:
            raise ValueError("ids for a block that isn't there: the input isn't the same when read again")
        numerals: dict[int, str] = _Numerals()
        part_of = unpack(left["words"][0].as_py())
        texts, decoded = np.empty(len(part_of), object), np.empty(len(part_of), object)
        widths_of, ids_of = np.zeros(len(part_of), np.int64), np.empty(len(part_of), object)
        order = np.argsort(part_of, kind="stable")
        by_part, met, seen = part_of[order], 0, set()
        for part, widths, ids, shown in zip(*(right[c].to_pylist() for c in ("part", "widths", "ids", "decoded"))):
            if part in seen:  # two blocks with the same content
                continue
            seen.add(part)
            at = order[np.searchsorted(by_part, part) : np.searchsorted(by_part, part, "right")]
            widths, ids = unpack(widths), unpack(ids).tolist()
            ends = np.cumsum(widths).tolist()
            widths_of[at] = widths
            met += len(at)
            shown = zstandard.ZstdDecompressor().decompress(shown).decode().split("\n")
            for word, a, b, text in zip(at.tolist(), [0, *ends], ends, shown):
                own = ids[a:b]
                texts[word] = " ".join([numerals[i] for i in own])
                decoded[word] = text
                if whole:
                    ids_of[word] = own
        if met != len(part_of):
            raise ValueError("a block lacks ids of its words: the input isn't the same when read again")
        texts, decoded = texts.tolist(), decoded.tolist()
        rows = []
        for doc_ids, counts, codes in zip(*(left[c].to_pylist() for c in ("doc_ids", "counts", "codes"))):
            codes, at = unpack(codes), 0
            for doc_id, count in zip(doc_ids, counts):
                own = codes[at : at + count]
                at += count
                total, own = int(widths_of[own].sum()), own.tolist()
                text = " ".join([decoded[c] for c in own])
                row = (doc_id, total, hashlib.sha256(" ".join([texts[c] for c in own]).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                rows.append((*row, [i for c in own for i in ids_of[c]], text) if whole else row)
            break  # further rows are of a block with the same content: they follow as blocks of their own
        out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        return pa.concat_tables([out] * left.num_rows)

    return run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole


def encode_decode(docs: DataFrame, tokenizer: str, whole: bool = False) -> DataFrame:
    """Encode every text by words and decode its ids again.

    ``tokenizer`` is the path of a word-level BPE file of the tokenizers
    library.  Ids are those of its encode(text, add_special_tokens=False)
    without truncation and padding; the decoded text is that of its decode(ids,
    skip_special_tokens=False).  Returns a row for each row of ``docs``: doc_id,
    n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256;
    with ``whole`` also ids and decoded.  Null and empty texts, and those of
    white space, have no ids and decode to the empty text.  Repeated rows,
    null ids and further columns do no harm; an empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    word_parts = max(1, parts // 2)
    dealt = map_batches(source, _split(tokenizer, word_parts), _BLOCK_DDL).repartition(parts, "block")
    words = map_batches(dealt, _dictionaries, "block long, part int, words binary")
    encoded = words.groupBy("part").applyInArrow(_encode(tokenizer), _PART_DDL)
    # as many rows as the vocabulary has, whatever the corpus; a part's words go along with the first of its ids
    table = F.broadcast(pieces_of(spark, tokenizer))
    named = encoded.select("part", "widths", "ids", F.posexplode_outer("used").alias("at", "id")).join(table, "id", "left")
    once = lambda c: F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c)
    named = named.select("part", once("widths"), once("ids"), "id", "piece")
    replies = words.groupBy("part").cogroup(named.groupBy("part")).applyInArrow(_answer, _REPLY_DDL)
    run, schema = _rebuild(whole)
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
