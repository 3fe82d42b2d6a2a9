"""Language identification with spans of mixed-language text.

Words are scored by byte trigrams (with the spaces around a word), hashed into
a table of fixed size for each learned language.  The script of a word, from
code point ranges, leaves only languages that use it.  Viterbi over the words
of a text with a penalty for each switch labels spans; the language with the
largest share of the text's letters is the text's language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lattica.llm.workers import map_batches, pieces

#: Trigram buckets of a language; labelled rows learned from for each language (a sample by a hash of the text); nats that a switch costs.
BUCKETS, ROWS, SWITCH = 1 << 15, 2_000, 25.0
_NARROW = -1e4
#: A language uses a script if so much of its letters are of it.
_USES = 0.001
#: Bytes of text labelled, and scored, at once; shared out if there are more than 4 languages.
_BLOCK, _SLICE = 5_000_000, 500_000
_ASCII_LETTER = re.compile("[A-Za-z]")
_NO_LETTER = regex.compile(r"[^\x00-\x7f\p{L}\p{M}]")

# First code points of script ranges, and scripts.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def _letters(text: str) -> str:
    """Lower-cased, with a space for all beyond ASCII that is neither a letter nor a mark on one; empty if there is no letter."""
    if not (_ASCII_LETTER.search(text) or any(map(str.isalpha, text))):
        return ""
    return (text if text.isascii() else _NO_LETTER.sub(" ", text)).lower()


def _clean(texts: list[str]) -> np.ndarray:
    """Bytes of all texts that _letters() made, with a space for what is no letter; a space before, between and after texts."""
    return _CLEAN[np.frombuffer((" " + " ".join(texts) + " ").encode(), np.uint8)]


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte but the first and last."""
    x = data.astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(17)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero((data[1:] == 32) != (data[:-1] == 32)) + 1
    return edges[::2], edges[1::2]


def scripts_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script numbers of the words that start there, from their first character."""
    out = np.full(len(starts), _SCRIPT[0])
    beyond = np.flatnonzero(data[starts] >= 0x80)
    if len(beyond):
        b = [data[np.minimum(starts[beyond] + i, len(data) - 1)].astype(np.int32) for i in range(4)]
        low = [x & 63 for x in b]
        point = np.select(
            [b[0] < 0xE0, b[0] < 0xF0],
            [(b[0] & 31) << 6 | low[1], (b[0] & 15) << 12 | low[1] << 6 | low[2]],
            (b[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3],
        )
        out[beyond] = _SCRIPT[np.searchsorted(_STARTS, point, "right") - 1]
    return out


@dataclass
class Model:
    languages: list[str]
    gains: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages: 0, or a large malus


def _counts(batches):
    schema = pa.schema([("lang", pa.string()), ("grams", pa.list_(pa.int64())), ("scripts", pa.list_(pa.int64()))])
    grams, scripts = {}, {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data = _clean([_letters(text)])
            starts, ends = _words(data)
            own = _grams(data)[data[1:-1] != 32]
            grams[lang] = grams.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
            scripts[lang] = scripts.get(lang, 0) + np.bincount(scripts_of(data, starts), weights=ends - starts, minlength=len(SCRIPT_NAMES)).astype(np.int64)
    if grams:
        yield pa.RecordBatch.from_arrays([pa.array(list(grams)), pa.array(list(grams.values()), pa.list_(pa.int64())), pa.array(list(scripts.values()), pa.list_(pa.int64()))], schema=schema)


def _sum(batches):
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])
    for batch in _counts(batches):
        for kind in (1, 2):
            for lang, values in zip(batch.column(0).to_pylist(), batch.column(kind)):
                values = values.values.to_numpy()
                at = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(values[at])], schema=schema)


def learn(labelled: DataFrame, rows: int = ROWS) -> Model:
    """Fit on (text, lang): about ``rows`` different texts of each language at most, those whose hashes are low, and the lowest in any case.

    Rows without a language or a text teach nothing; a text that a language has many times counts once; other columns
    are ignored.  So every language with a text is learned, however many copies it is made of, and takes 128 KB
    of the model, which is broadcast.  An empty table gives a model without languages.
    """
    own = labelled.select("text", "lang", F.xxhash64("text").alias("hash")).where("lang is not null and text is not null")
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n"), F.min("hash").alias("least")).collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), np.float32))
    shares = F.broadcast(labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / max(1, r["n"])), r["least"]) for r in sorted(sizes)], "lang string, share double, least long"))
    drawn = ((F.pmod("hash", F.lit(1 << 20)) / (1 << 20)) < F.col("share")) | (F.col("hash") == F.col("least"))
    sample = own.join(shares, "lang").where(drawn).select("text", "lang").distinct()
    counts = map_batches(sample, _sum, "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
    column = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    for kind, into in ((1, grams), (2, scripts)):
        own = (counts["kind"] == kind).to_numpy()
        into[counts["at"].to_numpy()[own], column[own]] = counts["n"].to_numpy()[own]
    gains = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    gains -= gains.mean(axis=1, keepdims=True)
    uses = scripts >= _USES * scripts.sum(axis=0)
    uses |= ~uses.any(axis=1, keepdims=True)  # a script that no language uses leaves all
    return Model(languages, gains.astype(np.float32), np.where(uses, 0, _NARROW).astype(np.float32))


def _shared(size: int, model: Model) -> int:
    return max(1_000, size * 4 // max(4, len(model.languages)))


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), len(model.languages)), np.float32)
    at, size = 0, _shared(_SLICE, model)
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + size)))
        base = starts[at] - 1
        gains = model.gains[_grams(data[base : ends[to - 1] + 1])]
        # a word's letters only: the gap up to the next word counts for nothing
        cuts = np.stack([starts[at:to], ends[at:to]], axis=1).reshape(-1) - base - 1
        out[at:to] = np.add.reduceat(np.concatenate([gains, np.zeros((1, gains.shape[1]), np.float32)]), cuts)[::2]
        at = to
    return out + model.allowed[scripts_of(data, starts)]


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each word; ``counts`` cuts the rows of ``scores`` into texts.  All texts advance together."""
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    labels = np.zeros(len(scores), np.int32)
    if not len(order):
        return labels
    begin, length = first[order], counts[order]
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # texts longer than t
    stays = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int32)
    best = scores[begin].astype(np.float64)
    for t in range(1, length[0]):
        n = active[t]
        at = begin[:n] + t
        now = best[:n]
        top = now.argmax(axis=1)
        switch = now[np.arange(n), top][:, None] - penalty
        stays[at] = keep = now >= switch
        source[at] = top
        best[:n] = np.where(keep, now, switch) + scores[at]
    state = best.argmax(axis=1)
    labels[begin + length - 1] = state
    for t in range(length[0] - 1, 0, -1):
        n = active[t]
        at = begin[:n] + t
        own = state[:n]
        own = np.where(stays[at, own], own, source[at])
        state[:n] = own
        labels[at - 1] = own
    return labels


def _predict(m: Model, texts: list[str]) -> list[tuple[str, float, str]]:
    """(language, share, spans) of each text of a block."""
    texts = [_letters(t) for t in texts]
    size = len(m.languages)
    bounds = np.cumsum([len(t.encode()) + 1 for t in texts]) + 1
    data = _clean(texts)
    starts, ends = _words(data)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    labels = viterbi(word_scores(m, data, starts, ends), counts) if size and len(starts) else np.zeros(len(starts), np.int32)
    inner = np.flatnonzero(data & 0xC0 == 0x80)  # characters count, not bytes
    lengths, out = ends - starts - np.searchsorted(inner, ends) + np.searchsorted(inner, starts), []
    for end, n in zip(np.cumsum(counts), counts):
        if not n or not size:
            out.append(("und", 0.0, ""))
            continue
        own = labels[end - n : end]
        share = np.bincount(own, lengths[end - n : end], size)
        top = int(share.argmax())
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(n)]
        spans = ",".join(f"{m.languages[own[a]]}:{a}:{b}" for a, b in zip(cuts, cuts[1:]))
        out.append((m.languages[top], float(share[top] / share.sum()), spans))
    return out


def _label(model):
    columns = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.string())]

    def run(batches):
        m = model.value
        for piece in pieces(batches, _shared(_BLOCK, m)):
            found = _predict(m, [t or "" for t in piece.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), *(pa.array(c, t) for c, (_, t) in zip(zip(*found), columns[2:]))], schema=pa.schema(columns))

    return run, "doc_id long, held_out boolean, lang_pred string, score double, spans string"


def keep_identified(docs: DataFrame, model: Model, share: float) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least that share of its letters, as they are; nothing is shuffled.

    Null texts and texts without a letter go, repeated rows go or stay alike,
    further columns come along whatever their names; an empty table gives none,
    and so does a model without languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for piece in pieces(batches, _shared(_BLOCK, m)):
            found = _predict(m, [t or "" for t in piece.column("text").to_pylist()])
            yield piece.filter(pa.array([lang != "und" and score >= share for lang, score, _ in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Label every text: doc_id, held_out (passed through, false if docs has none), lang_pred, score, spans.

    score is the share of the text's letters in spans of lang_pred; spans lists
    ``language:first word:end word`` in order.  ``und`` with score 0 and no
    spans stands for a null text, a text without a letter (as str.isalpha()
    says: other numerals, dashes and emoji are none), and any text if
    nothing was learned.  Ties go to the first language by name.  A row for each
    row of ``docs``, repeated ones alike; other columns are ignored; an empty table gives none.
    """
    held = F.col("held_out") if "held_out" in docs.columns else F.lit(False)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    run, schema = _label(docs.sparkSession.sparkContext.broadcast(model))
    return map_batches(source, run, schema)


def held_out(doc_id: str = "doc_id"):
    """Documents kept from learning: crc32 of the id's text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from documents that are not held out and have an id and a language, then label all; see :func:`identify`."""
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(own.select("doc_id", "held_out", "text"), learn(own.where("not held_out and doc_id is not null")))
