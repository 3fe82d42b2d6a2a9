"""Token counts by greedy longest match, without building tokens.

A trie of the vocabulary gets failure links: where a walk can go no further,
the link leads to the node from which it goes on after the longest tokens that
are certain have been cut off, and the link's number says how many these are.
A word is walked once, in time linear in its length.
"""

from __future__ import annotations

import json
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lattica.llm.bpe import as_letters
from lattica.llm.workers import map_batches, pieces

_WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")
_MEMO = 500_000
#: Bytes of texts that are counted at once.
_AT_ONCE = 2_000_000
_LOADED: dict = {}


class LongestMatch:
    """The automaton.  ``pieces``: tokens; those that begin with ``mark`` can only open a word, which is mark + its letters."""

    def __init__(self, pieces, mark: str):
        #: Node 0 opens a word, node 1 goes on within it.
        self.mark = mark
        self.next: list[dict[str, int]] = [{}, {}]
        whole = set()
        for piece in pieces:
            node = 0 if piece.startswith(mark) else 1
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                node = self.next[node][c]
            if node > 1:
                whole.add(node)
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if node in whole:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                link, n = self.fail[parent], self.popped[parent]
                while link is not None and c not in self.next[link]:
                    link, n = self.fail[link], n + self.popped[link]
                if link is not None:
                    self.fail[node], self.popped[node] = self.next[link][c], n

    def count(self, word: str) -> int:
        """Tokens of a word; 1 (the unknown token) if it can't be cut into tokens."""
        nodes, fail, popped = self.next, self.fail, self.popped
        node, n = 0, 0
        for c in self.mark + word:
            while c not in nodes[node]:
                if fail[node] is None:
                    return 1
                n += popped[node]
                node = fail[node]
            node = nodes[node][c]
        while node != 1:
            if fail[node] is None:
                return 1
            n += popped[node]
            node = fail[node]
        return n


def automaton(path: str) -> LongestMatch:
    """Of a byte-level vocabulary file: the letter for a space marks tokens that open a word."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {t["content"] for t in model["added_tokens"]}
        _LOADED[path] = LongestMatch([p for p in model["model"]["vocab"] if p not in added], as_letters(" "))
    return _LOADED[path]


class _Counts(dict):
    def __init__(self, machine: LongestMatch):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        self[word] = n = self.machine.count(as_letters(word))
        return n


def _count(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        known = _Counts(automaton(path))
        for piece in pieces(batches, _AT_ONCE):
            n_words, n_tokens = [], []
            for text in piece.column("text").to_pylist():
                words = _WORDS.findall(text or "")
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
                if len(known) > _MEMO:
                    known.clear()
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], schema=schema)

    return run, "doc_id long, n_words long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every text, a row for each row of ``docs``.

    Words are runs of letters and digits; every other character that isn't white
    space is a word of its own.  ``vocabulary`` is the path of a byte-level
    vocabulary file of the tokenizers library.  Null and empty texts have none of either.  Other
    columns are ignored; an empty table gives none.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _count(vocabulary)
    return map_batches(source, run, schema)
