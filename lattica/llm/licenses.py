"""Licence statements: identifier tags with licence expressions, and the phrases of notices.

One Aho-Corasick automaton finds the phrases in the words of a text, another one the tags in its
characters.  What follows a tag is read as a licence expression by a shunting-yard parser, which takes the longest
beginning that is an expression: ``or`` binds least, then ``and``, then
``with``.  Evaluated, an expression says how free the least restricted choice is: the freest of
alternatives, the least free of what holds together, and an exception frees a copyleft licence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lattica.llm.workers import map_batches, pieces

#: Phrases that every scan counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of licences' notices, with SPDX identifiers.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "MIT",
    "licensed under the apache license version 2 0": "Apache-2.0",
    "apache license version 2 0": "Apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "BSD-2-Clause",
    "neither the name of the copyright holder nor the names of its contributors may be used": "BSD-3-Clause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "ISC",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "version 2 of the gnu general public license": "GPL-2.0-only",
    "version 3 of the gnu general public license": "GPL-3.0-only",
    "gnu lesser general public license": "LGPL-3.0-only",
    "gnu affero general public license": "AGPL-3.0-only",
    "mozilla public license version 2 0": "MPL-2.0",
    "eclipse public license": "EPL-2.0",
    "boost software license": "BSL-1.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "creative commons attribution 4 0": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0": "CC-BY-NC-4.0",
    "creative commons zero": "CC0-1.0",
    "released into the public domain": "Unlicense",
}
#: What announces a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "@license", '"license":')
#: SPDX identifiers by how free their use is, from 1 (attribution at most) to 0.
FREEDOM = {
    1.0: ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC0-1.0", "ISC", "MIT", "MIT-0", "PSF-2.0", "Python-2.0", "Unlicense", "Zlib"),
    0.75: ("CDDL-1.0", "CDDL-1.1", "EPL-1.0", "EPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"),
    0.5: ("CC-BY-SA-4.0", "EUPL-1.2", "GPL-1.0", "GPL-2.0", "GPL-3.0"),
    0.25: ("AGPL-3.0", "SSPL-1.0"),
    0.0: ("BUSL-1.1", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-ND-4.0"),
}
#: A licence whose exception is named is as free as this at least.
EXCEPTED = 0.75
#: How sure a finding says that the text is under a licence.
SURE = {"tag": 1.0, "notice": 0.9, "base": 0.6, "unread tag": 0.3}

_KNOWN = {name.lower(): (name, free) for free, names in FREEDOM.items() for name in names}
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_QUOTES = re.compile(r"[ \t\"']*")
_AT_ONCE = 2_000_000
_FINDING = "struct<kind: string, label: string, word: long, text: string>"
_SCHEMA = f"doc_id long, n_words long, findings array<{_FINDING}>, freedom double, score double"


def known(identifier: str) -> tuple[str, float] | None:
    """Canonical spelling and freedom of an SPDX identifier, whatever its case; of ``+``, ``-only`` and ``-or-later`` those of its version."""
    own = identifier.lower()
    stem = re.sub(r"(\+|-only|-or-later)$", "", own)
    if stem not in _KNOWN:
        return None
    name, free = _KNOWN[stem]
    return name + ("-or-later" if own.endswith(("+", "-or-later")) else "-only" if own.endswith("-only") else ""), free


@dataclass
class Expression:
    """text: normalised; labels: its known licences, in order; freedom: None if a licence in it is unknown."""

    text: str
    labels: list[str]
    freedom: float | None


def parse(text: str, at: int = 0) -> Expression | None:
    """The longest licence expression that begins at ``at``, on one line; None if there is none.

    Operators in any case; a name after ``with`` is an exception's.
    """
    output: list[tuple[float | None, bool]] = []  # (freedom, is a name by itself)
    operators: list[str] = []
    said: list[str] = []
    labels: list[str] = []
    complete, operand, depth = None, True, 0

    def reduce() -> None:
        op = operators.pop()
        b, a = output.pop()[0], output.pop()[0]
        if op == "with":
            value = None if a is None else max(a, EXCEPTED)
        else:
            value = None if a is None or b is None else max(a, b) if op == "or" else min(a, b)
        output.append((value, False))

    while m := _TOKEN.match(text, at):
        token = m[1]
        word = token.lower()
        if operand:
            if token == "(" and operators[-1:] != ["with"]:
                operators.append(token)
                depth += 1
            elif token in "()" or word in _BINDS:
                break
            else:
                exception, found = operators[-1:] == ["with"], known(token)
                said.append(token if exception or found is None else found[0])
                if not exception and found is not None:
                    labels.append(found[0])
                output.append((0.0, False) if exception else (found and found[1], True))
                at, operand = m.end(), False
                if not depth:
                    complete = (len(said), len(labels))
                continue
        elif token == ")":
            if not depth:
                break
            while operators[-1] != "(":
                reduce()
            operators.pop()
            depth -= 1
            output[-1] = (output[-1][0], False)
        elif word in _BINDS:
            if word == "with" and not output[-1][1]:
                break
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[word]:
                reduce()
            operators.append(word)
            operand = True
        else:
            break
        said.append(token if token in "()" else word.upper())
        at = m.end()
        if not depth and not operand:
            complete = (len(said), len(labels))
    if complete is None:
        return None
    if operand or depth:
        # what follows the last complete beginning isn't part of it
        return parse(" ".join(said[: complete[0]]))
    while operators:
        reduce()
    return Expression(" ".join(said[: complete[0]]).replace("( ", "(").replace(" )", ")"), labels[: complete[1]], output[0][0])


def _automaton(values: dict[str, object]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for k, v in values.items():
        machine.add_word(k, v)
    machine.make_automaton()
    return machine


#: Bytes as letters: A-Z small; and what isn't a letter, a digit or beyond ASCII as a space.
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in _SMALL)


class Scanner:
    """The two automata. A phrase stands between single spaces; bytes are read as Latin-1, so that places are bytes."""

    def __init__(self) -> None:
        listed = {f" {p} ": ("base", label) for p, label in BASE.items()} | {f" {p} ": ("notice", label) for p, label in NOTICES.items()}
        self.phrases = _automaton({p: (len(p), *v) for p, v in listed.items()})
        self.tags = _automaton({t: len(t) for t in TAGS})

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, str, int, str]]]:
        """Words of a text, and findings (kind, label, word, text) in order of words."""
        spaced = text.translate(_WORDS)
        words = spaced.split()
        joined = b" " + b" ".join(words) + b" "
        out = []
        places = sorted((end + 1 - size, kind, label, size) for end, (size, kind, label) in self.phrases.iter(joined.decode("latin-1")))
        at = before = 0
        for start, kind, label, size in places:
            before += joined.count(b" ", at, start)
            at = start
            out.append((kind, label, before, joined[start + 1 : start + size - 1].decode()))
        small = text.translate(_SMALL).decode("latin-1")
        cased = text.decode("latin-1")
        at = before = 0
        for end, size in self.tags.iter(small):
            start = end + 1 - size
            if small[start].isalnum() and start and spaced[start - 1] != 32:
                continue
            before += len(spaced[at:start].split())
            at = start
            read = parse(cased, _QUOTES.match(cased, end + 1).end())
            if read is None or read.freedom is None:
                labels, said = (read.labels, read.text) if read else ([], "")
                out += [("unread tag", label, before, said) for label in labels or [""]]
            else:
                out += [("tag", label, before, read.text) for label in read.labels]
        return len(words), sorted(out, key=lambda f: (f[2], f[0], f[1]))


def judge(findings: list[tuple[str, str, int, str]]) -> tuple[float | None, float]:
    """(freedom of the least free statement, None where there is none; how sure the surest finding is)."""
    free = []
    for kind, label, _, text in findings:
        if kind == "tag":
            free.append(parse(text).freedom)
        elif kind == "notice":
            free.append(known(label)[1])
    return min(free, default=None), max((SURE[f[0]] for f in findings), default=0.0)


def _scan():
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()),
        ("findings", pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("text", pa.string())]))),
        ("freedom", pa.float64()), ("score", pa.float64()),
    ])

    def run(batches):
        scanner = Scanner()
        for piece in pieces(batches, _AT_ONCE):
            rows = [scanner.scan(t or b"") for t in piece.column("text").cast(pa.binary()).to_pylist()]
            judged = [judge(found) for _, found in rows]
            findings = [[dict(zip(("kind", "label", "word", "text"), f)) for f in found] for _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array(findings, schema.field("findings").type), pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], pa.float64())],
                schema=schema,
            )

    return run, _SCHEMA


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, findings, freedom and score of every text, a row for each row of ``docs``.

    A word is a run of ASCII letters, digits and characters beyond ASCII, in small letters where they are ASCII, numbered from 0.  A finding
    has a kind ("base" and "notice" phrases; "tag", one for each licence of the expression behind it; "unread tag", whose
    expression is missing or names an unknown licence), a label, the number of
    its first word and its text or normalised expression.  freedom is that of the least free statement (null without one),
    score how sure the surest finding is (0 without one).

    Null, empty and blank texts have no word and no finding; rows are looked at one by one, so repeated rows come out alike, null ids do no
    harm and other columns are ignored; an empty table gives none.  Very long texts are read whole, in linear time.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _scan()
    return map_batches(source, run, schema)


def _labels(findings: Column) -> Column:
    named = F.filter(findings, lambda f: f["label"] != "")
    return F.array_join(F.array_sort(F.array_distinct(F.transform(named, lambda f: F.lower(f["label"])))), ",")


def license_report(docs: DataFrame) -> DataFrame:
    """Counts and places of the base phrases, labels of all findings, freedom and score; odd rows as in :func:`scan_licenses`."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    places = F.transform(base, lambda f: f["word"])
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("findings")).alias("labels"),
        "score",
        "freedom",
    )
