"""Periodic runs, vector codes and license scans against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import licenses, runs, vector_codes

ODD = [None, "", " \t\n", "one", "a a a a a a", "a a a a a", "ab ab ab cd ab ab ab ab ab ab", "é É é É é É é É", "x\u0085x x\u0085x x\u0085x x\u0085x x\u0085x x\u0085x", "ha " * 3000, "日本 " * 7 + "語", "\x00 \x00 \x00 \x00 \x00 \x00 \x00"]


def brute_runs(words, min_length, min_exponent):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_length, min_exponent * q):
                found.setdefault((start, i - start + q), q)  # smaller periods come first
            i += i == start
    return sorted((s, q, n) for (s, n), q in found.items())


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(800):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(rng.choice([8, 30, 90])), rng.choice([1, 2, 2, 3, 5])
            d = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.4:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 11)
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
            docs.append(d)
        least, exponent = rng.choice([(6, 4), (6, 4), (2, 2), (1, 3)])
        of, start, length, period = runs.find_runs(np.array([x for d in docs for x in d], np.int32), np.array([len(d) for d in docs]), least, exponent)
        got = [[] for _ in docs]
        for o, *r in zip(of.tolist(), start.tolist(), period.tolist(), length.tolist()):
            got[o].append(tuple(r))
        assert got == [brute_runs(d, least, exponent) for d in docs]


def words_of(text):
    return (text or "").encode().split()


def brute_report(doc_id, text):
    w = words_of(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w, 6, 4)
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, q, n in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *((top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4), sha(listed.encode()), sha(kept))


def test_run_report(spark):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(150))) for _ in range(150))]
    rows = [(7 * i - 20, t, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[40], (None, "p q p q p q p q", "x", 1), (None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    out = runs.run_report(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(brute_report(r[0], r[1])) for r in rows)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5
    assert runs.run_report(docs.where("false")).count() == 0


def test_long_text_and_real_outputs(spark):
    rng = random.Random(6)
    words = [str(rng.randrange(50_000)) for _ in range(700_000)]
    words[300_000:300_000] = ["again", "and"] * 100_000
    out = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), min_exponent=5).first()
    assert [tuple(r) for r in out.runs] == [(300_000, 200_000, 2)] and out.n_words == 900_000
    assert out.collapsed.split(" ") == words[:300_002] + words[500_000:]
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.range(1), min_exponent=1)


# 12 --------------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, lab, [int(np.floor(float(v) * scale)) for v in e]) for i, e, lab in rows if e and len(e) % parts == 0 and all(v is not None and np.isfinite(v) for v in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    if not kept:
        return [], []
    width = len(kept[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[cut[j][p] for j in range(min(entries, len(kept)))] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(p, x[p])[1] for p in range(parts)] for x in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [x[p] for x, o in zip(cut, own) if o[p] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    best = [[near(p, x[p]) for p in range(parts)] for x in cut]
    return [(r[0], r[1], bytes(j for _, j in b), sum(d for d, _ in b)) for r, b in zip(kept, best)], books


def vectors(n, dims, seed, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * 0.2
    if grid:
        x = np.round(x * grid) / grid  # many ties and many alike
    return [(i, [float(np.float32(v)) for v in row], int(i % 5) if i % 7 else None) for i, row in enumerate(x)]


@pytest.mark.parametrize("grid", [None, 2])
def test_codes(spark, grid):
    rows = vectors(230, 16, 1, grid)
    rows += [rows[3], rows[3], (None, rows[9][1], 2), (-5, None, 1), (-6, [], 1), (-7, [0.1] * 15 + [None], 1), (-8, [float("nan")] * 16, 1), (-9, [float("inf")] + [0.0] * 15, 1), (-10, [0.5] * 12, None), (900, [0.5] * 24, None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, x int").repartition(4)
    codes = vector_codes.fit_codes(df, parts=4, entries=6, rounds=5, scale=64)
    want, books = brute_codes(rows, 4, 6, 5, 64)
    assert codes.codebooks == books
    assert sorted(map(repr, ((r.vec_id, r.label, bytes(r.code), r.error) for r in codes.rows.collect()))) == sorted(map(repr, want))


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = vectors(3, 8, 2)
    codes = vector_codes.fit_codes(spark.createDataFrame(rows, schema), parts=2, entries=16, rounds=3)
    want, books = brute_codes(rows, 2, 16, 3, 4096)
    assert codes.codebooks == books and sorted((r.vec_id, r.label, bytes(r.code), r.error) for r in codes.rows.collect()) == want
    none = spark.createDataFrame([(1, None, 2)], schema)
    assert vector_codes.code_report(none).count() == 0 and vector_codes.code_report(none.where("false")).count() == 0


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(size=16) * 0.01).tolist(), None) for i in range(2000)]
    codes = vector_codes.fit_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=8, rounds=4)
    assert codes.distances[0] == 2000 * 2 * 8 and all(d < 0.05 * codes.distances[0] for d in codes.distances[1:])


def test_bounds_are_on_the_safe_side():
    x = np.concatenate([np.sqrt(np.arange(5000.0)), [65504, 65505, 7e4, 1e9, 1e-9]])
    assert (vector_codes._up(x).astype(np.float64) >= x).all() and (vector_codes._down(x).astype(np.float64) <= x).all()


def test_code_report(spark):
    rows = vectors(120, 16, 3)
    out = vector_codes.code_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=8, entries=16, rounds=2)
    want, books = brute_codes(rows, 8, 16, 2, 4096)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    told = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    assert sorted(map(tuple, out.collect())) == sorted((i, code.hex(), error, sums[label], told) for i, label, code, error in want)


# 13 --------------------------------------------------------------------------------------------------------------

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute_base(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", small)
    found = [(i, label) for i in range(len(w)) for phrase, label in PHRASES.items() if tuple(w[i : i + len(phrase)]) == phrase]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


LICENSED = [
    "MIT License MIT license, mit-LICENSE", "The Apache\nLicense, Version 2.0", "GNU General Public License general public license", "mitlicense permit license é license", "MİT license mıt license ÉMIT license",
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\nmore", "x SPDX-License-Identifier: Unknown-1.0", 'spdx-license-identifier:', '{"license": "BSD-3-Clause", "x": 1}',
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "SPDX-License-Identifier: MIT and some more words", "aSPDX-License-Identifier: MIT", "mit " * 4000 + "license",
]


def test_base_phrases(spark):
    rng = random.Random(8)
    pieces = ["MIT", "mit", "Apache", "license", "LICENSE", "general", "public", "é", "-", "\n", "x1", "ß"]
    texts = [None, "", " \x00 ", *LICENSED, *("".join(rng.choice(pieces) + rng.choice(["", " ", " ", ", "]) for _ in range(60)) for _ in range(150))]
    rows = [(i, t, "clash", 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "mit license", "x", 1.0), (None, None, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double").repartition(3)
    out = licenses.license_report(docs)
    got = sorted(map(repr, map(tuple, out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())))
    assert got == sorted(repr((r[0], *brute_base(r[1]))) for r in rows)
    for r in out.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score > 0) >= bool(r.labels)
    assert licenses.license_report(docs.where("false")).count() == 0


def test_findings(spark):
    docs = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    tags = lambda i, kind="tag": [(f.label, f.word, f.text) for f in rows[i].findings if f.kind == kind]
    said = "(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0"
    assert tags(5) == [("Apache-2.0", 0, said), ("GPL-2.0-only", 0, said), ("MIT", 0, said)] and rows[5].freedom == 0.75
    assert tags(6, "unread tag") == [("", 1, "Unknown-1.0")] and tags(7, "unread tag") == [("", 0, "")] and rows[7].score == 0.3
    assert tags(8) == [("BSD-3-Clause", 0, "BSD-3-Clause")] and rows[8].freedom == 1.0 and rows[8].score == 1.0
    assert tags(10, "notice") == [("CC-BY-NC-4.0", 2, "cc by nc 4 0")] and rows[10].freedom == 0.0
    assert tags(12, "unread tag") == [("MIT", 0, "MIT AND some")] and not tags(13) and rows[11].score == 0.6


def brute_expression(tokens):
    """Freedom by recursive descent; IndexError, ValueError or KeyError where it is no expression."""
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom():
        if take() == "(":
            out = some("or")
            if take() != ")":
                raise ValueError
            return out
        name = tokens[at - 1]
        if name in ("and", "or", "with", ")"):
            raise ValueError
        free = licenses.known(name)[1]
        if peek() == "with":
            take()
            if take() in ("and", "or", "with", "(", ")"):
                raise ValueError
            free = max(free, licenses.EXCEPTED)
        return free

    def some(op):
        below = (lambda: some("and")) if op == "or" else atom
        out = below()
        while peek() == op:
            take()
            out = (max if op == "or" else min)(out, below())
        return out

    value = some("or")
    if at < len(tokens):
        raise ValueError
    return value


def test_expressions():
    rng = random.Random(9)
    names = ["MIT", "GPL-2.0-only", "AGPL-3.0", "MPL-2.0", "CC-BY-NC-4.0"]
    good = 0
    for _ in range(20_000):
        tokens = [rng.choice([*names, *names, "and", "or", "with", "(", ")"]) for _ in range(rng.randrange(1, 10))]
        text = " ".join(t.upper() if rng.random() < 0.3 and t in ("and", "or", "with") else t for t in tokens)
        # the longest beginning that is an expression by itself
        want = None
        for n in range(len(tokens), 0, -1):
            try:
                want = (n, brute_expression(tokens[:n]))
                break
            except (IndexError, ValueError):
                continue
        got = licenses.parse(text)
        assert (got is None) == (want is None), text
        if want:
            good += want[0] > 2
            shown = " ".join(t.upper() if t in ("and", "or", "with") else t for t in tokens[: want[0]]).replace("( ", "(").replace(" )", ")")
            assert (got.text, got.freedom) == (shown, want[1]), text
    assert good > 500
    assert licenses.parse("(" * 5000 + "mit" + ")" * 5000).labels == ["MIT"] and licenses.parse("gpl-3.0+").labels == ["GPL-3.0-or-later"]
