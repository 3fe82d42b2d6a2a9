"""Secret scans with DataFrame expressions only.

Known shapes (assignments to password-like names, access keys, hex runs) are
regular expressions; their places come from splitting the text at the pattern
and adding up lengths.  Other candidates are long runs of key characters: a
window slides over each, its Shannon entropy kept up by incremental counts (one
character enters, one leaves), against a threshold for the window's character
class.  Placeholders and other harmless shapes are on an allow-list; only they
and known shapes are left out of a run, not what they are joined to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The shapes of known secrets, as Java regular expressions.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # what is left of AKIA[A-Z0-9]+ with 20 characters or more
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Kinds by their place in listings; a span of each is kind:start:end.
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Character classes in the order they are tried, with the bits per character a window needs.
CLASSES = [
    ("letters", "^[^0-9]+$", 3.75),  # of a whole piece: words, paths and names are mostly below
    ("hex", "^[0-9a-fA-F]+$", 3.0),
    ("base32", "^[A-Z2-7=]+$", 3.5),
    ("base36", "^[0-9a-z]+$|^[0-9A-Z]+$", 3.6),
    ("base64", "^[A-Za-z0-9+/_=-]+$", 3.75),
]
# Harmless shapes, those that are cut out of a run and those of a whole run.
ALLOWED_PARTS = [
    "(?i:example|placeholder|changeme|dummy|sample|redacted|x{6,})",
    "(?i:abcdefghij|0123456789|1234567890)",
]
ALLOWED_RUNS = [
    "(?i:^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)",
    "^[0-9+/_=-]+$",  # numbers, dates and rules
]
ALLOWED = ALLOWED_PARTS + ALLOWED_RUNS


#: Elements that one fold of a scan goes through: folds copy what they gather, so long arrays are scanned in two levels.
STEP = 64
_SPANS = "array<struct<start:int,end:int>>"


def _bound(value: Column, of) -> Column:
    """``of(value)``, with the value made once: inside the functions over arrays an expression is made again for each element."""
    return F.get(F.transform(F.array(value), of), 0)


def _scan(values: Column, op) -> Column:
    """Running sums or maxima (``op``) of an array of numbers from 0 up."""

    def fold(part):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc, x):
            return _bound(op(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))

        return F.aggregate(part, zero, step, lambda acc: acc["out"])

    def in_parts(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda g: fold(F.slice(v, g * STEP + 1, STEP)))

        def joined(own):
            before = F.concat(F.array(F.lit(0)), fold(F.transform(own, lambda x: F.element_at(x, -1))))
            return F.flatten(_bound(before, lambda b: F.transform(own, lambda x, g: F.transform(x, lambda y: op(y, F.get(b, g))))))

        return _bound(parts, joined)

    return _bound(values, lambda v: F.when(F.size(v) > STEP, in_parts(v)).otherwise(fold(v)))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _places(text: Column, pattern: str, hits: Column) -> Column:
    """Array of (start, end) of all matches, given their texts; code points, end exclusive."""

    def of(x):
        sizes = F.transform(x["hits"], lambda h: F.length(h))
        steps = F.transform(x["hits"], lambda h, i: F.length(F.get(x["gaps"], i)) + F.length(h))
        return F.zip_with(_scan(steps, _plus), sizes, lambda end, size: F.struct((end - size).alias("start"), end.alias("end")))

    return _bound(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits")), of)


def _found(text: Column, pattern: str, hint: str | None = None) -> Column:
    spans = _places(text, pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(text.rlike(hint or pattern), spans).otherwise(F.array().cast(_SPANS))


def _assignments(text: Column) -> Column:
    """Matches whose value has 6 characters or more; shorter ones still use up their text."""
    spans = _places(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long = F.filter(F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= 6, s)), lambda s: s.isNotNull())
    return F.when(text.rlike(ASSIGN_HINT), long).otherwise(F.array().cast(_SPANS))


def _outside(k: Column) -> dict[str, Column]:
    """Of the k-th character of ALPHABET: the classes that a window with it is not of."""
    upper, lower, digit = k < 26, (k >= 26) & (k < 52), (k >= 52) & (k < 62)
    return {
        "hex": ~((k < 6) | (k >= 26) & (k < 32) | digit),
        "base32": ~(upper | (k >= 54) & (k < 60) | (k == ALPHABET.index("="))),
        "lower36": ~(lower | digit),
        "upper36": ~(upper | digit),
        "numbers": upper | lower,
    }


def windows_over(run: Column, digits: Column) -> Column:
    """Array of (start, end): the windows of ``run`` with the entropy of their class, those that overlap or touch as one.

    ``digits``: whether the run has any.
    """
    weigh = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    # what a count of n adds to the sum, for all counts a window can have
    table = F.array(*[F.lit(0.0)] * 2, *[weigh(F.lit(n)) for n in range(2, WINDOW + 1)])
    g = lambda n: F.get(table, n)
    bits = {name: F.lit(bits) for name, _, bits in CLASSES}
    names = list(_outside(F.lit(0)))
    none = F.lit(None).cast("int")
    # for each class the place of the last character outside of it
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"), F.array().cast(_SPANS).alias("done"), *[F.lit(-1).alias(name) for name in names])
    span = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))

    def over_all(chars):
        def step(acc, i):
            enters = F.get(chars, i)
            leaves = F.when(i >= WINDOW, F.get(chars, i - WINDOW)).otherwise(-1)
            a, b = F.get(acc["counts"], enters), F.get(acc["counts"], leaves)
            # if the same character leaves and enters nothing changes
            change = F.when(enters == leaves, 0.0).otherwise(g(a + 1) - g(a) + F.when(leaves >= 0, g(b - 1) - g(b)).otherwise(0.0))
            s = acc["s"] + change
            counts = F.when(enters == leaves, acc["counts"]).otherwise(F.transform(acc["counts"], lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int")))
            out = {name: F.when(outside, i).otherwise(acc[name]) for name, outside in _outside(enters).items()}
            within = {name: out[name] <= i - WINDOW for name in names}
            own = F.when(within["hex"], bits["hex"]).when(within["base32"], bits["base32"]).when(within["lower36"] | within["upper36"], bits["base36"]).otherwise(bits["base64"])
            threshold = F.when(within["numbers"], 9.0).when(digits, own).otherwise(bits["letters"])
            over = (i >= WINDOW - 1) & (F.lit(WINDOW).cast("double") * (F.log2(F.lit(float(WINDOW))) - threshold) - s >= -1e-9)
            apart = over & (i - (WINDOW - 1) > acc["last"])
            return F.struct(
                counts.alias("counts"), s.alias("s"),
                F.when(over & (acc["first"].isNull() | apart), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
                F.when(over, i + 1).otherwise(acc["last"]).alias("last"),
                F.when(apart, F.concat(acc["done"], span(acc["first"], acc["last"]))).otherwise(acc["done"]).alias("done"),
                *[out[name].alias(name) for name in names],
            )

        def close(acc):
            return F.when(acc["first"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], span(acc["first"], acc["last"])))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), zero, step, close)

    numbers = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return _bound(numbers, over_all)


def _pieces(run: Column, cuts: Column) -> Column:
    """What ``cuts`` (spans by start) leave of a run: (start, end) of every piece that holds a window."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    piece = lambda a, b: F.when(b - a >= WINDOW, F.array(F.struct(a.alias("start"), b.alias("end")))).otherwise(none)
    zero = F.struct(run["start"].alias("at"), none.alias("out"))

    def step(acc, cut):
        return F.struct(F.greatest(acc["at"], cut["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], cut["start"])).alias("out"))

    return F.aggregate(cuts, zero, step, lambda acc: F.concat(acc["out"], piece(acc["at"], run["end"])))


def _entropic(text: Column, base: Column, wide: bool) -> Column:
    """High-entropy spans; ``wide`` ones take along the rest of the letters and digits that their ends are in."""
    runs = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    both = F.zip_with(_places(text, CANDIDATE, runs), runs, lambda p, r: F.struct(p["start"].alias("start"), p["end"].alias("end"), r.alias("run")))
    any_of = lambda shapes: "|".join(f"(?:{shape})" for shape in shapes)
    both = F.filter(both, lambda c: ~c["run"].rlike(any_of(ALLOWED_RUNS)))

    def pieces(c):
        # known and harmless shapes are cut out; what they are joined to is looked at on its own
        known = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        known = F.transform(known, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
        harmless = F.transform(_found(c["run"], any_of(ALLOWED_PARTS)), lambda b: F.struct((c["start"] + b["start"]).alias("start"), (c["start"] + b["end"]).alias("end")))
        cuts = F.array_sort(F.concat(known, harmless))
        part = lambda p: F.substring(c["run"], p["start"] - c["start"] + 1, p["end"] - p["start"])
        found = F.transform(_pieces(c, cuts), lambda p: F.struct(p["start"].alias("start"), part(p).alias("run"), part(p).rlike("[0-9]").alias("digits")))
        spans = F.flatten(F.transform(found, window))
        return F.transform(spans, lambda s: widened(s, c)) if wide else spans

    def window(p):
        return F.transform(windows_over(p["run"], p["digits"]), lambda w: F.struct((p["start"] + w["start"]).alias("start"), (p["start"] + w["end"]).alias("end")))

    def widened(s, c):
        a, b = s["start"] - c["start"], s["end"] - c["start"]
        before = F.length(F.regexp_extract(F.substring(c["run"], F.lit(1), a + 1), "[A-Za-z0-9]*+$", 0))
        after = F.length(F.regexp_extract(F.substring(c["run"], b, F.length(c["run"])), "^[A-Za-z0-9]*", 0))
        return F.struct((s["start"] + 1 - F.greatest(before, F.lit(1))).alias("start"), (s["end"] - 1 + F.greatest(after, F.lit(1))).alias("end"))

    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(both, pieces))).otherwise(F.array().cast(_SPANS))


def _ranked(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", wide: bool = False) -> DataFrame:
    """``docs`` with column ``into``: array of (start, kind, end) by start, then kind.

    Kinds are numbers of KINDS; starts and ends are code points, ends exclusive.
    Of each kind spans are leftmost and don't overlap; those of different kinds
    may.  High-entropy spans never overlap known shapes, unless ``wide``: then
    they take along the rest of the letters and digits that their ends are in.  A null text counts as empty and has
    an empty array.  An existing column of that name is replaced.  A row for each row, repeated
    ones alike; an empty table gives none.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    known = F.concat(_ranked(0, _assignments(own)), _ranked(1, _found(own, ACCESS)), _ranked(2, _found(own, HEX)))
    # a separate projection, so that the known spans are made once
    return docs.withColumn(into, known).withColumn(into, F.array_sort(F.concat(into, _ranked(3, _entropic(own, F.col(into), wide)))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 (of the known shapes' spans) and spans (all), a row for each row of ``docs``."""
    found = find_secrets(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in text replaced by ``mark`` (overlapping spans by one); texts without one stay, null too.

    A high-entropy span takes along the rest of the letters and digits that its
    ends are in.  All rows stay, repeated ones alike, and all columns whatever
    their names; an empty table gives none.
    """
    columns = docs.columns
    into = "secrets"
    while into in columns:
        into += "_"
    spans, text = F.col(into), F.col("text")

    def pieces(x):
        # each span that starts behind all before it brings what is between, and a mark
        until = lambda i: F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)
        fresh = F.filter(F.transform(x["spans"], lambda s, i: F.struct(until(i).alias("from"), s["start"].alias("to"))), lambda p: p["to"] >= p["from"])
        kept = F.transform(fresh, lambda p: F.concat(F.substring(text, p["from"] + 1, p["to"] - p["from"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.element_at(x["ends"], -1) + 1, F.length(text)))

    ends = _scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    clean = _bound(F.struct(spans.alias("spans"), ends.alias("ends")), pieces)
    found = find_secrets(docs.withColumn("text", text.cast("string")), into=into, wide=True)
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text)).select(*columns)
