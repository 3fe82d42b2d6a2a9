"""Threshold-scaled sketches of documents, with DataFrame expressions only.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the
hash range, a quarter.  So the sketch of two documents together is the union of theirs, and the share
of the smaller sketch that is in the other estimates containment, however unequal the
documents are: with k hashes in the smaller one the standard error is at most 1 / sqrt(4 k).  Few
hashes say little: a text of fewer than ``EXACT`` shingles is compared on its full shingle set
wherever the other's is at hand too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: One of 2**SCALE hashes is kept; words of a shingle.
SCALE, WORDS = 2, 5
#: Distinct shingles from which on a text is compared by its sketch, which then has some 64 hashes or more: a standard error of at most 0.06.
EXACT = 256
#: Rows of an id range, id ranges from percentiles at most, and ranges that one of these is cut into at most.
RANGE_ROWS, RANGES, CUTS = 250, 2_048, 256
#: Bits of a text's hash that place the rows of one id.
_PLACE = 26


def shingles(text: Column, words: int = WORDS) -> Column:
    """Array of the distinct 64-bit hashes (xxhash64) of lower-cased shingles; a shorter text is one shingle, no words (and null) give none.

    Lower-casing is Spark's ``lower``.
    """
    own = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(tokens):
        n = F.size(tokens)
        # words one by one: a slice joined by concat_ws() takes twice the time of the whole
        run = lambda i: F.concat(*[part for k in range(words) for part in (F.lit(" "), F.get(tokens, i + k))][1:])
        runs = F.when(n >= words, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - words)), lambda i: F.xxhash64(run(i))))
        return runs.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", tokens)))).otherwise(F.array().cast("array<bigint>"))

    # transform() over a one-element array binds a value, so that it is made once
    return F.array_distinct(F.get(F.transform(F.array(own), of), 0))


def sketch(hashes: Column, scale: int = SCALE) -> Column:
    """Sorted array of the hashes below the threshold, of those that :func:`shingles` gives."""
    return F.sort_array(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - scale) == 0) if scale else hashes)  # a shift by 64 is one by 0


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents together, from their sketches of one scale."""
    return F.sort_array(F.array_union(a, b))


def _contained(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).when(F.size(a) == F.size(b), 1.0).otherwise(0.0)


def compared_exactly(n_a: Column, n_b: Column) -> Column:
    """Whether texts of so many distinct shingles are compared on their full sets."""
    return F.least(n_a, n_b) < EXACT


def likeness(a: Column, b: Column, all_a: Column | None = None, all_b: Column | None = None, whole: bool = False) -> Column:
    """Share of the smaller of two sketches that is in the other; 1 for two empty ones, 0 if one is empty.

    With the full shingle sets as well, those are compared if one has fewer than ``EXACT`` shingles, or with ``whole`` in any case.
    """
    if all_a is None or all_b is None:
        return _contained(a, b)
    if whole:
        return _contained(all_a, all_b)
    return F.when(compared_exactly(F.size(all_a), F.size(all_b)), _contained(all_a, all_b)).otherwise(_contained(a, b))


def as_text(a: Column) -> Column:
    """Hashes in 16 hex digits each, in unsigned order."""
    a = F.concat(F.filter(a, lambda h: h >= 0), F.filter(a, lambda h: h < 0))
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _range_of(key: Column, ends: list[float]) -> tuple[Column, Column, Column]:
    """(how many of the sorted ``ends`` are not above the key, the last of them, the next end), by a search in two steps."""
    step = max(1, round(len(ends) ** 0.5))
    parts = [ends[i : i + step] for i in range(0, len(ends), step)]
    arrays = F.array(*[F.array(*map(F.lit, part)) for part in parts])
    upto = lambda own: F.size(F.filter(own, lambda e: e <= key))
    part = F.greatest(upto(F.array(*[F.lit(part[0]) for part in parts])) - 1, F.lit(0))
    n = part * step + upto(F.get(arrays, part))
    at = lambda i: F.get(F.get(arrays, F.floor(i / step).cast("int")), i % step)
    return n, at(n - 1), at(n)


def with_next(docs: DataFrame, made: Column | None = None) -> DataFrame:
    """(doc_id, text, next_text) in ascending doc_id, nulls first; after the last comes the first.

    Rows of one id are in the order of 26 bits of a hash of their text, then of the
    text.  ``made``, an expression over text, comes along as own and next_own: it is evaluated once for a row.

    Rows are dealt to ranges of id and hash from percentiles, each cut evenly if there are
    many rows; so an id that many rows have (or none) is spread over ranges, and
    only rows alike in id and text stay together.  The first row of a range is also put behind the last of the
    range before.  So no task sorts more than some ranges, and nothing but the
    ranges' first ids and hashes reaches the driver.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = F.lit(None).cast("array<bigint>") if made is None else made
    own = own.withColumn("place", F.shiftrightunsigned(F.xxhash64("text"), 64 - _PLACE))
    share = F.col("place") / (1 << _PLACE)
    # the order of (id, place) as one number; where ids are too large for the fraction, equal numbers stay in one range
    key = F.col("doc_id") + share
    facts = own.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    if facts["n"] == 0:
        return own.select("doc_id", "text", made.alias("own"), F.lit("").alias("next_text"), made.alias("next_own"))
    ranges = min(RANGES, -(-facts["ids"] // RANGE_ROWS))
    cuts = min(CUTS, -(-facts["ids"] // (RANGE_ROWS * RANGES * 10)))
    loose = min(RANGES * CUTS, -(-(facts["n"] - facts["ids"]) // RANGE_ROWS))
    bucket = F.floor(share * loose).cast("long") - loose
    if ranges:
        ends = sorted(set(own.agg(F.percentile_approx(key, [i / ranges for i in range(ranges + 1)], 10_000)).first()[0]))
        n, low, high = _range_of(key, ends)
        fine = F.coalesce(F.least(F.floor((key - low) / (high - low) * cuts), F.lit(cuts - 1)), F.lit(0)) if cuts > 1 else F.lit(0)
        bucket = F.when(F.col("doc_id").isNull(), bucket).otherwise(n.cast("long") * cuts + fine.cast("long"))
    dealt = own.withColumn("bucket", bucket)
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "place")).alias("f")).select("bucket", "f.*").orderBy("bucket").collect()
    # of fixed width, at most (RANGES + 2) * CUTS rows with an id and as many without
    before = [(r["bucket"], firsts[i - 1]["bucket"], r["doc_id"], r["place"]) for i, r in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(before, "bucket long, previous long, head long, head_place long"))
    heads = dealt.join(table, (dealt["bucket"] == table["bucket"]) & dealt["doc_id"].eqNullSafe(table["head"]) & (dealt["place"] == table["head_place"]))
    heads = heads.groupBy("previous").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("place"), F.col("previous").alias("bucket"), F.lit(1).alias("extra"))
    rows = dealt.withColumn("extra", F.lit(0)).unionByName(heads).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("extra", F.asc_nulls_first("doc_id"), "place", "text")
    # made behind the shuffle and the sort, so that only texts are moved; the second window finds its rows in order
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("own", made).withColumn("next_own", F.lead("own").over(order))
    return rows.where("extra = 0").select("doc_id", "text", "own", "next_text", "next_own")


def fingerprint_report(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, and their likeness.

    Edited: the last floor(n_chars / 4) code points give way to the first as
    many of the next document (all, if it has fewer).  A fingerprint is the text's sketch, so that of a short text
    may be empty; texts of fewer than ``EXACT`` distinct shingles (counted in n_shingles, edited_shingles and next_shingles)
    are compared on their full sets, which are in the row; with ``whole`` all are.

    Null texts count as empty; rows without an id come first; repeated rows follow each other, and different rows
    of one id are in an order of their texts' hashes.  A very long text is one row like others: its words and hashes are
    arrays in memory, about a dozen times its size.  A row for each row of ``docs``; other columns are ignored; empty in, empty out.
    """
    rows = with_next(docs, shingles(F.col("text")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("following"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", shingles(F.col("edited")).alias("changed"), "following")
    rows = rows.withColumns({f"low_{c}": sketch(F.col(c)) for c in ("own", "changed", "following")})
    like = lambda other: likeness(F.col("low_own"), F.col(f"low_{other}"), F.col("own"), F.col(other), whole)
    counts = [F.size(c).cast("long").alias(name) for c, name in (("own", "n_shingles"), ("changed", "edited_shingles"), ("following", "next_shingles"))]
    prints = [as_text(F.col("low_own")).alias("fingerprint"), as_text(F.col("low_changed")).alias("edited_fingerprint")]
    return rows.select("doc_id", "n_chars", "edited_sha256", *prints, like("changed").alias("near_edited"), like("following").alias("near_next"), *counts)
