"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find grouping.

Plan
1. One pass over the texts gives each document the size of its shingle set, a
   128-bit digest of that set and the band keys of its SuperMinHash signature.
2. Documents with the same set are one class (copies never meet as pairs).
3. Band keys held by two classes or more are candidates.  In each such bucket
   all are tested against a pivot: the member that shares most buckets, which
   in a group of near copies is its centre.  A bucket of one true group thus
   costs a star, not all its pairs.
4. Small buckets (FEW members) with several groups left are tested pair by pair.  Larger
   ones are gathered into clusters.  A cluster of bounded size goes to one
   task, which counts the intersections of every set outside of the largest group
   with all sets.  A larger one meets by the rarest shingles of its sets: two
   sets that reach the threshold share one of the first n - ceil(threshold * n)
   + 1 in any common order.  There 64, 4096, ... members outside of a bucket's
   main group are tested against all others and taken out, until every bucket is one group.
   No way loses a link between groups; a bucket of unlike texts ends with all its pairs of
   similar size tested.
5. Every tested pair is confirmed on the full shingle sets; confirmed links are
   contracted to components in Spark.

The number of bands is chosen so that a pair right at the threshold shares no
band with a probability below ``miss``.  Linking is a function of the sets
only, so repeated rows and repeated ids are harmless.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lattica.llm.words import BLOCK_BYTES, TABLES, U, Words, mix, shingle_set
from lattica.llm.workers import map_batches, pieces
from lattica.plans.components import star_contract
from lattica.plans.storage import Scratch, stored

_GOLDEN = 0x9E3779B97F4A7C15
#: Bits for each candidate in the filter that spares the other documents the second shingling, and bits of the filter at
#: most (32 MB; a fuller filter only costs time).
FILTER_EACH, FILTER_MOST = 16, 1 << 28
#: Members of a bucket that are tested pair by pair; shingles and members of a cluster that one task settles (24 MB).
FEW, CLUSTER_SHINGLES, CLUSTER_MEMBERS = 8, 3_000_000, 20_000
#: Members of a bucket that meet in one task; columns of a member of a bucket.
SALT_ROWS, _MEMBER = 500, ("key", "salts", "salt", "digest", "n", "weight", "root")
#: Elements whose whole permutations are held at once.
_HELD = 20_000
#: Sets of so few shingles are named by their text: no 64-bit hash decides alone.
_FEW_SHINGLES = 3


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets: one row of m ranks (step in the high, a random number in the low half) each.

    Element x visits the slots in a random order of its own; at step j it
    offers its slot the rank (j, random).  A slot keeps the least rank.  The
    steps end when every slot of a set has a rank below the next step's.  All
    sets advance together; large ones by tracing swaps back (few steps are
    needed), small ones with whole permutations.
    """
    out = np.full((len(sets), m), np.iinfo(U).max, U)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    big = np.flatnonzero(sizes >= m)
    if len(big):
        _large(out, big, np.concatenate([sets[i] for i in big]), np.repeat(big, sizes[big]), m)
    small = np.flatnonzero(sizes < m)
    if len(small):
        group = np.cumsum(sizes[small]) // _HELD
        for g in np.unique(group):
            own = small[group == g]
            _small(out, own, np.concatenate([sets[i] for i in own]), np.repeat(own, sizes[own]), m)
    return out


def _draw(x: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(x + U((j + 1) * _GOLDEN % (1 << 64)))
    return U(j << 32) | (r >> U(32)), ((r & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64) + j


def _open(out: np.ndarray, own: np.ndarray, j: int) -> np.ndarray:
    """Sets that have a slot whose rank step j + 1 could still lower."""
    return own[out[own].max(axis=1) >> U(32) > U(j)]


def _large(out, own, x, of, m):
    swaps: list[np.ndarray] = []
    for j in range(m):
        rank, k = _draw(x, j, m)
        slot = k
        for i in range(j - 1, -1, -1):
            was = swaps[i]
            slot = np.where(slot == was, i, np.where(slot == i, was, slot))
        np.minimum.at(out.reshape(-1), of * m + slot, rank)
        left = _open(out, own, j)
        if not len(left):
            return
        swaps.append(k)
        if len(left) < len(own):
            keep = np.isin(of, left)
            own, x, of, swaps = left, x[keep], of[keep], [s[keep] for s in swaps]


def _small(out, own, x, of, m):
    order = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
    row = np.arange(len(x))
    for j in range(m):
        rank, k = _draw(x, j, m)
        slot = order[row, k]
        order[row, k] = order[:, j]
        np.minimum.at(out.reshape(-1), of * m + slot, rank)
        if j % 4 == 3:
            left = _open(out, own, j)
            if not len(left):
                return
            if len(left) < 0.7 * len(own):
                keep = np.isin(of, left)
                own, x, of, order = left, x[keep], of[keep], order[keep]
                row = np.arange(len(x))


def _digest(s: np.ndarray, text: bytes, k: int) -> bytes | None:
    """128 bits that name the set: of its shingles' hashes, or of the shingles themselves if it has only a few."""
    if len(s) > _FEW_SHINGLES:
        return xxhash.xxh3_128_digest(s.tobytes())
    words = text.translate(TABLES["folded"]).split()
    if not words:
        return None
    own = {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    return xxhash.xxh3_128_digest(b"\n".join(sorted(own)))


def _sets(batches, k: int) -> Iterator[tuple[list, list[np.ndarray], list[bytes | None]]]:
    """(ids, shingle sets, digests of the sets), some texts at a time."""
    for piece in pieces(batches, BLOCK_BYTES):
        texts = [t or b"" for t in piece.column("text").to_pylist()]
        words = Words(texts, "folded")
        hashes, ends = words.half(0), np.cumsum(words.counts)
        sets = [shingle_set(hashes[e - c : e], k) for e, c in zip(ends, words.counts)]
        yield piece.column("doc_id").to_pylist(), sets, [_digest(s, t, k) for s, t in zip(sets, texts)]


def _signatures(k: int, bands: int, rows: int):
    m = bands * rows
    weights = mix(np.arange(1, rows + 1, dtype=U) * U(_GOLDEN)) | U(1)
    salt = mix(np.arange(1, bands + 1, dtype=U))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for ids, sets, digests in _sets(batches, k):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = np.empty((0, bands), np.int64)
            if full:
                sig = super_minhash([sets[i] for i in full], m)
                keys = mix((sig.reshape(-1, bands, rows) * weights).sum(axis=2, dtype=U) + salt).view(np.int64)
            at = dict(zip(full, keys))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array([at.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
            ], schema=schema)

    return run, "doc_id long, n_shingles long, digest binary, bands array<long>"


def _bits(digest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return digest[:, 0] % U(size), digest[:, 1] % U(size)


def _filter_of(digests: DataFrame) -> np.ndarray:
    """A Bloom filter over the digests, or-ed together in Spark; its size, a power of two of bits, follows their number up to FILTER_MOST."""
    size = min(FILTER_MOST, 1 << max(16, (FILTER_EACH * digests.count()).bit_length()))
    hexed = F.hex("digest")
    # the digest's two halves as little-endian numbers modulo the size, as _bits() reads them: only low bytes count
    bit = lambda at: F.conv(F.concat(*[F.substring(hexed, at + 2 * i, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long") % size
    words = digests.select(F.explode(F.array(bit(1), bit(17))).alias("bit")).groupBy(F.expr("bit div 64").alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(U)


def _full_sets(k: int, kept):
    schema = pa.schema([("digest", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        bits = kept.value
        for _, sets, digests in _sets(batches, k):
            found = [(d, s) for d, s in zip(digests, sets) if d is not None]
            if not found:
                continue
            a, b = _bits(np.frombuffer(b"".join(d for d, _ in found), U).reshape(-1, 2), 64 * len(bits))
            hit = ((bits[a >> U(6)] >> (a & U(63))) & (bits[b >> U(6)] >> (b & U(63))) & U(1)).astype(bool)
            found = [x for x, h in zip(found, hit) if h]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], schema=schema)

    return run, "digest binary, shingles array<long>"


def _confirm(percent: int):
    columns = ("a", "b", "ra", "rb")
    schema = pa.schema([(c, pa.binary()) for c in columns])

    def run(batches):
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                yes.append(100 * common >= percent * (len(x) + len(y) - common))
            found = pc.filter(batch.select(list(columns)), pa.array(yes, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, schema=schema)

    return run, "a binary, b binary, ra binary, rb binary"


def _salted(members, digest) -> list:
    """Columns salts (how many parts a bucket of so many members has) and salt (a member's part)."""
    salts = F.ceil(members / SALT_ROWS).cast("int")
    return [salts.alias("salts"), F.pmod(F.xxhash64(digest), salts).cast("int").alias("salt")]


def _meet(left: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined by bucket with facts about buckets, which have salts: the members of a large bucket meet them in several tasks."""
    return left.join(facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["key", "salt"], how)


def _heaviest(left: DataFrame, *by) -> DataFrame:
    """Of each bucket (or part of one) the member with most weight, with columns salts, p_digest, p_n, p_root."""
    heads = left.groupBy(*by).agg(F.max(F.struct("weight", "digest", "n", "root")).alias("p"), F.max("salts").alias("salts"))
    return heads.select("key", "salts", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("digest", "n", "root")])


def _test(keep: Scratch, left: DataFrame, heads: DataFrame, sets: DataFrame, percent: int, tested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs tested, pairs confirmed): all members of a bucket against its heads, if they aren't in one group and can reach the threshold by size."""
    near = f"digest <> p_digest and root <> p_root and 100 * n >= {percent} * p_n and 100 * p_n >= {percent} * n"
    low, high = F.least("digest", "p_digest").alias("a"), F.greatest("digest", "p_digest").alias("b")
    pairs = _meet(left, heads).where(near).select(low, high, F.least("root", "p_root").alias("ra"), F.greatest("root", "p_root").alias("rb")).distinct()
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    pairs = keep.stored(pairs, "pairs")
    x, y = (sets.select(F.col("digest").alias(c), F.col("shingles").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    run, schema = _confirm(percent)
    return pairs, keep.stored(map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "ra", "rb", "x", "y"), run, schema), "links")


def _unsettled(left: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one group."""
    some = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("salts").alias("salts")).where("lo <> hi").select("key", "salts")
    return _meet(left, some, "left_semi").select(*_MEMBER)


def _renamed(left: DataFrame, found: DataFrame) -> DataFrame:
    """``left`` with roots of groups joined by the links found."""
    if left.isEmpty() or found.isEmpty():
        return left
    roots = star_contract(found.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).withColumnRenamed("root", "to")
    return left.join(roots, left["root"] == roots["node"], "left").withColumn("root", F.coalesce("to", "root")).select(*_MEMBER)


def _settle(percent: int):
    """Links that join the groups of one cluster, from its full sets: each set outside of the largest group against all others at once.

    The postings of a set's shingles, counted by document, are its
    intersections with all sets.  A set whose rarest shingles are all its own can't be linked
    (see _rare_shingles) and is passed over.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        digests, roots = table["digest"].to_pylist(), table["root"].to_pylist()
        sets = table["shingles"].combine_chunks()
        sizes = np.diff(sets.offsets.to_numpy())
        of = np.repeat(np.arange(len(sizes)), sizes)
        _, token, often = np.unique(sets.values.to_numpy()[sets.offsets[0].as_py() : sets.offsets[-1].as_py()], return_inverse=True, return_counts=True)
        posted, at, ends = of[np.argsort(token, kind="stable")], np.concatenate([[0], np.cumsum(often)]), np.cumsum(sizes)
        names, group = np.unique(np.array(roots, object), return_inverse=True)
        main, top, links = np.bincount(group).argmax(), np.arange(len(names)), []

        def find(x):
            while top[x] != x:
                x = top[x]
            return x

        for x in np.flatnonzero(group != main):
            own = token[ends[x] - sizes[x] : ends[x]]
            first = sizes[x] - -(-sizes[x] * percent // 100) + 1
            if np.partition(often[own], first - 1)[first - 1] == 1:
                continue
            common = np.bincount(np.concatenate([posted[at[t] : at[t + 1]] for t in own]), minlength=len(sizes))
            for y in np.flatnonzero(100 * common >= percent * (sizes[x] + sizes - common)):
                a, b = find(group[x]), find(group[y])
                if a != b:
                    top[a] = b
                    links.append((min(digests[x], digests[y]), max(digests[x], digests[y])))
        return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in (zip(*links) if links else ([], []))], schema=schema)

    return run, "a binary, b binary"


def _clusters(keep: Scratch, left: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members of clusters too large for one task, links within the others); a cluster is what buckets connect."""
    least = left.groupBy("key").agg(F.min("root").alias("b"), F.max("salts").alias("salts"))
    roots = star_contract(_meet(left, least).select(F.col("root").alias("a"), "b").distinct())
    cluster = keep.stored(left.join(roots.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root"), "clusters")
    members = cluster.groupBy("cluster", "digest").agg(F.max("n").alias("n"), F.max("root").alias("root"))
    weights = members.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count("*").alias("c"))
    light = (F.col("shingles") <= CLUSTER_SHINGLES) & (F.col("c") <= CLUSTER_MEMBERS)
    own = members.join(weights.where(light).select("cluster"), "cluster", "left_semi").join(sets, "digest")
    run, schema = _settle(percent)
    within = keep.stored(own.select("cluster", "digest", "root", "shingles").groupBy("cluster").applyInArrow(run, schema), "links")
    return cluster.join(weights.where(~light).select("cluster"), "cluster", "left_semi").select(*_MEMBER), within


def _rare_shingles(keep: Scratch, left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members of ``left`` in buckets of the rarest shingles of their sets."""
    members = keep.stored(left.groupBy("digest").agg(F.max("n").alias("n"), F.max("weight").alias("weight"), F.max("root").alias("root")), "members")
    each = members.join(sets, "digest").select("digest", F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(often, "key", "left").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "key"))).alias("all"))
    size = F.size("all")
    first = F.slice("all", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)
    keys = ranked.select("digest", F.explode(F.filter(first, lambda s: s["c"] > 1)).alias("s")).select("digest", "s.key", *_salted(F.col("s.c"), "digest"))
    return keys.join(members, "digest").select(*_MEMBER)


def _links(source: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between digests that join all classes of each group; everything else that was stored is deleted."""
    keep = Scratch()
    held = classes.select("digest", "n", F.explode("bands").alias("key"))
    shared = held.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = keep.stored(held.join(shared, "key"), "buckets")
    central = buckets.groupBy("digest").agg(F.sum("members").alias("weight"))
    left = buckets.join(central, "digest").select("key", "digest", "n", "weight", F.col("digest").alias("root"), *_salted(F.col("members"), "digest"))
    left = keep.stored(left.select(*_MEMBER), "buckets")
    keep.discard(buckets)
    central = left.select("digest").distinct()
    run, schema = _full_sets(words, source.sparkSession.sparkContext.broadcast(_filter_of(central)))
    full = map_batches(source, run, schema).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = keep.stored(full.join(central, "digest", "left_semi"), "sets")
    heads = _heaviest(left, "key")
    pairs, found = _test(keep, left, heads, sets, percent)
    rest = keep.stored(left.join(heads.select("key", F.col("p_digest").alias("digest")), ["key", "digest"], "left_anti"), "buckets")
    keep.discard(left)
    left, rest = rest, keep.stored(_unsettled(_renamed(rest, found)), "buckets")
    keep.discard(left)
    sizes = rest.groupBy("key").agg(F.count("*").alias("c"), F.max("salts").alias("salts"))
    few = _meet(rest, sizes.where(F.col("c") <= FEW).drop("c"), "left_semi")
    more_pairs, more = _test(keep, few, few.select("key", "salts", *[F.col(c).alias(f"p_{c}") for c in ("digest", "n", "root")]), sets, percent, pairs)
    tested, links = pairs.union(more_pairs), found.union(more).select("a", "b")
    rest = keep.stored(_meet(rest, sizes.where(F.col("c") > FEW).drop("c"), "left_semi").select(*_MEMBER), "buckets")
    rest = keep.stored(_unsettled(_renamed(rest, more)), "buckets")
    left, within = _clusters(keep, rest, sets, percent)
    links = links.union(within)
    left = keep.stored(_rare_shingles(keep, left, sets, percent), "buckets")
    for turn in count(1):
        left = keep.stored(_unsettled(left), "buckets")
        if left.isEmpty():
            break
        main = _heaviest(left, "key").select("key", "salts", F.col("p_root").alias("main"))
        # each turn tests one member of every part and takes it out; from some turn on every member is a part's only one
        part = F.pmod(F.xxhash64("digest", "key"), F.lit(1 << min(60, 6 * turn)))
        heads = _heaviest(_meet(left, main).where("root <> main"), "key", part.alias("part"))
        pairs, found = _test(keep, left, heads, sets, percent, tested)
        rest = keep.stored(left.join(heads.select("key", F.col("p_digest").alias("digest")), ["key", "digest"], "left_anti"), "buckets")
        left, tested, links = _renamed(rest, found), tested.union(pairs), links.union(found.select("a", "b"))
    out = stored(links, "links")
    keep.discard()
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, miss: float = 1e-9) -> DataFrame:
    """Group near-duplicate documents.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their
    names.  Returns one row per row of ``docs``: doc_id, n_shingles (size of the
    set of distinct ``words``-word shingles of the text with A-Z lower-cased; a
    shorter text is one shingle), component_id (smallest doc_id reachable by
    links with 100 * intersection >= ``percent`` * union) and kept (doc_id is
    that smallest one).

    Null and empty texts, and texts of white space only, have an empty set and
    are linked with nothing: kept.  A null doc_id is never a component's id; its
    row takes the smallest id of its group and is not kept, or is kept with a
    null component_id if no member of its group has an id.  Repeated rows share
    a component_id and are all kept if their doc_id is the smallest.  An empty
    table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bands = bands_for(percent / 100, rows, miss)
    run, schema = _signatures(words, bands, rows)
    signed = stored(map_batches(source, run, schema), "signatures")
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    roots = star_contract(_links(source, classes, words, percent))
    ids = classes.select("digest", "least_id")
    named = ids.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = named.join(least, "root").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(names, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
