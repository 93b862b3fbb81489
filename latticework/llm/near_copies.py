"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

First come the links of op9's method: SimHash fingerprints over the same shingles, joined on pigeonhole blocks, and components of those within ``MOST_BITS`` bits
(:mod:`simhash`). Each text of such a component is held against its least one, and those that are near copies by their sets are linked.

At 0.8 most pairs lie beyond that bound: they differ in ten of 64 bits on average and often in sixteen, for which no choice of blocks leaves a selective key. What SimHash
didn't link gets further candidates from MinHash. A text's ``BANDS`` x ``ROWS`` least hashes are cut into bands; texts that agree in a whole band share a key. A pair at
0.8 misses all bands with odds of (1 - 0.8^5)^40, some 1e-7. Every candidate's similarity is counted on the sets themselves, whichever way it came.

Groups that share a key are not paired off in full at once: each links its members to its least member first, but for those in that one's component already, then, while
it holds several components, what lies outside the commonest to that component's and its own least members; only pairs that are still in
different components then are held against each other. Sizes alone rule out most others: at 0.8 the smaller set has at least 0.8 of the greater.
Groups with more than ``SPLIT`` members outside the commonest component, such as letters that share a form, are not held against each other at all: their members are
split by the shingles of their own sets, rarest first. The smaller set of a pair at 0.8 has one of the first ninth of its shingles, and one more, in common with the first
fifth of the greater, so only members that share such a shingle are compared. What a whole family shares comes last in that order. This is exact
for any order that all sets keep, so counts of shingles come from a table of fixed size, ``COUNTERS``.

Of the pairs that are left then, most are too far apart, and no set is fetched for them. Each set has a bitmap in which a shingle flips one bit, so two bitmaps differ in no more bits
than the sets differ in shingles, and at 0.8 these are a ninth of both sizes at most. The joins that make the pairs hold the bitmaps against each other, which loses no pair.

Defined cases: null or wordless text has the empty set, and empty sets are equal; fewer words than a shingle give one shingle of all words; of each component the
least doc_id stays, null being after all others, and of several texts under that doc_id the one with the least hash; rows that repeat (equal doc_id and text)
all stay or all go: see exact dedup; very long texts are read whole, ``AT_ONCE`` shingles at a time; a similarity that equals ``LEAST`` links; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, release, slices, small_batches, texts_of
from .components import components

SHINGLE_WORDS = 5
LEAST = 0.8
BANDS, ROWS = 40, 5
SEED = 42
#: Shingles that are hashed at a time: what a very long text needs in memory.
AT_ONCE = 1 << 9
#: Members outside the commonest component from which on a group is split by shingles, and the counters (a power of two) that tell frequent shingles from rare ones.
SPLIT = 64
COUNTERS = 1 << 20
#: Words of 64 bits in a set's bitmap. 512 bits tell a similarity of 0.65 from 0.8 up to some 900 shingles; beyond that they only let more pairs by.
BIT_WORDS = 8
_drawn = np.random.default_rng(SEED)
FACTORS = _drawn.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _drawn.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text in UTF-8 as sorted 32-bit hashes."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint32)
    spaced = b" ".join(tokens)
    digest = xxhash.xxh32_intdigest
    if len(tokens) <= words:
        return np.array([digest(spaced, SEED)], np.uint32)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.unique(np.fromiter((digest(spaced[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint32, len(first)))


def bands(found: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band."""
    least = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), AT_ONCE):
        some = found[at : at + AT_ONCE]
        mixed = (some ^ (some >> np.uint32(16))) * FACTORS[:, None]
        mixed += SHIFTS[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        np.minimum(least, mixed.min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def bits(found: np.ndarray) -> list[int]:
    """A set's bitmap as signed words: the bits that an odd number of its shingles flip."""
    odd = np.bincount(found % np.uint32(BIT_WORDS * 64), minlength=BIT_WORDS * 64) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()


def _close(least: float):
    """Whether the bitmaps ``x_bits`` and ``y_bits`` of sets of ``x_size`` and ``y_size`` allow a near copy."""
    apart = sum((F.bit_count(F.col("x_bits")[i].bitwiseXOR(F.col("y_bits")[i])) for i in range(BIT_WORDS)), F.lit(0))
    return F.lit(1 + least) * apart <= F.lit(1 - least) * (F.col("x_size") + F.col("y_size")) + 1e-6


def _node():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes that are near copies."""
    left, right = (sets.select(F.col("node").alias(f"n_{x}"), F.col("found").alias(f"s_{x}")) for x in "ab")
    both = pairs.distinct().join(left, F.col("a") == F.col("n_a")).join(right, F.col("b") == F.col("n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _counter(found: np.ndarray) -> np.ndarray:
    return found // np.uint32((1 << 32) // COUNTERS)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each counter stand in ``sets``: ``COUNTERS`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column("found").to_pylist():
                np.add.at(counts, _counter(np.frombuffer(x, np.uint32)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["at", "n"])

    table = sets.select("found").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, frequencies: np.ndarray, least: float = LEAST) -> DataFrame:
    """(shingle, node, size, root, bits, head) from (node, size, root, bits, found): the rarest shingles of each set that one as great or smaller shares if they are near copies, and whether one as great or greater does."""

    def first(n: int, shared: float) -> int:
        return n - int(np.ceil(shared * n - 1e-6)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [np.frombuffer(x, np.uint32) for x in batch.column("found").to_pylist()]
            rarest = [x[np.lexsort((x, frequencies[_counter(x)]))[: first(len(x), least)]] if len(x) else x for x in sets_]
            heads = [np.arange(len(r)) < first(len(x), 2 * least / (1 + least)) for x, r in zip(sets_, rarest, strict=True)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(r) for r in rarest]), pa.int64())
            own = [batch.column(c).take(at) for c in ("node", "size", "root", "bits")]
            none = np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *rarest]).astype(np.int64)), *own, pa.array(np.concatenate([none.astype(bool), *heads]))], ["shingle", "node", "size", "root", "bits", "head"])

    return sets.select("node", "size", "root", "bits", "found").mapInArrow(run, "shingle long, node long, size long, root long, bits array<long>, head boolean")


def _sharing(keyed: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of :func:`prefixes` that can be near copies, the smaller by its head."""
    smaller = keyed.filter("head").select("shingle", F.col("node").alias("x"), F.col("size").alias("x_size"), F.col("root").alias("x_root"), F.col("bits").alias("x_bits"))
    greater = keyed.select(F.col("shingle").alias("r_shingle"), F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("root").alias("y_root"), F.col("bits").alias("y_bits"))
    fits = (F.col("shingle") == F.col("r_shingle")) & (F.col("x_root") != F.col("y_root")) & (F.struct("x_size", "x") < F.struct("y_size", "y")) & (F.col("x_size") >= F.lit(least) * F.col("y_size") - 1e-9) & _close(least)
    return smaller.join(greater.hint("merge"), fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def alike(rows: DataFrame, bits: int = simhash.MOST_BITS) -> DataFrame:
    """The pairs (a, b) of each text (node, fp) and the least text of its SimHash component."""
    prints = materialize(rows.select("node", "fp").distinct(), "prints")
    roots = simhash.labels(prints.select("fp").distinct(), bits).select(F.col("node").alias("r_fp"), "root")
    of = materialize(prints.join(roots, F.col("fp") == F.col("r_fp"), "left").select("node", F.coalesce("root", "fp").alias("root")), "alike")
    hubs = of.groupBy("root").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select(F.col("root").alias("h_root"), "a")
    pairs = materialize(of.join(hubs, F.col("root") == F.col("h_root")).filter("node <> a").select("a", F.col("node").alias("b")), "alike-pairs")
    release(prints, of)
    return pairs


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) that aren't in one component of ``links``."""
    roots = components(links)
    left, right = (roots.select(F.col("node").alias(f"n_{x}"), F.col("root").alias(f"r_{x}")) for x in "ab")
    both = pairs.distinct().join(left, F.col("a") == F.col("n_a"), "left").join(right, F.col("b") == F.col("n_b"), "left")
    return both.filter(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b")


def labels(rows: DataFrame, docs: DataFrame, least: float = LEAST, words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, root): the component of each text that isn't its component's least. ``rows`` has (node, size, fp, keys), ``docs`` the texts."""
    close = alike(rows)
    distinct = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"))
    keyed = distinct.select("node", "size", F.posexplode("keys").alias("t", "k"))
    shared = keyed.groupBy("t", "k").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(keyed.join(shared, ["t", "k"]).select("t", "k", "node", "size", "hub"), "bands")
    wanted = members.select(F.col("node").alias("w_node")).unionByName(close.select(F.explode(F.array("a", "b")).alias("w_node"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t, words) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(map(bits, found), pa.list_(pa.int64()))], ["node", "found", "bits"])

    texts = docs.select(_node().alias("node"), "text").join(wanted, F.col("node") == F.col("w_node"), "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(texts.mapInArrow(run, "node long, found binary, bits array<long>"), "shingles")
    first = materialize(_similar(close, sets, least), "simhash-links")
    to_hubs = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = materialize(_similar(_apart(to_hubs, first), sets, least).unionByName(first), "near-links")
    release(close, first)
    order = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    def held() -> tuple[DataFrame, DataFrame]:
        """All members (t, k, node, size, root), and those of groups with several components, with commonest, main (its least member) and outside (how many are in others)."""
        roots = components(links)
        of = members.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("t", "k", "node", "size", F.coalesce("root", "node").alias("root"))
        of = materialize(of, "held")
        per = of.groupBy("t", "k", "root").agg(F.count("*").alias("c"), F.min("node").alias("first"))
        mixed = per.groupBy("t", "k").agg(F.max_by("root", F.struct("c", "root")).alias("commonest"), F.max_by("first", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("outside")).filter("outside > 0")
        return of, materialize(of.join(mixed, ["t", "k"]), "open")

    for _ in range(2):
        of, still = held()
        outside = still.filter("root <> commonest")
        own = outside.groupBy("t", "k").agg(F.min("node").alias("own"))
        tries = outside.join(own, ["t", "k"]).select("node", F.explode(F.array("main", "own")).alias("other")).filter("node <> other").select(*order("node", "other"))
        tries = tries.unionByName(still.join(own, ["t", "k"]).filter("node <> own").select(*order("node", "own")))
        more = materialize(_similar(tries, sets, least).unionByName(links), "near-links")
        release(of, still, links)
        links = more
    of, still = held()
    own = sets.select(F.col("node").alias("s_node"), "bits")
    near = materialize(still.join(own, F.col("node") == F.col("s_node")).drop("s_node"), "open-bits")
    few, many = near.filter(F.col("outside") <= SPLIT), near.filter(F.col("outside") > SPLIT)
    left = few.filter("root <> commonest").select("t", "k", F.col("node").alias("x"), F.col("size").alias("x_size"), F.col("root").alias("x_root"), F.col("bits").alias("x_bits"))
    right = few.select(F.col("t").alias("r_t"), F.col("k").alias("r_k"), F.col("node").alias("y"), F.col("size").alias("y_size"), F.col("root").alias("y_root"), F.col("bits").alias("y_bits"))
    fits = (F.col("t") == F.col("r_t")) & (F.col("k") == F.col("r_k")) & (F.col("x_root") != F.col("y_root")) & (F.least("x_size", "y_size") >= F.lit(least) * F.greatest("x_size", "y_size") - 1e-9) & _close(least)
    rest, written = left.join(right.hint("merge"), fits).select(*order("x", "y")), []
    if not many.isEmpty():
        own = sets.select(F.col("node").alias("s_node"), "found")
        hot = materialize(many.select("node", "size", "root", "bits").distinct().join(own, F.col("node") == F.col("s_node")).drop("s_node"), "hot-sets")
        keyed = materialize(prefixes(hot, _frequencies(hot), least), "prefixes")
        rest, written = rest.unionByName(_sharing(keyed, least)), [hot, keyed]
    every = materialize(_similar(rest, sets, least).unionByName(links), "near-links")
    release(members, sets, of, still, near, links, *written)
    return components(every)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the least row, by doc_id and text, of each component."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t, words) for t in texts_of(batch.column("text"))]
            prints = np.array([simhash.fingerprint(t, words) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array(prints, pa.int64()), pa.array(map(bands, found), pa.list_(pa.int64()))], ["doc_id", "node", "size", "fp", "keys"])

    rows = materialize(plain.select("doc_id", _node().alias("node"), "text").mapInArrow(run, "doc_id long, node long, size long, fp long, keys array<long>"), "minhash")
    roots = labels(rows, plain, least, words)
    ids = rows.select("doc_id", "node").distinct()
    named = ids.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "roots")
    # Nulls come last: false is less than true.
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("stays")).withColumnRenamed("root", "s_root")
    gone = named.join(first, F.col("root") == F.col("s_root")).filter("not (doc_id <=> stays.doc_id and node = stays.node)").select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node"))
    gone = materialize(gone, "near")
    release(rows, named)
    same = docs[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["gone_node"])
    return docs.join(gone, same, "left_anti")
