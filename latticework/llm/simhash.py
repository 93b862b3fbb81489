"""Near-duplicates by 64-bit SimHash over word shingles, joined on pigeonhole blocks.

A fingerprint is cut into m blocks. Fingerprints that differ in at most d bits differ in at most d blocks, so they agree in
some m-d of them: each choice of m-d blocks is a table, its joined bits are a key, and close pairs share a key in one
table at least. m grows with the number of distinct fingerprints, so that the keys stay as selective as the data needs.

Groups that share a key are never paired off in full. Equal fingerprints are one node. Each key group first links its
members to its least member; after these links are joined into components, only groups that still hold several
components are looked at again. Those with many members outside their commonest component are split by further blocks: the members of a group agree on its key, so close
pairs differ in the remaining bits alone, and agree on some blocks of these by the same argument. What is left is small, and
there each member outside the commonest component is held against the rest. Every pair within d bits either lies in one component already or is found then, so no link is lost.

Defined cases: null or wordless text has fingerprint 0 and links like any other; fewer words than a shingle give one
shingle of all words; very long texts are hashed whole, ``AT_ONCE`` shingles at a time; a bit that is set in just half the hashes is 0; rows that repeat have one fingerprint and one component; null ``doc_id`` rows take part, and a component's id is its least non-null one; an empty table
gives an empty result; further columns are ignored by :func:`groups` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, release, slices, texts, texts_of
from .components import components

SHINGLE_WORDS = 4
MOST_BITS = 4
SEED = 42
#: Shingles that are hashed at a time: what a very long text needs in memory.
AT_ONCE = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text in UTF-8."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    spaced = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), AT_ONCE):
        some = np.array([digest(spaced[a:b], SEED) for a, b in zip(first[at : at + AT_ONCE], last[at : at + AT_ONCE], strict=True)], np.uint64)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, words) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _blocks(n: int, bits: int) -> int:
    """The least number of blocks whose keys, of 64 (m-bits)/m bits, tell n random fingerprints apart well: expected chance pairs per fingerprint and table below a quarter."""
    m = bits + 2
    while m < 16 and 64 * (m - bits) // m < np.log2(max(n, 2)) + 2:
        m += 1
    return m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _choices(places: list[int], m: int, bits: int) -> list[int]:
    """Bit positions cut into m blocks; a mask for each choice of m - bits of these."""
    edges = [round(len(places) * i / m) for i in range(m + 1)]
    blocks = [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(some)) for some in itertools.combinations(blocks, m - bits)]


def _masks(m: int, bits: int) -> list[int]:
    return _choices(list(range(64)), m, bits)


def _finer(mask: int, bits: int) -> list[int]:
    """Masks that split a group whose members agree on ``mask``: choices among the bits that are left."""
    places = [p for p in range(64) if not mask >> p & 1]
    return _choices(places, min(bits + 2, len(places)), bits) if len(places) > bits else [0]


def _close(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


#: Members outside the commonest component from which on a key group is split by further blocks.
SPLIT = 64


def _linked(held: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """``held`` with the roots that links between roots (a, b) lead to."""
    found = components(links, most)
    return held.join(found.withColumnRenamed("root", "__to"), held["root"] == found["node"], "left").withColumn("root", F.coalesce("__to", "root")).select(held.columns)


def _pairs(open_: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(a, b): the roots of close members of groups, each member outside the commonest component against all others."""
    left = open_.filter("root <> commonest").select(*keys, F.col("fp").alias("l_fp"), F.col("root").alias("l_root"))
    right = open_.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("fp").alias("r_fp"), F.col("root").alias("r_root"))
    near = (F.col("l_root") != F.col("r_root")) & _close("l_fp", "r_fp", bits)
    for k in keys:
        near = (F.col(k) == F.col(f"r_{k}")) & near
    return left.join(right.hint("merge"), near).select(F.least("l_root", "r_root").alias("a"), F.greatest("l_root", "r_root").alias("b")).distinct()


def _open(held: DataFrame, keys: list[str]) -> DataFrame:
    """The members of groups with several components: keys, fp, root, commonest, outside (how many are in others)."""
    per = held.groupBy(*keys, "root").count()
    top = F.max_by("root", F.struct("count", "root"))
    mixed = per.groupBy(*keys).agg(top.alias("commonest"), (F.sum("count") - F.max("count")).alias("outside")).filter("outside > 0")
    return held.select(*keys, "fp", "root").join(mixed, keys)


def labels(distinct: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(node, root): the component of each of the distinct fingerprints ``fp`` that isn't its component's least."""
    n = distinct.count()
    masks = _masks(_blocks(n, bits), bits)
    most = n * len(masks)
    table = F.posexplode(F.array(*[F.lit(x) for x in masks]))
    keyed = distinct.select("fp", table.alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    shared = keyed.groupBy("t", "k").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(keyed.join(shared, ["t", "k"]).select("t", "k", "fp", "hub"), "blocks", most_rows=most)
    first = components(members.filter("fp <> hub").filter(_close("fp", "hub", bits)).select(F.col("fp").alias("a"), F.col("hub").alias("b")), most)
    held = members.join(first, members["fp"] == first["node"], "left").select("t", "k", "fp", F.coalesce("root", "fp").alias("root"))
    held = materialize(held, "held", most_rows=most)
    release(members)
    open_ = materialize(_open(held, ["t", "k"]), "open", most_rows=most)
    links = _pairs(open_.filter(F.col("outside") <= SPLIT), ["t", "k"], bits)
    large = open_.filter(F.col("outside") > SPLIT)
    written = []
    if not large.isEmpty():
        # Finer keys within the large groups, linked to their least members first, as above.
        finer = F.element_at(F.array(*[F.array(*[F.lit(x) for x in _finer(mask, bits)]) for mask in masks]), F.col("t") + 1)
        split = large.select("t", "k", "fp", "root", F.posexplode(finer).alias("u", "mask")).withColumn("v", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
        keys = ["t", "k", "u", "v"]
        hubs = split.groupBy(*keys).agg(F.min(F.struct("fp", "root")).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").drop("low", "high")
        inner = materialize(split.join(hubs, keys).select(*keys, "fp", "root", F.col("hub.fp").alias("h_fp"), F.col("hub.root").alias("h_root")), "finer")
        near = materialize(inner.filter("root <> h_root").filter(_close("fp", "h_fp", bits)).select(F.least("root", "h_root").alias("a"), F.greatest("root", "h_root").alias("b")).distinct(), "finer-links")
        now = materialize(_linked(inner.select(*keys, "fp", "root"), near, most), "finer-held")
        rest = _pairs(_open(now, keys), keys, bits)
        # Roots that these links name may be roots no more, but they are nodes of the same components.
        links = links.unionByName(near).unionByName(rest)
        written = [inner, near, now]
    linked = components(links, most)
    release(open_, *written)
    second = linked.select(F.col("node").alias("s_node"), F.col("root").alias("s_root"))
    nodes = held.select("fp", "root").distinct()
    both = nodes.join(second, nodes["root"] == second["s_node"], "left").select(F.col("fp").alias("node"), F.coalesce("s_root", "root").alias("root"))
    return both.filter("node <> root")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MOST_BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = labels(distinct.select("fp"), bits)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots", most_rows=rows.count())
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select(F.col("fp").alias("c_fp"), "component_id")
    return rows.join(of, rows["fp"] == of["c_fp"]).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MOST_BITS, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with the least doc_id of each component only. A row goes by its doc_id and fingerprint, so other texts under the same (or no) doc_id stay. Rows that share the least doc_id (repeated rows) all stay: see exact dedup."""
    found = groups(docs, id_col, text_col, bits, words)
    gone = found.filter("not (doc_id <=> component_id)").select(F.col("doc_id").alias("gone_id"), "fp").distinct()
    # Fingerprints by text, whose hash is also at hand where the rows are dropped.
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    by_text = fingerprints(docs.select(key.alias("doc_id"), docs[text_col].alias("text")), words=words).distinct().select(F.col("doc_id").alias("gone_key"), F.col("fp").alias("t_fp"))
    gone = materialize(gone.join(by_text, F.col("fp") == F.col("t_fp")).select("gone_id", "gone_key"), "near")
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (key == gone["gone_key"]), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op9 over the whole of ``documents``."""
    return groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
