"""Exact duplicates by a minimal perfect hash over historical distinct digests.

The history is a table of distinct SHA-256 digests with the locator of the row that won (largest ``doc_id``): what earlier runs left, or, where there
are none, the older rows of the table itself, up to its median doc_id.
It is cut into shards by digest prefix. In each shard a hash-and-displace minimal perfect hash maps its n digests
to n slots: a digest's bucket names a seed, and ``xxhash64(digest, seed) mod n`` is its slot. Two tables hold it:

* buckets ``(shard, bucket, n_slots, seed)``: the displacement seeds,
* slots ``(shard, slot, slot_digest, winner, winner_uid, group_size)``: the whole digest and the winner's locator.

The newer rows are looked up. Those of known digests are summed up by slot and renew its winner and count, so a slot is as good as if all rows had been in the
history; the digests that are not in it are grouped on their own. Then every row is given the verdict of its slot or of its group.

A lookup is two equi-joins, so any hot digest is split by Spark's skew join, and it ends by comparing all 32 bytes of the
digest; a digest outside the history that happens to hit a slot is therefore never mistaken. Nothing is collected but a few counts.

Defined cases: null text is the empty text; very long texts are digested whole; a null ``doc_id`` loses against any other and counts as old; rows that repeat
``doc_id`` and text, or tie in it, are one group of which exactly one row stays; an empty table gives an empty result; further columns
of the input are kept by :func:`deduplicate` and ignored by :func:`verdicts`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, signed, slices, texts, texts_of

#: Digests in a shard on average: what one task builds a hash for.
SHARD_KEYS = 16_384
#: Tasks that build an index at least, where there are as many shards, and rows of a file of it.
LEAST_TASKS, FILE_ROWS = 64, 200_000
#: Digests in a bucket on average.
BUCKET_KEYS = 4
#: Seeds that are tried for a bucket; digests of a bucket that finds none stay out of the index and are grouped with the nonmembers.
MOST_SEEDS = 1 << 20


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lowered. The text goes no further than this pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [hashlib.sha256(t.lower()).digest() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest binary")


def _prefix(digest: Column, at: int, width: int) -> Column:
    """``width`` hex digits of the digest as a number."""
    return F.conv(F.substring(F.hex(digest), at, width), 16, 10).cast("long")


def _shard(digest: Column, shards: int) -> Column:
    return (_prefix(digest, 1, 12) % F.lit(shards)).cast("int")


def _bucket(digest: Column, n_slots: Column) -> Column:
    return (_prefix(digest, 13, 12) % F.floor((n_slots + BUCKET_KEYS - 1) / BUCKET_KEYS)).cast("int")


def _build(shard: pa.Table) -> pa.Table:
    """Seeds and slots of one shard, which holds about SHARD_KEYS digests."""
    keys = shard.column("digest").to_pylist()
    winners, uids, sizes = (shard.column(c).to_pylist() for c in ("winner", "winner_uid", "group_size"))
    n = len(keys)
    n_buckets = (n + BUCKET_KEYS - 1) // BUCKET_KEYS
    buckets: list[list[int]] = [[] for _ in range(n_buckets)]
    first = []
    for i, key in enumerate(keys):
        buckets[int.from_bytes(key[6:12], "big") % n_buckets].append(i)
        first.append(xxhash.xxh64_intdigest(key, 42))
    seeds, slot_of, taken = [0] * n_buckets, [-1] * n, bytearray(n)
    for b in sorted(range(n_buckets), key=lambda b: -len(buckets[b])):
        if not buckets[b]:
            continue
        for seed in range(MOST_SEEDS):
            eight = struct.pack("<q", seed)
            slots = [signed(xxhash.xxh64_intdigest(eight, first[i])) % n for i in buckets[b]]
            if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                seeds[b] = seed
                for i, s in zip(buckets[b], slots, strict=True):
                    slot_of[i], taken[s] = s, 1
                break
    number = shard.column("shard")[0].as_py()
    placed = [i for i in range(n) if slot_of[i] >= 0]
    none = lambda k: [None] * k
    m, k = n_buckets, len(placed)
    return pa.table(
        {
            "shard": pa.array([number] * (m + k), pa.int32()),
            "bucket": pa.array([*range(m), *none(k)], pa.int32()),
            "n_slots": pa.array([n] * (m + k), pa.int64()),
            "seed": pa.array([*seeds, *none(k)], pa.int64()),
            "slot": pa.array([*none(m), *(slot_of[i] for i in placed)], pa.int64()),
            "slot_digest": pa.array([*none(m), *(keys[i] for i in placed)], pa.binary()),
            "winner": pa.array([*none(m), *(winners[i] for i in placed)], pa.int64()),
            "winner_uid": pa.array([*none(m), *(uids[i] for i in placed)], pa.int64()),
            "group_size": pa.array([*none(m), *(sizes[i] for i in placed)], pa.int64()),
        }
    )


INDEX = "shard int, bucket int, n_slots long, seed long, slot long, slot_digest binary, winner long, winner_uid long, group_size long"


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, winner, winner_uid, group_size) from (doc_id, uid, digest); partial sums go before the shuffle, so copies cost nothing."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "uid")).alias("w"), F.count("*").alias("group_size")).select("digest", F.col("w.doc_id").alias("winner"), F.col("w.uid").alias("winner_uid"), "group_size")


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """The minimal perfect hash of ``history`` (digest, winner, winner_uid, group_size; digests distinct), as one table of seed rows and slot rows, and its number of shards."""
    n = history.count()
    shards = max(1, -(-n // SHARD_KEYS))
    # Tasks follow the shards, and files, where there are many, their rows.
    dealt = history.withColumn("shard", _shard(F.col("digest"), shards)).repartition(max(min(shards, LEAST_TASKS), -(-2 * n // FILE_ROWS)), "shard")
    return materialize(dealt.groupBy("shard").applyInArrow(_build, INDEX), "mph"), shards


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``rows`` with shard, slot, winner, winner_uid and group_size from the index; winner and size are null where the digest isn't in it."""
    seeds = index.filter("bucket is not null").select(F.col("shard").alias("b_shard"), F.col("bucket").alias("b_bucket"), "n_slots", "seed")
    sizes = index.filter("bucket = 0").select(F.col("shard").alias("s_shard"), F.col("n_slots").alias("s_slots"))
    slots = index.filter("slot is not null").select(F.col("shard").alias("t_shard"), F.col("slot").alias("t_slot"), "slot_digest", "winner", "winner_uid", "group_size")
    at = rows.withColumn("shard", _shard(F.col("digest"), shards)).join(sizes, F.col("shard") == F.col("s_shard"), "left")
    at = at.withColumn("bucket", _bucket(F.col("digest"), F.col("s_slots"))).join(seeds, (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket")), "left")
    at = at.withColumn("slot", F.pmod(F.xxhash64("digest", "seed"), F.col("n_slots")))
    hit = (F.col("shard") == F.col("t_shard")) & (F.col("slot") == F.col("t_slot")) & (F.col("digest") == F.col("slot_digest"))
    return at.join(slots, hit, "left").select(*rows.columns, "shard", "slot", "winner", "winner_uid", "group_size")


def renew(index: DataFrame, found: DataFrame) -> DataFrame:
    """The index with the winners and counts of ``found``, rows that :func:`lookup` has given their slots."""
    sums = found.groupBy(F.col("shard").alias("u_shard"), F.col("slot").alias("u_slot")).agg(F.max(F.struct("doc_id", "uid")).alias("w"), F.count("*").alias("n"))
    both = index.join(sums, (F.col("shard") == F.col("u_shard")) & (F.col("slot") == F.col("u_slot")), "left")
    won = F.greatest(F.struct(F.col("winner").alias("doc_id"), F.col("winner_uid").alias("uid")), F.col("w"))
    return both.withColumn("won", won).select(
        "shard", "bucket", "n_slots", "seed", "slot", "slot_digest", F.col("won.doc_id").alias("winner"), F.col("won.uid").alias("winner_uid"), (F.col("group_size") + F.coalesce("n", F.lit(0))).alias("group_size")
    )


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    ``history`` (digest, winner, winner_uid, group_size) may come from earlier runs, with winner_uid -1: its members then all
    go, with the earlier run's winner and count. Without one the table's older rows are the history and its newer ones renew it.
    """
    rows = materialize(digests(docs, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "digests")
    if history is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        old = F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(middle).cast("long"))
        index, shards = build_index(distinct_digests(rows.filter(old)))
        known = lookup(rows.filter(~old), index, shards).filter("group_size is not null")
        index = materialize(renew(index, known), "mph-renewed")
    else:
        index, shards = build_index(history)
    found = materialize(lookup(rows, index, shards), "looked-up")
    members = found.filter("group_size is not null")
    rest = found.filter("group_size is null").select("doc_id", "digest", "uid")
    alone = distinct_digests(rest).withColumnRenamed("digest", "g_digest")
    others = rest.join(alone, rest["digest"] == alone["g_digest"]).select("doc_id", "digest", "uid", "winner", "winner_uid", "group_size")
    everything = members.select("doc_id", "digest", "uid", "winner", "winner_uid", "group_size").unionByName(others)
    return everything.select("doc_id", F.col("winner").alias("keep_id"), "group_size", (F.col("uid") == F.col("winner_uid")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeats, all columns as they were.

    Dropped (doc_id, digest) keys leave by an anti-join; rows that repeat doc_id *and* text, few if any, are then made one.
    """
    n = docs.count()
    seen = materialize(verdicts(docs, id_col, text_col), "verdicts", most_rows=n)
    lost = seen.groupBy("doc_id", "digest").agg(F.max("kept").alias("any_kept"), F.count("*").alias("n"))
    lost = materialize(lost.filter("n > 1 or not any_kept"), "lost", most_rows=n)
    gone = lost.filter("not any_kept").select(F.col("doc_id").alias("g_id")).distinct()
    twice = lost.filter("any_kept").select(F.col("doc_id").alias("t_id")).distinct()
    if lost.filter("n > 1").isEmpty() and not _ids_repeat(seen):
        return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["g_id"]), "left_anti")
    # Some doc_id stands on several rows: the digest decides, and it is taken again where the doc_id is affected.
    name = "__text_digest"
    keyed = docs.withColumn(name, F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256))
    dropped = lost.filter("not any_kept").select(F.col("doc_id").alias("g_id"), F.lower(F.hex("digest")).alias("g_digest"))
    left = keyed.join(dropped, keyed[id_col].cast("long").eqNullSafe(dropped["g_id"]) & (keyed[name] == dropped["g_digest"]), "left_anti")
    again = left.join(twice, left[id_col].cast("long").eqNullSafe(twice["t_id"]), "left_semi").dropDuplicates([id_col, name])
    once = left.join(twice, left[id_col].cast("long").eqNullSafe(twice["t_id"]), "left_anti")
    return once.unionByName(again).drop(name)


def _ids_repeat(seen: DataFrame) -> bool:
    return not seen.groupBy("doc_id").count().filter("count > 1").isEmpty()


def query(spark, sf_dir: str) -> DataFrame:
    """op5 over the whole of ``documents``."""
    from .common import documents

    return verdicts(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
