"""Best-fit packing of tokenised documents into sequences of fixed capacity by large-item matching.

Pieces are packed by length class, not one by one: the histogram of piece lengths has at most ``capacity`` rows whatever
the input's size, so the whole packing is planned on the driver from it, in bin classes with a count each.

1. Large classes (over a third of the capacity; at most two such pieces fit a bin) are matched greedily: the longest
   takes the longest large piece that still fits beside it.
2. Smaller classes, longest first, go where they fit best: into the bins with the smallest sufficient gap, and into new
   bins when no gap is left.

The plan gives each length a range of ranks per bin class. Pieces get their rank within their length in two levels (counts per
chunk, then positions within a chunk), so a length that a third of all pieces share is still dealt over many tasks.

Defined cases: null text is the empty text, whose only token is the end id; a text over the capacity is cut into full pieces after a first
that may be shorter, and is one task's work until it is cut; rows that repeat are packed each; null ``doc_id`` rows are packed too, dealt over tasks by their ids' checksum;
of pieces that tie in every column any may come first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices, texts, texts_of
from .tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces whose ranks one task works out at a time, on average.
CHUNK = 4096
#: Most rows of a plan that are sent to every executor, some 15 MB; a larger one, of a large capacity, is joined as any table.
SENT_ROWS = 1 << 18

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with the CRC-32 of its ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                ids = np.append(encode(text.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                out += [(doc, i, at, n, zlib.crc32(ids[at : at + n].tobytes())) for i, (at, n) in enumerate(cut(len(ids), capacity))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, bin_from, per_bin, offset) rows from the number of pieces of each length.

    Ranks rank_from..rank_to-1 of a length go to bins bin_from + (rank - rank_from) // per_bin, there at offset + length * (rank - rank_from) % per_bin.
    """
    left = {n: c for n, c in counts.items() if c}
    bins: dict[int, list[tuple[int, tuple]]] = {}  # gap -> classes (bins, contents ((length, how many), ...))
    gaps: list[int] = []

    def put(gap: int, many: int, contents: tuple) -> None:
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((many, contents))

    def pop(gap: int) -> tuple[int, tuple]:
        one = bins[gap].pop()
        if not bins[gap]:
            del bins[gap]
            gaps.pop(bisect_left(gaps, gap))
        return one

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        b = next((n for n in reversed(large) if n <= capacity - a and left[n] - (n == a) > 0), None)
        if b is None:
            put(capacity - a, left[a], ((a, 1),))
            left[a] = 0
        elif b == a:
            put(capacity - 2 * a, left[a] // 2, ((a, 2),))
            left[a] %= 2
        else:
            many = min(left[a], left[b])
            put(capacity - a - b, many, ((a, 1), (b, 1)))
            left[a] -= many
            left[b] -= many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    put(capacity - each * n, full, ((n, each),))
                if rest:
                    put(capacity - rest * n, 1, ((n, rest),))
                left[n] = 0
                break
            gap = gaps[at]
            many, contents = pop(gap)
            each = min(gap // n, max(1, left[n]))
            use = min(many, left[n] // each)
            put(gap - each * n, use, (*contents, (n, each)))
            if use < many:
                put(gap, many - use, contents)
            left[n] -= use * each
    rows, base, used = [], 0, dict.fromkeys(counts, 0)
    for gap in gaps:
        for many, contents in bins[gap]:
            offset = 0
            for n, each in contents:
                rows.append((n, used[n], used[n] + many * each, base, each, offset))
                used[n] += many * each
                offset += n * each
            base += many
    return rows


def assign(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (pieces, materialized) with sequence_id and offset."""
    spark = found.sparkSession
    histogram = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in histogram}
    planned = plan(counts, capacity) or [(0, 0, 0, 0, 1, 0)]
    placed = spark.createDataFrame(planned, "p_length long, rank_from long, rank_to long, bin_from long, per_bin long, in_bin long")
    chunks = max(1, sum(counts.values()) // CHUNK)
    dealt = found.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "chunk").count().select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("place"))
    # The plan's size is bounded by the capacity alone: a bin class per split of a length, a row per length in it.
    at = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    joined = ranked.join(F.broadcast(placed) if len(planned) <= SENT_ROWS else placed, at)
    in_class = F.col("rank") - F.col("rank_from")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin_from") + F.floor(in_class / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("in_bin") + F.col("length") * (in_class % F.col("per_bin"))).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document: where it stands in which sequence."""
    return assign(materialize(pieces(docs, path or default_path(), capacity, end_id, id_col, text_col), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    """op6 over the whole of ``documents``."""
    return pack(documents(spark, sf_dir))
