"""Document fingerprints from content-defined chunks.

A gear hash rolls over the bytes of a text; where its high bits are zero a chunk ends. Chunking is normalised: up to the
normal size a boundary needs more zero bits than beyond it, which draws chunk sizes together, and a longest size ends what
has no boundary. A boundary depends on the 32 bytes before it only, so an insertion moves the boundaries with it and the
chunks after it are the same again. A fingerprint is the set of chunk digests with their lengths; likeness is the share
of the fingerprint's length whose chunks the other one has too (containment).

For comparison with the next document, texts are dealt into ranges of ``doc_id`` once, compressed. Each range also gets a
copy of the first document of the range after it, so every neighbour is at hand and no second pass is needed. A ``doc_id`` that many rows share, null
above all, has several ranges, by the hash that orders its texts.

Defined cases: null text is the empty text; two empty fingerprints are alike (1), an empty and a filled one are not (0); a
single document is its own next; rows that share a ``doc_id`` are ordered by a hash of their text, null ``doc_id`` comes after all others; rows that repeat are
each other's next; very long texts are read whole, one at a time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, slices, small_batches, texts, texts_of

SHORTEST, NORMAL, LONGEST = 16, 64, 256
#: Zero bits that end a chunk before and after the normal size.
STRICT, LOOSE = 8, 4
#: The gear table follows from a rule: the i-th entry is a hash of i.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)], np.uint32)
#: Rows of the output that a worker gathers before it hands them on.
ROWS_AT_ONCE = 512
LEAST_ID = -(1 << 63)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks by the loose and by the strict rule. The hash of the last 32 bytes, h = sum of gear[b] << age, doubles its window five times."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)  # the right side is evaluated before it is added
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    return loose + 1, loose[h[loose] < np.uint32(1 << (32 - STRICT))] + 1


def ends(data: bytes, start: int = 0) -> list[int]:
    """Where the chunks of ``data`` from ``start`` on end; ``start`` is 0 or the end of a chunk."""
    n, out = len(data), []
    origin = max(0, start - 32)
    loose, strict = (x + origin for x in candidates(data[origin:]))
    loose, strict = loose.tolist(), strict.tolist()
    i = j = 0
    n_loose, n_strict, at = len(loose), len(strict), start
    while n - at > SHORTEST:
        low, mid, high = at + SHORTEST, at + NORMAL, at + LONGEST
        while j < n_strict and strict[j] < low:
            j += 1
        if j < n_strict and strict[j] <= mid:
            at = strict[j]
        else:
            while i < n_loose and loose[i] <= mid:
                i += 1
            at = loose[i] if i < n_loose and loose[i] <= high else min(high, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes, where: list[int], start: int = 0) -> dict[int, int]:
    """Digest -> length of the chunks that end at ``where``."""
    out, digest = {}, xxhash.xxh3_64_intdigest
    for end in where:
        out[digest(data[start:end])] = end - start
        start = end
    return out


def containment(mine: dict[int, int], other: dict[int, int]) -> float:
    total = sum(mine.values())
    if not total:
        return 0.0 if other else 1.0
    return sum(n for d, n in mine.items() if d in other) / total


def as_text(chunk_set: dict[int, int]) -> str:
    """The fingerprint as 16 hex digits and a length for each chunk, in order of digest."""
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(chunk_set.items())])


def _tie(text: bytes) -> int:
    """What orders the texts of one ``doc_id``: 63 bits."""
    return xxhash.xxh3_64_intdigest(text) >> 1


def bounds_of(cuts: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Upper bounds (key, -tie) of the ranges, ascending, and the keys that have several. A key that is k of the quantiles is cut k times."""
    times = Counter(cuts)
    out = [(key, -((1 << 63) * j // n)) for key, n in sorted(times.items()) for j in range(n - 1, -1, -1)]
    return out, {key for key, n in times.items() if n > 1}


def _tops(batches: Iterator[pa.RecordBatch], bounds: list[tuple[int, int]], hot: set[int]) -> Iterator[pa.RecordBatch]:
    """The largest (key, -tie) of each range in each batch; ties are told for hot keys only, whose texts alone are read."""
    for batch in batches:
        best: dict[int, tuple[int, int]] = {}
        for key, text in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), strict=True):
            at = (key, -_tie(text) if key in hot else 0)
            band = bisect_left(bounds, at)
            best[band] = max(at, best.get(band, at))
        columns = zip(*((band, *at) for band, at in best.items()), strict=True) if best else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["band", "key", "under"])


def _part(batches: Iterator[pa.RecordBatch], tops: list[tuple[int, int]], hot: set[int]) -> Iterator[pa.RecordBatch]:
    """(part, key, tie, doc_id, blob): the range each row falls in, and a copy for the range before if it is its range's first document."""
    pack = zstandard.ZstdCompressor(level=1).compress
    n = len(tops)
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        out: list[tuple] = []
        copied: set[tuple[int, int]] = set()
        for doc, text in zip(ids, texts_of(batch.column("text")), strict=True):
            key, tie = LEAST_ID if doc is None else doc, _tie(text)
            at = (key, -tie if key in hot else 0)
            top = bisect_left(tops, at)
            part = n - 1 - top  # descending: part 0 holds the largest
            row = (key, tie, doc, pack(text))
            out.append((part, 0, *row))
            if at == tops[top] and (key, tie) not in copied:  # one of the rows that repeat is enough
                copied.add((key, tie))
                out.append(((part - 1) % n, 1, *row))
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["part", "ghost", "key", "tie", "doc_id", "blob"])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Doc:
    def __init__(self, doc_id, ghost, part, data):
        self.doc_id, self.ghost, self.part, self.data = doc_id, ghost, part, data
        self.text = data.decode("utf-8", "replace")
        self.ends = ends(data)
        self.set = chunks(data, self.ends)


def _edited(mine: _Doc, after: _Doc) -> tuple[bytes, dict[int, int]]:
    """The edited text and its chunks; those that end before the edit are the text's own."""
    third = len(mine.text) // 3
    if not third:
        return mine.data, mine.set
    head = mine.text[: len(mine.text) - third].encode()
    data = head + after.text[:third].encode()
    same = int(np.searchsorted(mine.ends, len(head), side="right"))
    while same and mine.ends[same - 1] + LONGEST > len(mine.data):  # an end that the text's end made
        same -= 1
    start = mine.ends[same - 1] if same else 0
    return data, chunks(data, mine.ends[:same] + ends(data, start))


def _row(mine: _Doc, after: _Doc) -> tuple:
    data, edited = _edited(mine, after)
    return (mine.doc_id, len(mine.text), hashlib.sha256(data).hexdigest(), as_text(mine.set), as_text(edited), containment(mine.set, edited), containment(mine.set, after.set))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: each is compared with the one after it; a ghost is only compared with."""
    unpack = zstandard.ZstdDecompressor()
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in OUT.split(", ")]
    out: list[tuple] = []
    last: _Doc | None = None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for batch in batches:
        for part, ghost, doc_id, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "blob")), strict=True):
            if ghost and (last is None or last.part != part or last.ghost):
                continue
            doc = _Doc(doc_id, ghost, part, unpack.decompress(blob))
            if last is not None and not last.ghost and last.part == part:
                out.append(_row(last, doc))
            last = doc
            if len(out) >= ROWS_AT_ONCE:
                yield made()
                out = []
    if out:
        yield made()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how much of it the edited text and the next document hold."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    small_batches(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    wanted = 3 * parts
    found = docs.select(key.alias("key")).agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], 20 * wanted).alias("cuts"))
    bounds, hot = bounds_of(found.first()["cuts"] or [])
    if not bounds:
        return spark.createDataFrame([], OUT)
    # The largest row up to each bound: the first document of its range. Their number is set by the partitions, not by the data.
    keys = docs.select(key.alias("key"), (F.when(key.isin(sorted(hot)), F.col(text_col)) if hot else F.lit(None).cast("string")).alias("text"))
    band = keys.mapInArrow(lambda b: _tops(b, bounds, hot), "band int, key long, under long")
    largest = band.groupBy("band").agg(F.max(F.struct("key", "under")).alias("top"))
    tops = sorted((r["top"]["key"], r["top"]["under"]) for r in largest.collect())
    dealt = texts(docs, id_col, text_col).mapInArrow(lambda b: _part(b, tops, hot), "part int, ghost int, key long, tie long, doc_id long, blob binary")
    order = [F.col("part"), F.col("ghost"), F.col("key").desc(), F.col("tie")]
    return dealt.repartition(parts, "part").sortWithinPartitions(*order).mapInArrow(_walk, OUT)


def query(spark, sf_dir: str) -> DataFrame:
    """op3 over the whole of ``documents``."""
    return fingerprints(documents(spark, sf_dir))
