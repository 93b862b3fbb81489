"""Token masks: 32 token ids in each 32-bit word, a set bit allows. As column expressions over array columns, and over numpy arrays for one cursor.

The three array libraries of common use differ in where the buffer lives, not in what is computed; here it is one column
expression, and numpy for driver-side buffers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import importable

WORD_BITS = 32
BLOCKED = float("-inf")


def words(vocab_size: int) -> int:
    return -(-vocab_size // WORD_BITS)


# Columns

def allocate(vocab_size: int) -> Column:
    """A mask that allows everything."""
    return F.array_repeat(F.lit(-1), words(vocab_size))


def mask_words(ids: DataFrame, vocab_size: int, by: list[str] | None = None, token: str = "token_id") -> DataFrame:
    """(by..., word_idx, word): the words that hold a set bit; ids beyond the last word are left out."""
    kept = ids.filter((F.col(token) >= 0) & (F.col(token) < words(vocab_size) * WORD_BITS))
    # shiftleft on an int: bit 31 gives the negative number that the word is then read as.
    bit = F.expr(f"shiftleft(1, cast({token} % {WORD_BITS} as int))")
    return kept.groupBy(*(by or []), F.expr(f"{token} div {WORD_BITS}").cast("int").alias("word_idx")).agg(F.bit_or(bit).alias("word"))


def masks(ids: DataFrame, vocab_size: int, by: list[str], token: str = "token_id") -> DataFrame:
    """(by..., mask): whole masks as arrays. A mask has as many words as the vocabulary needs, whatever the number of ids."""
    n = words(vocab_size)
    found = mask_words(ids, vocab_size, by, token).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("word_idx", "word"))).alias("w"))
    return found.select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("w")[i], F.lit(0))).alias("mask"))


def bit(mask: Column, token: Column) -> Column:
    """Whether a token's bit is set; not beyond the mask."""
    word = F.get(mask, F.floor(token / WORD_BITS).cast("int"))
    return F.coalesce(F.getbit(word.cast("long"), (token % WORD_BITS).cast("int")) == 1, F.lit(False))


def apply(logits: Column, mask: Column) -> Column:
    """Logits with -inf where the mask's bit is not set or beyond the mask."""
    return F.transform(logits, lambda x, i: F.when(bit(mask, i), x).otherwise(F.lit(BLOCKED).cast("float")))


# Whole masks as bytes: Spark's bitmaps, and a kernel over Arrow batches

#: Bits of one of Spark's bitmaps.
BITMAP_BITS = 1 << 15


def bitmaps(ids: DataFrame, vocab_size: int, by: list[str], token: str = "token_id") -> DataFrame:
    """(by..., mask): whole masks as bytes, the words of :func:`masks` in little-endian order; ids beyond the last word are left out.

    Bits are set in bitmaps where the ids lie, and each key's bitmaps are merged after one shuffle.
    """
    size = words(vocab_size) * WORD_BITS
    kept = ids.filter((F.col(token) >= 0) & (F.col(token) < size))
    # Spark counts positions from 1.
    place = F.col(token).cast("long") + 1
    parts = [F.bitmap_construct_agg(F.when(F.bitmap_bucket_number(place) == b + 1, F.bitmap_bit_position(place))).alias(f"__part_{b}") for b in range(-(-size // BITMAP_BITS))]
    found = kept.groupBy(*by).agg(*parts)
    whole = F.concat(*[F.col(f"__part_{b}") for b in range(len(parts))])
    return found.select(*by, F.substring(whole, 1, words(vocab_size) * WORD_BITS // 8).alias("mask"))


def word_of(mask: Column, index: int) -> Column:
    """A word of a mask of bytes, as the signed number that it is read as."""
    spelled = F.hex(F.substring(mask, 4 * index + 1, 4))
    unsigned = F.conv(F.concat(*[F.substring(spelled, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned).cast("int")


def apply_batches(rows: DataFrame, logits: str, mask: str) -> DataFrame:
    """``rows`` with -inf in the array<float> ``logits`` where the bytes ``mask`` (see :func:`bitmaps`) have no set bit, or end; without a mask nothing is allowed, null logits stay null.

    A kernel over Arrow batches: bits are unpacked a row at a time, and all numbers of a batch are written at once.
    """
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.fieldNames().index(logits)
        for batch in batches:
            lists = batch.column(logits)
            lengths = [0 if n is None else n for n in lists.value_lengths().to_pylist()]
            values = np.array(lists.flatten().to_numpy(zero_copy_only=False), np.float32)
            start = 0
            for n, bits in zip(lengths, batch.column(mask).to_pylist(), strict=True):
                allowed = np.unpackbits(np.frombuffer(bits or b"", np.uint8), bitorder="little")[:n].astype(bool)
                own = values[start : start + n]
                own[: len(allowed)][~allowed] = BLOCKED
                own[len(allowed) :] = BLOCKED
                start += n
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=lists.is_null())
            columns = [made if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    importable(rows.sparkSession)
    return rows.mapInArrow(run, schema)


# Buffers

def allocate_token_bitmask(vocab_size: int) -> np.ndarray:
    return np.full((1, words(vocab_size)), -1, np.int32)


# How the errors of these functions begin.
BAD_DTYPE = "Invalid mask dtype"
BAD_MASK = "Invalid mask dimensions: Expected a 2D array"
BAD_LOGITS = "Invalid logits dimensions: Expected a 2D array"
BAD_BATCH = "Invalid batch size"
ONE_GUIDE = f"{BAD_BATCH}: Batch mask writes are not supported"


def _checked(mask: np.ndarray) -> np.ndarray:
    if mask.dtype != np.int32:
        raise ValueError(f"{BAD_DTYPE}: words are int32, these are {mask.dtype}.")
    return mask


def _matrix(x: np.ndarray, complaint: str, strict: bool) -> np.ndarray:
    """One row may come without its batch dimension, unless ``strict``."""
    if x.ndim == 1 and not strict:
        return x[None, :]
    if x.ndim != 2:
        raise ValueError(f"{complaint}, but got {x.ndim}D.")
    return x


def fill_next_token_bitmask(guide, mask: np.ndarray) -> None:
    """Writes what the guide allows into the mask."""
    if _matrix(_checked(mask), BAD_MASK, strict=True).shape[0] != 1:
        raise ValueError(f"{ONE_GUIDE}, and this mask has {mask.shape[0]} rows.")
    if not mask.flags["C_CONTIGUOUS"]:
        raise ValueError("The mask's rows must lie next to each other in memory.")
    guide.write_mask_into(mask.ctypes.data, mask.size, mask.itemsize)


def apply_token_bitmask_inplace(logits: np.ndarray, mask: np.ndarray, strict: bool = False) -> None:
    """Sets logits to -inf where the mask's bit is not set or beyond the mask. With ``strict`` both must have their batch dimension."""
    bits = _matrix(_checked(mask), BAD_MASK, strict)
    rows = _matrix(logits, BAD_LOGITS, strict)
    if rows.shape[0] != bits.shape[0]:
        raise ValueError(f"{BAD_BATCH}: {rows.shape[0]} rows of logits, {bits.shape[0]} masks.")
    allowed = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little").astype(bool)
    n = min(rows.shape[1], allowed.shape[1])
    rows[:, :n][~allowed[:, :n]] = BLOCKED
    rows[:, n:] = BLOCKED


def apply_token_bitmask(logits: np.ndarray, mask: np.ndarray, strict: bool = False) -> np.ndarray:
    """The same as a new array, for libraries whose arrays don't change."""
    out = np.array(logits)
    apply_token_bitmask_inplace(out, mask, strict)
    return out
