"""A vocabulary is a DataFrame (token BINARY, token_id BIGINT) and the id that ends a sequence."""

from __future__ import annotations

import weakref
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions.tokens import byte_fallback, byte_level
from ..sources import tokenizer_files
from ..sources.scratch import delete, new_folder, written
from .trie import shared_ids, trie

SCHEMA = "token binary, token_id long"
EXPECTED = "Expected a dict with keys of type str or bytes and values of type list[int]"


def token_id(value: Any) -> int:
    if not isinstance(value, int) or isinstance(value, bool):
        raise TypeError(f"a token id must be an integer, not {type(value).__name__}")
    if not 0 <= value < 1 << 32:
        raise OverflowError(f"a token id must fit 32 bits without a sign: {value}")
    return value


def as_bytes(token: str | bytes) -> bytes:
    if isinstance(token, str):
        return token.encode()
    if isinstance(token, (bytes, bytearray)):
        return bytes(token)
    raise TypeError("Expected a token of type str or bytes, got " + type(token).__name__)


class Vocabulary:
    def __init__(self, eos_token_id: int, tokens: dict | DataFrame | None = None, spark: SparkSession | None = None, checked: bool = False):
        """``checked`` says that a DataFrame is known not to hold the end's id, which saves a job over it."""
        self.eos_token_id = token_id(eos_token_id)
        if isinstance(tokens, DataFrame):
            self.frame = tokens.select(F.col("token").cast("binary").alias("token"), F.col("token_id").cast("long").alias("token_id"))
            if not checked and not self.frame.filter(F.col("token_id") == self.eos_token_id).isEmpty():
                raise errors.EOSTokenDisallowed()
            return
        rows = self._rows({} if tokens is None else tokens)
        if any(i == self.eos_token_id for _, i in rows):
            raise errors.EOSTokenDisallowed()
        spark = spark or SparkSession.builder.getOrCreate()
        self.frame = spark.createDataFrame(rows, SCHEMA)

    @staticmethod
    def _rows(tokens: Any) -> list[tuple[bytearray, int]]:
        if not isinstance(tokens, dict):
            raise TypeError(f"{EXPECTED}, got {type(tokens).__name__}")
        kinds = {str if isinstance(t, str) else bytes if isinstance(t, bytes) else None for t in tokens}
        lists = all(isinstance(ids, (list, tuple)) and all(isinstance(i, int) and not isinstance(i, bool) and 0 <= i < 1 << 32 for i in ids) for ids in tokens.values())
        if len(kinds) > 1 or None in kinds or not lists:
            raise TypeError(f"Dict keys or/and values of the wrong types. {EXPECTED}")
        return [(bytearray(as_bytes(t)), i) for t, ids in tokens.items() for i in ids]

    @classmethod
    def from_pretrained(cls, model: str, revision: str | None = None, token: str | None = None, root: str | None = None, spark: SparkSession | None = None) -> Vocabulary:
        """From a folder with ``tokenizer.json`` and its configuration files, or a model's name under ``root``. Nothing is fetched, so ``token`` is not used."""
        eos, rows = tokenizer_files.load(tokenizer_files.find_folder(model, revision, root))
        spark = spark or SparkSession.builder.getOrCreate()
        return cls(eos, spark.createDataFrame([(bytearray(t), i) for t, i in rows], SCHEMA))

    @classmethod
    def decoded(cls, eos_token_id: int, strings: DataFrame, level: str = "byte", space: str = " ") -> Vocabulary:
        """From a DataFrame (token STRING, token_id) of any size, decoded by column expressions; a token that can't be decoded is an error."""
        kept = strings.filter(F.col("token_id") != eos_token_id)
        data = byte_level(F.col("token")) if level == "byte" else byte_fallback(F.col("token"), space)
        frame = kept.select(data.alias("token"), "token_id")
        if not frame.filter("token is null").isEmpty():
            raise errors.ByteProcessorFailed() if level == "byte" else errors.ByteFallbackProcessorFailed()
        return cls(eos_token_id, frame, checked=True)

    # Reading

    def tokens(self) -> DataFrame:
        """(token, ids): each token once, its ids in order."""
        return self.frame.groupBy("token").agg(F.array_sort(F.collect_list("token_id")).alias("ids"))

    _tree: tuple[DataFrame, DataFrame, bool] | None = None

    def tree(self) -> tuple[DataFrame, bool]:
        """The table of prefix trees (see ``trie``) of all tokens none of whose ids ends the sequence, and whether an id stands for several tokens. Written once, and deleted with the vocabulary."""
        if self._tree is None or self._tree[0] is not self.frame:
            spark = self.frame.sparkSession
            kept = self.tokens().filter(~F.array_contains("ids", self.eos_token_id))
            path = new_folder(spark, "trie")
            table = written(trie(kept, spark.sparkContext.defaultParallelism), path)
            weakref.finalize(self, delete, spark, path).atexit = False
            self._tree = (self.frame, table, shared_ids(self.frame))
        return self._tree[1:]

    def get(self, token: str | bytes) -> list[int] | None:
        """Ids of a token, or None."""
        found = self.frame.filter(F.col("token") == F.lit(bytearray(as_bytes(token)))).select("token_id").collect()
        return sorted(r["token_id"] for r in found) or None

    token_ids = get

    def lookup(self, other: DataFrame, on: str = "token") -> DataFrame:
        """``other`` with a column token_id for each id of its token; null where there is none."""
        mine = self.frame.select(F.col("token").alias("__token"), "token_id")
        return other.join(mine, F.col(on).cast("binary") == F.col("__token"), "left").drop("__token")

    def get_eos_token_id(self) -> int:
        return self.eos_token_id

    def count(self) -> int:
        """Ids, the end of sequence among them."""
        return self.frame.count() + 1

    __len__ = count

    def is_empty(self) -> bool:
        return self.frame.isEmpty()

    def __bool__(self) -> bool:
        return True

    # Changing

    def insert(self, token: str | bytes, new_id: int) -> None:
        data, new_id = as_bytes(token), token_id(new_id)
        if new_id == self.eos_token_id:
            raise errors.EOSTokenDisallowed()
        self.insert_all(self.frame.sparkSession.createDataFrame([(bytearray(data), new_id)], SCHEMA))

    def insert_all(self, rows: DataFrame) -> None:
        """Rows (token, token_id); ids are not checked for being unique."""
        self.frame = self.frame.unionByName(Vocabulary(self.eos_token_id, rows).frame)

    def remove(self, token: str | bytes) -> None:
        """All ids of a token; a token that isn't there is no error."""
        self.frame = self.frame.filter(F.col("token") != F.lit(bytearray(as_bytes(token))))

    def remove_all(self, rows: DataFrame) -> None:
        self.frame = self.frame.join(rows.select(F.col("token").cast("binary").alias("token")).distinct(), "token", "left_anti").select("token", "token_id")

    # Comparing and showing

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Vocabulary):
            return NotImplemented
        return self.eos_token_id == other.eos_token_id and self.frame.exceptAll(other.frame).isEmpty() and other.frame.exceptAll(self.frame).isEmpty()

    __hash__ = None

    def __copy__(self) -> Vocabulary:
        copy = object.__new__(Vocabulary)
        copy.eos_token_id, copy.frame = self.eos_token_id, self.frame
        return copy

    def __deepcopy__(self, memo: dict) -> Vocabulary:
        return self.__copy__()  # frames never change

    def __reduce__(self) -> tuple:
        """Pickles by value; :meth:`save` is the way for what doesn't fit one machine."""
        return _unpickled, (self.eos_token_id, [(bytes(r["token"]), r["token_id"]) for r in self.frame.collect()])

    def describe(self) -> str:
        lines = []
        for r in self.tokens().orderBy("token").collect():
            spelled = ", ".join(f"0x{b:02X}" for b in bytes(r["token"]))
            lines.append(f"token: [{spelled}] -> ids: {r['ids']}")
        return "\n".join([f"Vocabulary, eos_token_id: {self.eos_token_id}", *lines])

    def __repr__(self) -> str:
        return f"Vocabulary(eos_token_id={self.eos_token_id}, columns=[token, token_id])"

    __str__ = describe

    def save(self, path: str) -> None:
        from ..sources.saved import write

        write(path, {"kind": "vocabulary", "eos_token_id": self.eos_token_id}, self.frame.sparkSession, tokens=self.frame)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Vocabulary:
        from ..sources.saved import read

        scalars, frames = read(path, "vocabulary", spark, "tokens")
        return cls(scalars["eos_token_id"], frames["tokens"], checked=True)


def _unpickled(eos_token_id: int, rows: list[tuple[bytes, int]]) -> Vocabulary:
    spark = SparkSession.builder.getOrCreate()
    return Vocabulary(eos_token_id, spark.createDataFrame([(bytearray(t), i) for t, i in rows], SCHEMA))
