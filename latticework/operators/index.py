"""An index is the automaton of a pattern, stepped by whole tokens of a vocabulary: edges (state, token_id, next_state) and states (state, is_final).

The vocabulary is a table of prefix trees (``trie``), and the automaton is walked over it from the states that have been reached, frontier by frontier: the
edges of states that were reached for the first time are written, and what they lead to is the next frontier. The driver holds the automaton and the sets of its states; edges are a table,
sorted by state within its files.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions.tokens import bytes_of, int_array
from ..plans.automaton import START, Automaton, compile_pattern
from ..sources.scratch import delete, new_folder, written
from ..workers import importable
from .trie import BATCH_EDGES, Edges, blocks_of, walk_block
from .vocabulary import Vocabulary

EDGES = "state int, token_id long, next_state int"


def walk(automaton: Automaton, token: Column, state: Column) -> Column:
    """The state reached from ``state`` by the bytes of ``token``; 0 is dead."""
    delta, classes = int_array(automaton.delta), int_array(automaton.classes)
    return F.aggregate(bytes_of(token), state, lambda s, b: F.get(delta, s * automaton.n_classes + F.get(classes, b)))


def accepts(automaton: Automaton, text: Column) -> Column:
    """Whether the whole text matches."""
    return F.get(int_array(int(x) for x in automaton.final), walk(automaton, F.encode(text, "UTF-8"), F.lit(START))) == 1


def steps(automaton: Automaton, tree: DataFrame, states: list[int]) -> DataFrame:
    """(state, token_id, next_state) for the given states and each id of a token that leads to a useful one."""
    starts = np.array(states, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = Edges()
        for batch in batches:
            for row in blocks_of(batch):
                for found in walk_block(automaton.delta, automaton.n_classes, automaton.classes, automaton.useful, starts, row):
                    edges.add(*found)
                    if edges.size >= BATCH_EDGES:
                        yield edges.batch()
        if edges.parts:
            yield edges.batch()

    importable(tree.sparkSession)
    return tree.mapInArrow(run, EDGES)


#: States whose edges a cursor keeps at hand.
CACHED_STATES = 256


class Index:
    def __init__(self, regex: str, vocabulary: Vocabulary, **limits: int):
        """``limits`` go to :func:`compile_pattern`: most_threads, most_states."""
        self.regex = regex
        self.eos_token_id = vocabulary.eos_token_id
        automaton = compile_pattern(regex, **limits)
        spark = vocabulary.frame.sparkSession
        tree, shared = vocabulary.tree()
        self._path = new_folder(spark, "edges")
        # Frontier by frontier: the edges of states that were reached for the first time, then what these lead to.
        seen, leaving, frontier = {START}, set(), [START]
        waves = 0
        while frontier:
            found = steps(automaton, tree, frontier)
            if shared:  # an id that stands for several tokens can have several steps from a state; the least next state is taken
                found = found.groupBy("state", "token_id").agg(F.min("next_state").alias("next_state"))
            wave = written(found.sortWithinPartitions("state", "token_id"), f"{self._path}/wave={waves}")
            # The automaton bounds both sets, not the vocabulary.
            from_, to = wave.agg(F.collect_set("state"), F.collect_set("next_state")).first()
            leaving.update(from_)
            frontier = sorted(set(to) - seen)
            seen.update(frontier)
            waves += 1
        states = sorted(seen)
        for s in states:
            if s not in leaving and not automaton.final[s]:
                delete(spark, self._path)
                missing = [chr(b) if b < 128 else f"\\x{b:02x}" for b in automaton.live_bytes(s)]
                raise errors.IncompatibleVocabulary(regex=regex, error_state=s, missing_tokens=missing)
        self.finals = [s for s in states if automaton.final[s]]
        self.states = spark.createDataFrame([(s, bool(automaton.final[s])) for s in states], "state int, is_final boolean")
        ends = self.states.filter("is_final").select("state", F.lit(self.eos_token_id).cast("long").alias("token_id"), F.col("state").alias("next_state"))
        kept = spark.read.schema(EDGES).parquet(*[f"{self._path}/wave={i}" for i in range(waves)])
        self.edges = kept.unionByName(ends)
        self._size: int | None = None
        self._vocabulary = vocabulary
        self.automaton = automaton

    initial_state = START

    def unpersist(self) -> None:
        """Deletes the edges that were written; neither they nor what reads them can be read any more."""
        if self._path:
            delete(self.edges.sparkSession, self._path)

    @property
    def vocab_size(self) -> int:
        """Ids of the vocabulary, the end of sequence among them."""
        if self._size is None:
            self._size = self._vocabulary.count()
        return self._size

    # Relational reading, for data of any size

    def allowed(self, other: DataFrame, state: str = "state") -> DataFrame:
        """``other`` with a row for each token id that its state allows."""
        edges = self.edges.select(F.col("state").alias("__state"), "token_id")
        return other.join(edges, F.col(state) == F.col("__state")).drop("__state")

    def next_states(self, other: DataFrame, state: str = "state", token: str = "token_id") -> DataFrame:
        """``other`` with next_state; null where there is no step, as always for the end of sequence."""
        edges = self.edges.filter(F.col("token_id") != self.eos_token_id).select(F.col("state").alias("__state"), F.col("token_id").alias("__token"), "next_state")
        return other.join(edges, (F.col(state) == F.col("__state")) & (F.col(token) == F.col("__token")), "left").drop("__state", "__token")

    def with_finality(self, other: DataFrame, state: str = "state") -> DataFrame:
        """Rows of ``other`` whose state is final."""
        return other.join(self.states.filter("is_final").select(F.col("state").alias("__state")), F.col(state) == F.col("__state"), "left_semi")

    # Pointwise reading, for cursors: a state's edges are fetched when it is visited

    def _row(self, state: int) -> dict[int, int]:
        """The edges of a state. Files are sorted by state, so that few of their pages are read; the last CACHED_STATES states stay at hand."""
        rows = self.__dict__.setdefault("_rows", OrderedDict())
        if state not in rows:
            rows[state] = {r["token_id"]: r["next_state"] for r in self.edges.filter(F.col("state") == state).select("token_id", "next_state").collect()}
            if len(rows) > CACHED_STATES:
                rows.popitem(last=False)
        rows.move_to_end(state)
        return rows[state]

    def get_transitions(self) -> dict[int, dict[int, int]]:
        """All edges, for an index that fits the driver."""
        table: dict[int, dict[int, int]] = {}
        for r in self.edges.collect():
            table.setdefault(r["state"], {})[r["token_id"]] = r["next_state"]
        return table

    def get_initial_state(self) -> int:
        return START

    def get_final_states(self) -> set[int]:
        return set(self.finals)

    def is_final_state(self, state: int) -> bool:
        return state in self.finals

    def get_allowed_tokens(self, state: int) -> list[int] | None:
        return sorted(self._row(state)) or None

    def get_next_state(self, state: int, token_id: int) -> int | None:
        return None if token_id == self.eos_token_id else self._row(state).get(token_id)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Index):
            return NotImplemented
        same = (self.eos_token_id, self.finals, self.vocab_size) == (other.eos_token_id, other.finals, other.vocab_size)
        return same and self.edges.exceptAll(other.edges).isEmpty() and other.edges.exceptAll(self.edges).isEmpty()

    __hash__ = None

    def __deepcopy__(self, memo: dict) -> Index:
        copy = object.__new__(Index)
        copy.__dict__.update(self.__dict__)  # frames and tables never change
        copy.__dict__.pop("_rows", None)
        return copy

    def __reduce__(self) -> tuple:
        """Pickles by value; :meth:`save` is the way for what doesn't fit one machine."""
        scalars = {"regex": self.regex, "eos_token_id": self.eos_token_id, "vocab_size": self.vocab_size, "finals": self.finals}
        return _unpickled, (scalars, [tuple(r) for r in self.edges.collect()], [tuple(r) for r in self.states.collect()])

    def describe(self) -> str:
        lines = [f"{s} -> {to}" for s, to in sorted(self.get_transitions().items())]
        return "\n".join([f"Index with initial state {START}, final states {self.finals}, transitions:", *lines])

    __str__ = describe

    def __repr__(self) -> str:
        return f"Index(regex={self.regex!r}, states={self.automaton.n_states if self.automaton else '?'})"

    def save(self, path: str) -> None:
        from ..sources.saved import write

        scalars = {"kind": "index", "regex": self.regex, "eos_token_id": self.eos_token_id, "vocab_size": self.vocab_size, "finals": self.finals}
        ordered = self.edges.repartitionByRange(int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "state").sortWithinPartitions("state", "token_id")
        write(path, scalars, self.edges.sparkSession, edges=ordered, states=self.states)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Index:
        from ..sources.saved import read

        scalars, frames = read(path, "index", spark, "edges", "states")
        return cls._of(scalars, frames["edges"], frames["states"])

    @classmethod
    def _of(cls, scalars: dict, edges: DataFrame, states: DataFrame) -> Index:
        index = object.__new__(cls)
        index.regex, index.eos_token_id, index._size, index.finals = (scalars[k] for k in ("regex", "eos_token_id", "vocab_size", "finals"))
        index.edges, index.states, index._path = edges, states, None
        index.automaton, index._vocabulary = compile_pattern(index.regex), None
        return index


def _unpickled(scalars: dict, edges: list[tuple], states: list[tuple]) -> Index:
    spark = SparkSession.builder.getOrCreate()
    return Index._of(scalars, spark.createDataFrame(edges, EDGES), spark.createDataFrame(states, "state int, is_final boolean"))
