"""Many patterns at once: a table of patterns becomes one table of edges, keyed by pattern and state; and rows are held each against the pattern, or the schema, that it names.

Patterns are compiled where they lie, one row each with its automaton as arrays. Then all are walked together over the vocabulary's prefix trees, frontier by frontier: each frontier is a table of
states that a pattern has reached for the first time, each of its rows meets each block of the trees once, and the new edges say what is reached next. The driver holds the numbers of the blocks, one for some
thousand tokens, and counts waves.

Repeated patterns under one id count once; of different patterns under one id the least stands; null ids or patterns are left out; a pattern that can't be compiled has
an error and no edges. An id that stands for several tokens takes the least next state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LatticeError
from ..functions.tokens import bytes_of
from ..plans.automaton import START, compile_pattern
from ..plans.schema_regex import regex_from_str
from ..sources.scratch import delete, new_folder, written
from ..workers import importable
from .trie import BATCH_EDGES, Edges, blocks_of, walk_block
from .vocabulary import Vocabulary

TABLES = ("delta", "classes", "final", "useful")
AUTOMATON = "n_classes int, delta array<int>, classes array<int>, final array<boolean>, useful array<boolean>, error string"
_TYPES = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.string())
_NAMES = [x.split()[0] for x in AUTOMATON.split(", ")]


def compiled(patterns: DataFrame, pattern_of: Callable[[str], str] = str, **limits) -> DataFrame:
    """(pattern_id, automaton...) of (pattern_id, pattern), each id once. ``pattern_of`` makes a pattern of what stands there; ``limits`` go to :func:`compile_pattern`."""
    kind = dict(patterns.dtypes)["pattern_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("pattern_id")
            for i, text in enumerate(batch.column("pattern").to_pylist()):
                try:
                    a = compile_pattern(pattern_of(text), **limits)
                    row = (a.n_classes, a.delta, a.classes, a.final, a.useful, None)
                except LatticeError as e:
                    row = (*[None] * 5, str(e))
                yield pa.RecordBatch.from_arrays([numbers.slice(i, 1), *[pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)]], ["pattern_id", *_NAMES])

    importable(patterns.sparkSession)
    once = patterns.filter("pattern_id is not null and pattern is not null").groupBy("pattern_id").agg(F.min("pattern").alias("pattern"))
    return once.select("pattern_id", "pattern").mapInArrow(run, f"pattern_id {kind}, {AUTOMATON}")


def _row(batch: pa.RecordBatch, i: int) -> tuple:
    """n_classes, delta, classes, final, useful of one row."""
    return batch.column("n_classes")[i].as_py(), *(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in TABLES)


def _walked(automata: DataFrame, frontier: DataFrame, tree: DataFrame, blocks: list[int], kind: str) -> DataFrame:
    """Edges of the frontier (pattern_id, states). Spark broadcasts or deals out the trees by their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = None
        for batch in batches:
            edges = edges or Edges(batch.schema.field("pattern_id").type)
            for i, (number, block) in enumerate(zip(batch.column("pattern_id").to_pylist(), blocks_of(batch), strict=True)):
                n, delta, classes, _, useful = _row(batch, i)
                starts = batch.column("states")[i].values.to_numpy()
                for found in walk_block(delta, n, classes, useful, starts, block):
                    edges.add(*found, number)
                    if edges.size >= BATCH_EDGES:
                        yield edges.batch()
        if edges and edges.parts:
            yield edges.batch()

    each = frontier.join(automata, "pattern_id").withColumn("block", F.explode(F.array(*[F.lit(b) for b in blocks]).cast("array<long>")))
    return each.join(tree, "block").drop("block").mapInArrow(run, f"pattern_id {kind}, state int, token_id long, next_state int")


class PatternTable:
    """Indexes of all patterns of a table (pattern_id, pattern).

    ``edges`` (pattern_id, state, token_id, next_state), ``states`` (pattern_id, state, is_final), ``errors`` (pattern_id, error) of what can't be compiled, and ``missing`` (pattern_id, state, byte): what
    the vocabulary would need where a pattern is stuck, one row for each byte that the state would go on by. A pattern that is stuck anywhere is unfit for the vocabulary.
    """

    def __init__(self, patterns: DataFrame, vocabulary: Vocabulary, **limits: int):
        spark = patterns.sparkSession
        self._path = new_folder(spark, "patterns")
        kind = dict(patterns.dtypes)["pattern_id"]
        tree, shared = vocabulary.tree()
        blocks = [r["block"] for r in tree.select("block").collect()]
        automata = written(compiled(patterns, **limits), f"{self._path}/automata")
        self.errors = automata.filter("error is not null").select("pattern_id", "error")
        self.automata = automata.filter("error is null").drop("error")
        frontier = self.automata.select("pattern_id", F.lit(START).alias("state"))
        edges, seen = [], []
        while True:
            seen.append(written(frontier, f"{self._path}/reached={len(seen)}"))
            if seen[-1].isEmpty():
                break
            # The automaton bounds a pattern's states.
            found = _walked(self.automata, seen[-1].groupBy("pattern_id").agg(F.collect_list("state").alias("states")), tree, blocks, kind)
            if shared:
                found = found.groupBy("pattern_id", "state", "token_id").agg(F.min("next_state").alias("next_state"))
            edges.append(written(found.sortWithinPartitions("pattern_id", "state"), f"{self._path}/edges={len(edges)}"))
            frontier = edges[-1].select("pattern_id", F.col("next_state").alias("state")).distinct()
            for before in seen:
                frontier = frontier.join(before, ["pattern_id", "state"], "left_anti")
        reached, kept = (spark.read.schema(schema).parquet(*paths) for schema, paths in ((f"pattern_id {kind}, state int", [f"{self._path}/reached={i}" for i in range(len(seen))]), (f"pattern_id {kind}, state int, token_id long, next_state int", [f"{self._path}/edges={i}" for i in range(len(edges))] or [f"{self._path}/reached=0"])))
        self.states = reached.join(self.automata.select("pattern_id", "final"), "pattern_id").select("pattern_id", "state", F.get("final", F.col("state")).alias("is_final"))
        ends = self.states.filter("is_final").select("pattern_id", "state", F.lit(vocabulary.eos_token_id).cast("long").alias("token_id"), F.col("state").alias("next_state"))
        self.edges = kept.unionByName(ends)
        stuck = self.states.filter("not is_final").join(kept.select("pattern_id", "state").distinct(), ["pattern_id", "state"], "left_anti")
        each = stuck.join(self.automata, "pattern_id").withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(255))))
        to = F.get("delta", F.col("state") * F.col("n_classes") + F.get("classes", F.col("byte")))
        self.missing = each.filter(to != 0).select("pattern_id", "state", "byte")

    def unpersist(self) -> None:
        """Deletes what was written; the tables can't be read any more."""
        delete(self.automata.sparkSession, self._path)


def _fold(text: Column) -> Column:
    """Whether the automaton of the same row accepts the whole text."""
    state = F.aggregate(bytes_of(F.encode(text, "UTF-8")), F.lit(START), lambda s, b: F.get(F.col("__delta"), s * F.col("__n") + F.get(F.col("__classes"), b)))
    return F.get(F.col("__final"), state)


def matched(rows: DataFrame, patterns: DataFrame, value: str, by: str = "pattern_id", semantics: str = "all", pattern_of: Callable[[str], str] = str, **limits) -> DataFrame:
    """``rows`` with a column ``matches``: whether the whole ``value`` is in the language of the pattern that ``by`` names in ``patterns`` (pattern_id, pattern); null without a value or a pattern that compiles.

    Each pattern is compiled once, and the fold over a value's bytes is a column expression over the joined automaton. Spark picks the join by the measured size of the automata, and splits a pattern that many rows name.
    """
    automata = written(compiled(patterns, pattern_of, semantics=semantics, **limits), new_folder(rows.sparkSession, "automata"))
    own = automata.select(F.col("pattern_id").alias("__id"), *[F.col(c).alias(n) for c, n in (("delta", "__delta"), ("n_classes", "__n"), ("classes", "__classes"), ("final", "__final"))])
    joined = rows.join(own, rows[by] == own["__id"], "left")
    return joined.withColumn("matches", F.when(rows[value].isNotNull(), _fold(rows[value]))).select(*rows.columns, "matches")


def conforms(rows: DataFrame, schema: str, value: str, **limits) -> DataFrame:
    """``rows`` with a column ``matches``: whether the text ``value`` has the form that the JSON Schema in the same row's ``schema`` asks for; null without one of them, or where the schema has no pattern."""
    schemas = rows.select(F.col(schema).alias("pattern_id"), F.col(schema).alias("pattern")).distinct()
    return matched(rows, schemas, value, schema, pattern_of=regex_from_str, **limits)
