"""A vocabulary as a table of prefix trees, and automata walked over it from the states that are reached.

Tokens in order are cut into blocks of ``BLOCK_TOKENS``; a row of the table is the prefix tree of one block and its number, its nodes in preorder: depth, byte, where
the subtree ends, and the ids of tokens that end at nodes. A walk takes a set of states down a tree at once: at each node those
that go on by its byte stay, and where none does, the subtree is skipped. So the work is one step for each pair of a state and a node
that it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.automaton import DEAD
from ..workers import importable

BLOCK_TOKENS = 2048
TRIE = "block long, depths array<int>, bytes binary, ends array<int>, nodes array<int>, ids array<array<long>>"
_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())))
_NAMES = [x.split()[0] for x in TRIE.split(", ")]
#: Rows of a batch of edges.
BATCH_EDGES = 1 << 18


def block(tokens: list[bytes], ids: list[list[int]]) -> tuple:
    """A row of the table, without its number, from tokens in order. Node 0 is the root."""
    depths, data, ends, nodes = [0], bytearray(1), [0], []
    path = [0]
    before = b""
    for token in tokens:
        shared = 0
        while shared < min(len(token), len(before)) and token[shared] == before[shared]:
            shared += 1
        for node in path[shared + 1 :]:
            ends[node] = len(depths)
        del path[shared + 1 :]
        for i in range(shared, len(token)):
            path.append(len(depths))
            depths.append(i + 1)
            data.append(token[i])
            ends.append(0)
        nodes.append(path[-1])
        before = token
    for node in path:
        ends[node] = len(depths)
    return depths, bytes(data), ends, nodes, ids


def trie(tokens: DataFrame, partitions: int, most: int = BLOCK_TOKENS) -> DataFrame:
    """The table of (token, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, list[int]]] = []
        made_so_far = 0

        def made() -> pa.RecordBatch:
            nonlocal made_so_far
            row = (TaskContext.get().partitionId() << 32 | made_so_far, *block(*map(list, zip(*held, strict=True))))
            made_so_far += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for pair in zip(batch.column("token").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append(pair)
                if len(held) == most:
                    yield made()
                    held.clear()
        if held:
            yield made()

    importable(tokens.sparkSession)
    return tokens.repartitionByRange(partitions, "token").sortWithinPartitions("token").mapInArrow(run, TRIE)


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(batch.column(name).to_pylist() for name in _NAMES[1:]), strict=True)


def walk_block(delta: np.ndarray, n_classes: int, classes: np.ndarray, useful: np.ndarray, starts: np.ndarray, row: tuple) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(ids, states, states reached) of each token of a block by which some of ``starts`` reach a useful state."""
    depths, data, ends, nodes, ids = row
    columns = classes[np.frombuffer(data, np.uint8)].tolist()
    level: list[tuple[np.ndarray, np.ndarray]] = [(starts, starts)] * (max(depths) + 1)
    tokens = iter(zip(nodes, ids, strict=True))
    node, own = next(tokens, (len(depths), []))
    at = 0
    while at < len(depths):
        while node < at:
            node, own = next(tokens, (len(depths), []))
        if at:
            from_, to = level[depths[at] - 1]
            to = delta[to * n_classes + columns[at]]
            live = to != DEAD
            if not live.all():
                from_, to = from_[live], to[live]
            if not len(to):
                at = ends[at]
                continue
            level[depths[at]] = from_, to
        else:
            from_, to = level[0]
        if node == at:
            good = useful[to]
            if good.any():
                yield own, from_[good], to[good]
        at += 1


class Edges:
    """Collects steps and gives them out as batches (state, token_id, next_state), with a number of the pattern before them where there is one."""

    def __init__(self, pattern: pa.DataType | None = None):
        self.pattern, self.parts, self.size = pattern, [], 0

    def add(self, ids: list[int], from_: np.ndarray, to: np.ndarray, pattern=None) -> None:
        for i in ids:
            self.parts.append((pattern, i, from_, to))
        self.size += len(ids) * len(from_)

    def batch(self) -> pa.RecordBatch:
        lengths = [len(p[2]) for p in self.parts]
        columns = [pa.array(np.concatenate([p[2] for p in self.parts]), pa.int32()), pa.array(np.repeat([p[1] for p in self.parts], lengths), pa.int64()), pa.array(np.concatenate([p[3] for p in self.parts]), pa.int32())]
        names = ["state", "token_id", "next_state"]
        if self.pattern is not None:
            whose = pa.array([p[0] for p in self.parts], self.pattern)
            columns, names = [whose.take(pa.array(np.repeat(np.arange(len(lengths)), lengths))), *columns], ["pattern_id", *names]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, names)


def shared_ids(frame: DataFrame) -> bool:
    """Whether an id stands for several tokens (or stands there twice)."""
    return not frame.groupBy("token_id").count().filter(F.col("count") > 1).isEmpty()
