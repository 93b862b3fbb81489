"""A guide for each key of a stream: its state and its last states live in the stream's state store.

:func:`guide_stream` follows tokens; :func:`command_stream` takes rows that are commands (advance, roll back, reset), keeps the states that can be rolled back to as a list state, and lets go of keys that have been idle.

Rows of a micro-batch are put in order before they are followed; rows that come in a later batch follow what was already followed, and what is later than the
watermark of the stream is dropped by Spark if one is set. A token that leads nowhere is reported as not accepted and leaves the state as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.guide import MAX_ROLLBACK
from ..operators.index import Index
from ..operators.vocabulary import Vocabulary
from ..plans.automaton import DEAD, START
from ..workers import importable

STATE = "state int, before array<int>"


def guide_stream(rows: DataFrame, index: Index, vocabulary: Vocabulary, key: str, order: str, token: str = "token_id", max_rollback: int = MAX_ROLLBACK) -> DataFrame:
    """(key, order, token_id, state, accepted, finished, stored) for every row of the stream. The vocabulary is looked up by a stream-static join."""
    importable(rows.sparkSession)
    automaton, eos = index.automaton, vocabulary.eos_token_id
    static = vocabulary.frame.groupBy("token_id").agg({"token": "min"}).toDF("__id", "__token")
    joined = rows.join(static, rows[token] == static["__id"], "left").select(rows[key].alias("key"), rows[order].alias("at"), rows[token].alias("token_id"), "__token")
    kinds = dict(rows.dtypes)
    out = f"key {kinds[key]}, at {kinds[order]}, token_id {kinds[token]}, state int, accepted boolean, finished boolean, stored int"

    def follow(group: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, before = (kept.get[0], list(kept.get[1])) if kept.exists else (START, [])
        batch = pd.concat(list(frames)).sort_values(["at", "token_id"], kind="stable")
        found = []
        for at, t, data in zip(batch["at"], batch["token_id"], batch["__token"], strict=True):
            to = automaton.walk(bytes(data), state) if data is not None and t != eos else DEAD
            accepted = bool(automaton.useful[to])
            if accepted:
                before = [*before, state][-max_rollback:]
                state = to
            found.append((group[0], at, t, state, accepted, bool(automaton.final[state]), len(before)))
        kept.update((int(state), [int(b) for b in before]))
        yield pd.DataFrame(found, columns=["key", "at", "token_id", "state", "accepted", "finished", "stored"])

    return joined.groupBy("key").applyInPandasWithState(follow, out, STATE, "append", GroupStateTimeout.NoTimeout)


ADVANCE, BACK, RESET, EXPIRED = "advance", "back", "reset", "expired"
COMMANDS = ["at", "command", "argument", "state", "accepted", "finished", "stored"]
#: Commands are kept in a state store that has lists and timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class GuideProcessor(StatefulProcessor):
    """A key's guide: ``state`` its state, ``before`` the last states in order, the oldest first.

    Commands of a micro-batch are followed in their order. An advance that leads nowhere, a roll-back of more states than are stored and a command of another name are reported as not accepted and change nothing. ``reset`` goes back to the
    start and keeps what can be rolled back to. A key without commands for ``idle_ms`` is reported as expired and forgotten.
    """

    def __init__(self, automaton, eos: int, max_rollback: int, idle_ms: int | None):
        self.automaton, self.eos, self.max_rollback, self.idle_ms = automaton, eos, max_rollback, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state int")
        self.before = handle.getListState("before", "state int")
        self.steps: dict[tuple[int, int], int] = {}

    def step(self, state: int, token: int, data: bytes | None) -> int:
        if data is None or token == self.eos:
            return DEAD
        if (state, token) not in self.steps:
            if len(self.steps) >= 1 << 16:
                self.steps.clear()
            to = self.automaton.walk(bytes(data), state)
            self.steps[state, token] = to if self.automaton.useful[to] else DEAD
        return self.steps[state, token]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()[0] if self.state.exists() else START
        before = [r[0] for r in self.before.get()] if self.before.exists() else []
        batch = pd.concat(list(rows)).sort_values(["at", "command", "argument"], kind="stable")
        found = []
        for at, command, argument, data in zip(batch["at"], batch["command"], batch["argument"], batch["data"], strict=True):
            accepted = True
            if command == ADVANCE and (to := self.step(state, argument, data)) != DEAD:
                before.append(state)
                if self.max_rollback:
                    del before[: -self.max_rollback]
                state = to
            elif command == BACK and 0 <= argument <= len(before):
                if argument:
                    state = before[-int(argument)]
                    del before[-int(argument) :]
            elif command == RESET:
                state = START
            else:
                accepted = False
            found.append((key[0], at, command, argument, state, accepted, bool(self.automaton.final[state]), len(before)))
        self.state.update((int(state),))
        if before:
            self.before.put([(int(b),) for b in before])
        else:
            self.before.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(found, columns=["key", *COMMANDS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()[0]
        self.state.clear()
        self.before.clear()
        yield pd.DataFrame([(key[0], None, EXPIRED, None, state, True, bool(self.automaton.final[state]), 0)], columns=["key", *COMMANDS])

    def close(self) -> None:
        pass


def command_stream(rows: DataFrame, index: Index, vocabulary: Vocabulary, key: str, order: str, command: str, argument: str, max_rollback: int = MAX_ROLLBACK, idle_ms: int | None = None) -> DataFrame:
    """(key, at, command, argument, state, accepted, finished, stored) for every row of a stream of commands: ``advance`` by a token id, ``back`` by a number of states, ``reset``. A ``max_rollback`` of 0 sets no limit.

    The session needs a state store with lists and timers (see ``STORE``). With ``idle_ms`` a key that has been idle for so long is forgotten.
    """
    importable(rows.sparkSession)
    static = vocabulary.frame.groupBy("token_id").agg({"token": "min"}).toDF("__id", "__token")
    joined = rows.join(static, (rows[argument] == static["__id"]) & (rows[command] == ADVANCE), "left").select(rows[key].alias("key"), rows[order].alias("at"), rows[command].alias("command"), rows[argument].cast("long").alias("argument"), F.col("__token").alias("data"))
    kinds = dict(rows.dtypes)
    out = f"key {kinds[key]}, at {kinds[order]}, command string, argument long, state int, accepted boolean, finished boolean, stored int"
    processor = GuideProcessor(index.automaton, vocabulary.eos_token_id, max_rollback, idle_ms)
    return joined.groupBy("key").transformWithStateInPandas(processor, out, "append", "none" if idle_ms is None else "processingTime")
