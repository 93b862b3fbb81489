import json
import random

import numpy as np
import pytest

from latticework import Guide, Index, Vocabulary, errors
from latticework.operators import index as index_module
from latticework.operators import trie as T
from latticework.operators.pattern_table import PatternTable, conforms, matched
from latticework.plans.automaton import START, compile_pattern


def walked(automaton, tokens, starts):
    out = set()
    row = T.block(*map(list, zip(*sorted((t, [i]) for t, i in tokens.items()), strict=True)))
    for ids, from_, to in T.walk_block(automaton.delta, automaton.n_classes, automaton.classes, automaton.useful, np.array(starts, np.int32), row):
        out |= {(int(a), i, int(b)) for i in ids for a, b in zip(from_, to, strict=True)}
    return out


def test_trees_hold_every_token_and_walks_agree_with_single_steps():
    rng = random.Random(3)
    tokens = {bytes(rng.choices(b"ab1\xc3\xa9", k=rng.randint(0, 6))): i for i in range(300)}
    depths, data, ends, nodes, ids = T.block(*map(list, zip(*sorted((t, [i]) for t, i in tokens.items()), strict=True)))
    spelled, path = {}, []
    for at, (depth, byte) in enumerate(zip(depths, data, strict=True)):
        path = [*path[: max(0, depth - 1)], byte] if at else []
        spelled[at] = bytes(path)
        assert all(d > depth for d in depths[at + 1 : ends[at]]) and (ends[at] == len(depths) or depths[ends[at]] <= depth)
    assert {spelled[n]: i[0] for n, i in zip(nodes, ids, strict=True)} == tokens
    assert len(set(spelled.values())) == len(spelled)
    for pattern in ("(a|b1)*[1b]?", "é+a?", "b{2,5}"):
        automaton = compile_pattern(pattern)
        starts = [s for s in range(1, automaton.n_states) if automaton.useful[s]]
        want = {(s, i, to) for s in starts for t, i in tokens.items() if automaton.useful[to := automaton.walk(t, s)]}
        assert walked(automaton, tokens, starts) == want


def test_work_follows_states_and_nodes_that_are_reached():
    """Subtrees where no state goes on aren't entered."""
    steps = 0

    class Counting(np.ndarray):
        def __getitem__(self, key):
            nonlocal steps
            steps += 1
            return np.asarray(self)[key]

    tokens = sorted({f"{a}{b}{c}".encode() for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"})
    automaton = compile_pattern("ab[a-h]")
    row = T.block(tokens, [[i] for i in range(len(tokens))])
    found = list(T.walk_block(automaton.delta.view(Counting), automaton.n_classes, automaton.classes, automaton.useful, np.array([START], np.int32), row))
    assert len(found) == 8 and steps == 8 + 8 + 8


def test_only_reached_states_are_walked(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(index_module, "steps", lambda automaton, tree, states, plain=index_module.steps: seen.append(states) or plain(automaton, tree, states))
    index = Index("(a{50}|b)c*", Vocabulary(9, {"b": [1], "c": [2], "cc": [3], "a" * 50: [4]}, spark))
    every = sum(seen, [])
    assert len(every) == len(set(every)) == index.states.count() < 8 < index.automaton.n_states


def test_cursors_hold_the_states_they_visit(spark, monkeypatch):
    monkeypatch.setattr(index_module, "CACHED_STATES", 3)
    index = Index("[ab]{30}", Vocabulary(9, {"a": [1], "b": [2]}, spark))
    guide = Guide(index)
    for _ in range(8):
        guide.advance(1)
    assert len(index._rows) == 3 and guide.get_tokens() == [1, 2]
    assert len(index.get_transitions()) == 31


def test_tables_of_patterns_are_indexes_of_each(spark):
    vocabulary = Vocabulary(99, {"a": [1, 7], "b": [2], "ab": [3], "ba": [4, 1], "1": [5], "é": [6]}, spark)
    fit = {10: "(ab)*", 11: "a+b?", 12: "[ab1é]{1,4}", 13: "(a|b|1){2}", 14: "a"}
    unfit, broken = {20: "a1?x", 21: "xy|z", 22: "b1{3}c"}, {30: "(", 31: "a{2,1}"}
    rows = [*(fit | unfit | broken).items(), (10, "(ab)*"), (None, "a"), (40, None)]
    table = PatternTable(spark.createDataFrame(rows, "pattern_id int, pattern string").selectExpr("*", "1 as state").repartition(3), vocabulary)
    edges, states = table.edges.collect(), table.states.collect()
    for number, pattern in fit.items():
        index = Index(pattern, vocabulary)
        assert {(r.state, r.token_id, r.next_state) for r in edges if r.pattern_id == number} == {tuple(r) for r in index.edges.collect()}
        assert {(r.state, r.is_final) for r in states if r.pattern_id == number} == {tuple(r) for r in index.states.collect()}
    missing = {}
    for r in table.missing.collect():
        missing.setdefault(r.pattern_id, {}).setdefault(r.state, set()).add(chr(r.byte))
    for number, pattern in unfit.items():
        with pytest.raises(errors.IncompatibleVocabulary) as e:
            Index(pattern, vocabulary)
        details = e.value.details
        assert missing.pop(number)[details["error_state"]] == set(details["missing_tokens"])
    assert not missing
    assert {r.pattern_id for r in table.errors.collect()} == set(broken)
    table.unpersist()


def test_no_patterns(spark):
    table = PatternTable(spark.createDataFrame([], "pattern_id string, pattern string"), Vocabulary(9, {"a": [1]}, spark))
    assert [x.count() for x in (table.edges, table.states, table.errors, table.missing)] == [0] * 4


def test_rows_are_held_against_their_own_pattern(spark):
    import re

    rng = random.Random(2)
    patterns = [("p", "a*b"), ("q", "[é-ü]{1,3}"), ("r", "(ab|c)+"), ("x", "(")]
    words = [None, *("".join(rng.choices("abcéü", k=rng.randint(0, 4))) for _ in range(200))]
    rows = spark.createDataFrame([(p, w) for p in ("p", "q", "r", "x", "none", None) for w in words], "which string, w string")
    got = matched(rows.withColumn("final", rows["w"]), spark.createDataFrame(patterns, "pattern_id string, pattern string"), "w", "which").collect()
    assert len(got) == 6 * len(words)
    for r in got:
        want = None if r.w is None or r.which not in ("p", "q", "r") else bool(re.fullmatch(dict(patterns)[r.which], r.w))
        assert r.matches is want, r


def test_rows_are_held_against_their_own_schema(spark):
    short, item = {"type": "string", "maxLength": 2}, {"type": "array", "items": {"type": "integer"}, "minItems": 1}
    cases = [(short, '"é"', True), (short, '"abc"', False), (item, "[1, 22]", True), (item, "[]", False), ({"huh": 1}, "1", None), (short, None, None)]
    rows = spark.createDataFrame([(json.dumps(s), v, w) for s, v, w in cases] + [("no json", "1", None), (None, "1", None)], "schema string, value string, want boolean")
    assert all(r.matches is r.want for r in conforms(rows, "schema", "value").collect())
