import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework import errors
from latticework.functions import patterns as P
from latticework.plans import regex_syntax
from latticework.plans.automaton import DEAD, START, compile_pattern, utf8
from latticework.plans.schema_regex import regex_from_value

PATTERNS = ["a", "ab|cd", "a*b+c?", "(ab)*", "[a-c]{2,3}x", "a{2}", "a{2,}b", "(a|b)*abb", "[^a]b", ".", "a.c", r"\d+", r"\w\W", r"\s", r"[^\W\d]\w*", "(?i:aB)c", "(?i)é", "[é-ü]+", "😇| [😈-😍][😇-😎]*", r"\x41B", "[]a]", "[^]a]", "[a-]", r"[\]\\]", "(?:x|yz)+?", "(?P<n>a)(?<m>b)", "", "(|a)b", "[[:digit:]]+", "[a-c&&[^b]]", r"\.\*", r"\p{Lu}\P{L}", "(ac|[^a])+", "a$", "(?s).", "x{0}y"]
WORDS = ["", "a", "ab", "cd", "abb", "aabb", "b", "bb", "c", "xx", "abc", "aBc", "ABc", "é", "É", "ü", "😇", " 😍😎", "12", "٣", "_a1", "a\n", "\n", "]", "-", "\\", "AB", "yz", "xyz", "acac", "A1", "Aa", ".*", "aax", "abcx", "aab", "y", "a c", "a-"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_plain_language(pattern):
    """Against the matcher of the standard library, whose spellings of a few things differ."""
    theirs = pattern.replace("(?<m>", "(?P<m>").replace("[[:digit:]]", "[0-9]").replace("[a-c&&[^b]]", "[ac]").replace(r"\p{Lu}\P{L}", r"[A-Z][^\W\d_a-zA-Z]|[A-Z][0-9]")
    automaton = compile_pattern(pattern, "all")
    for word in WORDS:
        want = re.fullmatch(theirs, word) is not None and not (theirs.endswith("$") and word.endswith("\n"))
        assert automaton.accepts(word.encode()) == want, word


@settings(max_examples=150, deadline=None)
@given(st.from_regex(r"(a|b|[ab]|\.)(\*|\+|\?)?((a|b|[bc]|\(a\|bc?\))(\*|\?|\{1,2\})?){0,4}", fullmatch=True), st.lists(st.text("abc", max_size=6), max_size=12))
def test_random_patterns(pattern, words):
    automaton = compile_pattern(pattern, "all")
    for word in words:
        assert automaton.accepts(word.encode()) == bool(re.fullmatch(pattern, word))


def test_leftmost_first():
    assert not compile_pattern("1|12").accepts(b"12")
    assert compile_pattern("12|1").accepts(b"12")
    assert compile_pattern("(1|12)x").accepts(b"12x")
    number = regex_from_value({"type": ["integer", "number"]})
    assert not compile_pattern(number).accepts(b"12.3") and compile_pattern(number, "all").accepts(b"12.3")
    assert compile_pattern("a??b").accepts(b"ab")
    assert not compile_pattern("a*?").accepts(b"a")


def shape(automaton):
    """The graph as a form that doesn't depend on numbering, from the start by byte class."""
    return automaton.n_states, [sorted({automaton.step(s, b) for b in range(256)}) for s in range(automaton.n_states)], automaton.final.tolist()


def refined(automaton, labels):
    """How many blocks there are when the partition by labels is split until nothing changes."""
    block, n = labels, len(set(labels))
    rows = automaton.delta.reshape(-1, automaton.n_classes).tolist()
    while True:
        kinds = {}
        block = [kinds.setdefault((b, *(block[t] for t in row)), len(kinds)) for b, row in zip(block, rows, strict=True)]
        if len(kinds) == n:
            return n
        n = len(kinds)


SIZED = [*PATTERNS, r"\w{1,9}@[a-z0-9-]+(\.[a-z0-9-]+)+", "(a|b)*a(a|b){3}", "(ab|cb)*d|(eb|fb)*d", "a(xx|yx)*|b(xx|yx)*", "(0|1(01*0)*1)*", "((a|b){4}c)*", "(é|è|ê){2,5}", "(a?b?c?d?){3}"]


@pytest.mark.parametrize("pattern", SIZED)
@pytest.mark.parametrize("semantics", ["first", "all"])
def test_minimal_automata(pattern, semantics):
    """The same ends and useful states along every way from the start, and no two states that could be one."""
    plain, least = (compile_pattern(pattern, semantics, minimal=m) for m in (False, True))
    seen, todo = {(START, START)}, [(START, START)]
    while todo:
        a, b = todo.pop()
        assert (plain.final[a], plain.useful[a]) == (least.final[b], least.useful[b])
        for byte in range(256):
            pair = plain.step(a, byte), least.step(b, byte)
            assert (pair[0] == DEAD) == (pair[1] == DEAD)
            if pair not in seen:
                seen.add(pair)
                todo.append(pair)
    # What a late match tells apart stays apart: the bit is the same for all that lead to a state.
    of = {b: {a for a, c in seen if c == b} for _, b in seen}
    assert len(of) + (DEAD not in of) == least.n_states <= plain.n_states
    labels = list(zip(least.final.tolist(), least.useful.tolist(), [s == DEAD for s in range(least.n_states)], strict=True))
    assert refined(least, labels) <= least.n_states
    if semantics == "all" and not plain.final.any():
        assert least.n_states <= 2


def test_blocks_are_the_coarsest():
    """Random tables: as many blocks as splitting everything again and again gives."""
    import numpy as np

    from latticework.plans.automaton import minimised

    rng = np.random.default_rng(4)
    for n in (2, 3, 8, 30, 60):
        for _ in range(40):
            delta = np.where(rng.random((n, 2)) < 0.3, DEAD, rng.integers(0, n, (n, 2)))
            delta[DEAD] = DEAD
            labels = [(bool(x), i == DEAD) for i, x in enumerate(rng.random(n) < 0.3)]
            block = minimised(delta, labels)
            whole = [*labels]
            size = len(set(whole))
            while True:
                kinds = {}
                whole = [kinds.setdefault((b, *(whole[t] for t in row)), len(kinds)) for b, row in zip(whole, delta.tolist(), strict=True)]
                if len(kinds) == size:
                    break
                size = len(kinds)
            assert len({(a, b) for a, b in zip(block.tolist(), whole, strict=True)}) == len(set(block.tolist())) == size


def test_copies_of_a_set_are_cheap():
    import time

    start = time.time()
    automaton = compile_pattern(r"[\w.+-]{1,64}@[a-z0-9-]+(\.[a-z0-9-]+)+")
    assert time.time() - start < 6 and automaton.accepts("jörg.ä+x@mail.example".encode())


def test_late_matches_make_their_own_states():
    automaton = compile_pattern("0|[1-9][0-9]*")
    zero, one = automaton.walk(b"0"), automaton.walk(b"1")
    more = automaton.walk(b"11")
    assert len({zero, one, more}) == 3 and automaton.walk(b"111") == more
    assert all(automaton.final[[zero, one, more]])
    after = automaton.walk(b"00")
    assert after != DEAD and not automaton.useful[after] and not automaton.final[after]
    assert shape(automaton)[0] == 6


@pytest.mark.parametrize("a, b", [(0, 0x10FFFF), (0x7F, 0x80), (0x7FF, 0x800), (0xD000, 0xE100), (0xFFFF, 0x10000), (0x1F607, 0x1F60E), (0xE9, 0x2603)])
def test_byte_ranges_of_code_points(a, b):
    products = list(utf8(((a, b),)))
    inside = lambda data: sum(len(p) == len(data) and all(x <= d <= y for (x, y), d in zip(p, data, strict=True)) for p in products)
    samples = {0, 0x7F, 0x80, 0x7FF, 0x800, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF, a, b, max(0, a - 1), min(0x10FFFF, b + 1), (a + b) // 2}
    for c in samples:
        if not 0xD800 <= c <= 0xDFFF:
            assert inside(chr(c).encode()) == (a <= c <= b), hex(c)


@pytest.mark.parametrize("pattern", ["(", ")", "a)", "[a", "a{2,1}", "*a", r"\b", r"(?=a)", r"(?!a)", r"(?<=a)b", r"\1", "a{", "[b-a]", r"\p{Nope}", "(?z)", r"\q", "(?-u:a)", "[[:nope:]]", r"\x{110000}"])
def test_what_is_refused(pattern):
    with pytest.raises(errors.IndexDfaError):
        compile_pattern(pattern)


def test_start_anchors():
    with pytest.raises(errors.DfaHasNoStartState):
        compile_pattern("^a")
    assert compile_pattern("a^b|c").accepts(b"c")
    assert not compile_pattern("a^b|c").accepts(b"ab")


def test_patterns_of_schemas_compile():
    for pattern in (P.STRING, P.NUMBER, P.DATE_TIME, P.DATE, P.TIME, P.UUID, P.URI, P.EMAIL):
        compile_pattern(pattern)
    automaton = compile_pattern(regex_from_value({"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}))
    assert automaton.accepts('{"a": "é\\n"}'.encode()) and not automaton.accepts(b'{"a": "\xff"}')
    assert automaton.walk(b"") == START


def test_classes_follow_unicode():
    assert regex_syntax.complement(()) == ((0, 0x10FFFF),)
    assert regex_syntax.union(((1, 3),), ((4, 5),)) == ((1, 5),)
    assert regex_syntax.intersection(((1, 5),), ((3, 9),)) == ((3, 5),)
    assert compile_pattern(r"\d").accepts("٣".encode())
