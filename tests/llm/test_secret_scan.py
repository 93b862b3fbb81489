import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import secret_scan as op

from . import cases


def brute(text):
    """The base rules as plain patterns."""
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


PARTS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcd1234", "x", "AKIA", "B" * 11, "0123456789abcdef" * 2, "ab", ".", "é", "\n", "ſecret", "toKen"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_base_rules(parts):
    text = "".join(parts)
    base, more = op.scan(text, text.encode())
    assert [x[:3] for x in base] == brute(text)
    for a, b in more:
        assert b - a >= 8 and all(b <= s or e <= a for s, _, e in brute(text))


def words(rng, n):
    return [rng.choice(["mail", "page", "item", "file", "chapter"]) + str(rng.randint(1, 99)) + rng.choice([".example.com", "-draft", "_final.txt", ".2024"]) for _ in range(n)]


def test_automata_learn_lengths_prefixes_and_alphabets():
    rng = random.Random(4)
    keys = ["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)) for _ in range(600)]
    automaton = op.Automaton(keys)
    fresh = "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16))
    for other in (fresh[:-1], fresh + "A", "ZZZZ" + fresh[4:], fresh.lower()):
        assert automaton.score(fresh) > automaton.score(other) + 3
    # Any length, two symbols: all states are compatible.
    loop = op.Automaton(["".join(rng.choices("ab", k=min(60, 8 + int(rng.expovariate(0.2))))) for _ in range(2000)], rare=16)
    assert len(loop.log) < 0.7 * len(loop.states)
    # Probabilities of all short strings of a small alphabet sum up to one at most.
    small = op.Automaton(["ab", "abb", "a", "ba"] * 20, rare=2)
    strings = [""]
    for _ in range(4):
        strings += [s + c for s in strings for c in "ab" if len(s) < 4]
    assert 0.9 < sum(2.718281828459045 ** small.score(s) for s in set(strings)) <= 1


def planted(seed=8, n=400):
    """Documents with labelled credentials, and the same formats without a name before them."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        pin = "".join(rng.choices("0123456789abcdef", k=18))
        line = cases.sentence(rng, 20) + " " + " ".join(words(rng, 3))
        bare = i % 4 == 0
        text = line + (f" found {pin} there." if bare else f" password={pin} kept.") + " " + cases.sentence(rng, 5)
        made.append((3000 + i, text, "en", "a", 0, pin if bare else None))
    return made


def test_whole_operator(spark):
    more = planted()
    data = cases.rows() + [r[:5] for r in more] + [(9000, "AKIA" + "Q" * 20 + " token: 'abc", None, None, None)]
    docs = spark.createDataFrame(data, cases.SCHEMA).selectExpr("*", "1 as kind", "'x' as value")
    got = op.detect(docs).collect()
    assert len(got) == len(data)
    want = sorted((str(r[0]), hashlib.sha256(op.spell(brute(r[1] or "")).encode()).hexdigest()) for r in data)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    for doc, text, *_ in data:
        if doc not in (None, 5, 6):
            base = [x for x in op.spell(brute(text or "")).split(",") if x]
            assert set(base) <= set(filter(None, by[doc].spans.split(",")))
            assert (by[doc].n_assign, by[doc].n_access, by[doc].n_hex) == tuple(sum(x.startswith(k) for x in base) for k in op.KINDS)
    hits = sum(f"assign:{text.index(pin)}:{text.index(pin) + 18}" in by[doc].spans.split(",") for doc, text, *_, pin in more if pin)
    extra = sum(len([x for x in by[doc].spans.split(",") if x]) for doc, *_ in more) - 300 - hits
    assert hits >= 95 and extra <= 2, (hits, extra)


def test_few_labels_add_nothing(spark):
    data = [(1, "password=q1w2e3r4t5 and x9y8z7w6v5", "en", "a", 0)]
    assert [r.spans for r in op.detect(spark.createDataFrame(data, cases.SCHEMA)).collect()] == ["assign:0:19"]


def test_empty(spark):
    assert op.detect(cases.table(spark).limit(0)).count() == 0


def test_long_texts_take_linear_time():
    import time

    for text in ("password " * 60_000, "token" + " " * 500_000 + "x", "api" * 200_000, "0123456789abcde " * 40_000, "AKIA" * 150_000, "A1" * 300_000, "." * 600_000):
        start = time.time()
        op.scan(text, text.encode())
        assert time.time() - start < 3
