import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import personal_data as op

from . import cases


def brute(text):
    """The base rules as plain patterns."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1290.@-+ ()%é\n", max_size=60))
def test_base_rules(text):
    assert op.base_spans(text) == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "x@y.example.com", "+1 (974) 555-3436", "10.0.0.300", "192.168.1.1", "a@b@c.d", "0000000000000000", "v1.2.3.4", "a", " ", "é", "@", "+"]), max_size=12))
def test_base_rules_on_likely_text(parts):
    text = "".join(parts)
    assert op.base_spans(text) == brute(text)


def test_numbers_of_any_length():
    text = "0" * 9000 + ".1.2.3 " + "9" * 9000 + " +" + "1" * 9000
    assert [s[1] for s in op.base_spans(text)] == [1]
    assert op.scan(text)[0] == op.base_spans(text)


def test_em_finds_the_better_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.4
    rates = [0.95, 0.9, 0.8, 0.6, 0.7]
    ballot = np.stack([np.where(rng.random(len(truth)) < 0.2, 0, np.where((rng.random(len(truth)) < r) == truth, 2, 1)) for r in rates], axis=1)
    patterns, at, n = np.unique(ballot, axis=0, return_inverse=True, return_counts=True)
    table, prior, post = op.reliabilities(patterns, n)
    assert abs(prior - 0.4) < 0.03
    best = np.log(0.4 / 0.6) + sum(np.where(ballot[:, i] == 2, 1, np.where(ballot[:, i] == 1, -1, 0)) * np.log(r / (1 - r)) for i, r in enumerate(rates))
    assert ((post[at.ravel()] > 0.5) == truth).mean() > ((best > 0) == truth).mean() - 0.005
    hit = [table[i, 1, 2] / (table[i, 1, 2] + table[i, 1, 1]) for i in range(5)]
    assert np.allclose(hit, rates, atol=0.05)


def test_whole_operator(spark):
    extra = [(500 + i, t, None, None, None) for i, t in enumerate(["mail me: anna [at] example [dot] com", "tel. 0171 555 3436", "write to x.y@mail.example.org or +49 30 1234567890", "card 4111-1111-1111-1111 from 10.1.2.3"] * 5)]
    data = cases.rows() + extra
    docs = spark.createDataFrame(data, cases.SCHEMA).selectExpr("*", "1 as kind", "'x' as base")
    got = op.detect(docs).collect()
    assert len(got) == len(data)
    want = sorted((str(r[0]), hashlib.sha256(op.spell(brute(r[1] or "")).encode()).hexdigest()) for r in data)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert (by[502].n_email, by[502].n_phone, by[503].n_card, by[503].n_ip) == (1, 1, 1, 1)
    assert "email:9:36" in by[500].spans
    for r in got:
        base = op.spell(brute(dict((x[0], x[1]) for x in data).get(r.doc_id) or ""))
        if r.doc_id not in (None, 5, 6):
            assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_empty(spark):
    assert op.detect(cases.table(spark).limit(0)).count() == 0


def test_long_texts_take_linear_time():
    import time

    for text in ("7" * 1_000_000, " ".join(f"a{i}@mail{i % 7}.example.com" for i in range(100_000)), "1." * 300_000, "@a" * 300_000, "+1(" * 200_000):
        start = time.process_time()
        base, more = op.scan(text)
        op.join(base, [x[:3] for x in more if not x[4]])
        assert time.process_time() - start < 4  # a few times what is needed: the machine may be busy


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 3), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 3), st.integers(1, 9)), max_size=12))
def test_joined_spans_against_all_pairs(base, more):
    base, more = (sorted((a, k, a + n) for a, k, n in x) for x in (base, more))
    taken = list(base)
    for a, k, b in more:
        if not any(a < y and x < b for x, _, y in taken):
            taken.append((a, k, b))
    assert op.join(base, more) == sorted(taken)


def test_spans_against_the_fitted_classifier(spark):
    """Every document's ``spans``, recomputed from the counts of all candidates."""
    from collections import Counter

    extra = [(500 + i, t, None, None, None) for i, t in enumerate(["mail me: anna [at] example [dot] com", "tel. 0171 555 3436", "write to x.y@mail.example.org or +49 30 1234567890", "card 4111-1111-1111-1111 from 10.1.2.3"] * 5)]
    data = cases.rows() + extra
    scans = [(r[0], op.scan(r[1] or "")) for r in data]
    weights = op.classifiers([(k, c, n) for (k, c), n in Counter((k, c) for _, (_, more) in scans for _, k, _, c, _ in more).items()])
    want = []
    for doc, (base, more) in scans:
        taken = list(base)
        for a, k, b, c, strict in more:
            p = 1 / (1 + np.exp(-(op.features(np.array([c])) @ weights[k])[0]))
            if not strict and p >= op.ACCEPT and not any(a < y and x < b for x, _, y in taken):
                taken.append((a, k, b))
        want.append((doc, ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in sorted(taken))))
    got = [(r.doc_id, r.spans) for r in op.detect(spark.createDataFrame(data, cases.SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
