import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import spelling_variants as op

from . import cases


def near(a, b):
    """By the definition: one code point put in, taken out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [form, None, n, len(others), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def dictionary(seed=1, n=500):
    """Words of two letters and few beginnings and ends, so that blocks are large, and each other's variants."""
    rng = random.Random(seed)
    made = {rng.choice(["unter", "aab", "éà"]) + "".join(rng.choice("ab") for _ in range(rng.randint(3, 7))) + rng.choice(["", "ung", "bbb"]) for _ in range(n)}
    made |= {"x" * 300, "x" * 301, "x" * 200 + "y" + "x" * 99, "a" * 6, "a" * 7, "a" * 8}
    return {w: rng.choice([5, 6, 30, 31, 160, 900]) for w in sorted(made) if len(w) >= 6}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({g[0] for g in got}) == len(got)
    return {g[0]: g[1:] for g in got}


def test_against_all_pairs(spark):
    counts = dictionary()
    want = brute(counts)
    assert sum(w[0] is not None for w in want.values()) > 100 and sum(w[1] != k and w[1] != w[0] for k, w in want.items()) > 10
    for most in (3, 64):
        assert rows_of(op.variants(table(spark, counts), most)) == want


def test_pairs_come_once_and_blocks_stay_small(spark, monkeypatch):
    counts = dictionary(2, 300)
    pairs, written = op.near_pairs(table(spark, counts), 4)
    got = [frozenset((r.word, r.other)) for r in pairs.collect()]
    assert len(got) == len(set(got)) == sum(near(a, b) for a in counts for b in counts) // 2
    assert len(written) > 2


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abé", min_size=6, max_size=9), min_size=2, max_size=8, unique=True))
def test_edits(words):
    words.sort(key=len)
    i, j = np.triu_indices(len(words), 1)
    got = op.edits_at(words, i, j)
    for a, b, at in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
        assert (at >= 0) == near(words[a], words[b])
        assert at == op.edit_at(words[a], words[b]) == op.edit_at(words[b], words[a])


def test_words_of_documents(spark):
    data = cases.rows() + [(2000 + i, "Überprüfung überprüfung-STRASSE × x÷yzabcd " * 3, "de", "a", 0) for i in range(50)]
    want = Counter()
    for doc, text, *_ in data:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(data, cases.SCHEMA).selectExpr("*", "'x' as word", "1 as n", "2 as m")
    counts = op.counted(docs)
    assert {r.word: r.n for r in counts.collect()} == want
    assert rows_of(op.variants(counts)) == brute(want)


def test_long_chains_have_one_root(spark):
    counts = {"a" * (6 + i): 5**i * 5 for i in range(9)}
    got = rows_of(op.variants(table(spark, counts)))
    assert {g[1] for g in got.values()} == {"a" * 14} and got["a" * 6][0] == "a" * 7


def test_empty(spark):
    assert op.variants(op.counted(cases.table(spark).limit(0))).count() == 0
