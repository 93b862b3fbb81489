import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import fingerprints as op

from . import cases


def brute_ends(data):
    """One byte at a time."""
    gear = [xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)]
    h, hashes = 0, []
    for b in data:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        hashes.append(h)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + op.LONGEST)
        if len(data) - at <= op.SHORTEST:
            end = len(data)
        else:
            for e in range(at + op.SHORTEST, end):
                zeros = op.STRICT if e <= at + op.NORMAL else op.LOOSE
                if hashes[e - 1] >> (32 - zeros) == 0:
                    end = e
                    break
        out.append(end)
        at = end
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3000), st.sampled_from([2, 30, 256]))
def test_ends_against_brute_force(seed, n, symbols):
    rng = random.Random(seed)
    data = bytes(rng.randrange(symbols) for _ in range(n))
    want = brute_ends(data)
    assert op.ends(data) == want
    for start in want[:3]:
        assert op.ends(data, start) == [e for e in want if e > start]


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), xxhash.xxh3_64_intdigest((r[1] or "").encode()) >> 1))
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        sets = [op.chunks(t.encode(), brute_ends(t.encode())) for t in (text, edited, after)]
        yield doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), op.as_text(sets[0]), op.as_text(sets[1]), op.containment(sets[0], sets[1]), op.containment(sets[0], sets[2])


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as key", "'x' as fingerprint")
    got = sorted(map(tuple, op.fingerprints(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_whole_operator(spark):
    check(spark, [r[:2] for r in cases.rows()])
    check(spark, [(1, "only one text of some length " * 9)])
    check(spark, [(7, "a b"), (3, None)])
    assert op.fingerprints(cases.table(spark).limit(0)).count() == 0


def test_rows_that_share_an_id_are_dealt_over_ranges(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 else i, cases.sentence(rng, 9)) for i in range(300)]
    rows += [(50, "one text of a common id")] * 40 + [(50, cases.sentence(rng, 5)) for _ in range(60)] + [(None, None)] * 30
    check(spark, rows)
    bounds, hot = op.bounds_of([op.LEAST_ID] * 4 + [7, 9, 9])
    assert hot == {op.LEAST_ID, 9} and bounds == sorted(bounds) and len(bounds) == 7 and bounds[3] == (op.LEAST_ID, 0) and bounds[4] == (7, 0)
    # Each range has a share of the texts without an id, and only rows that open one are copied.
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None] * 400, pa.int64()), "text": pa.array([str(i) for i in range(400)])})
    keyed = pa.RecordBatch.from_pydict({"key": pa.array([op.LEAST_ID] * 400, pa.int64()), "text": batch.column("text")})
    (found,) = op._tops([keyed], bounds, hot)
    tops = sorted(zip(found["key"].to_pylist(), found["under"].to_pylist(), strict=True))
    (dealt,) = op._part([batch], tops, hot)
    own = Counter(p for p, g in zip(dealt["part"].to_pylist(), dealt["ghost"].to_pylist(), strict=True) if not g)
    assert len(tops) == len(own) == 4 and min(own.values()) > 60 and dealt.num_rows == 404


def test_likeness(spark):
    rng = random.Random(2)
    docs = [(i, cases.sentence(rng, 400)) for i in range(40)]
    got = op.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert np.mean([r.near_edited for r in got]) > 0.55
    assert max(r.near_next for r in got) < 0.2
