import random
import re

import numpy as np

from latticework.llm import near_copies as op

from . import cases
from .test_exact_dedup import lowered


def shingles(text, words=5):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def brute(rows, least=0.8):
    """The rows that stay, from all pairs."""
    nodes = sorted({t or "" for _, t in rows})
    sets, label = [shingles(t) for t in nodes], list(range(len(nodes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= least * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                label[find(i)] = find(j)
    root = {t: find(i) for i, t in enumerate(nodes)}
    groups = {}
    for doc, text in rows:
        groups.setdefault(root[text or ""], []).append((doc is None, doc or 0))
    return {c: min(ids) for c, ids in groups.items()}, root


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def check(spark, rows):
    got = op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as gone_id", "4 as keys")).collect()
    least, root = brute(rows)
    kept = {}
    for r in got:
        kept.setdefault(root[r.text or ""], set()).add((r.doc_id, r.text))
    assert set(kept) == set(least)
    for c, of in kept.items():
        (only,) = of
        assert (only[0] is None, only[0] or 0) == least[c]
    return got


def test_pairs_at_the_limit_are_found(spark):
    """Edits of 200 words: most pairs near 0.8 differ in more than four bits of their SimHash."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        base = cases.sentence(rng, 200)
        rows += [(3 * i, base), (3 * i + 1, edited(rng, base, rng.randint(1, 7))), (3 * i + 2, edited(rng, base, 3))]
    got = check(spark, rows)
    assert 120 <= len(got) < 260


def test_simhash_links_near_copies_by_itself(spark, monkeypatch):
    """Without a band that two texts share, components of fingerprints are left, and the sets are held against each other all the same."""
    rng = random.Random(13)
    rows, short = [], cases.sentence(rng, 6)
    for i in range(20):
        base = cases.sentence(rng, 800)
        rows += [(3 * i, base), (3 * i + 1, base + " more"), (3 * i + 2, "less " + base)]
    rows += [(100, short), (101, short + " " + short)]
    monkeypatch.setattr(op, "bands", lambda found: [int(found[0]) * 1000 + len(found)] * op.BANDS if len(found) < 100 else [hash((i, found.tobytes())) for i in range(op.BANDS)])
    got = check(spark, rows)
    assert len(got) == 22


def test_what_simhash_links_is_not_held_against_each_other_again(spark, monkeypatch):
    rng = random.Random(14)
    base = cases.sentence(rng, 800)
    held, plain = [], op._similar

    def counting(pairs, sets, least):
        held.append(pairs.distinct().count())
        return plain(pairs, sets, least)

    monkeypatch.setattr(op, "_similar", counting)
    assert len(check(spark, [(i, base + f" end{i}") for i in range(30)])) == 1
    assert held[0] == 29 and not any(held[1:])


def test_chains_of_copies(spark):
    rng = random.Random(6)
    rows, text = [], cases.sentence(rng, 150)
    for i in range(60):
        rows.append((i, text))
        text = edited(rng, text, 2)
    check(spark, rows)


def test_null_and_repeated_ids_with_different_texts(spark):
    rng = random.Random(8)
    base, alone = cases.sentence(rng, 100), [cases.sentence(rng, 50) for _ in range(6)]
    rows = [(1, base), (None, base + " x"), (None, alone[0]), (None, alone[1]), (7, base + " y"), (7, alone[2]), (7, alone[3]), (None, alone[4]), (None, alone[4] + " z"), (None, alone[0])]
    got = sorted(((r.doc_id, r.text) for r in check(spark, rows)), key=str)
    assert len(got) == 7
    assert {(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (1, base)} < set(got)


def letters(rng, n, words, own):
    """Texts of one form, each with words of its own at the end, and edits of some of these."""
    form = cases.sentence(rng, words)
    out = [f"{form} " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(own)) for _ in range(n)]
    for text in out[: n // 5]:
        kept = text.split()
        kept[-rng.randint(1, own)] = "other"
        out.append(" ".join(kept))
    return out


def test_a_form_that_many_texts_share_is_not_paired_off(spark, monkeypatch):
    """Two texts of the form are at 0.73, just below the limit, and share keys by the hundred."""
    rng = random.Random(9)
    texts = letters(rng, 500, 170, 30) + letters(rng, 100, 60, 60)
    held, plain = [], op._similar

    def counting(pairs, sets, least):
        held.append(pairs.distinct().count())
        return plain(pairs, sets, least)

    monkeypatch.setattr(op, "_similar", counting)
    got = check(spark, list(enumerate(texts)))
    assert len(got) == 600
    # Each round holds a member against at most three others a band; what the rounds leave is split by shingles.
    *rounds, rest = held
    assert all(n <= 3 * op.BANDS * len(texts) for n in rounds)
    assert rest < 5 * len(texts) < len(texts) ** 2 / 100


def test_prefixes_miss_no_near_copy(spark):
    """Sets of random sizes and overlaps around the limit, with frequent and rare members."""
    rng = random.Random(10)
    sets = []
    for _ in range(60):
        base = [rng.randrange(1 << 32) for _ in range(rng.randint(1, 60))] + rng.sample(range(200), rng.randint(0, 40))
        sets.append(set(base))
        for _ in range(3):
            other = set(rng.sample(base, max(1, len(base) - rng.randint(0, len(base) // 4)))) | {rng.randrange(1 << 32) for _ in range(rng.randint(0, len(base) // 5))}
            sets.append(other)
    packed = [(i, len(x), i, op.bits(found), bytearray(found.tobytes())) for i, x in enumerate(sets) for found in [np.array(sorted(x), np.uint32)]]
    table = spark.createDataFrame(packed, "node long, size long, root long, bits array<long>, found binary")
    got = {(r.a, r.b) for r in op._sharing(op.prefixes(table, op._frequencies(table)), 0.8).collect()}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert len(near) > 50 and near <= got


def test_bitmaps_rule_out_no_near_copy_and_most_others(spark):
    """Bitmaps differ in no more bits than the sets in shingles; at 0.65 next to no pair is left."""
    rng = random.Random(12)
    pairs = []
    for n in (0, 1, 2, 9, 150, 700, 5000):
        for changed in (0, 1, n // 20, n // 9, n // 5, n // 3):
            base = rng.sample(range(1 << 32), n)
            x, y = set(base), set(base[min(changed, n) :]) | set(rng.sample(range(1 << 32), min(changed, n)))
            pairs.append((x, y, len(x & y) / len(x | y) if x | y else 1.0))
    bits = lambda s: op.bits(np.array(sorted(s), np.uint32))
    rows = [(i, len(x), bits(x), len(y), bits(y)) for i, (x, y, _) in enumerate(pairs)]
    table = spark.createDataFrame(rows, "i int, x_size long, x_bits array<long>, y_size long, y_bits array<long>")
    left = {r.i for r in table.filter(op._close(0.8)).collect()}
    assert {i for i, (_, _, j) in enumerate(pairs) if j >= 0.8 - 1e-9} <= left
    assert not any(100 < len(x) < 900 and j < 0.65 and i in left for i, (x, _, j) in enumerate(pairs))


def test_awkward_rows(spark):
    check(spark, [r[:2] for r in cases.rows()])
    assert op.deduplicate(cases.table(spark).limit(0)).count() == 0
    assert op.deduplicate(cases.table(spark)).columns == cases.table(spark).columns
