import random
import re

import xxhash

from latticework.llm import simhash as op

from . import cases


def brute(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, bits=4):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                label[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check(rows, got):
    fps = [brute(t) for _, t in rows]
    comp = roots(fps)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((-1 if i is None else i, f - (1 << 64) if f >> 63 else f, least.get(c, -1)) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_against_brute_force(spark):
    data = [r for r in cases.rows(n=80) if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(data, cases.SCHEMA).selectExpr("*", "1 as fp", "2 as k", "3 as root")
    check([r[:2] for r in data], op.groups(docs).collect())


def test_every_link_is_found(spark):
    """Chains and clouds of fingerprints at distances around the limit."""
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for _ in range(900):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    near = roots(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in op.labels(frame).collect()}
    mine = [got.get(f, f) for f in fps]
    assert len(set(zip(near, mine, strict=True))) == len(set(near)) == len(set(mine))


def test_masks_cover_every_pair_of_close_blocks():
    for n in (10, 10**6, 10**9):
        m = op._blocks(n, 4)
        masks = [x & (1 << 64) - 1 for x in op._masks(m, 4)]
        rng = random.Random(n)
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(d & x == 0 for x in masks)


def test_very_long_text_and_empty(spark):
    long = " ".join(f"w{i % 977}" for i in range(90_000))
    assert op.fingerprint(long.encode()) == brute(long)
    assert op.groups(cases.table(spark).limit(0)).count() == 0


def test_deduplicate_keeps_the_least_of_each_group(spark):
    text = cases.sentence(random.Random(1), 300)
    docs = spark.createDataFrame([(3, text), (1, text + " x"), (2, "something else entirely"), (9, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in op.deduplicate(docs).collect()) == [1, 2, 9]


def test_deduplicate_keeps_other_texts_of_the_same_or_no_id(spark):
    rng = random.Random(2)
    text, *alone = (cases.sentence(rng, 300) for _ in range(5))
    rows = [(1, text), (None, text + " x"), (None, alone[0]), (None, alone[1]), (7, text + " y"), (7, alone[2]), (7, alone[3])]
    got = op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[3], rows[5], rows[6]], key=str)


def test_a_family_that_shares_a_key_is_split(spark, monkeypatch):
    """20,000 fingerprints with one key: every link is found, and far fewer pairs are compared than the family has."""
    rng = random.Random(5)
    mask = op._masks(6, 4)[0]
    fixed = rng.getrandbits(64) & mask
    fps = {fixed | (rng.getrandbits(64) & ~mask) for _ in range(19_000)}
    chained = list(fps)[:500]
    for x in chained:
        for b in rng.sample([p for p in range(64) if not mask >> p & 1], rng.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    compared = []
    plain = op._pairs

    def counting(open_, keys, bits):
        compared.append(open_.filter("root <> commonest").groupBy(*keys).count().join(open_.groupBy(*keys).agg(op.F.count("*").alias("n")), keys).selectExpr("coalesce(sum(count * n), 0)").first()[0])
        return plain(open_, keys, bits)

    monkeypatch.setattr(op, "_pairs", counting)
    got = {r.node: r.root for r in op.labels(spark.createDataFrame([(sign(x),) for x in fps], "fp long")).collect()}
    assert sum(compared) < 200 * len(fps) < len(fps) ** 2 / 90
    # Brute force over buckets of the free bits: pairs within 4 bits share one of 5 parts of these.
    free = [p for p in range(64) if not mask >> p & 1]
    parts = [sum(1 << p for p in free[i::5]) for i in range(5)]
    buckets = {}
    for x in fps:
        for part in parts:
            buckets.setdefault((part, x & part), []).append(x)
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for some in buckets.values():
        for i, x in enumerate(some):
            for y in some[:i]:
                if (x ^ y).bit_count() <= 4:
                    label[find(x)] = find(y)
    families = {}
    for x in fps:
        families.setdefault(find(x), []).append(sign(x))
    want = {x: min(f) for f in families.values() for x in f if x != min(f)}
    assert len(want) > 300 and got == want
