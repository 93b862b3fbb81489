import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from latticework.llm import mixing as op

from . import cases


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Reshare what stands above a limit until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, out, left = set(names), {}, share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 900, "c": 50, None: 10}, {"x": 5}, {"a": 0, "b": 7}, {chr(97 + i): (i * 37) % 91 + 1 for i in range(20)}, {"é": 10, "z": 1000, "Z": 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([("2" if s is None else "1" + s, n) for s, n in sizes.items()], "s string, source_size long")
    got = {None if r.s == "2" else r.s[1:]: r.target for r in op.targets(frame).collect()}
    want = brute_targets(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}


@pytest.mark.parametrize("n", [1, 2, 7, 100, 513])
def test_networks_are_permutations(spark, n):
    x = spark.range(n).select("id", op._network(F.col("id"), F.lit(n), [F.lit("s")]).alias("y"), F.lit(n).cast("long").alias("n"))
    got = x.select("id", "y", op._network(F.col("y"), F.lit(n), [F.lit("s")], backwards=True).alias("z")).collect()
    assert sorted(r.y for r in got) == list(range(n))
    assert all(r.z == r.id for r in got)
    if n > 50:
        assert sum(r.y == r.id for r in got) < n / 5


@pytest.mark.parametrize("block", [1, 8, 64, 512])
def test_taken(spark, block):
    data = cases.rows(n=200)
    docs = cases.table(spark, n=200).selectExpr("*", "1 as size", "'x' as s", "0 as block", "7 as uid", "1 as pass")
    got = op.taken(docs, block=block).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in data)
    sums = defaultdict(int)
    for r in data:
        sums[r[3]] += size(r[1])
    want = brute_targets(sums)
    source = defaultdict(set)
    for r in data:
        source[r[0]].add(r[3])
    per = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        s = next(s for s in source[r.doc_id] if sums[s] == r.source_size)
        assert r.target == pytest.approx(want[s])
        per[s] += r.taken
    assert all(abs(per[s] - t) <= 0.5 + 1e-6 for s, t in want.items())
    again = op.taken(docs.repartition(3), block=block).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def spark_hash(*values):
    """xxhash64 of the values as Spark takes it: each with the hash before as its seed; nulls leave it."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Int) else "<q", v), h)
    return h - (1 << 64) if h >> 63 else h


class Int(int):
    """A number that Spark holds as an int."""


def network(x, n, *seed):
    for i in range(op.ROUNDS):
        partner = (spark_hash(*seed, Int(i)) % n - x) % n
        if spark_hash(*seed, Int(i), max(x, partner)) % 2 == 1:
            x = partner
    return x


@pytest.mark.parametrize("block, shard", [(8, 16), (64, 1024)])
def test_taken_against_brute_force(spark, block, shard, monkeypatch):
    """Every document's words and first shard: layout, targets, draws, permutations and the cut, one at a time."""
    monkeypatch.setattr(op, "SHARD_SLOTS", shard)
    monkeypatch.setattr(op, "CHUNK", 16)
    rows = [(r[0], r[1], r[3]) for r in cases.rows(n=150) if r[0] is not None]
    sums = defaultdict(int)
    for _, t, source in rows:
        sums[source] += size(t)
    want_targets = brute_targets(sums)
    name = lambda s: "2" if s is None else "1" + s
    chunks = max(1, len(rows) // 16)
    slots_of, pieces = {}, {}
    for source in sums:
        at = 0
        mine = [r for r in rows if r[2] == source]
        for i, (doc, text, _) in enumerate(sorted(mine, key=lambda r: (spark_hash(r[0], spark_hash(r[1])) % chunks, r[0], size(r[1]), spark_hash(r[1])))):
            pieces[source, i] = (doc, size(text), at)
            at += size(text)
        n_blocks, left, k, own = -(-at // block), int(want_targets[source] + 0.5), 0, []
        while left > 0:
            b = network(k % n_blocks, n_blocks, name(source), k // n_blocks)
            held = min(block, at - b * block)
            own.append((b, min(held, left)))
            left, k = left - held, k + 1
        slots_of[source] = own
    order = sorted(slots_of, key=name)
    line = [s for s in order for _ in slots_of[s]]
    drawn, shards = defaultdict(list), -(-len(line) // shard)
    for i in range(len(line)):
        s = line[spark_hash("draw", i // shard, i % shard) % len(line)]
        if len(drawn[s]) < len(slots_of[s]):
            drawn[s].append(i // shard)
    taken, first = defaultdict(int), {}
    for s in order:
        drawn[s] += [shards - 1] * (len(slots_of[s]) - len(drawn[s]))
        for (b, takes), where in zip(slots_of[s], drawn[s], strict=True):
            for key, (_, n, at) in pieces.items():
                words = min(at + n, b * block + takes) - max(at, b * block) if key[0] == s else 0
                if words > 0:
                    taken[key] += words
                    first[key] = min(first.get(key, shards), where)
    got = op.taken(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block).collect()
    want = [(doc, n, sums[key[0]], taken[key], first.get(key)) for key, (doc, n, _) in pieces.items()]
    assert Counter((r.doc_id, r.size, r.source_size, r.taken, r.first_shard) for r in got) == Counter(want)
    assert len({r.first_shard for r in got}) > min(shards, 50) // 2


def test_shards_get_every_slot_once_and_multinomial_counts(spark):
    frame = spark.createDataFrame([("1a", 300_000, 450_000.0), ("1b", 300_000, 300_000.0), ("1c", 300_000, 600_000.0)], "s string, source_size long, target double")
    planned = op.plan(frame, 64)
    rows = op.slots(planned, 64).collect()
    of = {r.s: r.slots for r in planned.collect()}
    assert Counter((r.s, r.k) for r in rows) == Counter((s, k) for s, n in of.items() for k in range(n))
    counts = Counter((r.shard, r.s) for r in rows)
    last = max(r.shard for r in rows)
    for s, share in (("1a", 1 / 3), ("1b", 2 / 9), ("1c", 4 / 9)):
        own = [counts[i, s] for i in range(last - 1)]
        expected = op.SHARD_SLOTS * share
        assert all(abs(c - expected) < 5 * expected**0.5 for c in own)
        assert len(set(own)) > 3


def test_running_sums(spark):
    rows = spark.range(5000).selectExpr("concat('s', id % 3) s", "id div 3 at", "id % 7 v")
    got = op.running(rows, "at", "v", "before").collect()
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: r.at):
        assert r.before == sums[r.s]
        sums[r.s] += r.v


def test_mix_holds_the_words_taken(spark):
    docs = cases.table(spark, n=100).selectExpr("*", "7 as uid", "1 as pass", "2 as skip", "3 as size", "'x' as s")
    got = op.mix(docs, block=16)
    assert got.columns == docs.columns
    per = defaultdict(int)
    for r in got.collect():
        per[r.source] += size(r.text)
        assert r.n_chars == len(r.text)
    sums = defaultdict(int)
    for r in cases.rows(n=100):
        sums[r[3]] += size(r[1])
    assert all(abs(per[s] - t) <= 0.5 + 1e-6 for s, t in brute_targets(sums).items())
    texts = {r[1] for r in cases.rows(n=100) if r[1]}
    whole = sum(r.text in texts for r in got.collect())
    assert whole > 50


def test_no_plan_joins_all_tables_of_the_mix(spark):
    """The driver reports a plan anew after each shuffle, so its memory goes by the square of these."""
    for made in (op.mix(cases.table(spark)), op.taken(cases.table(spark))):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 10


def test_empty(spark):
    assert op.taken(cases.table(spark).limit(0)).count() == 0
    assert op.mix(cases.table(spark).limit(0)).count() == 0
