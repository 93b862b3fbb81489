import hashlib
from collections import defaultdict

from latticework.llm import exact_dedup as op

from . import cases


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_against_brute_force(spark):
    data = cases.rows()
    got = op.verdicts(cases.table(spark)).collect()
    groups = defaultdict(list)
    for r in data:
        groups[hashlib.sha256(lowered(r[1]).encode()).digest()].append(r[0])
    assert len(got) == len(data)
    for r in got:
        ids = groups[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = defaultdict(int)
    for r in got:
        kept[bytes(r.digest)] += r.kept
    assert set(kept.values()) == {1}


def test_deduplicate_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = cases.table(spark).selectExpr("*", "doc_id as digest", "1 as kept")
    got = op.deduplicate(docs)
    assert got.columns == docs.columns
    texts = [lowered(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({lowered(r[1]) for r in cases.rows()})
    plain = docs.filter("doc_id > 6")
    assert op.deduplicate(plain).count() == len({lowered(r.text) for r in plain.collect()})


def test_history_members_go_and_nonmembers_are_grouped(spark):
    old = spark.createDataFrame([(900, "seen before"), (901, "also seen")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "SEEN before"), (2, "fresh"), (3, "Fresh")], "doc_id long, text string")
    history = op.distinct_digests(op.digests(old).selectExpr("*", "-1L as uid"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in op.verdicts(new, history=history).collect()}
    assert got == {1: (900, 1, False), 2: (3, 2, False), 3: (3, 2, True)}


def test_empty(spark):
    assert op.verdicts(cases.table(spark).limit(0)).count() == 0
    assert op.deduplicate(cases.table(spark).limit(0)).count() == 0


def test_newer_rows_renew_slots_or_are_grouped(spark, monkeypatch):
    """Texts in the older half only, in the newer half only, and in both, over several shards."""
    monkeypatch.setattr(op, "SHARD_KEYS", 7)
    data = [(i, f"old {i % 30}") for i in range(100)] + [(100 + i, f"old {i % 40}" if i % 2 else f"new {i % 24}") for i in range(100)] + [(None, "old 3"), (None, "new 2"), (None, "none")]
    seen = {}
    monkeypatch.setattr(op, "renew", lambda index, found, plain=op.renew: seen.setdefault("renewed", plain(index, seen.setdefault("found", found))))
    got = op.verdicts(spark.createDataFrame(data, "doc_id long, text string")).collect()
    groups = defaultdict(list)
    for doc, text in data:
        groups[hashlib.sha256(text.encode()).digest()].append(doc)
    for r in got:
        ids = groups[bytes(r.digest)]
        assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
        assert r.kept == (r.doc_id == r.keep_id)
    old = {t for i, t in data if i is None or i <= 99}
    assert seen["renewed"].filter("slot is not null").count() == len(old)  # new texts that no old row has are in no slot
    assert 0 < seen["found"].count() == sum(t in old for i, t in data if i is not None and i > 99) < 100
