import random
import re
from collections import Counter

import corpus_pipeline
from latticework.llm import packing, simhash, tokens

from . import cases
from .test_exact_dedup import lowered
from .test_mixing import brute_targets, size
from .test_simhash import brute, roots


def table(spark):
    rng = random.Random(11)
    rows = [(i, cases.sentence(rng, rng.randint(5, 200)), rng.choice(["en", "fr"]), rng.choice("abc"), 0) for i in range(150)]
    rows += [(200 + i, rows[i][1], "en", "a", 0) for i in range(20)]  # exact copies
    long = cases.sentence(rng, 900)
    rows += [(300 + i, long + f" end{i}", "en", "b", 0) for i in range(5)]  # near copies
    rows += [(400, "12 345 6", "en", "a", 0), (401, None, None, None, None), (402, "", "en", "c", 0)]
    return spark.createDataFrame(rows, cases.SCHEMA), rows


def test_stages_one_by_one(spark):
    docs, rows = table(spark)
    by_id = {r[0]: r for r in rows}
    names, frames = [], []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, before, "").schema)
        names.append(stage.__name__)
        frames.append(docs)
    assert names == ["identify_languages", "drop_exact_copies", "drop_near_copies", "mix_sources", "pack_sequences"]
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in frames[:4])
    languages, exact, near, mixed, packed = (f.collect() for f in frames)
    assert {r.doc_id for r in languages} == set(by_id) - {400, 401, 402}
    best = {}
    for r in languages:
        best[lowered(r.text)] = max(best.get(lowered(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(best.values())
    comp = roots([brute(r.text) for r in exact])
    least = {}
    for r, c in zip(exact, comp, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in near) == sorted(least.values())
    sums, per = Counter(), Counter()
    for r in near:
        sums[r.source] += size(r.text)
    for r in mixed:
        per[r.source] += size(r.text)
        assert set(re.findall(r"\S+", r.text)) <= set(re.findall(r"\S+", by_id[r.doc_id][1]))
    assert all(abs(per[s] - t) <= 0.5 + 1e-6 for s, t in brute_targets(sums).items())
    encode = tokens.encoder(tokens.default_path())
    assert sum(r.length for r in packed) == sum(len(encode(r.text)) + 1 for r in mixed)
    assert len({r.sequence_id for r in packed}) >= sum(r.length for r in packed) / packing.CAPACITY
    assert simhash.MOST_BITS == 4


def test_run(spark, tmp_path):
    docs, _ = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 100
    assert "sequence_id" in got.columns


def test_empty(spark):
    docs = table(spark)[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


CLASHING = "uid keep_id group_size kept digest winner shard slot fp component_id root node k t hub gone_id gone_key key declared accepted words lines line length piece sequence_id chunk rank s size block d c n g_id t_id count pass skip shares code".split()


def test_extra_columns_with_clashing_names(spark):
    docs = cases.table(spark).selectExpr("*", *[f"1 as {c}" for c in CLASHING])
    plain = cases.table(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        got, want = stage(spark, docs, ""), stage(spark, plain, "")
        assert got.columns == docs.columns
        assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, want.collect()))


def test_queries_take_extra_columns(spark, tmp_path):
    from latticework.llm.queries import QUERIES

    talk = spark.createDataFrame([(i // 5, i % 5, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(60)], "conv_id long, turn long, role string, text string")
    for name, table in (("documents", cases.table(spark)), ("conversations", talk)):
        table.selectExpr("*", *[f"1 as {c}" for c in CLASHING]).write.parquet(str(tmp_path / "extra" / f"{name}.parquet"))
        table.write.parquet(str(tmp_path / "plain" / f"{name}.parquet"))

    def rows(df):
        return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())

    for name, query in QUERIES.items():
        if name.startswith("op"):
            got, want = (query(spark, str(tmp_path / kind)) for kind in ("extra", "plain"))
            assert got.columns == want.columns and rows(got) == rows(want), name
