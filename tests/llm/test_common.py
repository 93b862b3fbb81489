import os

import pyarrow as pa

from latticework.llm import common
from latticework.llm.components import components


def test_scratch_tables_are_written_where_the_session_says_and_can_go(spark):
    common_root = common.scratch_root(spark)
    frame = common.materialize(spark.range(1000).repartition(50), "t", most_rows=1000)
    assert frame.count() == 1000
    where = frame._scratch_path
    assert where.startswith(common_root)
    local = where.removeprefix("file://")
    assert sum(f.endswith(".parquet") for f in os.listdir(local)) <= common.LEAST_FILES
    common.release(frame, spark.range(1))
    assert not os.path.exists(local)


def test_settings_are_lowered_but_never_raised(spark):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, 64)
    common.small_batches(spark)
    assert spark.conf.get(name) == "64"
    spark.conf.unset(name)
    common.small_batches(spark)
    assert int(spark.conf.get(name)) == common.SETTINGS[name]


def test_slices_bound_bytes_and_lose_nothing():
    texts = ["x" * n for n in (5, 0, 300, 7, 90, 20, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(common.slices([batch, batch.slice(0, 0)], "text", most=100))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 for p in parts)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 181)} | {i: 500 for i in range(501, 560)} | {901: 900, 902: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
