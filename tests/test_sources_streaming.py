import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import latticework
from latticework import Guide, Index, Vocabulary, errors
from latticework.functions import tokens as T
from latticework.operators.guide import follow
from latticework.sources import tokenizer_files as files
from latticework.streaming.guide_stream import guide_stream

SYMBOLS = [("Ā", 0), ("ā", 1), ("Ă", 2), ("Ğ", 0x1E), ("ğ", 0x1F), ("Ġ", 0x20), ("!", 0x21), ("~", 0x7E), ("ġ", 0x7F), ("Ģ", 0x80), ("ŀ", 0x9E), ("Ł", 0x9F), ("ł", 0xA0), ("¡", 0xA1), ("¬", 0xAC), ("Ń", 0xAD), ("®", 0xAE), ("ÿ", 0xFF)]


def test_byte_symbols():
    table = T.byte_symbols()
    assert len(table) == 256 and sorted(table.values()) == list(range(256))
    for c, b in SYMBOLS:
        assert table[c] == b


def byte_processor():
    return files.TokenProcessor({"decoder": {"type": "ByteLevel"}})


def fallback_processor(space="▁"):
    return files.TokenProcessor({"decoder": {"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": space}, "content": " "}, {"type": "ByteFallback"}]}})


FALLBACK = [("abc", b"abc"), ("<0x61>", b"a"), ("<0x61>a", b"<0x61>a"), ("▁", b" "), ("▁▁abc", b"  abc"), ("<0xzz", b"<0xzz"), ("é", "é".encode()), ("", b"")]


def test_processors():
    assert byte_processor().process("Ġaé".replace("é", "Ã©")) == b" a\xc3\xa9"
    for token in ("𝒜", "京", "🦄"):
        with pytest.raises(errors.ByteProcessorFailed):
            byte_processor().process(token)
    for token, data in FALLBACK:
        assert fallback_processor().process(token) == data
    with pytest.raises(errors.ByteFallbackProcessorFailed):
        fallback_processor().process("<0x6y>")
    for decoder in (None, {"type": "WordPiece"}, {"type": "Sequence", "decoders": [{"type": "WordPiece"}]}):
        with pytest.raises(errors.UnsupportedByTokenProcessor):
            files.TokenProcessor({"decoder": decoder})
    assert files.space_replacement({"content": "-", "pattern": {"String": "_"}}) is None
    assert files.space_replacement({"content": " ", "pattern": {"String": "_*"}}) is None
    assert files.space_replacement({"content": " ", "pattern": {"String": "_"}}) == "_"


def test_decoding_columns(spark):
    frame = spark.createDataFrame([(c,) for c, _ in SYMBOLS] + [("京",), ("",)], "token string")
    got = {r.token: r.b for r in frame.select("token", T.byte_level(F.col("token")).alias("b")).collect()}
    assert {t: bytes(b) for t, b in got.items() if b is not None} == {c: bytes([b]) for c, b in SYMBOLS} | {"": b""}
    assert got["京"] is None
    frame = spark.createDataFrame([(t,) for t, _ in FALLBACK] + [("<0x6y>",)], "token string")
    got = {r.token: r.b for r in frame.select("token", T.byte_fallback(F.col("token"), "▁").alias("b")).collect()}
    assert got.pop("<0x6y>") is None
    assert {t: bytes(b) for t, b in got.items()} == dict(FALLBACK)
    with pytest.raises(errors.ByteProcessorFailed):
        Vocabulary.decoded(9, spark.createDataFrame([("京", 1)], "token string, token_id long"))
    assert Vocabulary.decoded(9, spark.createDataFrame([("Ġa", 1), ("</s>", 9)], "token string, token_id long")).get(" a") == [1]


def folder(tmp_path, tokenizer, **configs):
    for name, content in {"tokenizer": tokenizer, **configs}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    return str(tmp_path)


BYTE_LEVEL = {
    "model": {"type": "BPE", "vocab": {"a": 0, "Ġb": 1, "</s>": 2, "ÿ": 3}, "merges": []},
    "decoder": {"type": "ByteLevel"},
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "Prepend", "prepend": "x"}, {"type": "NFC"}]},
    "added_tokens": [{"id": 2, "content": "</s>", "special": True}, {"id": 7, "content": "Ġplain", "special": False}],
}


def test_a_folder(spark, tmp_path):
    vocabulary = Vocabulary.from_pretrained(folder(tmp_path, BYTE_LEVEL, tokenizer_config={"eos_token": "</s>"}), spark=spark)
    assert vocabulary.get_eos_token_id() == 2
    assert vocabulary.get(" b") == [1] and vocabulary.get(b"\xff") == [3] and vocabulary.get("Ġplain") == [7]
    assert len(vocabulary) == 5


def test_many_models_in_one_frame(spark, tmp_path, monkeypatch):
    """Each folder's rows are those of ``load``; what can't be read is named, and other files are left alone."""
    monkeypatch.setattr(files, "BATCH_ROWS", 7)
    level = {"type": "ByteLevel"}
    whole = {}
    for name, n in (("one", 3), ("deep/two", 40), ("three", 0)):
        at = tmp_path / name
        at.mkdir(parents=True)
        vocab = {f"Ġw{i}": i + 1 for i in range(n)} | {"<end>": 0}
        (at / "tokenizer.json").write_text(json.dumps({"decoder": level, "model": {"vocab": vocab}}))
        (at / "generation_config.json").write_text(json.dumps({"eos_token_id": 0}))
        (at / "vocab.json").write_text("not JSON")
        whole[name] = files.load(str(at))
    for name, text in (("no-end", json.dumps({"decoder": level, "model": {"vocab": {}}})), ("broken", "{"), ("odd", json.dumps({"decoder": level, "model": {"vocab": 5}}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "tokenizer.json").write_text(text)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "generation_config.json").write_text("{}")
    rows = files.read_models(spark, str(tmp_path)).collect()
    short = lambda r: r.model.split(f"{tmp_path}/")[1]
    for name, (eos, expected) in whole.items():
        got = [r for r in rows if short(r) == name]
        assert all(r.error is None and r.eos_token_id == eos for r in got)
        assert sorted((bytes(r.token), r.token_id) for r in got) == sorted(expected)
    bad = {short(r): r for r in rows if r.error is not None}
    assert set(bad) == {"no-end", "broken", "odd"} and all(r.token is None and r.eos_token_id is None for r in bad.values())
    assert "other" not in {short(r) for r in rows}


@pytest.mark.parametrize(
    "configs, eos",
    [
        ({"generation_config": {"eos_token_id": 3}, "tokenizer_config": {"eos_token": "</s>"}}, 3),
        ({"generation_config": {"eos_token_id": [3]}, "tokenizer_config": {"eos_token": "</s>"}}, 2),
        ({"generation_config": {"eos_token_id": -1}, "tokenizer_config": {"eos_token": {"content": "</s>"}}}, 2),
        ({"tokenizer_config": {"eos_token": "nope"}}, None),
        ({}, None),
    ],
)
def test_where_the_end_token_is_named(tmp_path, configs, eos):
    where = folder(tmp_path, BYTE_LEVEL, **configs)
    if eos is None:
        with pytest.raises(errors.UnsupportedTokenizer):
            files.load(where)
    else:
        assert files.load(where)[0] == eos


def test_names_under_a_root(tmp_path):
    snapshot = tmp_path / "models--org--m" / "snapshots" / "abc"
    snapshot.mkdir(parents=True)
    (tmp_path / "models--org--m" / "refs").mkdir()
    (tmp_path / "models--org--m" / "refs" / "main").write_text("abc")
    assert files.find_folder("org/m", root=str(tmp_path)) == files.find_folder("org/m", "abc", str(tmp_path)) == str(snapshot)
    with pytest.raises(errors.TokenizersError):
        files.find_folder("org/other", root=str(tmp_path))
    with pytest.raises(errors.TokenizersError):
        files.find_folder("org/m", "a b", str(tmp_path))


def test_names_and_normalizers(tmp_path):
    assert files.validate("org/model-1.0_x") == "org/model-1.0_x"
    for bad in ("a b", "a$", "a:b"):
        with pytest.raises(errors.TokenizersError):
            files.validate(bad)
    assert files.without_prepend({"type": "Prepend"}) is None
    assert files.without_prepend(BYTE_LEVEL["normalizer"])["normalizers"] == [{"type": "NFC"}]
    assert files.without_prepend({"type": "NFC"}) == {"type": "NFC"}
    with pytest.raises(errors.TokenizersError):
        files.load(str(tmp_path))


def test_stream_agrees_with_the_fold(spark, tmp_path):
    vocabulary = Vocabulary(9, {"a": [1], "b": [2]}, spark)
    index = Index("(ab)*", vocabulary)
    rows = [("x", i, 1 + i % 2) for i in range(6)] + [("y", 0, 1), ("y", 1, 9), ("y", 2, 1), ("y", 3, 2)]
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] % 6 // 3 == part], "key string, at int, token_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at int, token_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = guide_stream(stream, index, vocabulary, "key", "at").writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = spark.table("followed").collect()
    assert len(got) == len(rows)
    x = max((r for r in got if r.key == "x"), key=lambda r: r["at"])
    folded = {r.key: r for r in follow(spark.createDataFrame(rows, "key string, at int, token_id long"), index, vocabulary, ["key"], ["at"]).collect()}
    assert x.state == folded["x"].state and x.finished and x.stored == 6
    y = {r["at"]: r for r in got if r.key == "y"}
    assert [y[i].accepted for i in range(4)] == [True, False, False, True]


def commands_into(spark, folder, name, index, vocabulary, where, **more):
    from latticework.streaming.guide_stream import command_stream

    stream = spark.readStream.schema("key string, at int, command string, argument long").parquet(str(folder))
    told = command_stream(stream, index, vocabulary, "key", "at", "command", "argument", **more)
    out = told.writeStream.outputMode("append").option("checkpointLocation", str(where))
    return out.format("memory").queryName(name) if isinstance(name, str) else out.format("parquet").option("path", str(name))


@pytest.fixture
def store(spark):
    from latticework.streaming.guide_stream import STORE

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_commands_are_what_a_cursor_does_and_outlive_a_restart(spark, tmp_path, store):
    """Three runs of one stream from its checkpoint, each over new rows, against one cursor for each key."""
    rng = random.Random(8)
    vocabulary = Vocabulary(9, {"a": [1], "b": [2], "ab": [3]}, spark)
    index = Index("(ab|b)*a?", vocabulary)
    guides, told = {k: Guide(index, 3) for k in "xyz"}, {}
    for run in range(3):
        rows = [(rng.choice("xyz"), 100 * run + i, *rng.choice([("advance", rng.choice([1, 2, 3, 9, 77])), ("advance", 2), ("back", rng.randint(0, 4)), ("reset", None), ("jump", 1)])) for i in range(60)]
        for key, at, command, argument in rows:
            guide, accepted = guides[key], command != "jump"
            try:
                if command == "advance":
                    guide.advance(argument, return_tokens=False)
                elif command == "back":
                    guide.rollback_state(argument)
                elif command == "reset":
                    guide.reset()
            except ValueError:
                accepted = False
            told[key, at] = (guide.get_state(), accepted, guide.is_finished(), guide.get_allowed_rollback())
        spark.createDataFrame(rows, "key string, at int, command string, argument long").write.mode("append").parquet(str(tmp_path / "in"))
        commands_into(spark, tmp_path / "in", tmp_path / "out", index, vocabulary, tmp_path / "cp", max_rollback=3).trigger(availableNow=True).start().awaitTermination()
        got = {(r.key, r["at"]): (r.state, r.accepted, r.finished, r.stored) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == told


def test_idle_keys_are_forgotten(spark, tmp_path, store):
    import time

    vocabulary = Vocabulary(9, {"a": [1]}, spark)
    index = Index("a*", vocabulary)
    put = lambda rows: spark.createDataFrame(rows, "key string, at int, command string, argument long").write.mode("append").parquet(str(tmp_path / "in"))
    put([("x", 1, "advance", 1), ("x", 2, "advance", 1)])
    running = commands_into(spark, tmp_path / "in", "idle", index, vocabulary, tmp_path / "cp", idle_ms=1500).trigger(processingTime="500 milliseconds").start()
    try:
        wait = time.time() + 60
        while time.time() < wait and not spark.table("idle").filter("command = 'expired'").count():
            time.sleep(0.5)
        put([("x", 3, "back", 1), ("x", 4, "advance", 1)])
        while time.time() < wait and spark.table("idle").filter("at >= 3").count() < 2:
            time.sleep(0.5)
    finally:
        running.stop()
    got = [(r["at"], r.command, r.accepted, r.stored) for r in spark.table("idle").collect()]
    assert got[:5] == [(1, "advance", True, 1), (2, "advance", True, 2), (None, "expired", True, 0), (3, "back", False, 0), (4, "advance", True, 1)]


def test_byte_fallback_spells_and_reads_every_text(spark):
    texts = ["Où ▁ <0x41> €\U0001f600\n", "", None, "".join(map(chr, range(300)))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.posexplode(T.spell_byte_fallback(F.col("t"), "▁")).alias("n", "token"))
    got = {}
    for r in frame.select("i", "n", T.byte_fallback(F.col("token"), "▁").alias("b")).orderBy("i", "n").collect():
        got[r.i] = got.get(r.i, b"") + bytes(r.b)
    assert got == {i: t.encode() for i, t in enumerate(texts) if t is not None}


def test_package():
    for name in latticework.__all__:
        assert hasattr(latticework, name)
    done = subprocess.run([sys.executable, "-m", "latticework"], input='{"type": "null"}', capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])
    assert done.stdout == "Regex: null\nRegex len: 4\n"


def test_sql_function(spark):
    from latticework.sql import register

    register(spark)
    rows = spark.sql("""SELECT schema_regex(s) AS r FROM VALUES ('{"type": "null"}'), ('{'), (NULL) AS t(s)""").collect()
    assert [r.r for r in rows] == ["null", None, None]
