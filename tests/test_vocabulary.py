import copy
import random

import pytest

from pyspark.sql import functions as F

from latticework import Vocabulary, errors
from latticework.functions import tokens as T


@pytest.fixture
def vocabulary(spark):
    return Vocabulary(70, {"ge": [12, 31], "é": [8]}, spark)


def test_a_random_walk_against_a_dict(spark):
    """Inserts, removals and look-ups in any order, by text or bytes, leave what they leave in a dict of lists."""
    rng = random.Random(11)
    tokens = [b"ge", "é".encode(), b"\xe9", b" ", b"\n\n", b"0"]
    real, model = Vocabulary(70, {}, spark), {}
    spelled = lambda t: t.decode() if t != b"\xe9" and rng.random() < 0.5 else t
    for _ in range(40):
        token, new = rng.choice(tokens), rng.randrange(60)
        if rng.random() < 0.6:
            real.insert(spelled(token), new)
            model.setdefault(token, []).append(new)
        else:
            real.remove(spelled(token))
            model.pop(token, None)
    assert {bytes(r.token): r.ids for r in real.tokens().collect()} == {t: sorted(ids) for t, ids in model.items()}
    assert [real.get(spelled(t)) for t in tokens] == [sorted(model[t]) if t in model else None for t in tokens]
    assert len(real) == 1 + sum(map(len, model.values())) and real.is_empty() == (not model)


def test_shown(vocabulary):
    assert vocabulary.get_eos_token_id() == 70
    assert "[0x67, 0x65] -> ids: [12, 31]" in str(vocabulary) and "0xC3, 0xA9" in str(vocabulary) and "eos_token_id=70" in repr(vocabulary)


def test_refused(vocabulary):
    with pytest.raises(errors.EOSTokenDisallowed):
        vocabulary.insert("zu", 70)
    for call in (lambda: vocabulary.insert(2.5, 1), lambda: vocabulary.insert("zu", None), lambda: vocabulary.remove(["ge"]), lambda: vocabulary.get(None)):
        with pytest.raises(TypeError):
            call()
    assert len(vocabulary) == 4


def test_making(spark):
    assert Vocabulary(3, spark=spark).is_empty() and len(Vocabulary(3, {}, spark)) == 1
    assert Vocabulary(3, {b"\xf0\x9f": [1, 2]}, spark).get(b"\xf0\x9f") == [1, 2]
    with pytest.raises(errors.EOSTokenDisallowed):
        Vocabulary(3, {"a": [1, 3]}, spark)
    with pytest.raises(TypeError, match="Dict keys or/and values of the wrong types"):
        Vocabulary(1, {1: 2}, spark)
    with pytest.raises(TypeError, match="got int"):
        Vocabulary(1, 2, spark)
    with pytest.raises(errors.EOSTokenDisallowed):
        Vocabulary(3, spark.createDataFrame([("x", 3)], "token string, token_id long"))


def test_comparing_and_copying(vocabulary, spark):
    assert vocabulary == Vocabulary(70, {"é": [8], "ge": [31, 12]}, spark)
    assert vocabulary != Vocabulary(71, {"é": [8], "ge": [31, 12]}, spark)
    twin = copy.deepcopy(vocabulary)
    assert twin == vocabulary
    twin.insert("z", 9)
    assert twin != vocabulary and vocabulary.get("z") is None


def test_saving(vocabulary, spark, tmp_path):
    vocabulary.save(str(tmp_path / "v"))
    assert Vocabulary.load(str(tmp_path / "v"), spark) == vocabulary


def test_byte_level_reads_every_symbol_and_spells_every_text(spark):
    symbols = T.byte_symbols()
    rows = [(c, b) for c, b in symbols.items()] + [(c, None) for c in (" ", "€", "\xad", "a\0")]
    got = spark.createDataFrame(rows, "c string, b int").select("c", "b", T.byte_level(F.col("c")).alias("x")).collect()
    assert all((None if r.b is None else bytes([r.b])) == (r.x and bytes(r.x)) for r in got) and len(symbols) == 256
    texts = ["Où est\n\x00\t\U0001f600€ü", "", None, "".join(map(chr, range(300)))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] if r[0] is None else bytes(r[0]).decode() for r in frame.select(T.byte_level(T.spell_byte_level(F.col("t")))).collect()] == texts
