"""Document quality without labels: a label model over overlapping heuristics, and a hashed linear scorer trained on it.

Seven heuristics look at a whole text and vote good, bad or abstain. Vote patterns are counted over all documents (at most 3^7 rows);
EM estimates each heuristic's accuracy and a posterior per pattern. A logistic scorer over hashed byte trigrams (their shares of the
text) and the heuristics' votes learns the posteriors on a bounded sample of documents and then scores every whole text.

Defined cases: null text is the empty text; texts without words are voted on by length alone; very long texts are read whole, a text at a time where one
exceeds ``AT_ONCE``; rows that repeat are scored each but are one row of the sample; of rows whose pick ties one is in the sample; a score that equals ``keep`` keeps;
null ``doc_id`` stays null; an empty table gives an empty result; further columns are ignored by :func:`assess`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, release, slices, small_batches, texts, texts_of
from .weak import accuracies

HEURISTICS = ("symbols", "capitals", "separators", "repetition", "function words", "word length", "length")
#: Hashed dimensions of the scorer.
BITS = 12
#: Most documents that the scorer is fitted on: 4096 rows of 4096 half-precision shares are 32 MB on the driver.
SAMPLE_DOCS = 4096
SCALE = 64.0
#: Trigrams at which a text's own evidence counts half: the shares of a few words say little.
HALF = 64
#: Score from which a document is kept: high, as good documents are the most by far.
KEEP = 0.9
AT_ONCE = 1 << 20

SYMBOLS = b"*#$%&^~=<>{}[]\\@_"
#: Function words of the four languages (fixed values).
FUNCTION = frozenset(w.encode() for w in "the of and to in is that it was for on are with as by this be at from or les la le de des une un que et dans pour pas sur est qui en du au der die und den das nicht von mit sich auf für ist im ein dem zu el los las por con para del se una al lo su".split())


def votes(text: bytes) -> list[int]:
    """Of each heuristic: 0 abstains, 1 bad, 2 good."""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0, 0, 1]
    size = len(text)
    marks = size - len(text.translate(None, SYMBOLS))
    upper = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = max(1, upper + size - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz")))
    bars, shouts = text.count(b"|"), text.count(b"!")
    lines = [x for x in text.split(b"\n") if len(x) > 20]
    again = 1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    common, kinds = sum(map(FUNCTION.__contains__, words)), len(FUNCTION.intersection(words))
    mean = sum(map(len, words)) / n
    function = common / n
    return [
        int(marks / n > 0.5),
        int(upper / letters > 0.3),
        int((bars + shouts) / n > 0.3),
        int(n > 8 and max(again, 3 * doubled) > 0.5),
        0 if n < 8 else 2 if function > 0.15 and kinds >= min(8, n // 8) else int(function < 0.04),
        int(mean > 14 or mean < 2),
        int(n < 3),
    ]


def code(ballot: list[int]) -> int:
    out = 0
    for v in ballot:
        out = 3 * out + v
    return out


def ballots(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (len(HEURISTICS) - 1 - i) % 3 for i in range(len(HEURISTICS))], axis=1)


def structure(codes: np.ndarray) -> np.ndarray:
    """Bad and good votes as features: what trigrams don't tell, such as repetition."""
    ballot = ballots(codes)
    return np.concatenate((ballot == 1, ballot == 2), axis=1).astype(np.float32)


def trigrams(some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts in a row, where each text's begin, and how many there are. Two zero bytes end each text; what begins at these is code 0, whatever follows."""
    joined = np.frombuffer(b"".join([t + b"\0\0" for t in some]) + b"\0\0", np.uint8).astype(np.uint32)
    three = (joined[:-2] << np.uint32(16)) | (joined[1:-1] << np.uint32(8)) | joined[2:]
    lengths = np.fromiter((len(t) + 2 for t in some), np.int64, len(some))
    ends = np.cumsum(lengths)
    three[np.concatenate((ends - 2, ends - 1))] = 0
    return (three * np.uint32(2654435761)) >> np.uint32(32 - BITS), np.concatenate(([0], ends[:-1])).astype(np.int64), lengths


def _pick(id_col: str, text_col: str) -> Column:
    """What the sample is drawn by: a hash of doc_id and text, so that neither empty texts nor a text's copies come in together."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def vote(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pick, code): the votes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            codes = pa.array([code(votes(t)) for t in texts_of(batch.column("text"))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pick"), codes], ["doc_id", "pick", "code"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _pick(id_col, text_col).alias("pick"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, pick long, code int")


def sample(docs: DataFrame, voted: DataFrame, n: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(codes, shares) of the ``size`` rows of least ``pick``, all distinct; never more, whatever repeats. ``n`` counts all rows."""
    picks = voted.groupBy("pick").agg(F.min("code").alias("code"))
    edge = -(1 << 63) + ((2 * size << 64) // max(n, 1))
    near = picks.filter(F.col("pick") < edge) if edge < (1 << 63) - 1 else picks
    chosen = near.orderBy("pick").limit(size).collect()
    if len(chosen) < min(size, n) and near is not picks:  # rows repeat so much that few lie below the edge
        chosen = picks.orderBy("pick").limit(size).collect()
    codes = {r["pick"]: r["code"] for r in chosen}
    few = docs.sparkSession.createDataFrame([(k,) for k in codes], "pick long")
    rows = docs.select(_pick(id_col, text_col).alias("pick"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(few), "pick", "left_semi")  # at most ``size`` longs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, "text", AT_ONCE):
            picks, shares = [], []
            for pick, t in zip(batch.column("pick").to_pylist(), texts_of(batch.column("text")), strict=True):
                if pick not in seen:
                    found, _, many = trigrams([t])
                    picks.append(pick)
                    shares.append((np.bincount(found, minlength=1 << BITS) * (SCALE / many[0])).astype(np.float16).tobytes())
                    seen.add(pick)
            yield pa.RecordBatch.from_arrays([pa.array(picks, pa.int64()), pa.array(shares, pa.binary())], ["pick", "shares"])

    shares = {r["pick"]: r["shares"] for r in rows.mapInArrow(run, "pick long, shares binary").groupBy("pick").agg(F.first("shares").alias("shares")).collect()}
    order = sorted(shares)
    x = np.stack([np.frombuffer(shares[k], np.float16) for k in order]).astype(np.float32) if order else np.zeros((0, 1 << BITS), np.float32)
    return np.array([codes[k] for k in order], np.int64), x


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; both classes weigh the same."""
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1e-9), 0.5 / max((1 - y).sum(), 1e-9))
    rate = 4.0 / max(1e-9, float((weight[:, None] * x * x).sum(axis=1).sum() + weight.sum()))
    w = v = np.zeros(x.shape[1], np.float32)
    b = c = 0.0
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        error = (weight * (p - y)).astype(np.float32)
        new, bias = v - rate * (error @ x + ridge * v), c - rate * float(error.sum())
        pull = i / (i + 3)
        v, c = new + pull * (new - w), bias + pull * (bias - b)
        w, b = new, bias
    return w, b


RESULT = "doc_id long, posterior double, score double, keep boolean"


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, keep: float = KEEP) -> DataFrame:
    """One row per document: the label model's posterior, the scorer's P(good), and whether it is kept."""
    spark = docs.sparkSession
    n = docs.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    voted = materialize(vote(docs, id_col, text_col), "votes")
    patterns = sorted((r["code"], r["count"]) for r in voted.groupBy("code").count().collect())  # at most 3^7
    codes, counts = (np.array(x) for x in zip(*patterns, strict=True))
    _, prior, post = accuracies(ballots(codes), counts)
    posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))
    own, shares = sample(docs, voted, n, sample_docs, id_col, text_col)
    weights, bias = fit(np.concatenate((shares, structure(own)), axis=1), np.array([posterior[c] for c in own.tolist()]))
    release(voted)
    odds = float(np.log(prior / (1 - prior)))  # the fit weighs both classes alike

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            some = texts_of(batch.column("text"))
            found, starts, lengths = trigrams(some)
            sums = np.add.reduceat(weights[found], starts, dtype=np.float64) if some else np.zeros(0)
            own = [code(votes(t)) for t in some]
            told = structure(np.array(own, np.int64)) @ weights[1 << BITS :]
            p = 1 / (1 + np.exp(-np.clip(sums * SCALE / (lengths + HALF) + told + bias + odds, -30, 30)))
            known = pa.array([posterior[c] for c in own], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), known, pa.array(p, pa.float64()), pa.array(p >= keep, pa.bool_())], [x.split()[0] for x in RESULT.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """op2 over the whole of ``documents``."""
    return assess(documents(spark, sf_dir))
