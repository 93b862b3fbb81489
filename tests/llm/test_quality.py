import random

import numpy as np

from latticework.llm import quality as op
from latticework.llm import weak

from . import cases


def test_accuracies_are_found_from_votes_alone():
    rng = np.random.default_rng(2)
    truth = rng.random(30_000) < 0.8
    rates = [0.95, 0.85, 0.75, 0.9]
    ballot = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < r) == truth, 2, 1)) for r in rates], axis=1)
    patterns, at, n = np.unique(ballot, axis=0, return_inverse=True, return_counts=True)
    accuracy, prior, post = weak.accuracies(patterns, n)
    assert np.allclose(accuracy, rates, atol=0.04)
    assert abs(prior - 0.8) < 0.04
    assert ((post[at.ravel()] > 0.5) == truth).mean() > 0.93


def corpus(n=500):
    rng = random.Random(9)
    for i in range(n):
        good = rng.random() < 0.8
        text = cases.sentence(rng, rng.randint(30, 150))
        if not good:
            kind = rng.randrange(3)
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split()) if kind == 0 else text.upper() if kind == 1 else " | ".join(text.split())
        yield i, text, good


def test_held_out_truth(spark):
    """Labels play no part in the fit, so all of them are held out."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus()], "doc_id long, text string")
    got = {r.doc_id: r for r in op.assess(docs).collect()}
    truth = {i: g for i, _, g in corpus()}
    assert np.mean([got[i].keep for i in truth if truth[i]]) > 0.98
    assert np.mean([got[i].keep for i in truth if not truth[i]]) < 0.4
    good, bad = ([got[i].score for i in truth if truth[i] == g] for g in (True, False))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_labels_of_the_test_data(spark):
    folder = "/root/testdata/sf0.01"
    got = op.assess(spark.read.parquet(f"{folder}/documents.parquet"))
    joined = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good, bad = joined[joined.quality == 1], joined[joined.quality == 0]
    assert good.keep.mean() > 0.97
    assert bad.keep.mean() < 0.4
    rank = joined.score.rank()
    assert (rank[joined.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad)) > 0.95


def test_awkward_rows(spark):
    docs = cases.table(spark).selectExpr("*", "1 as code", "2 as shares", "3 as keep")
    got = op.assess(docs).collect()
    assert len(got) == len(cases.rows())
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert op.assess(docs.limit(0)).count() == 0
    again = {(r.doc_id, r.score) for r in op.assess(docs.repartition(3)).collect()}
    assert all(any(abs(s - r.score) < 1e-3 for i, s in again if i == r.doc_id) for r in got)


def test_sample_is_bounded_and_of_distinct_rows(spark):
    """Half the rows are empty and a quarter are one text; the sample holds ``size`` distinct rows, whatever repeats."""
    texts = [(i, cases.sentence(random.Random(i), 20)) for i in range(500)]
    data = texts + [(None, None)] * 500 + [(600 + i, "") for i in range(500)] + [(None, "the very same text")] * 500
    docs = spark.createDataFrame(data, "doc_id long, text string")
    voted = op.vote(docs).cache()
    for size in (50, 400, 5000):
        codes, shares = op.sample(docs, voted, len(data), size)
        assert len(codes) == len(shares) == min(size, 1002)
    copies = spark.createDataFrame([(None, "one text")] * 3000 + [(1, "another text")], "doc_id long, text string")
    assert len(op.sample(copies, op.vote(copies), 3001, 10)[0]) == 2


def test_scores_from_the_fitted_weights(spark):
    """The same label model and scorer, text by text."""
    rows = [(i, t) for i, t, _ in corpus(120)] + [(900, None), (901, ""), (902, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in op.assess(docs).collect()}
    ballots = {i: op.votes((t or "").encode()) for i, t in rows}
    kinds = sorted({op.code(b) for b in ballots.values()})
    counts = np.array([sum(op.code(b) == k for b in ballots.values()) for k in kinds])
    _, prior, post = weak.accuracies(op.ballots(np.array(kinds)), counts)
    posterior = dict(zip(kinds, post, strict=True))
    codes, shares = op.sample(docs, op.vote(docs), len(rows), op.SAMPLE_DOCS)
    weights, bias = op.fit(np.concatenate((shares, op.structure(codes)), axis=1), np.array([posterior[c] for c in codes.tolist()]))
    for i, t in rows:
        data = (t or "").encode() + b"\0\0"
        # The last two windows are padding alone.
        windows = [data[j : j + 3].ljust(3, b"\0") for j in range(len(data))]
        total = sum(float(weights[(int.from_bytes(w, "big") * 2654435761 & 0xFFFFFFFF) >> 32 - op.BITS]) for w in windows) * op.SCALE / (len(data) + op.HALF)
        told = sum(float(weights[(1 << op.BITS) + j]) for j, v in enumerate(ballots[i]) if v == 1) + sum(float(weights[(1 << op.BITS) + len(op.HEURISTICS) + j]) for j, v in enumerate(ballots[i]) if v == 2)
        p = 1 / (1 + np.exp(-np.clip(total + told + bias + np.log(prior / (1 - prior)), -30, 30)))
        assert got[i].posterior == posterior[op.code(ballots[i])]
        assert abs(got[i].score - p) < 1e-5, i


def test_scores_do_not_depend_on_the_next_text():
    some = [b"Plain words", b"", b"x", b"\xc3\xa9nd"]
    codes, starts, lengths = op.trigrams(some)
    for t, at, n in zip(some, starts, lengths, strict=True):
        assert codes[at : at + n].tolist() == op.trigrams([t])[0].tolist()
