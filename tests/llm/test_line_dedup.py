import random
import re
from collections import defaultdict

from latticework.llm import line_dedup as op

from . import cases


def masked(line):
    return tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))


def plain(line):
    words = masked(line)
    if words:
        yield line
        if "<*>" in words and 2 * sum(w != "<*>" for w in words) >= len(words):
            yield words


def runs(w):
    edges = [2 + (len(w) - 2) * i // 16 for i in range(17)]
    return [w[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def leaf_firsts(lists):
    """{words: least document} of the lists of recurring leaf templates; ``lists`` has the documents of each list."""
    nodes, anchored, out = defaultdict(set), defaultdict(set), {}
    of = lambda w, j: (len(w), w[:2], j, tuple(runs(w)[4 * j : 4 * j + 4]))
    deep = [w for w in lists if len(w) >= 4 and 2 * sum(x != "<*>" for x in w) >= len(w)]
    parts = lambda w: [j for j in range(4) if any(runs(w)[4 * j : 4 * j + 4])]
    for w in deep:
        for j in parts(w):
            nodes[of(w, j)].add(w)
    for w in deep:
        good = [(len(nodes[of(w, j)]), -j) for j in parts(w) if len(nodes[of(w, j)]) > 1 and len(set().union(*(lists[x] for x in nodes[of(w, j)]))) > 1]
        if good:
            anchored[of(w, -max(good)[1])].add(w)
    for node, ws in anchored.items():
        if len(ws) < 2:
            continue
        template = {}
        for p in range(16):
            for x in {runs(w)[p] for w in ws}:
                if 2 * sum(runs(w)[p] == x for w in ws) > len(ws):
                    template[p] = x
        if 2 + sum(map(len, template.values())) < 0.75 * node[0]:
            continue
        fits = [w for w in ws if all(runs(w)[p] == x for p, x in template.items())]
        docs = set().union(*(lists[w] for w in fits)) if fits else set()
        if len(docs) > 1:
            out |= {w: min(docs) for w in fits}
    return out


def brute(rows):
    where, lists = defaultdict(set), defaultdict(set)
    for doc, text in rows:
        d = op.LAST_ID if doc is None else doc
        for line in (text or "").split("\n"):
            for k in plain(line):
                where[k].add(d)
            lists[masked(line)].add(d)
    firsts = leaf_firsts(lists)
    for doc, text in rows:
        d = op.LAST_ID if doc is None else doc
        lines = (text or "").split("\n")
        kept = [x for x in lines if not any(min(where[k]) < d for k in plain(x)) and firsts.get(masked(x), d) >= d]
        yield doc, "\n".join(kept), len(lines), len(lines) - len(kept)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    notices = [cases.sentence(rng, rng.randint(3, 30)) for _ in range(8)]
    long = cases.sentence(rng, 60)
    for i in range(n):
        lines = [cases.sentence(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        for notice in rng.sample(notices, 2):
            words = notice.split()
            if rng.random() < 0.4:
                words[-1] = f"{rng.randrange(10**6)}"
            if rng.random() < 0.3 and len(words) > 12:
                words[len(words) // 2] = f"x{rng.choice('abcdef')}"
            lines.insert(rng.randint(0, len(lines)), " ".join(words))
        if i % 40 == 7:
            lines.append(long)
        yield i, "\n".join(lines)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "'x' as line", "2 as tie", "3 as leaf", "4 as n", "5 as runs")
    got = sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in op.drop_lines(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    return got


def test_against_brute_force(spark):
    got = check(spark, list(corpus()))
    assert sum(r[3] for r in got) > 100


def test_awkward_rows(spark):
    same = "the very same line of words stands here"
    rows = [r[:2] for r in cases.rows()] + [(700, same), (701, same + "\n" + same), (None, same), (702, "short line here"), (703, "short line here"), (704, "1 2 3 4 5 6 7 8 9"), (705, "2 3 4 5 6 7 8 9 1")]
    got = {r[0]: r for r in check(spark, rows)}
    assert got[700][3] == 0 and got[701][3] == 2
    assert got[703][3] == 1 and got[705][3] == 0  # short lines recur too; a line of nothing but fields doesn't, unless it is the same
    assert op.drop_lines(cases.table(spark).limit(0)).count() == 0


def test_planted_passages_go_and_clean_lines_stay(spark):
    rows = list(corpus())
    long = next(t.split("\n")[-1] for i, t in rows if i == 7)
    got = {r[0]: r[1] for r in check(spark, rows)}
    assert [i for i in got if long in got[i]] == [7]
    clean = [(i, cases.sentence(random.Random(i), 80)) for i in range(100)]
    assert all(r[3] == 0 for r in check(spark, clean))


def test_leaves_generalise_any_field(spark):
    """Names, places and numbers change in three of four runs; the template is found, and lines that merely share its beginning stay."""
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"Session opened for user {name()} from the host {name()} by the usual daemon after {rng.randrange(99)} tries in {name()} mode today") for i in range(40)]
    rows += [(100 + i, "Session opened " + " ".join(name() for _ in range(17))) for i in range(40)]
    rows += [(200 + i, f"{name()}\nThe end {i}\n" + rows[3][1].split(" by ")[0]) for i in range(5)]
    got = {r[0]: r for r in check(spark, rows)}
    assert [got[i][3] for i in range(40)] == [0] + [1] * 39
    assert all(got[100 + i][3] == 0 for i in range(40))


def test_dropped_lines_are_found_by_halving(spark):
    values = sorted(random.Random(1).sample(range(-(10**9), 10**9), 100))
    for n in (0, 1, 2, 3, 7, 8, 100):
        some = values[:n]
        frame = spark.createDataFrame([(x, some) for x in [*values, 10**10, -(10**10)]], "x long, o array<long>")
        assert all(r.hit == (r.x in some) for r in frame.select("x", op._listed(op.F.col("x"), op.F.col("o")).alias("hit")).collect())


def test_sql_against_brute_force(spark):
    import duckdb
    import pandas as pd

    rows = list(corpus(seed=8, n=200))
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = connection.execute(op.ORACLE).fetchall()
    assert sorted(r[:3] for r in got) == sorted((d, n, k) for d, _, n, k in brute(rows))


def test_short_lines_generalise_by_the_same_rule(spark):
    """Bylines of five words, menu lines of four; two leading words and one of two others are three quarters, one of three is not."""
    names = "Ada Ben Cleo Dan Eve Finn Gus Hal".split()
    data = [(i, f"Posted by {n} in News\nGo to {n} page\nMade for {n} near {n}") for i, n in enumerate(names)]
    got = {r.doc_id: r.text for r in op.drop_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[0] == data[0][1]
    assert all(got[i] == f"Made for {n} near {n}" for i, n in enumerate(names) if i)
