"""Spelling variants: words one edit apart, from dictionaries sorted forwards and backwards.

One edit leaves a half of the word intact. So the words stand in two dictionaries, sorted from their beginnings and from their ends, once for each length ``m`` that the shorter
of two words may have: those that share their first, or their last, ``m // 2`` code points are one block, a range of the dictionary. A
pass over the sorted ranges compares the words of each block; one that holds more than ``BLOCK`` words is cut again
instead: of what is not shared yet, one edit leaves a half intact too. That ends where one code point is left,
and there the alphabet bounds a block. Nothing is left out, and no block is ever paired off beyond ``BLOCK`` words.

Each pair is reported in one block alone: from the common prefix of two words follows on which side each cut leaves
them together, the front first; a block reports the pairs whose way leads to it.

Defined cases: null or empty text has no words; very long texts are read whole, and words of any length take part; of near words of
equal counts the least in code-point order is the form; repeated rows count each; a null ``doc_id`` is spelled empty where it is
hashed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, release, shuffle_partitions, slices, texts, texts_of

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One word in so many, by document, has a code point taken out by the contract.
DAMAGED = 199
#: Words of a block that are compared with each other; larger ones are cut again.
BLOCK = 64
#: Distinct words whose counts a task sums up before it passes them on; pairs that are verified at once; longest words that are verified in one array.
SUMS, AT_ONCE, WIDE = 1 << 18, 1 << 18, 128


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGED) -> DataFrame:
    """(word, n): distinct words of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more. ``damage`` of 0 leaves words as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(data.lower().decode("utf-8", "replace"))).items():
                    if len(word) < LEAST_LENGTH:
                        continue
                    if damage and (h := zlib.crc32(word.encode(), start)) % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    sums[word] += n
                if len(sums) >= SUMS:
                    yield made()
                    sums.clear()
        if sums:
            yield made()

    return texts(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


BLOCKS = ("m", "p", "s", "way", "part")


def blocks(words: DataFrame) -> DataFrame:
    """Each word's places in both dictionaries: (m, p, s, way, part, word, n), ``part`` being the p first and s last code points that a block of words of lengths m and m + 1 shares; ``way`` has a bit for each cut so far after a leading 1, which is set where the front is shared."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1))
    half = F.floor(F.col("m") / 2).cast("int")
    cuts = F.explode(F.array(F.struct(half.alias("p"), F.lit(0).alias("s"), F.lit(3).cast("long").alias("way")), F.struct(F.lit(0).alias("p"), half.alias("s"), F.lit(2).cast("long").alias("way"))))
    return _placed(words.select("word", "n", lengths.alias("m")).filter(F.col("m") >= LEAST_LENGTH).select("word", "n", "m", cuts.alias("c")))


def finer(rows: DataFrame) -> DataFrame:
    """The two places of a word of a block that is cut again."""
    half = F.floor((F.col("m") - F.col("p") - F.col("s")) / 2).cast("int")
    cuts = F.explode(F.array(F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), (2 * F.col("way") + 1).alias("way")), F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s"), (2 * F.col("way")).alias("way"))))
    return _placed(rows.select("word", "n", "m", cuts.alias("c")))


def _placed(rows: DataFrame) -> DataFrame:
    p, s = F.col("c.p"), F.col("c.s")
    part = F.concat(F.substring(F.col("word"), F.lit(1), p), F.substring(F.col("word"), F.length("word") - s + 1, s))
    return rows.select("m", p.alias("p"), s.alias("s"), F.col("c.way").alias("way"), part.alias("part"), "word", "n")


def edit_at(a: str, b: str) -> int:
    """How long the common prefix of two words is that one edit tells apart; else -1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return -1
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return at if b[at + 1 :] == a[at + (len(a) == len(b)) :] else -1


def edits_at(words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for pairs of numbers of words, the shorter one on the left."""
    width = max(map(len, words))
    if width > WIDE:
        return np.array([edit_at(words[i], words[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    points = np.array(words, f"U{width}").view(np.uint32).reshape(-1, width)
    points = np.concatenate([points, np.zeros((len(words), 1), np.uint32)], axis=1)
    x, y = points[left], points[right]
    differ = x != y
    at = differ.argmax(axis=1)
    longer = np.fromiter(map(len, words), np.int64, len(words))
    longer = longer[right] - longer[left]
    shifted = ((x[:, :-1] == y[:, 1:]) | (np.arange(width) < at[:, None])).all(axis=1)
    one = np.where(longer == 0, differ.sum(axis=1) == 1, (longer == 1) & shifted)
    return np.where(one, at, -1)


def on_the_way(m: np.ndarray, way: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether pairs with a common prefix of ``at`` are reported by the block of length m and that way."""
    a, b, own, depth = np.zeros_like(m), np.zeros_like(m), np.ones_like(m), np.floor(np.log2(way)).astype(np.int64)
    for level in range(int(depth.max(initial=0))):
        half = (m - a - b) // 2
        front, on = at >= a + half, level < depth
        a, b = np.where(on & front, a + half, a), np.where(on & ~front, b + half, b)
        own = np.where(on, 2 * own + front, own)
    return own == way


SCANNED = "m int, p int, s int, way long, word string, n long, other string, other_n long"


def scanned(places: DataFrame, most: int = BLOCK) -> DataFrame:
    """Ordered ranges of both dictionaries, block by block: near pairs (word, n, other, other_n), and, with no other, the words of blocks that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCANNED.split(", ")]
        types = (*[pa.int32()] * 3, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        words: list[str] = []
        counts: list[int] = []
        tags: list[tuple[int, int]] = []
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        pairs = 0

        def verified() -> Iterator[pa.RecordBatch]:
            nonlocal words, counts, tags, left, right, pairs
            if pairs:
                i, j = np.concatenate(left), np.concatenate(right)
                at = edits_at(words, i, j)
                own = np.array(tags, np.int64)[i]
                there = np.flatnonzero((at >= 0) & on_the_way(own[:, 0], own[:, 1], at))
                i, j = i[there], j[there]
                text, n = pa.array(words, pa.string()), np.array(counts, np.int64)
                columns = [pa.array(own[there, 0], pa.int32()), *[pa.nulls(len(there), pa.int32())] * 2, pa.array(own[there, 1]), text.take(pa.array(i)), pa.array(n[i]), text.take(pa.array(j)), pa.array(n[j])]
                yield pa.RecordBatch.from_arrays(columns, names)
            words, counts, tags, left, right, pairs = [], [], [], [], [], 0

        def compare(block: tuple, held: list[tuple[str, int]]) -> None:
            """Each word of length m against each later one of that length and each longer one."""
            nonlocal pairs
            held.sort(key=lambda x: len(x[0]))
            short, start = sum(len(w) == block[0] for w, _ in held), len(words)
            i, j = np.triu_indices(len(held), 1)
            these = i < short
            if these.any():
                words.extend(w for w, _ in held)
                counts.extend(n for _, n in held)
                tags.extend([(block[0], block[3])] * len(held))
                left.append(i[these] + start)
                right.append(j[these] + start)
                pairs += int(these.sum())

        block, held, large = None, [], False
        for batch in batches:
            again: list[tuple] = []
            for *key, word, n in zip(*(batch.column(c).to_pylist() for c in (*BLOCKS, "word", "n")), strict=True):
                if key != block:
                    if held:
                        compare(block, held)
                    block, held, large = key, [], False
                    if pairs >= AT_ONCE:
                        yield from verified()
                held.append((word, n))
                m, p, s, way, _ = key
                if (large or len(held) > most) and m - p - s > 1:
                    again += [(m, p, s, way, w, k, None, None) for w, k in held]
                    held, large = [], True
            if again:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*again, strict=True), types, strict=True)], names)
        if held:
            compare(block, held)
        yield from verified()

    dealt = places.repartitionByRange(shuffle_partitions(places.sparkSession), *BLOCKS).sortWithinPartitions(*BLOCKS)
    return dealt.mapInArrow(run, SCANNED)


def near_pairs(words: DataFrame, most: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, other, other_n) of all pairs of ``words`` (word, n) that one edit tells apart, each once; and the written tables that it reads."""
    written = [materialize(scanned(blocks(words), most), "blocks")]
    while not (rest := written[-1].filter("other is null")).isEmpty():
        written.append(materialize(scanned(finer(rest), most), "finer-blocks"))
    pairs = None
    for level in written:
        own = level.filter("other is not null").select("word", "n", "other", "other_n")
        pairs = own if pairs is None else pairs.unionByName(own)
    return pairs, written


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, two steps, then four, and so on. Counts grow along the way, so it ends."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        next_ = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        joined = materialize(now.join(next_, now["root"] == next_["via"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        release(now)
        now = joined
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, most: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``words`` (distinct word, n): form, root, n, n_near, form_n."""
    pairs, written = near_pairs(words, most)
    ways = F.explode(F.array(F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    each = pairs.select(ways.alias("w")).select("w.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")).withColumnRenamed("word", "b_word")
    judged = words.join(best, words["word"] == best["b_word"], "left").withColumn("form_n", F.when(-F.col("best.minus") >= ratio * F.col("n"), -F.col("best.minus")))
    judged = materialize(judged.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "variants")
    release(*written)
    last = roots(judged.filter("form is not null")).withColumnRenamed("word", "r_word")
    return judged.join(last, judged["word"] == last["r_word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op12 over the whole of ``documents``."""
    return variants(materialize(counted(documents(spark, sf_dir)), "words"))


ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= {LEAST_LENGTH} GROUP BY 1, 2),
spelled AS (SELECT w, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS b FROM runs),
hashed AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, b), lambda c, b: xor(c >> 8, crc.t[((xor(c, b) & 255) + 1)::INT])), 4294967295) AS h FROM spelled, crc),
made AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
one_way AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT * FROM one_way UNION SELECT near, near_n, word, n FROM one_way UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, min({{'minus': -near_n, 'near': near}}) AS best FROM near GROUP BY 1),
judged AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.minus >= {RATIO} * w.n THEN b.best.near END AS form, CASE WHEN -b.best.minus >= {RATIO} * w.n THEN -b.best.minus END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
ways AS (SELECT word, word AS reached, 0 AS depth FROM judged UNION ALL SELECT ways.word, j.form, depth + 1 FROM ways JOIN judged j ON ways.reached = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, depth) AS root FROM ways GROUP BY 1)
SELECT j.word, j.form, l.root, j.n::BIGINT AS n, j.n_near::BIGINT AS n_near, j.form_n::BIGINT AS form_n FROM judged j JOIN ends l ON j.word = l.word
"""
