"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per document:

* the text: naive Bayes models over hashed byte trigrams, fitted on the distinct texts of each declared language or a bounded sample of them,
* the declared language (the ``lang`` attribute of markup, or a column): how often each declaration goes with each language,
* the address suffix (``de`` of ``example.de``): the same for suffixes,
* the host: a prior that is smoothed from the whole corpus to the domain to the host.

The last three are counts of text-only posteriors over all documents by grouped aggregation, joined back on their keys, and each
document's own share is taken out before they are applied to it. Texts fall into two halves by their hash, and each half is scored by models that the other one taught: no text, nor a copy of it, judges itself.

A declared value is a language if the halves of its texts know each other: under the other half's model a trigram has to gain ``LEARNT`` on average over a model in which all are alike, however many or few there are. Letters at random, in words, gain
0.8 at most, from millions of trigrams, and less from fewer.
The models, and what is carried along for each document, grow with these languages, not with what else is declared. A document is accepted if the fused posterior reaches ``LEAST`` and its text reads like some language: its mean gain has to
lie nearer to that of the language's own texts than to that of letters at random. Where the declared value is a language, whose models the document's like may have taught, it has to lie ``NEAR`` of the way; what declares no language, or nothing, has
taught nothing and needs ``FAR`` of it. ``DOUBT`` is what a text's trigrams have to say in all before they count against it.

Defined cases: null or empty text has no text evidence and is not accepted; very long texts are read whole, a text at a time where one exceeds ``AT_ONCE``; null declaration, address or host
contribute nothing; ties go to the commoner language, then the lesser name; rows that repeat are judged each; where declared values are there but none of them is a language, letters are enough; without any
declared value in the table nothing is accepted; an empty table gives an empty result; further columns are kept by :func:`accepted` and ignored by
:func:`identify`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices, small_batches, texts_of

BITS = 14
#: Rows of each declared value that the text model is fitted on: all up to this many, about as many of a commoner one, whose texts have the least hashes.
SAMPLE_ROWS = 20_000
#: The least mean gain, in nats a trigram, of a language's texts.
LEARNT = 1.5
#: Where between the two a text's gain has to lie, and the nats that a whole text may fall short of that.
NEAR, FAR, DOUBT = 0.7, 0.4, 8.0
#: Added to each trigram's count.
SMOOTH = 0.02
#: Entries of a task's counts before it passes them on.
SUMS = 1 << 20
#: Trigrams overlap and are no independent evidence; their log-likelihood is scaled by this.
TEMPER = 0.2
#: Weight, in documents, of a level's parent.
STRENGTH = 8.0
LEAST = 0.5
AT_ONCE = 1 << 20
MARKUP = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})"
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


#: Bytes that tell of a language: letters, all of UTF-8 beyond ASCII, white space.
TELLING = np.array([chr(b).isalpha() or b >= 128 or b in b" \t\n\x0b\x0c\r" for b in range(256)])
NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
#: What a trigram scores in no language at all; trigrams with digits or signs have code 0 and score this in every language.
NEUTRAL = float(np.float32(-BITS * np.log(2)))


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and where each text's begin. Two spaces end each text; what begins at these would see the next text and is code 0."""
    joined = np.frombuffer(b"".join([t.lower() + b"  " for t in texts]) + b"  ", np.uint8).astype(np.uint32)
    three = (joined[:-2] << np.uint32(16)) | (joined[1:-1] << np.uint32(8)) | joined[2:]
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    telling = TELLING[joined]
    three = np.where(telling[:-2] & telling[1:-1] & telling[2:], three, np.uint32(0))
    ends = np.cumsum(lengths)
    three[np.concatenate((ends - 2, ends - 1))] = 0
    return (three * np.uint32(2654435761)) >> np.uint32(32 - BITS), np.concatenate(([0], ends[:-1])).astype(np.int64)


def evidence(docs: DataFrame, text: Column, declared: Column | None = None, address: Column | None = None, host: Column | None = None) -> DataFrame:
    """(doc_id, text, declared, host, domain, suffix): what the fusion reads. Hosts that are no dotted names are their own domain."""
    none = F.lit(None).cast("string")
    site = F.lower(F.regexp_extract(address, HOST, 1)) if address is not None else none
    site = F.coalesce(F.when(site != "", site), host.cast("string") if host is not None else none)
    frame = docs.select("doc_id", text.cast("string").alias("text"), (F.lower(declared.cast("string")) if declared is not None else none).alias("declared"), site.alias("host"))
    dotted = F.col("host").rlike(r"^[^.]+(\.[^.]+)+$")
    return frame.withColumn("domain", F.when(dotted, F.substring_index("host", ".", -2)).otherwise(F.col("host"))).withColumn("suffix", F.when(dotted, F.substring_index("host", ".", -1)))


def trigrams(frame: DataFrame, sample_rows: int) -> DataFrame:
    """(declared, half, code, n): trigrams of the distinct texts of each declared value, or of about ``sample_rows`` rows of a commoner one."""
    own = frame.filter("declared is not null and declared <> ''").withColumn("key", text_key())
    # The commoner values only, at most one for so many rows, in a written table: Spark knows its size, and texts stay where they are.
    common = own.groupBy("declared").count().filter(F.col("count") > sample_rows)
    common = materialize(common.select(F.col("declared").alias("d"), (sample_rows / F.col("count") * float(1 << 62)).alias("below")), "common", most_rows=1)
    sample = own.join(common, own["declared"] == common["d"], "left").filter(F.col("below").isNull() | (F.shiftrightunsigned("key", 2).cast("double") <= F.col("below")))
    once = sample.groupBy("key", "declared").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], int] = {}

        def made() -> pa.RecordBatch:
            names, numbers = zip(*sums, strict=True)
            both = np.array(numbers, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array((both >> BITS).astype(np.int32)), pa.array((both & (1 << BITS) - 1).astype(np.int32)), pa.array(list(sums.values()), pa.int64())], ["declared", "half", "code", "n"])

        for batch in batches:
            for part in slices([batch], "text", AT_ONCE):
                code, starts = codes(texts_of(part.column("text")))
                owner = np.searchsorted(starts, np.arange(len(code)), side="right") - 1
                keys, names = np.array(part.column("key").to_pylist(), np.int64), part.column("declared").to_pylist()
                numbered = {x: i for i, x in enumerate(dict.fromkeys(names))}
                spelled = list(numbered)
                kinds = np.array([numbered[x] for x in names], np.int64) << 1 | keys & 1
                both, n = np.unique(kinds[owner] << BITS | code, return_counts=True)
                for k, v in zip(both.tolist(), n.tolist(), strict=True):
                    if k & (1 << BITS) - 1:
                        place = (spelled[k >> BITS + 1], k & (2 << BITS) - 1)
                        sums[place] = sums.get(place, 0) + v
            if len(sums) >= SUMS:
                yield made()
                sums.clear()
        if sums:
            yield made()

    found = once.mapInArrow(count, "declared string, half int, code int, n long")
    return materialize(found.groupBy("declared", "half", "code").agg(F.sum("n").alias("n")), "trigrams")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fit(frame: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray, bool]:
    """The languages; log P(trigram | language) as [half that is scored, language, trigram]; of each [half, language] the mean gain of its texts and of letters at random; and whether anything is declared."""
    counts = trigrams(frame, sample_rows)
    size = float((1 << BITS) - 1)
    totals = counts.groupBy("declared").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"all{h}") for h in (0, 1)]).withColumnRenamed("declared", "d")
    paired = counts.groupBy("declared", "code").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)])
    joined = paired.join(totals, paired["declared"] == totals["d"])
    gain = [F.log((F.col(f"n{1 - h}") + SMOOTH) / (F.col(f"all{1 - h}") + SMOOTH * size)) - NEUTRAL for h in (0, 1)]
    nothing = [F.log(SMOOTH / (F.first(f"all{1 - h}") + SMOOTH * size)) - NEUTRAL for h in (0, 1)]
    # Of letters at random every trigram is as likely; those that the other half doesn't know count too.
    known = [F.sum(F.when(F.col(f"n{1 - h}") > 0, gain[h])) for h in (0, 1)]
    absent = [size - F.count_if(F.col(f"n{1 - h}") > 0) for h in (0, 1)]
    each = joined.groupBy("declared").agg(
        *[F.coalesce(F.sum(F.col(f"n{h}") * gain[h]) / F.greatest(F.lit(1), F.first(f"all{h}")), F.lit(0.0)).alias(f"own{h}") for h in (0, 1)],
        *[((F.coalesce(known[h], F.lit(0.0)) + absent[h] * nothing[h]) / size).alias(f"any{h}") for h in (0, 1)],
        (F.first("all0") + F.first("all1")).alias("n"),
        F.least(F.first("all0"), F.first("all1")).alias("less"),
    )
    each = materialize(each, "gains")
    learnt = each.filter((F.col("less") > 0) & (F.least("own0", "own1") >= LEARNT)).orderBy(F.desc("n"), "declared").collect()
    names = [r["declared"] for r in learnt]
    number = {x: i for i, x in enumerate(names)}
    model = np.full((2, len(names), 1 << BITS), SMOOTH)
    if names:
        chosen = each.join(counts.select(F.col("declared").alias("d"), "half", "code", "n"), F.col("d") == F.col("declared")).filter(F.col("declared").isin(names))
        for r in chosen.select("declared", "half", "code", counts["n"]).toLocalIterator():
            model[1 - r["half"], number[r["declared"]], r["code"]] += r["n"]
    model[:, :, 0] = 0
    model = np.log(np.maximum(model, 1e-9) / model.sum(axis=2, keepdims=True))
    model[:, :, 0] = NEUTRAL
    gains = np.array([[[r[f"own{h}"], r[f"any{h}"]] for r in learnt] for h in (0, 1)]).reshape(2, len(names), 2)
    return names, model.astype(np.float32), gains, not each.isEmpty()


def score(frame: DataFrame, names: list[str], model: np.ndarray, gains: np.ndarray) -> DataFrame:
    """Text evidence per document: scaled log-likelihoods, the text-only posterior q, and whether the text reads like any language."""
    n_languages, known = len(names), set(names)
    own, anything = gains[:, :, 0], gains[:, :, 1]
    least = np.stack([anything + share * (own - anything) for share in (FAR, NEAR)])  # by whether the declared value is a language, half, language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            texts = texts_of(batch.column("text"))
            halves = np.array(batch.column("key").to_pylist(), np.int64) & 1
            sums, telling = np.zeros((len(texts), n_languages)), np.zeros(len(texts), np.int64)
            for h in (0, 1):
                if len(these := np.flatnonzero(halves == h)):
                    code, starts = codes([texts[i] for i in these])
                    sums[these] = np.stack([np.add.reduceat(row[code], starts, dtype=np.float64) for row in model[h]], axis=1)
                    telling[these] = np.add.reduceat((code != 0).astype(np.int64), starts)
            lengths = np.array([len(t) for t in texts], np.int64)
            lettered = np.array([len(t.translate(None, NO_LETTER)) > 0 for t in texts], bool)
            taught = np.array([x in known for x in batch.column("declared").to_pylist()], np.int64)
            gain = sums - (lengths + 2)[:, None] * NEUTRAL
            spoken = lettered & ((gain - telling[:, None] * least[taught, halves] > -DOUBT).any(axis=1) | (telling == 0))
            scaled = np.where(lengths[:, None] > 0, TEMPER * (sums - sums.max(axis=1, keepdims=True)), 0.0)
            q = np.exp(scaled)
            q /= q.sum(axis=1, keepdims=True)
            q[lengths == 0] = 0
            same = [batch.column(c) for c in ("doc_id", "key", "declared", "host", "domain", "suffix")]
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (scaled, q)]
            yield pa.RecordBatch.from_arrays([*same, *lists, pa.array(spoken, pa.bool_())], ["doc_id", "key", "declared", "host", "domain", "suffix", "loglik", "q", "spoken"])

    keyed = frame.select("doc_id", text_key().alias("key"), "text", "declared", "host", "domain", "suffix")
    return keyed.mapInArrow(run, "doc_id long, key long, declared string, host string, domain string, suffix string, loglik array<double>, q array<double>, spoken boolean")


def _counts(scored: DataFrame, key: str, n: int) -> DataFrame:
    """(key, counts): the sum of the text-only posteriors of all documents that share the key."""
    sums = F.array(*[F.sum(F.col("q")[i]) for i in range(n)])
    return scored.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"k_{key}")).agg(sums.alias(f"n_{key}"))


def identify(frame: DataFrame, sample_rows: int = SAMPLE_ROWS, least: float = LEAST) -> DataFrame:
    """One row per row of ``frame`` (see :func:`evidence`): doc_id, key (a hash of the text), lang, p, text_lang, declared, accepted."""
    result = "doc_id long, key long, lang string, p double, text_lang string, declared string, accepted boolean"
    small_batches(frame.sparkSession)
    names, model, gains, declared = fit(frame, sample_rows)
    if not names:
        # No value can be told from letters at random: where any is declared, letters are enough.
        enough = F.lit(declared) & F.coalesce(F.col("text").rlike(r"[\p{L}\x{80}-\x{10FFFF}]"), F.lit(False))
        return frame.select(F.col("doc_id").cast("long"), text_key().alias("key"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("p"), F.lit(None).cast("string").alias("text_lang"), "declared", enough.alias("accepted"))
    scored = materialize(score(frame, names, model, gains), "scored")
    n = len(names)
    total = np.array(scored.agg(*[F.coalesce(F.sum(F.col("q")[i]), F.lit(0.0)) for i in range(n)]).first(), float)
    known = F.when(F.col("declared").isin(names), F.col("declared"))
    joined = scored.withColumn("declared_known", known)
    keys = ("declared_known", "suffix", "domain", "host")
    for key in keys:
        # Written, so that Spark knows its size: small tables are broadcast and the documents stay where they are.
        own = materialize(_counts(scored.withColumn("declared_known", known), key, n), f"per-{key}")
        joined = joined.join(own, joined[key] == own[f"k_{key}"], "left")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(-total, kind="stable")  # ties go to the commoner language
        for batch in batches:
            rows = batch.num_rows

            def matrix(c: str) -> np.ndarray:
                lists = batch.column(c)
                out, there = np.zeros((rows, n)), lists.is_valid().to_numpy(zero_copy_only=False)
                out[there] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                return out

            has = {c: batch.column(c).is_valid().to_numpy(zero_copy_only=False)[:, None] for c in keys}
            q, loglik = matrix("q"), matrix("loglik")
            rest = total[None, :] - q
            prior = (rest + 1) / (rest + 1).sum(axis=1, keepdims=True)
            globally = prior
            one = pc.fill_null(pc.equal(batch.column("domain"), batch.column("host")), False).to_numpy(zero_copy_only=False)
            for key in ("domain", "host"):
                others = np.maximum(matrix(f"n_{key}") - q, 0) * has[key]
                finer = (others + STRENGTH * prior) / (others.sum(axis=1, keepdims=True) + STRENGTH)
                prior = np.where(one[:, None], prior, finer) if key == "host" else finer
            fused = loglik + np.log(prior)
            for key in ("declared_known", "suffix"):
                # P(key | language) up to a factor that is the same for all languages: P(language | key) / P(language).
                others = np.maximum(matrix(f"n_{key}") - q, 0)
                given = (others + STRENGTH * globally) / (others.sum(axis=1, keepdims=True) + STRENGTH)
                fused += np.where(has[key], np.log(given / globally), 0.0)
            fused -= fused.max(axis=1, keepdims=True, initial=-np.inf) if rows else 0
            p = np.exp(fused)
            p /= p.sum(axis=1, keepdims=True)
            best, by_text = (order[np.argmax(x[:, order], axis=1)] for x in (p, loglik))
            top = p[np.arange(rows), best]
            spoken = np.array(batch.column("spoken").to_pylist(), bool)
            columns = [batch.column("doc_id"), batch.column("key"), pa.array([names[i] for i in best], pa.string()), pa.array(top, pa.float64()), pa.array([names[i] if s else None for i, s in zip(by_text, spoken, strict=True)], pa.string()), batch.column("declared"), pa.array(spoken & (top >= least), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in result.split(", ")])

    columns = ["doc_id", "key", "declared", "declared_known", "host", "domain", "suffix", "loglik", "q", "spoken", *(f"n_{k}" for k in keys)]
    return joined.select(*columns).mapInArrow(fuse, result)


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence of ``documents``: markup in the text declares, else the lang column; the source is the host."""
    markup = F.when(F.col("text").contains("<") & F.col("text").rlike("(?i)<html"), F.regexp_extract("text", MARKUP, 1))
    return evidence(docs.withColumn("doc_id", F.col("doc_id").cast("long")), F.col("text"), F.coalesce(F.when(markup != "", markup), F.col("lang")), None, F.col("source"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence of ``pages``, under doc_id: the text between tags, the lang attribute, the address."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    declared = F.regexp_extract("html", MARKUP, 1)
    return evidence(pages.withColumn("doc_id", F.col("page_id").cast("long")), plain, F.when(declared != "", declared), F.col("url"))


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are rejected, all columns as they were."""
    found = identify(of_documents(docs))
    gone = materialize(found.groupBy("doc_id", "key").agg(F.max("accepted").alias("any")).filter("not any").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")), "rejected", most_rows=docs.count())
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_key"])
    return docs.join(gone, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op10 over the whole of ``documents``."""
    return identify(of_documents(documents(spark, sf_dir))).select("doc_id", "lang", "p", "text_lang", "declared", "accepted")


def query_pages(spark, sf_dir: str) -> DataFrame:
    """The same operator over the whole of ``pages``, whose markup and addresses bear witness too."""
    found = identify(of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.select(F.col("doc_id").alias("page_id"), "lang", "p", "text_lang", "declared", "accepted")
